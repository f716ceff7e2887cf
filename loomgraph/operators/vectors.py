"""Statistics of embedding tables that need the whole matrix, by its Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products) of ``vectors(embedding)``: d x d numbers a task, summed in Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(0).to_pylist(), dtype=np.float64)
            s = x.sum(0) if s is None else s + x.sum(0)
            g = x.T @ x if g is None else g + x.T @ x
            n += len(x)
        if n:
            d = len(s)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, [-1] * (d + 1))), pa.array(np.concatenate([j, np.arange(d), [-1]])), pa.array(np.concatenate([g.ravel(), s, [n]]))], ["i", "j", "x"])

    rows = vectors.where("embedding is not null").select("embedding").mapInArrow(part, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = max((r.j for r in rows), default=-1) + 1
    s, g, n = np.zeros(d), np.zeros((d, d)), 0
    for r in rows:
        if r.j < 0:
            n = int(r.x)
        elif r.i < 0:
            s[r.j] = r.x
        else:
            g[r.i, r.j] = r.x
    return n, s, g


def effective_rank(vectors: DataFrame) -> DataFrame:
    """(n, effective_rank): the exponential of the entropy of the centred matrix's singular values."""
    n, s, g = gram(vectors)
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(g - np.outer(s, s) / n), 0)) if n else np.zeros(0)
    p = values / values.sum() if values.sum() > 0 else np.zeros(0)
    p = p[p > 1e-15]
    rank = float(np.exp(-(p * np.log(p)).sum())) if len(p) else 0.0
    return vectors.sparkSession.createDataFrame([(n, round(rank, 4))], "n long, effective_rank double")
