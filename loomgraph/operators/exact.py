"""Sums that do not depend on the order or the partitioning of their rows.

A double is split into whole numbers over fixed powers of two. Whole numbers add
up without rounding, so any grouping of rows, any number of partitions and any
task that is run again give the same bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Powers of two that the parts of a single number count, 40 bits each: up to 2**120, down to 2**-120.
BITS, POWERS = 40, (-80, -40, 0, 40, 80, 120)
#: The same for vectors in numpy: three parts of 32 bits hold entries below 2**31 down to 2**-64, over two thousand million rows.
VECTOR_BITS, VECTOR_POWERS = 32, (0, 32, 64)


def exact_sum(x: Column) -> Column:
    """An aggregate: the sum of ``x``, whatever the order. Nulls are left out; what lies below 2**-120 is rounded off number by number.

    Numbers from 2**120 on, infinities and NaN are added the usual way and added to the rest.
    """
    x = x.cast("double")
    small = F.abs(x) < F.lit(2.0**120)
    y = F.when(small, x)
    total = F.lit(0.0)
    for k in reversed(range(len(POWERS))):
        part = F.rint(y * F.lit(2.0 ** POWERS[k]))
        if k:  # less what the part above has taken, which is a difference without rounding
            part = part - F.rint(y * F.lit(2.0 ** POWERS[k - 1])) * F.lit(2.0**BITS)
        total = total + F.coalesce(F.sum(part.cast("long").cast("decimal(20,0)")).cast("double"), F.lit(0.0)) * F.lit(2.0 ** -POWERS[k])
    rest = F.sum(F.when(~small, x))
    return F.when(F.count(x) > 0, F.when(rest.isNull(), total).otherwise(total + rest))


def exact_avg(x: Column) -> Column:
    return exact_sum(x) / F.count(x)


def split(x: np.ndarray) -> np.ndarray:
    """Whole-number parts of an array, along a new last axis."""
    out = np.empty((*x.shape, len(VECTOR_POWERS)), np.int64)
    before = np.zeros_like(x)
    for k, power in enumerate(VECTOR_POWERS):
        now = np.rint(x * 2.0**power)
        out[..., k] = now - before * 2.0**VECTOR_BITS
        before = now
    return out


def join(parts: np.ndarray) -> np.ndarray:
    """The numbers of added parts, the smallest first."""
    out = np.zeros(parts.shape[:-1])
    for k in reversed(range(len(VECTOR_POWERS))):
        out = out + parts[..., k] * 2.0 ** -VECTOR_POWERS[k]
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths, without nulls, as rows of a matrix; no copy where it is one already."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x).ravel()))


def borders(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where rows begin that differ from the row before in ``keys``, which hold no nulls."""
    differs = np.zeros(max(0, b.num_rows - 1), dtype=bool)
    for k in keys:
        c = b.column(k)
        differs |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(differs) + 1]).astype(np.int64)


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def partial_sums(rows: DataFrame, keys: list[str], vector: str = "vector", weight: str = "weight") -> DataFrame:
    """(keys..., vector, weight, parts, n): of ``weight * vector`` and ``weight`` by key, one row a key for each batch of a task.

    Summed where the rows are, so a key of very many rows leaves few behind. What
    is alone in its batch stays as it is, which is a third of its parts; ``sorted_sums``
    takes it apart. Keys and weights hold no nulls.
    """
    names = [*keys, "vector", "weight", "parts", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, np.int64)
            for k in keys:
                own = pc.dictionary_encode(b.column(k))
                own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
                code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            first = np.concatenate([[0], np.flatnonzero(np.diff(code[order])) + 1])
            n = np.diff(np.append(first, b.num_rows))
            w = b.column(weight).to_numpy()[order]
            x = np.concatenate([matrix(b.column(vector))[order] * w[:, None], w[:, None]], axis=1)
            alone = n == 1
            one, many = x[first[alone]], np.repeat(~alone, n)
            parts = split(x[many])
            if len(parts):
                parts = np.add.reduceat(parts, np.concatenate([[0], np.cumsum(n[~alone])[:-1]]), axis=0)
            kept = [b.column(k).take(pa.array(order[first])) for k in keys]
            load = np.zeros(len(n))
            load[alone] = one[:, -1]
            yield pa.RecordBatch.from_arrays([*kept, _some(one[:, :-1], alone), pa.array(load, mask=~alone), _some(parts.reshape(len(parts), parts.shape[1] * parts.shape[2]), ~alone), pa.array(n)], names)

    cols = [F.col(f"`{k}`") for k in keys]
    plain = rows.select(*cols, F.col(vector).cast("array<double>").alias(vector), F.col(weight).cast("double").alias(weight))
    return plain.mapInArrow(run, f"{_schema(rows, keys)}, vector array<double>, weight double, parts array<long>, n long")


def _some(x: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column that holds them where ``there`` is set and nulls elsewhere."""
    ends = np.cumsum(there, dtype=np.int32) * np.int32(x.shape[1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel()), mask=pa.array(~there))


def _taken_apart(b: pa.RecordBatch) -> np.ndarray:
    """The parts of each row of ``partial_sums``."""
    parts = b.column("parts")
    alone = parts.is_null()
    if not alone.true_count:
        return matrix(parts)
    x = np.concatenate([matrix(b.column("vector").filter(alone)), b.column("weight").filter(alone).to_numpy()[:, None]], axis=1)
    own, at = split(x).reshape(len(x), -1), alone.to_numpy(zero_copy_only=False)
    if at.all():
        return own
    out = np.empty((b.num_rows, own.shape[1]), np.int64)
    out[at], out[~at] = own, matrix(parts.filter(pc.invert(alone)))
    return out


def sorted_sums(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by ``keys``, one row a key: (keys..., parts, n). Only one key's sum goes on from batch to batch."""
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), lists(_taken_apart(b)), b.column("n")], [*keys, "parts", "n"])
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        at = borders(b, keys)
        parts = np.add.reduceat(matrix(b.column("parts")), at, axis=0)
        n = np.add.reduceat(b.column("n").to_numpy(), at)
        kept = [b.column(k).take(pa.array(at)) for k in keys]
        done = pa.RecordBatch.from_arrays([*kept, lists(parts), pa.array(n)], [*keys, "parts", "n"])
        held = done.slice(done.num_rows - 1)
        if done.num_rows > 1:
            yield done.slice(0, done.num_rows - 1)
    if held is not None:
        yield held


def of_parts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums of vectors, sums of weights) of rows with ``parts``."""
    got = join(matrix(b.column("parts")).reshape(b.num_rows, -1, len(VECTOR_POWERS)))
    return got[:, :-1], got[:, -1]


def vector_sums(rows: DataFrame, keys: list[str], vector: str = "vector", weight: str = "weight") -> DataFrame:
    """(keys..., total array<double>, load, n): sums of ``weight * vector`` and of ``weight`` by key, the same bits under any partitioning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sorted_sums(batches, keys):
            total, load = of_parts(b)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), lists(total), pa.array(load), b.column("n")], [*keys, "total", "load", "n"])

    cols = [F.col(f"`{k}`") for k in keys]
    dealt = partial_sums(rows, keys, vector, weight).repartition(*cols).sortWithinPartitions(*cols)
    return dealt.mapInArrow(run, f"{_schema(rows, keys)}, total array<double>, load double, n long")
