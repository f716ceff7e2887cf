"""Toxicity: maximum-scoring segments over token log-odds.

Tokens are runs of letters and digits. A token's weight is its log-odds between
toxic and clean documents under an informative Dirichlet prior, drawn back
towards zero by its standard deviation: what was seen too rarely to tell weighs
nothing, for a toxic token as for a clean one. Tokens without a weight cost a
little. All maximal scoring segments come from one scan, extreme-value statistics of clean
documents turn them into surprise beyond chance, and a logistic curve into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shared import discard, materialize
from loomgraph.llm.textkit import lean, text_chunks, word_hashes

#: The classifier is fitted on at most so many labelled rows, taken by a hash of the id.
FIT_ROWS = 20_000
#: Pseudo-documents of the prior for each document; the least weight that is told from none, and the greatest; the least and the greatest cost of a token between.
PRIOR, LEAST, CAP, GAP, STEEP = 0.02, 0.5, 8.0, 0.1, 1.0
LIMIT = 0.3
#: ASCII letters and digits, and whatever is beyond ASCII, belong to tokens.
PLAIN = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each token, first token of each row and the total); A-Z count as a-z."""
    hashes, _, first = word_hashes(PLAIN[buf], offs)
    return hashes, first


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0
    k: float = 0.1
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def hits(self, buf: np.ndarray, offs: np.ndarray):
        """(row, token in its row, weight, cost of the tokens before it up to the hit before) of each token that tells toxic texts; tokens and cost of each row."""
        key, first = tokens(buf, offs)
        counts = np.diff(first)
        if not len(key) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), counts, counts * GAP
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        weight = np.where(self.keys[i] == key, self.weights[i], 0.0)
        pos = np.flatnonzero(weight > 0)
        paid = np.append(0, np.cumsum(np.where(weight > 0, 0, np.clip(-weight, GAP, STEEP))))
        row = np.searchsorted(first, pos, side="right") - 1
        return row, pos - first[row], weight[pos], np.diff(paid[pos], prepend=0.0), counts, np.diff(paid[first])

    def features(self, place: np.ndarray, weight: np.ndarray, cost: np.ndarray, n: int) -> tuple[float, float]:
        """Surprise of the best passage beyond chance, and the sum over all significant ones."""
        beyond = [self.rate * s - math.log(self.k * max(n, 1)) for _, _, s in segments(place, weight, cost)]
        good = [x for x in beyond if x > 0]
        return max(good, default=0.0), sum(good)

    def score(self, best: float, total: float) -> float:
        z = self.curve[0] + self.curve[1] * math.log1p(best) + self.curve[2] * math.log1p(total)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def segments(place: np.ndarray, weight: np.ndarray, cost: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in one pass.

    ``place`` are the numbers of the tokens with a positive weight, in order;
    ``cost`` is what those between one and the one before take off. The stack
    holds candidates with the sums before and after them; a new one joins those
    that it cannot be parted from.
    """
    out: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total = 0.0
    for last, w, c in zip(place.tolist(), weight.tolist(), cost.tolist()):
        total -= c
        first, left = last, total
        total += w
        right = total
        at = len(out) - 1
        while True:
            while at >= 0 and out[at][2] >= left:
                at -= 1
            if at < 0 or out[at][3] >= right:
                break
            first, left = out[at][0], out[at][2]
            del out[at:]
            at -= 1
        out.append((first, last, left, right))
    return [(a, b, r - x) for a, b, x, r in out]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        toxic = b.column(1).to_numpy(zero_copy_only=False)
        for at, buf, offs in text_chunks(b.column(0)):
            key, first = tokens(buf, offs)
            found: tuple[list, list] = ([], [])
            for r in range(len(offs) - 1):
                found[int(toxic[at + r] == 1)].append(np.unique(key[first[r] : first[r + 1]]))
            for y in (0, 1):
                if found[y]:
                    k, n = np.unique(np.concatenate(found[y]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.full(len(k), y)), pa.array(n)], ["part", "y", "n"])


def weigh(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, weights) of ``rows(text, toxic)``; without rows of both classes there are none."""
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0)
    seen = rows.select("text", "toxic").mapInArrow(lean(_count), "part long, y long, n long")
    per = seen.groupBy("part").agg(F.sum(F.col("n") * F.col("y")).alias("c1"), F.sum(F.col("n") * (1 - F.col("y"))).alias("c0"))
    prior, pseudo = (F.col("c1") + F.col("c0")) * F.lit(PRIOR), PRIOR * (n1 + n0)
    odds = lambda c, total: F.log((F.col(c) + prior) / (F.lit(total + pseudo + 0.5) - F.col(c) - prior))  # a token may be in every document
    weight, deviation = odds("c1", n1) - odds("c0", n0), F.sqrt(1 / (F.col("c1") + prior) + 1 / (F.col("c0") + prior))
    drawn = F.signum(weight) * (F.abs(weight) - deviation)
    best = per.where(F.abs(weight) > deviation + LEAST).select("part", drawn.alias("w")).toArrow()
    keys = best["part"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.minimum(best["w"].to_numpy(), CAP)[order]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from ``labels(doc_id, toxic)``, without the held-out rows.

    Four fifths of the rows give the weights, the others the curve. The weights
    that are not zero and two numbers a document come to the driver, both
    bounded by the texts of ``fit_rows`` documents; the chosen labels, bounded by
    ``fit_rows``, are broadcast. An id with several label rows is toxic if one of them says so; null
    ids and labels are left out. Without rows of both classes, as in empty
    tables, every text scores alike.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("k"))
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    n = known.count()
    share = min(1.0, 0.95 * fit_rows / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(fit_rows)
    rows = materialize(
        docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select(
            "text", "toxic", (F.pmod(F.xxhash64("k", F.lit(5)), F.lit(5)) == 0).alias("judge")
        )
    )
    model = Model()
    model.keys, model.weights = weigh(rows.where("not judge"))
    if not len(model.keys):
        discard(rows)
        return model

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_pylist()
            for at, buf, offs in text_chunks(b.column(0)):
                row, place, w, cost, counts, loss = model.hits(buf, offs)
                lo = np.searchsorted(row, np.arange(len(offs)))
                every = [segments(place[lo[r] : lo[r + 1]], w[lo[r] : lo[r + 1]], cost[lo[r] : lo[r + 1]]) for r in range(len(offs) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(toxic[at + r] == 1) for r in range(len(every))], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([lo[r + 1] - lo[r] for r in range(len(every))], pa.int64()),
                        pa.array([float(w[lo[r] : lo[r + 1]].sum()) for r in range(len(every))], pa.float64()),
                        pa.array(loss, pa.float64()),
                        pa.array([[s for _, _, s in x] for x in every], pa.list_(pa.float64())),
                    ],
                    ["y", "words", "hits", "weight", "loss", "scores"],
                )

    judged = materialize(rows.where("judge").select("text", "toxic").mapInArrow(lean(look), "y long, words long, hits long, weight double, loss double, scores array<double>"))
    calibrate(model, judged)
    discard(judged)
    discard(rows)
    return model


def calibrate(model: Model, judged: DataFrame) -> None:
    """The extreme-value rate and scale from clean documents, then the logistic curve from all.

    ``judged(y, words, hits, weight, loss, scores)`` has a row a document; sums and
    means of it, and then two numbers a document, come to the driver.
    """
    top = F.when(F.col("words") > 0, F.coalesce(F.array_max("scores"), F.lit(0.0)))
    clean = judged.where("y = 0").agg(
        F.sum("words").alias("words"), F.sum("hits").alias("hits"), F.sum("weight").alias("weight"), F.sum("loss").alias("loss"), F.avg(top).alias("top"), F.avg(F.when(F.col("words") > 0, F.col("words"))).alias("n")
    ).first()
    words = (clean.words or 0) + 1000
    hits, weight = (clean.hits or 0) + 1.0, (clean.weight or 0.0) + 3.0
    p, mean = hits / words, weight / hits
    gap = max(GAP, (clean.loss or 0.0) / max(1.0, words - hits))
    lo, hi = 1e-6, 50.0
    for _ in range(80):  # the rate at which a random walk of such steps has expectation 1
        mid = (lo + hi) / 2
        grown = p * math.exp(min(700.0, mid * mean)) + (1 - p) * math.exp(-mid * gap)
        lo, hi = (mid, hi) if grown < 1 else (lo, mid)
    model.rate = min(max(lo, 0.2), 5.0)
    if clean.top is not None:
        model.k = min(max(math.exp(model.rate * clean.top - 0.5772) / clean.n, 1e-3), 1.0)
    beyond = F.filter(F.transform("scores", lambda s: s * model.rate - F.log(F.greatest(F.col("words"), F.lit(1)) * model.k)), lambda v: v > 0)
    seen = judged.select("y", beyond.alias("v")).select(
        "y", F.coalesce(F.array_max("v"), F.lit(0.0)).alias("best"), F.aggregate("v", F.lit(0.0), lambda a, v: a + v).alias("total")
    ).collect()
    t = np.array([r.y for r in seen], dtype=float)
    if len(set(t.tolist())) < 2:
        model.curve = (-3.0, 1.0, 0.5)
        return
    a, beta = np.array([(1.0, math.log1p(r.best), math.log1p(r.total)) for r in seen]), np.zeros(3)
    for _ in range(50):  # Newton with a small ridge
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (q * (1 - q) + 1e-9)[:, None]).T @ a + 0.05 * np.eye(3), a.T @ (t - q) - 0.05 * beta)
        beta = beta + np.clip(step, -2, 2)
        beta[1:] = np.maximum(beta[1:], 0)  # more evidence never lowers a score
    model.curve = tuple(map(float, beta))


def score_documents(docs: DataFrame, model: Model, passages: bool = False) -> DataFrame:
    """(doc_id, score, predicted), with ``passages`` also the significant ones as (first token, last token, surprise).

    Null or empty texts score what no evidence scores; long texts are read whole.
    Repeated rows and null ids are scored row by row, an empty table gives none;
    nothing but the text is read. Ties: of equal segments the first is the best,
    and a score equal to LIMIT is predicted toxic.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, buf, offs in text_chunks(b.column(1)):
                row, place, w, cost, counts, loss = model.hits(buf, offs)
                lo = np.searchsorted(row, np.arange(len(offs)))
                scores, found = [], []
                for r in range(len(offs) - 1):
                    p, v, c = (x[lo[r] : lo[r + 1]] for x in (place, w, cost))
                    scores.append(model.score(*model.features(p, v, c, int(counts[r]))))
                    if passages:
                        found.append(
                            [
                                {"first": a, "last": z, "surprise": x}
                                for a, z, s in segments(p, v, c)
                                if (x := model.rate * s - math.log(model.k * max(int(counts[r]), 1))) > 0
                            ]
                        )
                cols = [b.column(0).slice(at, len(scores)), pa.array(scores, pa.float64()), pa.array([int(s >= LIMIT) for s in scores], pa.int32())]
                names = ["doc_id", "score", "predicted"]
                if passages:
                    cols.append(pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("surprise", pa.float64())]))))
                    names.append("passages")
                yield pa.RecordBatch.from_arrays(cols, names)

    ids = docs.schema["doc_id"].dataType.simpleString()
    more = ", passages array<struct<first:long,last:long,surprise:double>>" if passages else ""
    return docs.select("doc_id", "text").mapInArrow(lean(score), f"doc_id {ids}, score double, predicted int{more}")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all columns, whatever their names, in one pass.

    Null and empty texts, ties, repeated rows and empty tables are handled as in
    ``train`` and ``score_documents``: what no evidence marks is kept.
    """
    model = train(docs, labels)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = names.index("text")
        for b in (whole.slice(at, 1_000) for whole in batches for at in range(0, whole.num_rows, 1_000)):
            ok = np.zeros(b.num_rows, dtype=bool)
            for at, buf, offs in text_chunks(b.column(text)):
                row, place, w, cost, counts, loss = model.hits(buf, offs)
                lo = np.searchsorted(row, np.arange(len(offs)))
                for r in range(len(offs) - 1):
                    s = model.score(*model.features(place[lo[r] : lo[r + 1]], w[lo[r] : lo[r + 1]], cost[lo[r] : lo[r + 1]], int(counts[r])))
                    ok[at + r] = s < LIMIT
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(lean(keep), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
