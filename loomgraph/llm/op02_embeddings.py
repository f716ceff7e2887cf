"""Embedding near-dedup with a forest of random-projection trees.

Every tree splits along random directions near the median; vectors close to a
split go to both sides, so near vectors rarely part, and several trees make up
for those that do. The depth follows the number of vectors. Thresholds come from
a bounded sample; where a node has few sampled vectors left, the nodes below go on
with their own directions and the quantiles of those vectors. All vectors are indexed.
Vectors meet within leaves of equal label, every pair is verified in double
precision and counted in the first leaf that its two vectors share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.shared import connected_components, materialize
from loomgraph.llm.textkit import mix

COSINE = 0.98
TREES = 6
#: Vectors a leaf, over all labels; vectors of one leaf and label that are compared in one block.
LEAF, BLOCK = 128, 1_500
#: The forest's thresholds are fitted on at most so many vectors, and so many bytes of them in double precision.
FIT_SAMPLE, FIT_BYTES = 100_000, 64_000_000
#: Sampled vectors that a node needs for thresholds of its own.
FIT_NODE = 32
#: How far from a split a vector goes to both sides, in deviations of the difference of two vectors at the limit.
SPILL = 0.7
#: Earlier leaves that a task looks at in one step.
MET = 1_024
#: Groups beyond one block that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000


class Forest:
    """Trees as thresholds in heap order; a node takes one of its level's directions by a hash of its number.

    A pair at the limit parts at one split with a probability of about 0.006 in 64
    dimensions; groups whose members are as far apart as the limit is, part more often, which the trees make up for.
    """

    def __init__(self, sample: np.ndarray, n: int, cosine: float, trees: int, leaf: int, seed: int, ways: int = 4):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] if sample.ndim == 2 else 1
        self.depth, self.trees, self.ways = math.ceil(math.log2(max(1, n / leaf))), trees, ways
        self.fitted = max(0, min(self.depth, int(math.log2(max(1, len(sample) / FIT_NODE)))))
        self.directions = rng.standard_normal((trees, max(1, self.depth), d, ways))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.spill = SPILL * math.sqrt(2 * (1 - cosine)) / math.sqrt(d)
        self.cuts = []
        for t in range(trees):
            node = np.zeros(len(sample), dtype=np.int64)
            cuts = []
            for level in range(self.depth):
                deep = min(level, self.fitted)
                held = node >> (level - deep)  # the node, or the last one above it with a sample of its own
                seen = sample @ self.directions[t, level]
                cut = np.zeros((1 << deep, ways))
                order = np.argsort(held, kind="stable")
                edge = np.searchsorted(held[order], np.arange((1 << deep) + 1))
                for x in range(1 << deep):
                    own = seen[order[edge[x] : edge[x + 1]]]
                    if len(own):
                        cut[x] = np.quantile(own, rng.uniform(0.45, 0.55), axis=0)
                way = self.way(t, level, node)
                node = 2 * node + (seen[np.arange(len(sample)), way] > cut[held, way])
                cuts.append(cut)
            self.cuts.append(cuts)

    def way(self, tree: int, level: int, node: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(node.astype(np.uint64) + np.uint64((tree << 8 | level) << 40)) % np.uint64(self.ways)).astype(np.int64)

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, each once, over all trees; leaf ids are ordered by tree."""
        rows, ids = [], []
        for t in range(self.trees):
            row, node = np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64)
            for level in range(self.depth):
                way = self.way(t, level, node)
                held = node >> (level - min(level, self.fitted))
                p = (unit @ self.directions[t, level])[row, way] - self.cuts[t][level][held, way]
                low, high = p <= self.spill, p > -self.spill
                row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
            rows.append(row)
            ids.append(node + (t << 48))
        return np.concatenate(rows), np.concatenate(ids)


def as_matrix(raw: list[bytes], kind: str, d: int) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are filled up with zeros."""
    out = np.zeros((len(raw), d))
    size = np.array([len(x) for x in raw], dtype=np.int64) // np.dtype(kind).itemsize
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        v = np.frombuffer(b"".join(raw[i] for i in at), dtype=kind).reshape(len(at), width).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        out[at, :width] = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return out


def met_before(row: np.ndarray, leaf: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` vectors share one of the (row, leaf) given, at most MET leaves at a time."""
    met = np.zeros((n, n), dtype=bool)
    names, at, held = np.unique(leaf, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(held > 1)
    for low in range(0, len(shared), MET):
        place = np.full(len(names), -1)
        place[shared[low : low + MET]] = np.arange(len(shared[low : low + MET]))
        here = place[at] >= 0
        m = np.zeros((n, min(MET, len(shared) - low)), dtype=np.float32)
        m[row[here], place[at[here]]] = 1
        met |= m @ m.T > 0
    return met


def compare(unit: np.ndarray, n: np.ndarray, cosine: float, block: np.ndarray | None, row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one leaf and label: links of each class by members, and each class's least linked class.

    With ``block`` only pairs of different blocks count, as those within one are
    another task's. Pairs that share one of the earlier (row, leaf) are counted there.
    """
    link = unit @ unit.T >= cosine
    np.fill_diagonal(link, False)
    if block is not None:
        link &= block[:, None] != block[None, :]
    label = np.arange(len(unit))
    if not link.any():
        return np.zeros(len(unit), dtype=np.int64), label
    while True:  # least reachable class
        least = np.minimum(label, np.where(link, label[None, :], len(unit)).min(axis=1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    if len(row):
        link &= ~met_before(row, leaf, len(unit))
    return link @ n, label


def in_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of whole runs of rows that agree on ``keys``, and the runs' borders; the stream is sorted by those.

    Besides one batch, only the run that goes on is held.
    """
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        differs = np.zeros(max(0, b.num_rows - 1), dtype=bool)
        for k in keys:
            c = b.column(k)
            differs |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(differs) + 1).tolist()]
        held = b.slice(at[-1])
        if len(at) > 1:
            yield b.slice(0, at[-1]), at
    if held is not None:
        yield held, [0, held.num_rows]


def dedup_embeddings(
    vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK, seed: int = 7
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors(vec_id, embedding, label)``.

    Vectors link when labels are equal and not null, lengths are equal and the
    cosine is ``cosine`` at least. A vector that is null, empty, zero or holds
    null or non-finite numbers links with nothing, nor does a row without a
    vec_id; its component is its own id. Equal vectors of a label are one class
    from the start, so copies are counted and not compared. Rows that repeat are
    links of each other. Classes of one leaf and label beyond ``block`` are
    compared block by block in tasks of their own. Vectors have any length. Ties:
    a cosine equal to the limit, in double precision, links; of equal distances
    nothing depends. An empty table gives no rows. Other columns are not read.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f8" if isinstance(element, T.DoubleType) else "<f4"
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, keys = [], []
            for x in b.column(1).to_pylist():
                v = np.array([np.nan if y is None else y for y in x or ()], dtype=kind)
                good = len(v) and np.isfinite(v).all() and v.any()
                raws.append(v.tobytes() if good else None)
                keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "label", "vkey", "raw"]
            )

    labelled = vectors.schema["label"].dataType.simpleString()
    rows = ids.mapInArrow(prepare, f"vec_id long, label {labelled}, vkey binary, raw binary")
    good = rows.where("vec_id is not null and label is not null and vkey is not null")
    classes = materialize(
        good.groupBy("label", "vkey").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.max("raw").alias("raw"))
    )
    size = classes.agg(F.count("*"), F.max(F.octet_length("raw"))).first()
    n, d = size[0], (size[1] or 0) // (8 if kind == "<f8" else 4)
    most = max(1, min(FIT_SAMPLE, FIT_BYTES // (8 * max(1, d))))
    share = min(1.0, most * 0.95 / max(1, n))
    sample = classes.where(F.pmod(F.xxhash64("vkey"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select("raw").limit(most)
    forest = Forest(as_matrix([r[0] for r in sample.collect()], kind, d), n, cosine, trees, leaf, seed) if n else None

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in (b.iloc[at : at + 2_000] for at in range(0, len(b), 2_000)):
                row, leaves = forest.leaves(as_matrix(part["raw"].tolist(), kind, d))
                order = np.lexsort((leaves, row))
                row, leaves = row[order], leaves[order]
                own = np.split(leaves, np.flatnonzero(np.diff(row)) + 1)
                yield part.assign(leaves=own)

    classes_schema = f"label {labelled}, vkey binary, rep long, n long, raw binary"
    indexed = classes.mapInPandas(index, f"{classes_schema}, leaves array<long>")
    group = ["leaf", "mark", "length"]
    placed = materialize(  # a vector, once a leaf, with the leaves that it meets others in before
        indexed.select("*", F.posexplode("leaves").alias("pos", "leaf"))
        .withColumn("leaves", F.slice("leaves", F.lit(1), F.col("pos")))
        .withColumn("length", F.octet_length("raw"))
        .withColumn("mark", F.col("label").cast("string"))
        .drop("pos")
    )
    over = materialize(placed.groupBy(*group).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")).where("blocks > 1"))
    over = F.broadcast(over) if over.count() <= BROADCAST_ROWS else over
    dealt = (
        placed.join(over, group, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("vkey"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("bi", F.least("own", "other"))
        .withColumn("bj", F.greatest("own", "other"))
        .drop("other", "blocks")
    )
    task = [*group, "bi", "bj"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(kind).itemsize
        for b, at in in_runs(batches, task):
            raw, before = b.column("raw").to_pylist(), b.column("leaves")
            n, rep, own, bi, bj = (b.column(c).to_numpy() for c in ("n", "rep", "own", "bi", "bj"))
            edge, value = before.offsets.to_numpy(), before.values.to_numpy()
            rows, links, peers = [], [], []
            for s, e in zip(at, at[1:]):
                if e - s < 2:
                    continue
                row, leaf = np.repeat(np.arange(e - s), np.diff(edge[s : e + 1])), value[edge[s] : edge[e]]
                unit = as_matrix(raw[s:e], kind, len(raw[s]) // size)
                link, least = compare(unit, n[s:e], cosine, own[s:e] if bi[s] != bj[s] else None, row, leaf)
                found = np.flatnonzero((link > 0) | (least != np.arange(e - s)))
                rows.append(found + s)
                links.append(link[found])
                peers.append(rep[s:e][least[found]])
            if rows:
                take = np.concatenate(rows)
                kept = [b.column(c).take(pa.array(take)) for c in ("label", "vkey", "rep")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.concatenate(links)), pa.array(np.concatenate(peers))], ["label", "vkey", "rep", "links", "peer"]
                )

    found = materialize(
        dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(within, f"label {labelled}, vkey binary, rep long, links long, peer long")
    )
    components = connected_components(found.where("rep <> peer").select(F.col("rep").alias("u"), F.col("peer").alias("v")))
    links = found.groupBy("label", "vkey").agg(F.sum("links").alias("links"))
    told = (
        classes.select("label", "vkey", "rep", "n")
        .join(links, ["label", "vkey"], "left")
        .join(components, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "vkey",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return (
        rows.select("vec_id", "label", F.when(F.col("vec_id").isNotNull(), F.col("vkey")).alias("vkey"))
        .join(told, ["label", "vkey"], "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
            F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
