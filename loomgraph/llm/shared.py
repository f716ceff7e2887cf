"""Helpers that several operators use: shared storage, sessions, components."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges of a forest that one task unites (16 bytes each, some 150 while it does); beyond it, rounds of joins.
TASK_EDGES = 1_000_000
#: Edges that a task holds before it turns them into a forest.
CONTRACT_EDGES = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode, where it may be unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
        os.makedirs(path, exist_ok=True)
        path = f"file://{path}"
    return path.rstrip("/")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``df`` needs, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, dots and other marks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running stage only, and the
    next stages read a file that every executor can see.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(by) if by else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path  # noqa: SLF001
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which must not be read again."""
    path = getattr(df, "_loom_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the edges that is not the least one its component has."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := root[root], root):
            root = nxt
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, as a forest that hangs every node under the least one it reaches there."""
    u = v = np.zeros(0, np.int64)
    more: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        more += [b] if b is not None else []
        if more and (b is None or sum(x.num_rows for x in more) > max(CONTRACT_EDGES, len(u))):
            u, v = (np.concatenate([old, *(x.column(i).to_numpy() for x in more)]) for i, old in enumerate((u, v)))
            u, v = _forest(u, v)
            more = []
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def connected_components(edges: DataFrame, rounds: int = 40, task_edges: int = TASK_EDGES) -> DataFrame:
    """Smallest reachable node for each node of ``edges(u long, v long)``: (node, component).

    Each task first turns its edges into a forest, never more edges than nodes.
    Up to ``task_edges`` of those, counted, one task unites them; beyond that
    large-star and small-star steps alternate over tables of edges. The least
    neighbour of a node is an aggregate with a partial step, so a node with very
    many edges costs no single task; each round is written to the shared folder.
    Self-loops and repeated edges are allowed; a node without an edge is absent,
    one with a self-loop only as well. Rows with a null end are no edges.
    """
    plain = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    cur = materialize(plain.mapInArrow(_contract, "u long, v long"))
    if cur.count() <= task_edges:
        forest = materialize(cur.coalesce(1).mapInArrow(_contract, "u long, v long"))
        discard(cur)
        return _named(forest)
    seen = None
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # large star hangs greater neighbours under the least one; own edges to it stay
        own = least.where("k > m").select(F.col("k").alias("u"), F.col("m").alias("v"))
        star = large.unionByName(own).where("u <> v").distinct()
        down = star.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = (
            star.join(down, star["u"] == down["k"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        nxt = materialize(
            small.unionByName(down.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        )
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return _named(cur)


def _named(forest: DataFrame) -> DataFrame:
    """(node, component) of a forest ``(u, v)`` of depth one: roots belong to themselves."""
    roots = forest.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
