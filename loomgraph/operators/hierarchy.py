"""Class hierarchies: closure, cycles, transitive reduction and distances through common ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import cut


def closure(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(c, p): every ancestor p that a path of ``edges(c, p)`` reaches from c; a path may be a cycle."""
    got = cut(edges.select("c", "p").where("c <> p").distinct())
    n = got.count()
    for _ in range(rounds):  # paths double in length
        more = got.select("c", F.col("p").alias("via")).join(got.select(F.col("c").alias("via"), "p"), "via").select("c", "p")
        got = cut(got.unionByName(more).distinct())
        m = got.count()
        if m == n:
            return got
        n = m
    raise RuntimeError("the closure did not settle")


def acyclic(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """``edges`` without loops and those whose ends reach each other: members of a cycle are incomparable."""
    back = reach.select(F.col("c").alias("p"), F.col("p").alias("c"))
    return edges.select("c", "p").where("c <> p").distinct().join(back, ["c", "p"], "left_anti")


def reduced(edges: DataFrame) -> DataFrame:
    """(c, p): ``edges`` of the acyclic part that no longer path replaces."""
    dag = cut(acyclic(edges, closure(edges)))
    reach = closure(dag)
    longer = dag.select("c", F.col("p").alias("via")).join(reach.select(F.col("c").alias("via"), "p"), "via").select("c", "p").distinct()
    return dag.join(longer, ["c", "p"], "left_anti")


def up_distances(dag: DataFrame, rounds: int = 200) -> DataFrame:
    """(n, anc, d): fewest steps up from each node to each of its ancestors, itself included."""
    nodes = dag.select(F.col("c").alias("n")).union(dag.select("p")).distinct()
    front = cut(nodes.select("n", F.col("n").alias("anc"), F.lit(0).alias("d")))
    seen = front
    for d in range(1, rounds + 1):
        step = front.join(dag, F.col("anc") == F.col("c")).select("n", F.col("p").alias("anc")).distinct()
        front = cut(step.join(seen.select("n", "anc"), ["n", "anc"], "left_anti").withColumn("d", F.lit(d)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise RuntimeError("deeper than the rounds allow")


def lca_distance(dag: DataFrame, pairs: DataFrame, most: int = 250) -> DataFrame:
    """(a, b, dist, kind, lca) of ``pairs(a, b)`` over the reduced ``dag(c, p)``.

    The least sum of steps up to a common ancestor. One that is an end itself
    always counts; another only with ``most`` descendants at most. -1 without
    such an ancestor, -2 where a is not in the hierarchy. Ties: an end itself first, then by name.
    """
    up = cut(up_distances(dag))
    many = up.where("d > 0").groupBy("anc").agg(F.count("*").alias("below"))
    met = (
        pairs.select("a", "b").distinct()
        .join(up.select(F.col("n").alias("a"), "anc", F.col("d").alias("da")), "a")
        .join(up.select(F.col("n").alias("b"), "anc", F.col("d").alias("db")), ["b", "anc"])
        .join(many, "anc", "left")
        .withColumn("lineal", (F.col("anc") == F.col("a")) | (F.col("anc") == F.col("b")))
        .where(F.col("lineal") | (F.coalesce("below", F.lit(0)) <= most))
        .withColumn("kind", F.when(F.col("anc") == F.col("b"), "descendant").when(F.col("anc") == F.col("a"), "ancestor").otherwise("collateral"))
    )
    best = met.groupBy("a", "b").agg(F.min(F.struct((F.col("da") + F.col("db")).alias("dist"), (~F.col("lineal")).alias("far"), F.col("anc").alias("lca"), "kind")).alias("x"))
    inside = up.select(F.col("n").alias("a"), F.lit(True).alias("in")).distinct()
    return (
        pairs.select("a", "b").join(best, ["a", "b"], "left").join(inside, "a", "left")
        .select("a", "b", F.when(F.col("in").isNull(), -2).otherwise(F.coalesce("x.dist", F.lit(-1))).alias("dist"), F.coalesce("x.kind", F.lit("none")).alias("kind"), F.coalesce("x.lca", F.lit("")).alias("lca"))
    )
