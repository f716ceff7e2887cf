"""Graph operators over edge tables: components, bounded search, rank mass, neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.components import connected_components, materialize
from loomgraph.operators.exact import vector_sums


def cut(df: DataFrame) -> DataFrame:
    """End the lineage: what ``df`` holds, written once as Parquet into the folder that spark.checkpoint.dir names.

    A reliable checkpoint runs the last stage a second time to write its rows, plain, and does not know their size.
    """
    return materialize(df)


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("head").alias("u"), F.col("tail").alias("v")).union(edges.select("tail", "head")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node reaches, by name.

    Nodes are numbered in the order of their names, so the least number is the least name.
    """
    from loomgraph.operators.ids import numbered  # which cuts lineages with this module

    # repeated edges and their ways cost a forest nothing, so no shuffle tells them apart
    both = edges.select(F.col("head").alias("u"), F.col("tail").alias("v")).where("u <> v")
    ids = cut(numbered(both.select(F.col("u").alias("node")).union(both.select("v")).distinct(), "node").select("node", "id"))
    coded = both.join(ids.toDF("u", "a"), "u").join(ids.toDF("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = connected_components(coded)
    return found.join(ids.toDF("name", "node"), "node").join(ids.toDF("least", "component"), "component").select(F.col("name").alias("node"), F.col("least").alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The rows of ``edges(head, tail, ...)`` with both ends in the component of most nodes; of equal ones the least node's."""
    label = components(edges)
    top = label.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    inside = label.join(F.broadcast(top), "component").select("node")  # one row
    return edges.join(inside.withColumnRenamed("node", "head"), "head", "left_semi").join(inside.withColumnRenamed("node", "tail"), "tail", "left_semi").select(*edges.columns)


def bfs(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, dist) for every node within ``hops`` of each ``sources(node)``."""
    both = undirected(edges)
    seen = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"))
    front = seen
    for d in range(1, hops + 1):
        step = front.join(both, front["node"] == both["u"]).select("source", F.col("v").alias("node")).distinct()
        front = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("dist", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


#: Types of nodes by which walks are ruled out; in a graph of more, none is.
KINDS = 64


def pair_distance(edges: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """(head, tail, dist) of ``pairs(head, tail)``: shortest path of at most ``hops`` edges, 4 at most, -1 beyond.

    Neighbours of both ends are listed for the pairs that are left, and looked up
    as edges or, each different two of them once, by the neighbours of the one
    that has fewer. No ball around a node is made, so a node with very many
    edges in the middle costs nothing. Nodes go by numbers, and by their types (what
    stands before ``::``): where no walk of so many edges leads from a pair's
    one type to the other, as between sides of a bipartite graph, nothing is asked.
    """
    from loomgraph.operators.ids import numbered  # which cuts lineages with this module

    if not 0 <= hops <= 4:
        raise ValueError("0 to 4 hops")
    plain = edges.select("head", "tail").where("head <> tail")
    asked = cut(pairs.select("head", "tail").distinct())
    sides = [df.select(F.col(c).alias("node")) for df in (plain, asked) for c in ("head", "tail")]
    named = cut(numbered(reduce(DataFrame.union, sides).where("node IS NOT NULL").distinct(), "node").withColumn("type", F.substring_index("node", "::", 1)))
    types = [r[0] for r in named.select("type").distinct().limit(KINDS + 1).collect()]
    place = F.create_map(*[F.lit(x) for i, t in enumerate(types) for x in (t, i)])[F.col("type")] if 0 < len(types) <= KINDS else F.lit(0)
    ids = cut(named.select("node", "id", place.alias("kind")))
    end = lambda c, x, k: ids.select(F.col("node").alias(c), F.col("id").alias(x), F.col("kind").alias(k))
    one = plain.join(end("head", "u", "ku"), "head").join(end("tail", "v", "kv"), "tail").select("u", "v", "ku", "kv")
    both = cut(one.union(one.select("v", "u", "kv", "ku")).distinct())
    linked = {tuple(r) for r in both.select("ku", "kv").distinct().collect()}
    walks = [{(k, k) for k in range(max(1, len(types)))}]
    for _ in range(hops):
        walks.append({(a, c) for a, b in walks[-1] for x, c in linked if x == b})
    may = lambda n, a, b: (F.col(a) * KINDS + F.col(b)).isin([x * KINDS + y for x, y in sorted(walks[n])])
    to = lambda at, node, kind=None: both.select(F.col("u").alias(at), F.col("v").alias(node), *([F.col("kv").alias(kind)] if kind else []))
    left = cut(asked.join(end("head", "h", "kh"), "head").join(end("tail", "t", "kt"), "tail").select("h", "t", "kh", "kt"))
    found = left.where("h = t").select("h", "t", F.lit(0).alias("dist"))
    left = left.where("h <> t")
    met = {tuple(r) for r in left.select("kh", "kt").distinct().collect()}
    for d in range(1, hops + 1):
        if not walks[d] & met:
            continue
        todo = left.where(may(d, "kh", "kt"))
        if d == 1:
            got = todo.join(to("h", "t"), ["h", "t"], "left_semi").select("h", "t")
        elif d == 2:
            got = todo.join(to("t", "b"), "t").join(to("h", "b"), ["h", "b"], "left_semi").select("h", "t").distinct()
        else:
            ends = todo.join(to("h", "a", "ka"), "h").join(to("t", "b", "kb"), "t").where(may(d - 2, "ka", "kb")).select("h", "t", "a", "b")
            if d == 3:
                got = ends.join(to("a", "b"), ["a", "b"], "left_semi").select("h", "t").distinct()
            else:
                many = cut(both.groupBy("u").agg(F.count("*").alias("n")))
                two = ends.select("a", "b").distinct().join(many.toDF("a", "x"), "a").join(many.toDF("b", "y"), "b")
                less = F.col("x") < F.col("y")
                meet = two.select("a", "b", F.when(less, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("far"))
                near = meet.join(to("few", "w"), "few").join(to("far", "w"), ["far", "w"], "left_semi").select("a", "b").distinct()
                got = ends.join(near, ["a", "b"], "left_semi").select("h", "t").distinct()
        got = cut(got)
        found = found.unionByName(got.withColumn("dist", F.lit(d)))
        left = cut(left.join(got, ["h", "t"], "left_anti"))
    names = found.join(ids.select(F.col("node").alias("head"), F.col("id").alias("h")), "h").join(ids.select(F.col("node").alias("tail"), F.col("id").alias("t")), "t")
    return pairs.select("head", "tail").join(names.select("head", "tail", "dist"), ["head", "tail"], "left").fillna(-1, "dist")


def common_neighbours(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(head, tail, cn, aa, ra) of ``anchors(head)`` and all nodes two steps away; sums are exact decimals of nine digits."""
    both = undirected(edges)
    deg = both.groupBy(F.col("u").alias("mid")).agg(F.count("*").alias("d")).where("d > 1").select(
        "mid", F.round(1 / F.log("d"), 9).cast("decimal(18,9)").alias("x"), F.round(1 / F.col("d"), 9).cast("decimal(18,9)").alias("y")
    )
    first = anchors.select("head").distinct().join(both, F.col("head") == F.col("u")).select("head", F.col("v").alias("mid")).join(deg, "mid")
    return (
        first.join(both, F.col("mid") == F.col("u")).where("v <> head")
        .groupBy("head", F.col("v").alias("tail")).agg(F.count("*").cast("double").alias("cn"), F.sum("x").cast("double").alias("aa"), F.sum("y").cast("double").alias("ra"))
    )


def walks(edges: DataFrame, anchors: DataFrame, length: int = 3) -> DataFrame:
    """(head, tail, w1, w2, ...): walks of each length up to ``length`` from ``anchors(head)``, counted step by step."""
    both = undirected(edges)
    at = anchors.select("head", F.col("head").alias("tail"), F.lit(1).cast("long").alias("w")).distinct()
    found = None
    for n in range(1, length + 1):
        at = cut(at.join(both, F.col("tail") == F.col("u")).groupBy("head", F.col("v").alias("tail")).agg(F.sum("w").cast("long").alias("w")))
        rows = at.select("head", "tail", *[(F.col("w") if i == n else F.lit(0).cast("long")).alias(f"w{i}") for i in range(1, length + 1)])
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("head", "tail").agg(*[F.sum(f"w{i}").alias(f"w{i}") for i in range(1, length + 1)])


def katz(counted: DataFrame, beta: float = 0.05) -> DataFrame:
    """(head, tail, score) from ``walks``: beta w1 + beta^2 w2 + beta^3 w3."""
    return counted.select("head", "tail", F.round(F.col("w1") * beta + F.col("w2") * (beta * beta) + F.col("w3") * (beta * beta * beta), 9).alias("score"))


#: Sources whose masses one row of a node holds.
SOURCES = 64


def page_rank(edges: DataFrame, sources: DataFrame, alpha: float = 0.15, rounds: int = 30, pool: DataFrame | None = None, together: int = SOURCES) -> DataFrame:
    """(source, node, mass) after ``rounds`` of r = alpha x + (1 - alpha) A D^-1 r from each ``sources(node)``.

    A row holds a node's masses from ``together`` sources; a round joins rows with
    the edges of their node and adds up what arrives, order-free. A source
    without an edge keeps what starts there. With ``pool(node)`` only its nodes
    are given. Neither the graph nor the sources pass through one task.
    """
    from loomgraph.operators.ids import numbered  # which cuts lineages with this module

    both = undirected(edges)
    step = cut(both.join(both.groupBy("u").agg(F.lit(1 - alpha) / F.count("*")).toDF("u", "weight"), "u"))
    told = cut(numbered(sources.select("node").distinct(), "node", name="i").select("node", F.floor(F.col("i") / together).alias("block"), (F.col("i") % together).cast("int").alias("slot")))
    ones = F.transform(F.sequence(F.lit(0), F.lit(together - 1)), lambda j: F.when(j == F.col("slot"), 1.0).otherwise(0.0))
    start = cut(told.select("block", "node", ones.alias("vector")))
    mass = start
    for i in range(rounds):
        sent = mass.join(step, mass["node"] == step["u"]).select("block", F.col("v").alias("node"), "vector", "weight")
        mass = vector_sums(sent.unionByName(start.withColumn("weight", F.lit(alpha))), ["block", "node"]).select("block", "node", F.col("total").alias("vector"))
        mass = cut(mass) if i % 3 == 2 else mass
    if pool is not None:
        mass = mass.join(pool.select("node").distinct(), "node", "left_semi")
    each = mass.select("block", "node", F.posexplode("vector").alias("slot", "mass")).where("mass <> 0")
    return each.join(told.withColumnRenamed("node", "source"), ["block", "slot"]).select("source", "node", "mass")


#: Upper ends of the size brackets, and their names.
BRACKETS = ((1, "1 (isolated)"), (2, "2 (pairs)"), (5, "3-5"), (10, "6-10"), (100, "11-100"), (1000, "101-1000"), (10000, "1001-10000"))


def component_sizes(label: DataFrame, edges: DataFrame) -> DataFrame:
    """(bracket, components, nodes, largest, density) of ``components``; density is of the whole graph."""
    sizes = label.groupBy("component").agg(F.count("*").alias("size"))
    name = F.lit(">10000")
    for top, text in reversed(BRACKETS):
        name = F.when(F.col("size") <= top, text).otherwise(name)
    n, m = sizes.agg(F.sum("size")).first()[0] or 0, edges.count()
    density = m / (n * (n - 1) / 2) if n > 1 else 0.0
    return sizes.groupBy(name.alias("bracket")).agg(
        F.count("*").alias("components"), F.sum("size").alias("nodes"), F.max("size").alias("largest"), F.lit(round(density, 9)).alias("density")
    )
