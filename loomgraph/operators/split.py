"""Hash-ordered splits and samples: the same rows under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import cut
from loomgraph.operators.ids import numbered


def order_key(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def draw(key: Column) -> Column:
    """A number below 2**32 from the first eight digits of a digest."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def stratified(df: DataFrame, test: float = 0.2, val: float = 0.15, seed: int = 42) -> DataFrame:
    """``df(head, tail)`` with ``part``: per tail test first, then validation, then training.

    One edge trains; of two one is tested; else ceil(test * n) are tested and of
    the rest, unless one is left, max(1, round half even(val * rest)) validate.
    """
    w = Window.partitionBy("tail")
    n = F.col("n")
    n_test = F.when(n == 1, 0).when(n == 2, 1).otherwise(F.ceil(n * test))
    rest = n - n_test
    n_val = F.when((n <= 2) | (rest <= 1), 0).otherwise(F.greatest(F.lit(1), F.bround(rest * val, 0).cast("int")))
    return (
        df.withColumn("n", F.count("*").over(w))
        .withColumn("i", F.row_number().over(w.orderBy(order_key(seed, "head", "tail"), "head")))
        .withColumn("part", F.when(F.col("i") <= n_test, "test").when(F.col("i") <= n_test + n_val, "val").otherwise("train"))
        .drop("n", "i")
    )


def undersample(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Exactly ``k`` rows of (head, interaction, tail), without replacement."""
    return df.orderBy(order_key(seed, "head", "interaction", "tail"), "head", "interaction", "tail").limit(k)


def oversample(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)).cast("array<long>")))


def filtered_negatives(positives: DataFrame, true: DataFrame, attempts: int = 50, first: int = 4, seed: int = 42) -> DataFrame:
    """One negative (head, tail, neg_head, neg_tail) for each row of ``positives(head, tail)``.

    Each attempt draws a side and a candidate of the relation's own pool, which
    holds the ends of all ``true(head, tail)`` and positives; the first that is
    none of these pairs is taken, else the positive itself comes back. All rows
    make the ``first`` attempts, those that are left the others.
    """
    known = cut(true.select("head", "tail").unionByName(positives.select("head", "tail")).distinct())
    pools = {c: numbered(known.select(F.col(c).alias("pick")).distinct(), "pick", name="i") for c in ("head", "tail")}
    sizes = {c: p.count() for c, p in pools.items()}
    if not all(sizes.values()):
        return positives.select("head", "tail", F.col("head").alias("neg_head"), F.col("tail").alias("neg_tail"))
    pool = pools["head"].withColumn("side", F.lit("h")).unionByName(pools["tail"].withColumn("side", F.lit("t")))
    key = F.concat_ws("|", F.lit(str(seed)), "head", "tail", F.col("k").cast("string"))

    def tried(rows: DataFrame, a: int, z: int) -> DataFrame:
        side = F.when(draw(F.concat(key, F.lit("|side"))) % 2 == 0, "h").otherwise("t")
        size = F.when(F.col("side") == "h", sizes["head"]).otherwise(sizes["tail"])
        made = (
            rows.withColumn("k", F.explode(F.sequence(F.lit(a), F.lit(z)))).withColumn("side", side).withColumn("i", draw(key) % size)
            .join(pool, ["side", "i"])
            .select("head", "tail", "k", F.when(F.col("side") == "h", F.col("pick")).otherwise(F.col("head")).alias("neg_head"),
                    F.when(F.col("side") == "t", F.col("pick")).otherwise(F.col("tail")).alias("neg_tail"))
        )
        free = made.join(known.toDF("neg_head", "neg_tail"), ["neg_head", "neg_tail"], "left_anti")
        return free.groupBy("head", "tail").agg(F.min_by(F.struct("neg_head", "neg_tail"), "k").alias("x"))

    rows = positives.select("head", "tail").distinct()
    got = cut(tried(rows, 1, min(first, attempts)))
    if attempts > first:
        got = got.unionByName(tried(rows.join(got, ["head", "tail"], "left_anti"), first + 1, attempts))
    return positives.select("head", "tail").join(got, ["head", "tail"], "left").select(
        "head", "tail", F.coalesce("x.neg_head", "head").alias("neg_head"), F.coalesce("x.neg_tail", "tail").alias("neg_tail")
    )


def derived_seeds(run: int, base: int = 42) -> dict[str, int]:
    """The seeds of a run: the run's own, and one for each thing that is drawn besides."""
    seed = base + run
    return {"run": seed, "data": base, "val": seed + 1000, "test": seed + 2000, "warm": seed + 3000, "dedup": seed + 4000}


def global_random(df: DataFrame, test: float = 0.2, val: float = 0.15, seed: int = 42) -> DataFrame:
    """``df(head, tail)`` with ``part`` by a hash of the pair, whatever the tail; shares hold on average."""
    u = draw(F.concat_ws("|", F.lit(str(seed)), "head", "tail")) / F.lit(float(1 << 32))
    return df.withColumn("part", F.when(u < test, "test").when(u < test + (1 - test) * val, "val").otherwise("train"))


def supervision(positives: DataFrame, epoch: int, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """(head, tail, role, reverse) of an epoch: some of the distinct ``positives(head, tail)`` supervise, the rest stay in the graph with their reverses.

    Of n pairs min(n - 1, max(1, round half even(ratio * n))) supervise, other
    ones each epoch, first by a digest of seed, epoch and pair. They are numbered
    by ranges, so no task sorts all. A single pair stays in the graph.
    """
    pairs = positives.select("head", "tail").distinct().withColumn("_k", order_key(seed + epoch, "head", "tail"))
    told = cut(numbered(pairs, "_k", "head", "tail", name="_i"))
    n = told.count()
    many = min(n - 1, max(1, round(n * ratio)))
    role = F.when(F.col("_i") < many, "supervises").otherwise("graph")
    rows = told.select("head", "tail", role.alias("role"), F.lit(False).alias("reverse"))
    back = rows.where("role = 'graph'").select(F.col("tail").alias("head"), F.col("head").alias("tail"), "role", F.lit(True).alias("reverse"))
    return rows.unionByName(back)
