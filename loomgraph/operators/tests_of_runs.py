"""Paired comparisons of variants with a reference, by the roles of a plan that was fixed beforehand."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import stats


def paired_comparison(runs: DataFrame, reference: str, primary: list[str] | None = None, alternative: str = "two-sided", margin: float | None = None) -> DataFrame:
    """A row a variant of ``runs(variant, run, value)``: difference to the reference over the runs that both have.

    (variant, role, n, delta, sd, sem, t, ci_low, ci_high, p_t, p_w, p_equiv,
    p_holm). Null and NaN values are left out. Without ``primary`` all variants
    are primary and tested on both sides; else only the primary ones are tested
    by ``alternative`` and adjusted. One row of sums a variant reaches Python.
    """
    good = runs.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    ref = good.where(F.col("variant") == reference).select("run", F.col("value").alias("base"))
    d = good.where(F.col("variant") != reference).join(ref, "run").select("variant", F.round(F.col("value") - F.col("base"), 9).alias("d"))
    size = Window.partitionBy("variant").orderBy(F.abs("d"))
    same = Window.partitionBy("variant", F.abs("d"))
    ranks = d.where("d <> 0").select("variant", "d", (F.rank().over(size) + (F.count("*").over(same) - 1) / 2).alias("r"), F.count("*").over(same).alias("c"))
    signed = ranks.groupBy("variant").agg(
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w"), F.count("*").alias("m"), F.sum(F.col("r") * F.col("r")).alias("q"), (F.max("c") > 1).alias("tied")
    )
    sums = d.groupBy("variant").agg(F.count("*").alias("n"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") == 0).alias("zeros")).join(signed, "variant", "left")

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                main = primary is None or r.variant in primary
                alt = alternative if primary is not None and main else "two-sided"
                row = dict(variant=r.variant, role="" if primary is None else "primary" if main else "secondary", n=r.n, delta=r.delta, sd=r.sd, zeros=r.zeros)
                if r.n >= 2 and r.sd > 0:
                    se, df = r.sd / r.n**0.5, r.n - 1
                    half = stats.t_quantile(0.975, df) * se
                    row |= dict(sem=se, t=r.delta / se, ci_low=r.delta - half, ci_high=r.delta + half, p_t=stats.t_p(r.delta / se, df, alt))
                    row |= dict(p_w=stats.wilcoxon_p(r.w, int(r.m), r.q, bool(r.tied) or r.zeros > 0, alt))
                    if margin is not None:
                        row["p_equiv"] = max(stats.t_above((r.delta + margin) / se, df), 1 - stats.t_above((r.delta - margin) / se, df))
                out.append(row)
            yield pd.DataFrame(out, columns=["variant", "role", "n", "delta", "sd", "zeros", "sem", "t", "ci_low", "ci_high", "p_t", "p_w", "p_equiv"])

    tested = sums.select("variant", "n", "delta", "sd", "zeros", "w", "m", "q", "tied").mapInPandas(
        told, "variant string, role string, n long, delta double, sd double, zeros long, sem double, t double, ci_low double, ci_high double, p_t double, p_w double, p_equiv double"
    )
    by = Window.partitionBy("in_family").orderBy("p_t", "variant")  # a row a variant
    family = tested.withColumn("in_family", (F.col("role") != "secondary") & F.col("p_t").isNotNull())
    step = (F.count("*").over(Window.partitionBy("in_family")) - F.row_number().over(by) + 1) * F.col("p_t")
    adjusted = family.withColumn("step", step).withColumn("p_holm", F.when(F.col("in_family"), F.least(F.lit(1.0), F.max("step").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))))
    return adjusted.drop("in_family", "step")


def verdicts(compared: DataFrame, level: float = 0.05) -> DataFrame:
    """``compared`` with a verdict: of primary variants by the adjusted p, else by equivalence, else none."""
    return compared.withColumn(
        "verdict",
        F.when((F.col("role") != "secondary") & (F.col("p_holm") < level), F.when(F.col("delta") > 0, "better").otherwise("worse"))
        .when(F.col("p_equiv") < level, "equivalent").when(F.col("p_t").isNull(), "not testable").otherwise("undecided"),
    )


def early_stop(points: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """(run, best_epoch, best, stopped): the best value of ``points(run, epoch, value)`` up to the epoch where it stops, null if it doesn't.

    A value is better if it exceeds the best before by more than ``min_delta``; the run stops at the first epoch
    ``patience`` or more after the last better one. Null and NaN values are none. A run's epochs are held in one row.
    """
    good = points.where(F.col("value").isNotNull() & ~F.isnan("value"))
    runs = good.groupBy("run").agg(F.sort_array(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("value").cast("double").alias("value")))).alias("x"))
    start = F.struct(F.lit(None).cast("int").alias("epoch"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("stopped"))

    def step(at, x):
        better = at["epoch"].isNull() | (x["value"] > at["value"] + min_delta)
        over = ~better & (x["epoch"] - at["epoch"] >= patience)
        new = F.struct(F.when(better, x["epoch"]).otherwise(at["epoch"]).alias("epoch"), F.when(better, x["value"]).otherwise(at["value"]).alias("value"), F.when(over, x["epoch"]).alias("stopped"))
        return F.when(at["stopped"].isNotNull(), at).otherwise(new)

    return runs.select("run", F.aggregate("x", start, step).alias("y")).select("run", F.col("y.epoch").alias("best_epoch"), F.col("y.value").alias("best"), F.col("y.stopped").alias("stopped"))
