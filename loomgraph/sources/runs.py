"""Logs of training runs, their configurations, and results that are kept once computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The lines that a training run prints, and how its log is called.
NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|nan|inf)"
TEST_LINE = rf"Run\s+(\d+)\s*\|\s*(?:([A-Z_]+)\s+)?Test Auroc:\s*{NUMBER},\s*Test Auprc:\s*{NUMBER},\s*Test MRR:\s*{NUMBER},\s*TEST HITS:\s*\{{([^}}]*)\}}"
VAL_LINE = r"\brun\s+(\d+)\s+epoch\s+(\d+)\s*" + "".join(rf"\|\s*{name}\s+{NUMBER}\s*" for name in ("loss", "AUROC", "AUPRC", "MRR", "M"))
TIME_LINE = rf"Run\s+(\d+)\s*\|\s*best_epoch:\s*(\d+|None)\s*\|\s*train_time_sec:\s*{NUMBER}"
SHARE_LINE = r"Run\s+(\d+)\s*\|\s*([a-z_-]+)(?: test triples|: test triples)[^:]*:\s*(\d+)/(\d+)"
LOG_NAME = r"^([a-z0-9]+)_(.+)_(\d{8}_\d{6})\.log$"
HIT = rf"(\d+)\s*:\s*{NUMBER}"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """(family, tag, stamp, line) of all logs in ``folder``, split at carriage returns as well."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    part = lambda i: F.regexp_extract("name", LOG_NAME, i)
    raw = spark.read.text(f"{folder}/*.log").select(name.alias("name"), F.explode(F.split("value", "\r")).alias("line"))
    return raw.select(part(1).alias("family"), part(2).alias("tag"), part(3).alias("stamp"), "line").where("tag <> ''")


def test_results(spark: SparkSession, folder: str) -> DataFrame:
    """(family, tag, stamp, run, subset, auroc, auprc, mrr, hits) of the test lines; of several logs of a tag the one with most runs, then the first.

    ``subset`` is empty for all test rows, else the name before the line, as ``warm`` or ``dedup``.
    """
    got = lambda i: F.regexp_extract("line", TEST_LINE, i)
    hits = F.map_from_arrays(F.regexp_extract_all(got(6), F.lit(HIT), F.lit(1)).cast("array<int>"), F.regexp_extract_all(got(6), F.lit(HIT), F.lit(2)).cast("array<double>"))
    rows = _lines(spark, folder).where(F.col("line").rlike(TEST_LINE)).select(
        "family", "tag", "stamp", got(1).cast("int").alias("run"), F.lower(got(2)).alias("subset"), got(3).cast("double").alias("auroc"), got(4).cast("double").alias("auprc"), got(5).cast("double").alias("mrr"), hits.alias("hits")
    )
    best = Window.partitionBy("family", "tag").orderBy(F.desc("n"), "stamp")
    kept = rows.groupBy("family", "tag", "stamp").agg(F.count(F.when(F.col("subset") == "", 1)).alias("n")).withColumn("r", F.row_number().over(best)).where("r = 1")
    return rows.join(kept.select("family", "tag", "stamp"), ["family", "tag", "stamp"], "left_semi")


def run_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(family, tag, stamp, run, name, value) of what else a run prints: its best epoch, its seconds, and shares of test rows such as cold-start ones."""
    lines = _lines(spark, folder)
    time, share = (lambda i, p=p: F.regexp_extract("line", p, i) for p in (TIME_LINE, SHARE_LINE))
    fact = lambda name, value: F.struct(name.alias("name"), value.cast("double").alias("value"))
    epoch = F.when(time(2) != "None", time(2))
    timed = lines.where(F.col("line").rlike(TIME_LINE)).select("*", time(1).alias("run"), F.array(fact(F.lit("best_epoch"), epoch), fact(F.lit("seconds"), time(3))).alias("facts"))
    shared = lines.where(F.col("line").rlike(SHARE_LINE)).select("*", share(1).alias("run"), F.array(fact(share(2), share(3).cast("double") / F.nullif(share(4).cast("double"), F.lit(0.0)))).alias("facts"))
    return timed.unionByName(shared).select("family", "tag", "stamp", F.col("run").cast("int").alias("run"), F.inline("facts")).where("value is not null")


def curves(spark: SparkSession, folder: str) -> DataFrame:
    """(family, tag, run, epoch, loss, auroc, auprc, mrr, m) of the validation lines of each tag's newest log."""
    got = lambda i, name, kind="double": F.regexp_extract("line", VAL_LINE, i).cast(kind).alias(name)
    rows = _lines(spark, folder)
    newest = rows.groupBy("family", "tag").agg(F.max("stamp").alias("stamp"))
    return rows.join(newest, ["family", "tag", "stamp"], "left_semi").where(F.col("line").rlike(VAL_LINE)).select(
        "family", "tag", got(1, "run", "int"), got(2, "epoch", "int"), *[got(i, c) for i, c in enumerate(("loss", "auroc", "auprc", "mrr", "m"), 3)]
    )


def curve_means(points: DataFrame, metric: str) -> DataFrame:
    """(family, tag, epoch, mean, sd, n) over the runs that reached an epoch; NaN is no value, one value has a deviation of 0."""
    good = points.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return good.groupBy("family", "tag", "epoch").agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"), F.count("*").alias("n"))


def configurations(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value): scalars of JSON objects, one a file; nested values stay JSON text."""
    file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    value = "get_json_object(value, concat('$[\\'', name, '\\']'))"
    raw = spark.read.text(path, wholetext=True).select(file, "value", F.explode(F.json_object_keys("value")).alias("name"))
    return raw.select("file", "name", F.expr(value).alias("value"))


def kept(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """What ``compute`` gives, read from ``path`` where a finished table is already there, else written first."""
    sc = spark.sparkContext
    mark = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(sc._jsc.hadoopConfiguration()).exists(mark):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
