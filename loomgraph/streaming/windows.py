"""Event-time operators (an extension): sessions, sliding windows, a watermarked stream without repeats, and triples that grow."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import cut


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def deduplicated(spark: SparkSession, folder: str, schema, late: str = "1 day") -> DataFrame:
    """A stream of Parquet files of events, each event_id once within the watermark."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sliding(events: DataFrame, length: str = "7 days", step: str = "1 day") -> DataFrame:
    """(start, n, users, total) of overlapping windows; an event counts in each that holds it."""
    w = F.window("ts", length, step)
    return events.groupBy(w).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 3).alias("total")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("start"), "n", "users", "total"
    )


def append_triples(path: str, batch: DataFrame) -> None:
    """Adds ``batch(head, interaction, tail)`` to the triples at ``path``; a batch that comes again changes nothing.

    Only the folders of the batch's relations are read and replaced, at the job's commit.
    """
    spark = batch.sparkSession
    rows = cut(batch.select("head", "tail", "interaction").distinct())
    touched = [r[0] for r in rows.select("interaction").distinct().collect()]  # relations, not rows
    if not touched:
        return
    try:
        rows = rows.unionByName(spark.read.schema("head string, tail string, interaction string").parquet(path).where(F.col("interaction").isin(touched))).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    new = cut(rows)  # what is read is replaced
    new.repartitionByRange("interaction", "head", "tail").sortWithinPartitions("interaction", "head", "tail").write.partitionBy("interaction").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def ingest(spark: SparkSession, folder: str, path: str, checkpoint: str):
    """A stream of Parquet files of triples into ``path``, all that is there now; degrees are read with ``degrees``."""
    read = spark.readStream.schema("head string, interaction string, tail string").parquet(folder)
    return read.writeStream.foreachBatch(lambda batch, _: append_triples(path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def degrees(spark: SparkSession, path: str) -> DataFrame:
    """(node, degree, place) over all triples at ``path``; equal degrees share a place."""
    kg = spark.read.schema("head string, tail string, interaction string").parquet(path)
    return _placed(kg.select(F.col("head").alias("node")).unionByName(kg.select(F.col("tail").alias("node"))).groupBy("node").agg(F.count("*").alias("degree")))


def _placed(deg: DataFrame) -> DataFrame:
    sizes = deg.groupBy("degree").agg(F.count("*").alias("n"))  # a row a degree, few
    above = sizes.withColumn("place", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
    return deg.join(above.select("degree", "place"), "degree").select("node", "degree", "place")


def growing_degrees(edges: DataFrame, path: str, checkpoint: str, late: str = "1 day"):
    """A stream of ``edges(ts, head, interaction, tail)`` into the degrees of nodes at ``path``, batch by batch.

    A triple counts once within the watermark; rows that are ``late`` are dropped
    and counted in the query's progress, see ``late_rows``. The counts are the
    stream's state, and a batch writes the nodes that it changes, nothing else, so
    its cost follows the batch and not what came before. A batch that is run
    again writes the same folder.
    """
    once = edges.withWatermark("ts", late).dropDuplicatesWithinWatermark(["head", "interaction", "tail"])
    counted = once.select(F.explode(F.array("head", "tail")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    write = lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}")
    return counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query) -> int:
    """Rows that a query's watermark dropped, over its recent batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def grown_degrees(spark: SparkSession, path: str) -> DataFrame:
    """(node, degree, place) as of the last batch at ``path``; equal degrees share a place."""
    told = spark.read.schema("node string, degree long, batch long").parquet(path)
    return _placed(told.groupBy("node").agg(F.max_by("degree", "batch").alias("degree")))


def compact_degrees(spark: SparkSession, path: str, into: str) -> None:
    """The last degree of each node as one batch in a new folder, from which reading is as cheap as the nodes are many."""
    told = spark.read.schema("node string, degree long, batch long").parquet(path)
    last = told.agg(F.max("batch")).first()[0]
    told.groupBy("node").agg(F.max_by("degree", "batch").alias("degree")).write.parquet(f"{into}/batch={last}")
