"""Dense numbers in a global order without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import cut


def numbered(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """``df`` with 0, 1, ... in the order of the columns ``order``, which must tell its rows apart.

    Rows are dealt by range and sorted in their partitions; the number is the
    place in the partition after the rows of the partitions before, of which one count each is kept.
    """
    far = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in far.groupBy(part.alias("p")).count().collect())
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_p long, _before long")
    return far.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_before") + place).cast("long")).drop("_m", "_p", "_before")  # a row a partition
