"""Tables that are made once for what they are made of: pools of candidates and sets of known pairs by the digest of their rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ids import numbered
from loomgraph.sources.runs import kept
from loomgraph.sources.sinks import shared_dir


def digest(df: DataFrame) -> str:
    """A fingerprint of the rows of ``df``, whatever their order and partitions: their number and two sums of hashes by other seeds. Names and types of columns count."""
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")), F.lit(0)) for seed in (1, 2)]
    n, a, b = df.agg(F.count("*"), *sums).first()
    shape = hashlib.sha256(df.schema.simpleString().encode()).hexdigest()[:16]
    return f"{shape}-{n:x}-{int(a) % (1 << 64):016x}{int(b) % (1 << 64):016x}"


def by_content(df: DataFrame, purpose: str, make: Callable[[DataFrame], DataFrame], folder: str | None = None) -> DataFrame:
    """What ``make`` gives for ``df``, read from the shared folder if it was made for the same rows before.

    One pass over ``df`` tells; a changed row is another table. Two calls at once may both write, with the same result.
    """
    path = f"{folder or shared_dir(df.sparkSession)}/loom-{purpose}-{digest(df)}"
    return kept(df.sparkSession, path, lambda: make(df))


def pools(known: DataFrame, folder: str | None = None) -> dict[str, DataFrame]:
    """(i, pick) of the heads and of the tails of ``known(head, tail)``, numbered from 0 by name."""
    return {c: by_content(known.select(F.col(c).alias("pick")).distinct(), f"pool-{c}", lambda d: numbered(d, "pick", name="i"), folder) for c in ("head", "tail")}


def known_pairs(pairs: DataFrame, folder: str | None = None) -> DataFrame:
    """The distinct ``pairs(head, tail)`` sorted by head and tail within ranges, so that files and row groups tell what they can't hold."""
    return by_content(pairs.select("head", "tail"), "known", lambda d: d.distinct().repartitionByRange("head", "tail").sortWithinPartitions("head", "tail"), folder)


def unknown(made: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``made(head, tail, ...)`` that ``known`` lacks. Where the rows made have few heads, only the known pairs of those take part in the join."""
    own = known.join(made.select("head").distinct(), "head", "left_semi")
    return made.join(own, ["head", "tail"], "left_anti")
