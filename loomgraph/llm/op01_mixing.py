"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target number of words; the repetition rate of its documents
is target / size, so a document comes floor(rate) times plus once more with the
probability of the fraction, decided by a hash of its id and a seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import WORD, columns_of, free_names

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the key and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order, null last, take the weights in turn. All targets
    together are all sizes together; a target stops at ``limit`` times its
    source's size and the excess goes to the others by weight, until none is
    above. That is min(limit * size, level * weight) for one level: with sources
    ordered by cap / weight, the first k are full and the level is what the caps
    leave over the weights that are left. One row a source reaches the windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    dec = "decimal(30,0)"
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast(dec)).withColumn(
        "cap", (F.col("source_size").cast(dec) * limit).cast(dec)
    )
    by = Window.orderBy((F.col("cap") / F.col("w")).cast("double"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum(F.col("source_size")).over(all_rows).cast(dec))
        .withColumn("left_t", (F.col("total") - F.coalesce(F.sum("cap").over(before).cast(dec), F.lit(0).cast(dec))).cast(dec))
        .withColumn("left_w", (F.sum("w").over(all_rows).cast(dec) - F.coalesce(F.sum("w").over(before).cast(dec), F.lit(0).cast(dec))).cast(dec))
        .withColumn("full", F.col("cap").cast("double") * F.col("left_w").cast("double") < F.col("left_t").cast("double") * F.col("w").cast("double"))
    )
    # the first source that its share does not fill sets the level for itself and all after it
    level = F.first(F.when(~F.col("full"), F.struct("left_t", "left_w")), ignorenulls=True).over(
        by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    open_ = F.max((~F.col("full")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return (
        per.withColumn("level", level)
        .withColumn("open", open_)
        .select(
            "source",
            "source_size",
            F.when(
                F.col("open"),
                F.col("level.left_t").cast("double") * F.col("w").cast("double") / F.col("level.left_w").cast("double"),
            )
            .otherwise(F.col("cap").cast("double"))
            .alias("target"),
        )
    )


def _rated(docs: DataFrame, names: list[str], weights, limit: int, seed: str) -> DataFrame:
    """All columns of ``docs`` and, under the four free ``names``, size, source's size, its target and copies."""
    size, source_size, target, n = names
    (source,) = free_names(docs.select("*", *[F.lit(None).alias(x) for x in names]), "mix_source")
    sized = docs.select(*columns_of(docs), n_words(docs["text"]).alias(size))
    per = source_targets(sized.select(sized["source"].alias("source"), F.col(size).alias("size")), weights, limit).select(
        F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target)
    )
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = F.least(whole + (uniform(F.col("doc_id"), seed) < rate - whole).cast("long"), F.lit(limit).cast("long"))
    return sized.join(per, sized["source"].eqNullSafe(per[source]), "left").drop(source).withColumn(n, copies.cast("long"))


def with_copies(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies (columns of that name are replaced).

    Empty table: empty result. Null or empty text, or a source without words: no
    words to take, so no copies where the source has none. Null source: a source of its own,
    after all others. Long texts are counted whole. Repeated rows draw the same
    number, as it depends on the id and the seed alone; a null id draws one as
    well. Ties: sources that fill up at one level go by code point, and a draw
    equal to the fraction takes no copy. The table of sources is joined by key; a
    source with a third of all rows is split by adaptive execution or meets a
    broadcast that its size allows.
    """
    names = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    return _rated(docs.drop(*names), names, weights, limit, seed)


def mix_sources(docs: DataFrame, weights=WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """Every document as often as the mix takes it: the rows of ``docs``, repeated, with all its columns and no others.

    Columns may have any name. Nulls, empty and long texts, ties, repeated rows
    and empty tables are handled as in ``with_copies``.
    """
    *names, turn = free_names(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_n")
    got = _rated(docs, names, weights, limit, seed).where(F.col(names[3]) > 0)
    return got.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).select(*columns_of(docs))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return with_copies(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS i FROM per
), rest AS (
  SELECT a.*, (SELECT sum(source_size) FROM per) - coalesce((SELECT sum(b.cap) FROM ordered b WHERE b.i < a.i), 0) AS left_t,
         (SELECT sum(w) FROM per) - coalesce((SELECT sum(b.w) FROM ordered b WHERE b.i < a.i), 0) AS left_w
  FROM ordered a
), stop AS (
  SELECT i, left_t, left_w FROM rest WHERE cap * left_w >= left_t * w ORDER BY i LIMIT 1
), goal AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.i >= s.i THEN s.left_t::DOUBLE * r.w::DOUBLE / s.left_w::DOUBLE ELSE r.cap::DOUBLE END AS target
  FROM rest r CROSS JOIN stop s
), rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM rated
"""
