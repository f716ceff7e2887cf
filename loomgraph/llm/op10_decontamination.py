"""Benchmark decontamination with DataFrame functions only.

Windows of a document as long as a benchmark item get a SimHash of their
weighted five-word shingles. Fingerprints are cut into four blocks of 16 bits.
Two within the radius are within a fourth of it on some block, so each item is
indexed under all values that near its own, and a window's own four values fetch
all items within the radius; the exact weighted similarity of the shingle sets
verifies them. A window can only be as similar to an item as the weight of the
item's shingles that it holds allows. A join of the shingles gives where those
are, and a sweep over the starts adds up what each window holds, so every window
that can reach the limit gets a fingerprint, whatever the order of its passages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import WORD, materialize

SHINGLE, SIMILAR = 5, 0.8
#: At similarity 0.8 about 10 of 64 bits differ, with a deviation of 3.
RADIUS, BITS, BLOCK = 19, 64, 16
#: Rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Most words of the sieve, a bit map of the items' shingles ahead of that shuffle; 8 MB.
SIEVE_WORDS = 1 << 20


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def shingles_of(words: Column, k: int) -> Column:
    """Fingerprints of the ``k``-word shingles in order; of the whole sequence if it is shorter, none without words."""
    n = F.size(words)
    whole = F.when(n == 0, F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(F.concat_ws(" ", words))))
    each = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(k)]))
    return F.when(n >= k, each).otherwise(whole)


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _bit(shingle: Column, words: int) -> tuple[Column, Column]:
    return F.shiftrightunsigned(shingle, 6).bitwiseAND(words - 1), F.expr("shiftleft(1L, cast(shingle & 63 as int))")


def sieved(at: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """The rows of ``at`` whose shingle an item can have, by a bit map of at most SIEVE_WORDS longs.

    The map lets through what it can't tell apart, so the join that follows
    decides; it spares that join's shuffle nearly all other shingles of the corpus.
    """
    words = 64
    while words < SIEVE_WORDS and words * 4 < rows:  # 16 bits a shingle
        words *= 2
    word, bit = _bit(F.col("shingle"), words)
    held = sets.select(word.alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = at.sparkSession.range(words).join(held, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    bits = every.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("bits"))
    return at.where(F.element_at(bits.scalar(), (word + 1).cast("int")).bitwiseAND(bit) != 0)


def fingerprint(rows: DataFrame, by: list[str]) -> DataFrame:
    """SimHash (fp) and total weight of rows (by..., shingle, weight)."""
    bit = lambda i: F.when(F.shiftrightunsigned("shingle", i).bitwiseAND(1) == 1, F.col("weight")).otherwise(-F.col("weight"))
    sums = rows.groupBy(*by).agg(F.sum("weight").alias("total"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(64)])
    fp = F.lit(0).cast("long")
    for i in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return sums.select(*by, "total", fp.alias("fp"))


def blocks(fp: Column) -> Column:
    """(block, value): the 16-bit blocks of a fingerprint."""
    parts = [F.shiftrightunsigned(fp, i * BLOCK).bitwiseAND((1 << BLOCK) - 1) for i in range(BITS // BLOCK)]
    return F.explode(F.array(*[F.struct(F.lit(i).alias("block"), p.alias("value")) for i, p in enumerate(parts)]))


def reach(radius: int) -> list[int]:
    """Bits that each block is probed for: were all blocks farther apart than that, the sum would exceed the radius."""
    m = BITS // BLOCK
    left = radius - m + 1
    return [max(0, left // m + (i < left % m)) for i in range(m)]


def probes(fp: Column, radius: int) -> Column:
    """(block, value): every value within reach of each block of a fingerprint."""
    def near(i: int, bits: int) -> Column:
        masks = F.lit(",".join(str(x) for x in range(1 << BLOCK) if x.bit_count() <= bits))
        own = F.shiftrightunsigned(fp, i * BLOCK).bitwiseAND((1 << BLOCK) - 1)
        return F.transform(F.split(masks, ",").cast("array<long>"), lambda x: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(x).alias("value")))

    return F.explode(F.concat(*[near(i, bits) for i, bits in enumerate(reach(radius))]))


def starts(hits: DataFrame, known: DataFrame, n_items: int, k: int, similar: float) -> DataFrame:
    """(row_key, start, n_words) of each window that holds ``similar`` of some item's weight.

    ``hits`` are the places of an item's shingles in a document: (row_key, n, pos,
    item_key, n_words, shingle, weight). A window counts a shingle once, at its first
    place; so a place counts for the starts after the one before it, and the sums
    change only where such a stretch begins or ends.
    """
    one = ["row_key", "item_key", "n_words"]
    hits = hits.select(*one, "n", "pos", "shingle", "weight").distinct().repartition("row_key", "item_key")
    before = F.lag("pos").over(Window.partitionBy(*one, "shingle").orderBy("pos"))
    span = F.greatest(F.lit(1), F.col("n_words") - (k - 1))
    first = F.greatest(F.lit(0), F.col("pos") - span + 1, F.coalesce(before + 1, F.lit(0)))
    last = F.least(F.col("pos"), F.greatest(F.lit(0), F.col("n") - F.col("n_words")))
    change = lambda at, by: F.struct(at.alias("start"), by.alias("by"))
    order = Window.partitionBy(*one).orderBy("start")
    sums = (
        hits.select(*one, "weight", first.alias("first"), last.alias("last"))
        .where("first <= last")
        .select(*one, F.explode(F.array(change(F.col("first"), F.col("weight")), change(F.col("last") + 1, -F.col("weight")))).alias("x"))
        .groupBy(*one, "x.start")
        .agg(F.sum("x.by").alias("by"))
        .withColumn("held", F.sum("by").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("next", F.lead("start").over(order))
    )
    return (
        sums.join(small(known.select("item_key", F.col("total").alias("item_total")), n_items), "item_key")
        .where(F.col("next").isNotNull() & (F.col("held") >= similar * F.col("item_total") - 1e-6))  # sums of doubles
        .select("row_key", "n_words", F.explode(F.sequence("start", F.col("next") - 1)).alias("start"))
        .distinct()
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(row_key, doc_id, item_id, start, n_words, hamming, similarity): the best window of each document and item it leaks.

    ``start`` counts words from 0; row_key tells rows of one id with other texts
    apart. A shingle weighs ln(1 + items / items that hold it), one that no item
    holds as if one did. An item or document of fewer than ``k`` words is one
    shingle, of all its words; without words it matches nothing. Windows are cut
    off at the document's end. Null texts are empty; null ids match like others;
    texts have any length; empty tables on either side give no rows. Ties: of
    equally similar windows the first is given. Rows that repeat are one.
    An item is an id, null or not, and its words: texts of one id are searched
    and given each by itself, rows of the same id and words count once; other
    columns are not read.
    """
    items = (
        benchmark.select("item_id", words_of(F.col("text")).alias("iw"))
        .where(F.size("iw") > 0)
        .select("item_id", F.xxhash64("item_id", F.concat_ws(" ", "iw")).alias("item_key"), "iw")
        .dropDuplicates(["item_key"])
        .select("item_id", "item_key", F.size("iw").alias("n_words"), F.posexplode(shingles_of(F.col("iw"), k)).alias("place", "shingle"))
    )
    items = materialize(items)
    n_items, n_rows = items.agg(F.countDistinct("item_key"), F.count("*")).first()
    weights = items.groupBy("shingle").agg(F.countDistinct("item_key").alias("c")).select("shingle", F.log(1 + F.lit(float(n_items)) / F.col("c")).alias("weight"))
    alone = F.lit(float(n_items))
    sets = materialize(items.select("item_key", "n_words", "shingle").distinct().join(weights, "shingle"))

    key = F.xxhash64("doc_id", "text")
    read = docs.select(key.alias("row_key"), "doc_id", words_of(F.col("text")).alias("w"))
    at = read.select("row_key", "doc_id", F.size("w").alias("n"), F.posexplode(shingles_of(F.col("w"), k)).alias("pos", "shingle"))
    lengths = [r[0] for r in items.where(F.col("n_words") < k).select("n_words").distinct().collect()]
    for m in lengths:  # fewer than k of them: items shorter than a shingle
        at = at.unionByName(
            read.where(F.size("w") > m).select("row_key", "doc_id", F.size("w").alias("n"), F.posexplode(
                F.transform(F.sequence(F.lit(1), F.size("w") - (m - 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, m))))
            ).alias("pos", "shingle"))
        )
    known = materialize(fingerprint(sets, ["item_key", "n_words"]))
    at = at if n_rows <= BROADCAST_ROWS else sieved(at, sets, n_rows)
    begun = materialize(starts(at.join(small(sets, n_rows), "shingle"), known, n_rows, k, similar))
    held = materialize(begun.select("row_key").distinct())
    n_held = held.count()
    again = docs.select(key.alias("row_key"), "doc_id", "text").join(small(held, n_held), "row_key", "left_semi").dropDuplicates(["row_key"])
    window = (
        again.select("row_key", "doc_id", words_of(F.col("text")).alias("w"))
        .join(begun, "row_key")
        .select("row_key", "doc_id", "start", "n_words", F.slice("w", F.col("start") + 1, F.col("n_words")).alias("v"))
        .select("row_key", "doc_id", "start", "n_words", F.explode(F.array_distinct(shingles_of(F.col("v"), k))).alias("shingle"))
        .join(small(weights, n_rows), "shingle", "left")
        .withColumn("weight", F.coalesce("weight", F.log(1 + alone)))
    )
    window = materialize(window)
    place = ["row_key", "start", "n_words"]
    seen = materialize(fingerprint(window, place))
    index = known.select("item_key", "n_words", F.col("fp").alias("item_fp"), F.col("total").alias("item_total"), probes(F.col("fp"), radius).alias("x"))
    index = index.select("item_key", "n_words", "item_fp", "item_total", "x.block", "x.value")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    met = (  # windows that read alike share a fingerprint, which is looked up once
        seen.select("n_words", "fp").distinct()
        .select("n_words", "fp", blocks(F.col("fp")).alias("x"))
        .select("n_words", "fp", "x.block", "x.value")
        .join(index.hint("merge"), ["n_words", "block", "value"])  # its bytes look few, its rows are many: never broadcast
        .where(apart <= radius)
        .select("n_words", "fp", "item_key", "item_total", apart.alias("hamming"))
        .distinct()
    )
    pairs = seen.join(met, ["n_words", "fp"]).select(*place, "item_key", "total", "item_total", "hamming")
    shared = (
        window.join(pairs, place)
        .join(small(sets.select("item_key", "shingle"), n_rows), ["item_key", "shingle"])
        .groupBy(*place, "item_key")
        .agg(F.first("doc_id").alias("doc_id"), F.sum("weight").alias("both"), F.max("total").alias("total"), F.max("item_total").alias("item_total"), F.max("hamming").alias("hamming"))
        .withColumn("similarity", F.round(F.col("both") / (F.col("total") + F.col("item_total") - F.col("both")), 9))
        .where(F.col("similarity") >= similar)
    )
    best = F.max_by(F.struct("start", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    found = shared.groupBy("row_key", "item_key").agg(F.first("doc_id").alias("doc_id"), best.alias("b"))
    return found.join(small(items.select("item_key", "item_id").distinct(), n_rows), "item_key").select("row_key", "doc_id", "item_id", "b.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all columns, whatever their names.

    Nulls, empty and long texts, ties, repeated rows and empty tables are handled
    as in ``find_leaks``: a document without words leaks nothing and is kept.
    """
    leaks = materialize(find_leaks(docs, benchmark, **how).select(F.col("row_key").alias("leak_key")).distinct())
    n = leaks.count()
    return docs.join(small(leaks, n), F.xxhash64(docs["doc_id"], docs["text"]) == leaks["leak_key"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row_key")
