"""Importance resampling towards a target distribution.

Every document gets a weight from an array of integer gains, one a hash bucket
of its features, and a score that adds Gumbel noise of its own, so that the
highest scores are a draw without replacement in proportion to exp(weight / 1000).
Which scores survive is read off an exact histogram of integer scores: counts
summed from above give every score its first rank and the score where the draw
ends. Documents are numbered only within one surviving score each, so nothing
is sorted as a whole.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import materialize
from loomgraph.llm.textkit import lean

BUCKETS = 10_000
NGRAM = 1
#: Documents of fewer words are not drawn; of the others so many in a hundred are.
MIN_WORDS, PERCENT = 20, 10
SEED = 2024
#: Features whose bucket a task remembers, and the longest of them in bytes.
CACHED, CACHED_BYTES = 400_000, 64
#: Scores that one block of the histogram covers.
SPAN = 256

#: Fixed value: digits, lower-case letters and everything beyond ASCII belong to words.
_WORDS = bytes(b + 32 if 65 <= b < 91 else b if b >= 128 or 48 <= b < 58 or 97 <= b < 123 else 32 for b in range(256))


class Buckets(dict):
    """Bucket of a feature, by the checksum of its bytes; emptied when it is full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        got = zlib.crc32(feature) % self.buckets
        if len(feature) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[feature] = got
        return got


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def features(words: list[bytes], ngram: int) -> Iterator[bytes]:
    """Runs of 1 to ``ngram`` consecutive words."""
    yield from words
    for n in range(2, ngram + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM) -> DataFrame:
    """(bucket, n) of all features of ``texts(text)``: each task adds up its own, so few rows are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                words = words_of(text.as_py())
                if words:
                    total += np.bincount(np.fromiter(map(of.__getitem__, features(words, ngram)), np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket; both tables have ``buckets`` rows at most, whatever the corpus."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for into, table in ((s, corpus), (t, target)):
        for bucket, n in table.collect():
            into[bucket] = n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((a + 1.0) * all_s / ((b + 1.0) * all_t))) for a, b in zip(t.tolist(), s.tolist())], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of ``docs(doc_id, text)``."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(len(gains))
        for b in batches:
            n_words, n_features, weight, total = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(text.as_py())
                at = np.fromiter(map(of.__getitem__, features(words, ngram)), np.int64) if words else np.zeros(0, np.int64)
                n_words.append(len(words))
                n_features.append(len(at))
                weight.append(int(gains[at].sum()) // len(at) if len(at) else 0)
                total.append(None if doc is None else weight[-1] + noise(doc, seed))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight, total))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(score), ", ".join(f"{n} long" for n in names))


def first_ranks(eligible: DataFrame, span: int = SPAN) -> DataFrame:
    """(score, start): how many rows of ``eligible(score)`` have a greater score, for each score there is.

    Counts are summed over blocks of ``span`` scores first, of which there are a
    few hundred at most, and then within each block.
    """
    counts = eligible.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("score") / span))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("block").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    return counts.join(blocks, "block").select("score", (F.col("above") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("start"))


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngram: int = NGRAM, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of ``docs(doc_id, text)``; ``target(text)`` is what to come near.

    Of the N rows with an id and ``min_words`` words at least, the
    floor(percent * N / 100) of highest score are drawn and ranked from 1; the
    others have no rank. Ties go to the smaller doc_id. A null or empty text has
    no features and weight 0. A row without an id has no noise, so neither score
    nor rank. Rows that repeat an id are ranked one by one, in the order of
    their number of features; of rows equal in that as well any may come first.
    An empty target has a gain by the corpus alone; an empty table of documents
    gives no rows. Texts are read whole; other columns are not read.

    The noise parts even rows of equal text: no score can hold more than one in
    2,700 of all ids, so numbering within a score stays spread over tasks.
    """
    gains = gains_of(bucket_counts(docs, buckets, ngram), bucket_counts(target, buckets, ngram), buckets)
    scored = materialize(score_documents(docs, gains, ngram, seed))
    may = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    draws = percent * scored.where(may).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not draws:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    starts = materialize(first_ranks(scored.where(may)).where(F.col("start") < draws))
    cutoff = starts.agg(F.min("score")).first()[0]
    order = Window.partitionBy("score").orderBy("doc_id", "n_features")
    place = F.col("start") + F.row_number().over(order)
    drawn = scored.where(may & (F.col("score") >= cutoff)).join(starts, "score").select(*out, place.alias("rank"))
    rest = scored.where(~may | (F.col("score") < cutoff)).select(*out, F.lit(None).cast("long").alias("rank"))
    return drawn.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank"))).unionByName(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: The checksum is folded over bytes with a table that the query makes by shifts, once a distinct word.
SQL = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step
), words AS (
    SELECT 's' AS side, row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
    UNION ALL
    SELECT 't', 0, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark
), each AS (SELECT side, row, unnest(words) AS word FROM words
), hexed AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM each)
), placed AS (
    SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
                                 lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
    FROM hexed, crc
), counted AS (
    SELECT bucket, sum((side = 's')::BIGINT) AS s, sum((side = 't')::BIGINT) AS t FROM each JOIN placed USING (word) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM counted) + 10000) / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM counted) + 10000))))::BIGINT AS gain
    FROM counted
), weighed AS (
    SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM each JOIN placed USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY row
), scored AS (
    SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
           (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
    FROM words LEFT JOIN weighed USING (row) WHERE side = 's'
), ranked AS (
    SELECT *, n_features >= 20 AND score IS NOT NULL AS may,
           row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN may AND place <= 10 * (SELECT count(*) FROM ranked WHERE may) // 100 THEN place END AS rank
FROM ranked
"""
