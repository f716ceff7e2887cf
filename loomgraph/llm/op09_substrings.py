"""Suffix-array dedup with a logarithmic family of indexes.

A batch of documents gets a sparse suffix array: of each window of the match
length the suffix at its least ``k``-byte fingerprint, so every long match shares
a kept suffix. The array is a table in the order of the fingerprint of those first
bytes: what is needed of a suffix order is that suffixes that begin alike are
neighbours, and eight bytes a suffix give that. A new batch is merge-scanned
against each level for suffixes that begin alike, then becomes a level; two levels
of one rank merge into the next. Only suffixes found twice have their bytes
fetched, and windows around them are compared whole: a window goes if an equal one
starts earlier. A window that repeats one a short period before it in its own text
is never the first of its kind, so it goes at once and keeps no suffix.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import discard, materialize, shared_dir
from loomgraph.llm.textkit import CHUNK, _powers, lean, mix, signed, text_chunks

LENGTH, K = 100, 32
BATCHES = 4
#: Suffixes that begin alike and are compared in one sorted run; more are dealt over several.
RUN_ROWS = 20_000


def window_hashes(buf: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the ``k`` bytes from each place, or from the places ``at``."""
    n = len(buf)
    r, inv = _powers(n + 1)
    with np.errstate(over="ignore"):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * r[:n], dtype=np.uint64)])
        if at is None:
            return mix((c[k:] - c[: n - k + 1]) * inv[: n - k + 1])
        return mix((c[at + k] - c[at]) * inv[at])


def _pieces(chunks: Iterator[tuple], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """The chunks, a long text in pieces that overlap by a window less one byte, with the place where a piece begins."""
    for first, buf, offs in chunks:
        if len(offs) > 2 or len(buf) <= 2 * CHUNK:
            yield first, buf, offs, 0
            continue
        for at in range(0, len(buf) - length + 1, CHUNK):
            piece = buf[at : at + CHUNK + length - 1]
            yield first, piece, np.array([0, len(piece)]), at


def anchors(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(h, uid, at, stop): kept suffixes; ``at`` packs the place and how many bytes before it its windows may start.

    The window from s keeps the leftmost of its suffixes with the least
    fingerprint, which depends on the window's bytes alone. Where the suffix
    before has the same fingerprint, at the distance of a period, windows that
    equal the one a period earlier are not kept: a row with a ``stop`` says that
    the bytes from ``at`` to there go, whatever else is found. So a text that
    repeats one letter has one suffix, however long it is.
    """
    width = length - k + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, buf, offs, base in _pieces(text_chunks(b.column(1)), length):
                if len(buf) < length:
                    continue
                g = window_hashes(buf, k)
                cur = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
                size = 1
                while size * 2 <= width:
                    cur = np.minimum(cur[:-size], cur[size:])
                    size *= 2
                if size < width:
                    cur = np.minimum(cur[: len(cur) - (width - size)], cur[width - size :])
                row_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(cur)]
                s = np.flatnonzero(np.arange(len(cur)) + length <= offs[1:][row_of])
                if not len(s):
                    continue
                a, row = (cur[s] & np.uint64(0xFFFFFFFF)).astype(np.int64), row_of[s]
                start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
                group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(s))))
                period = np.zeros(len(start), dtype=np.int64)
                head = a[start]
                period[1:] = np.where((row[start[1:]] == row[start[:-1]]) & (g[head[1:]] == g[head[:-1]]), head[1:] - head[:-1], 0)
                p = period[group]
                again = np.flatnonzero((p > 0) & (s - p >= offs[row]))
                if len(again):
                    same = window_hashes(buf, length, s[again]) == window_hashes(buf, length, s[again] - p[again])
                    again = again[same]
                if len(again):
                    z, r = s[again], row[again]
                    cut = np.flatnonzero(np.concatenate([[True], (np.diff(z) != 1) | (np.diff(r) != 0)]))
                    end = np.append(cut[1:], len(z)) - 1
                    uid, lo = ids[first + r[cut]], z[cut] - offs[r[cut]] + base
                    with np.errstate(over="ignore"):
                        spread = mix(uid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64))  # any bucket does
                    yield pa.RecordBatch.from_arrays([pa.array(signed(spread)), pa.array(uid), pa.array(lo), pa.array(z[end] - offs[r[cut]] + base + length)], ["h", "uid", "at", "stop"])
                    left = np.ones(len(s), dtype=bool)
                    left[again] = False
                    s, a, row = s[left], a[left], row[left]
                    if not len(s):
                        continue
                    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (row[1:] != row[:-1])]))
                stop = np.append(start[1:], len(s)) - 1
                # between the first and the last window of a suffix all are compared, also those that were known to go
                a, row = a[start], row[start]
                at = ((a - offs[row] + base) << 16) | ((a - s[stop]) << 8) | (a - s[start])
                yield pa.RecordBatch.from_arrays([pa.array(signed(g[a])), pa.array(ids[first + row]), pa.array(at), pa.nulls(len(at), pa.int64())], ["h", "uid", "at", "stop"])

    return docs.select("uid", "text").mapInArrow(lean(emit), "h long, uid long, at long, stop long")


class SuffixFamily:
    """Levels of sorted suffix tables; level ranks are powers of two of a batch."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, str]] = []

    def _write(self, rows: DataFrame) -> str:
        """A bucketed table whose files are in the shared folder, as executors may not see the driver's warehouse."""
        name = f"loom_suffixes_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        try:
            rows.repartition(n, "h").write.bucketBy(n, "h").sortBy("h").option("compression", "zstd").option("path", self._folder(name)).saveAsTable(name)
        except BaseException:
            self._drop(name)
            raise
        return name

    def _folder(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/{name}"

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(self._folder(name))
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    def add(self, batch: DataFrame, merge: bool = True) -> DataFrame:
        """Index the suffixes ``batch(h, uid, at, stop)``: fingerprints that it holds twice or that a level holds."""
        name = self._write(batch)
        new = self.spark.table(name)
        found = new.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
        for _, level in self.levels:
            found = found.unionByName(new.join(self.spark.table(level).select("h"), "h", "left_semi").select("h").distinct())
        found = materialize(found.distinct())
        self.levels.append((0, name))
        while merge and len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._write(self.spark.table(a).unionByName(self.spark.table(b)))))
            for x in (a, b):
                self._drop(x)
        return found

    def rows(self) -> DataFrame:
        """All suffixes and known spans that the levels hold."""
        out = self.spark.table(self.levels[0][1])
        for _, level in self.levels[1:]:
            out = out.unionByName(self.spark.table(level))
        return out

    def drop(self) -> None:
        for _, level in self.levels:
            self._drop(level)
        self.levels = []


def ordered(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text): uids are unique and in the order of ids, null first, then of a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        return docs.select(F.coalesce("doc_id", F.lit(0)).alias("uid"), "doc_id", "text")
    far = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return materialize(far.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"))


def later_copies(rows: DataFrame) -> DataFrame:
    """(copy): uids of texts that a smaller uid has as well, byte for byte.

    All their windows start earlier and none of theirs is the first, so they go
    whole and no other document needs their bytes.
    """
    seen = rows.select("uid", F.sha2(F.coalesce("text", F.lit("")), 256).alias("dg"))
    first = seen.groupBy("dg").agg(F.min("uid").alias("least"), F.count("*").alias("c")).where("c > 1")
    return seen.join(first, "dg").where("uid > least").select(F.col("uid").alias("copy"))


def _contexts(length: int, k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py().encode()
                every = b.column(2)[i].values
                for j in range(0, len(every), 20_000):
                    seeds = every.slice(j, 20_000)
                    h, at = seeds.field("h"), seeds.field("at").to_numpy(zero_copy_only=False)
                    pos, lo, hi = at >> 16, (at >> 8) & 255, at & 255
                    # the suffix's own k bytes are the same in all rows of h
                    ctx = [raw[p:m] + raw[m + k : q] for p, m, q in zip((pos - hi).tolist(), pos.tolist(), (pos - lo + length).tolist())]
                    yield pa.RecordBatch.from_arrays([h, pa.array(np.full(len(at), b.column(0)[i].as_py())), pa.array(at), pa.array(ctx, pa.binary()), seeds.field("runs")], ["h", "uid", "at", "ctx", "runs"])

    return emit


def _later(length: int, k: int):
    """Of rows sorted by (h, uid, at): the bytes of windows that an earlier row holds as well.

    Of a suffix in ``runs`` > 1 the windows first seen here come as well, with
    their fingerprint ``w``: another run may hold an earlier one. One chunk of
    rows and the window fingerprints of one suffix are held.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_h, seen = None, np.zeros(0, np.uint64)
        for whole in batches:
            for at0 in range(0, whole.num_rows, 20_000):
                b = whole.slice(at0, 20_000)
                h, uid, at, runs = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
                ctx = b.column(3)
                offs = np.frombuffer(ctx.buffers()[1], dtype=np.int32)[ctx.offset : ctx.offset + len(ctx) + 1].astype(np.int64)
                buf = np.frombuffer(ctx.buffers()[2], dtype=np.uint8)[offs[0] : offs[-1]]
                offs = offs - offs[0]
                pos, lo, hi = at >> 16, (at >> 8) & 255, at & 255
                n = hi - lo + 1
                row = np.repeat(np.arange(len(at)), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = window_hashes(buf, length - k, offs[:-1][row] + j)
                with np.errstate(over="ignore"):  # a window is its suffix, how many bytes come before that, and the other bytes
                    w = mix(w ^ mix(h.view(np.uint64)[row] + (hi[row] - j).astype(np.uint64)))
                _, first, inverse = np.unique(w, return_index=True, return_inverse=True)
                again = first[inverse] != np.arange(len(w))
                if open_h is not None and h[0] == open_h:
                    own = h[row] == open_h
                    again[own] |= np.isin(w[own], seen)
                last = np.unique(w[h[row] == h[-1]])
                seen = np.union1d(seen, last) if open_h == h[-1] else last
                open_h = h[-1]
                place = (pos - hi)[row] + j
                d = np.flatnonzero(again)
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 1) | (np.diff(row[d]) != 0)])[: len(d)])
                end = np.append(cut[1:], len(d))[: len(cut)] - 1
                f = np.flatnonzero(~again & (runs[row] > 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([uid[row[d[cut]]], uid[row[f]]])),
                        pa.array(np.concatenate([place[d[cut]], place[f]])),
                        pa.array(np.concatenate([place[d[end]], place[f]]) + length),
                        pa.concat_arrays([pa.nulls(len(cut), pa.int64()), pa.array(signed(w[f]))]),
                    ],
                    ["uid", "a", "b", "w"],
                )

    return emit


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i in range(b.num_rows):
            raw = (b.column(1)[i].as_py() or "").encode()
            spans = b.column(2)[i].values
            if b.column(3)[i].as_py() and len(raw) >= length:
                out.append((len(raw), len(raw), 1, hashlib.sha256(b"").hexdigest()))
                continue
            kept, at, removed, n = hashlib.sha256(), 0, 0, 0
            if spans is not None and len(spans):
                a, z = spans.field("a").to_numpy(zero_copy_only=False), spans.field("b").to_numpy(zero_copy_only=False)
                order = np.argsort(a, kind="stable")
                a, z = a[order], np.maximum.accumulate(z[order])
                start = np.flatnonzero(np.concatenate([[True], a[1:] > z[:-1]]))
                for x, y in zip(a[start].tolist(), z[np.append(start[1:], len(a)) - 1].tolist()):
                    kept.update(raw[at:x])
                    at, removed, n = y, removed + y - x, n + 1
            kept.update(raw[at:])
            out.append((len(raw), removed, n, kept.hexdigest()))
        cols = [*zip(*out)] or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _seeds(suffixes: DataFrame, found: list[DataFrame], copies: DataFrame, run_rows: int) -> tuple[DataFrame, DataFrame]:
    """((uid, rare, often): each document's suffixes that are found again, (often, runs): those of more than ``run_rows`` rows)."""
    twice = found[0]
    for f in found[1:]:
        twice = twice.unionByName(f)
    again = suffixes.join(twice.distinct(), "h", "left_semi")
    often = materialize(
        again.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > run_rows).select(F.col("h").alias("often"), F.ceil(F.col("c") / run_rows).alias("runs"))
    )
    told_apart = again.join(often, F.col("h") == F.col("often"), "left")
    by_doc = told_apart.groupBy("uid").agg(
        F.collect_list(F.when(F.col("runs").isNull(), F.struct("h", "at", F.lit(1).cast("long").alias("runs")))).alias("rare"),
        F.collect_list(F.when(F.col("runs").isNotNull(), F.struct("h", "at", "runs"))).alias("often"),
    )
    return materialize(by_doc.join(copies, F.col("uid") == F.col("copy"), "left_anti")), often


def dedup_substrings(docs: DataFrame, length: int = LENGTH, k: int = K, batches: int = BATCHES, run_rows: int = RUN_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, null is empty. A byte goes if a ``length``-byte string
    over it starts earlier in the input: in a smaller doc_id, or before in its
    document. Rows of one id go by a hash of the text, rows without an id come
    first; each is a document of its own, and equal ones go in any order. Texts
    have any length; an empty table gives no rows. Other columns are not read. A
    suffix found more than ``run_rows`` times is compared in several runs, and of each
    window the first of every run are compared once more. ``length`` may exceed
    ``k`` by 255 at most, as two offsets of a suffix take a byte each.
    """
    if not 0 < k < length <= k + 255:
        raise ValueError("length must be more than k, by 255 at most")
    spark = docs.sparkSession
    rows = ordered(docs)
    cuts = rows.agg(F.percentile_approx("uid", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    bounds = [None, *dict.fromkeys(cuts), None]
    family, found = SuffixFamily(spark), []
    try:
        for i, (a, z) in enumerate(zip(bounds, bounds[1:])):
            batch = rows if a is None else rows.where(F.col("uid") > a)
            batch = batch if z is None else batch.where(F.col("uid") <= z)
            found.append(family.add(anchors(batch, length, k), merge=i + 2 < len(bounds)))
        copies = materialize(later_copies(rows))
        known = materialize(family.rows().where("stop is not null").select("uid", F.col("at").alias("a"), F.col("stop").alias("b")).join(copies, F.col("uid") == F.col("copy"), "left_anti"))
        seeds, often = _seeds(family.rows().where("stop is null"), found, copies, run_rows)
    finally:
        family.drop()
    for f in (*found, often):
        discard(f)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.repartition(n, "uid")

    def found_again(kind: str) -> DataFrame:
        own = seeds.where(F.size(kind) > 0).select(F.col("uid").alias("key"), F.col(kind).alias("seeds"))
        hit = texts.join(own, F.col("uid") == F.col("key")).select("uid", "text", "seeds")
        windows = hit.mapInArrow(_contexts(length, k), "h long, uid long, at long, ctx binary, runs long")
        to = [F.pmod(F.xxhash64("uid", "at"), "runs")] if kind == "often" else []
        return windows.repartition(n, "h", *to).sortWithinPartitions("h", "uid", "at").mapInArrow(_later(length, k), "uid long, a long, b long, w long")

    # what is known to be a copy gets a group of its own; of the first windows of runs all but one are copies
    group = F.coalesce("w", F.xxhash64("uid", "a"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.col("w").isNull(), "uid", "a"))
    over_runs = found_again("often").withColumn("nth", nth).where("w is null or nth > 1").select("uid", "a", "b")
    spans = (
        found_again("rare").select("uid", "a", "b").unionByName(over_runs).unionByName(known).groupBy(F.col("uid").alias("key")).agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )
    told = texts.join(spans, F.col("uid") == F.col("key"), "left").join(copies, F.col("uid") == F.col("copy"), "left")
    return told.select("doc_id", "text", "spans", F.col("copy").isNotNull().alias("whole")).mapInArrow(
        lambda batches: _cut(batches, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
