"""Best-fit packing in bulk-synchronous rounds over documents and gaps.

Every round sorts what is not placed yet, documents and the gaps of open
sequences together, by size into ranges. Each range is swept from large to small:
a document takes the least gap that has room for it, its successor in size, and
what is left of the gap goes on. A document that finds no gap in its own range
is matched with a range above: ranges tell how many documents wait and how many
gaps they offer, and the sweep goes on over these counts, so that the document
of rank i takes the gap of a rank that follows from i; no two want the same one.
Gaps are updated and the next round begins. Sequences are opened only for
documents that no gap can hold any more, as few as their tokens need.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.op02_embeddings import in_runs
from loomgraph.llm.shared import materialize
from loomgraph.llm.textkit import LOWER, _powers, lean, mix, text_chunks
from loomgraph.llm.vocab import Chunks, tokenizer as load

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4_096
#: The id that ends every document.
END = 1
#: Rows that a range aims at, and the greatest number of ranges; with more rows, ranges grow.
RANGE_ROWS, RANGES = 4_000, 20_000
#: White space in ASCII, letters, digits, other marks in ASCII, and what a word is handled as a whole for.
_KIND = np.array([4 if b >= 128 or b == 39 else 0 if b in (32, *range(9, 14)) else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: How the tokenizer divides a lower-case ASCII word, and marks that it parts from a letter before them.
_PARTS, _MARKS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t\n\v\f\r a-z0-9]+"), ",.;:!?"
#: Units, and parts of those that are cut further, whose ids a worker remembers; units that are encoded in one text; bytes of text that are handled at once.
UNITS, PARTS, TOGETHER, CHUNK = 300_000, 100_000, 256, 2_000_000
#: Kinds of rows in a sweep; gaps come before documents of their size.
GAP, WAITS, PLACED = 0, 1, 2
_SWEPT = "kind int, id long, size int, part int, rank long, sequence long"


def parts_of(word: str) -> list[str]:
    """Parts of a word with an apostrophe or characters beyond ASCII that give the same ids alone as in it."""
    if word.isascii():
        return _PARTS.findall(word.lower())
    body = word.rstrip(_MARKS)
    return [body, word[len(body) :]] if body[-1:].isalpha() and len(body) < len(word) else [word]


@functools.lru_cache(2)
def known_units(name: str) -> Chunks:
    """Ids of units by the tokenizer ``name``, as bytes; what a worker has learnt stays from task to task.

    Parts that are one run of letters, digits or marks are encoded many at a time: the last id of each run ends a word.
    """
    tool = load(name, False)
    ends = np.zeros(tool.get_vocab_size(), bool)
    ends[[i for w, i in tool.get_vocab().items() if w.endswith("</w>")]] = True

    def encode(parts: list[str]) -> list[bytes]:
        found = tool.encode_batch_fast([" ".join(parts[i : i + TOGETHER]) for i in range(0, len(parts), TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        at = np.append(0, np.flatnonzero(ends[ids]) + 1).tolist()
        if len(at) != len(parts) + 1:  # one of them was more than one run
            return [np.array(e.ids, "<u4").tobytes() for e in tool.encode_batch_fast(parts, add_special_tokens=False)]
        raw = ids.tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(at, at[1:])]

    def many(parts: list[str]) -> list[bytes]:
        single = [p.isascii() or p.isalpha() for p in parts]
        runs, others = ([p for p, one in zip(parts, single) if one is which] for which in (True, False))
        alone = tool.encode_batch_fast(others, add_special_tokens=False)
        a, b = iter(encode(runs) if runs else []), (np.array(e.ids, "<u4").tobytes() for e in alone)
        return [next(a if one else b) for one in single]

    inner = Chunks(many, PARTS)

    def make(units: list[str]) -> list[bytes]:
        plain = [u.isascii() and "'" not in u for u in units]
        cut = [parts_of(u) for u, easy in zip(units, plain) if not easy]
        easy = [u for u, own in zip(units, plain) if own]
        ids, runs = iter(inner.of([p for own in cut for p in own])), iter(encode(easy) if easy else [])
        words = (b"".join([next(ids) for _ in own]) for own in cut)
        return [next(runs if own else words) for own in plain]

    return Chunks(make, UNITS)


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first byte, byte after the last, and the first one of each row) of the units of some rows of text.

    White space in ASCII parts words. A word of ASCII without an apostrophe is cut
    where the tokenizer cuts it, into runs of letters, digits and runs of marks;
    another one is a unit. A-Z count as a-z, as they do for the tokenizer.
    """
    n = len(buf)
    kind = _KIND[buf]
    space = kind == 0
    begin = np.append(True, space[:-1]) & ~space
    row = offs[:-1][offs[:-1] < n]
    begin[row] = ~space[row]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(offs), np.int64)
    whole = np.logical_or.reduceat(kind == 4, starts)[np.maximum(np.cumsum(begin) - 1, 0)]
    begin |= ~space & ~whole & ((kind != np.append(0, kind[:-1])) | (kind == 2))
    starts = np.flatnonzero(begin)
    over = np.append(space[1:] | begin[1:], True)  # a unit ends before white space, the next one, or the end of its row
    over[offs[offs > 0] - 1] = True
    r, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        v = (LOWER[buf].astype(np.uint64) + np.uint64(1)) * r[:n]
        v[space] = 0
        hashes = mix(np.add.reduceat(v, starts) * inverse[starts])
    return hashes, starts, np.flatnonzero(over & ~space) + 1, np.searchsorted(starts, offs)


def ids_of_rows(buf: np.ndarray, offs: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows of some text one after the other, where each row's begin). Equal units of the rows are looked up once."""
    hashes, starts, ends, first = units(buf, offs)
    if not len(hashes):
        return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = buf.tobytes()
    ids = known_units(name).of([raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
    n = np.array([len(x) // 4 for x in ids])
    flat, begin, lengths = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(n) - n, n[which]
    to = np.append(0, np.cumsum(lengths))
    return flat[np.repeat(begin[which] - to[:-1], lengths) + np.arange(to[-1])], to[first]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]) of ``docs(doc_id, text)``; ids are little-endian 32-bit numbers.

    ``uid`` tells pieces apart, whatever their ids; it is only steady once the rows are written.
    """
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    end = np.array([END], "<u4").tobytes()

    def texts(b: pa.RecordBatch) -> Iterator[bytes]:
        for row, buf, offs in text_chunks(b.column(1), CHUNK):
            ids, first = ids_of_rows(buf, offs, tokenizer)
            for i in range(len(offs) - 1):
                own = ids[first[i] : first[i + 1]]
                if b"<|" in (raw := buf[offs[i] : offs[i + 1]].tobytes()):  # special tokens begin so, and are told by their case
                    own = np.array(load(tokenizer, False).encode(raw.decode(), add_special_tokens=False).ids, "<u4")
                yield own.tobytes() + end

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), texts(b)):
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((uid, doc, n, at // 4, len(cut) // 4, zlib.crc32(cut), cut if keep_ids else None))
                    uid += 1
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(cols[: 7 if keep_ids else 6], names[: 7 if keep_ids else 6])

    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(encode), schema)


def sweep(sizes: list[int], kinds: list[int]) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]]]:
    """Best fit within one range, which is sorted by size from large to small, gaps first among equals.

    Returns (document, gap) pairs, waiting documents, and (gap, what it has left), all by position.
    """
    pairs, waiting = [], []
    open_: list[tuple[int, int]] = []  # gaps for which documents were small enough so far; the least is last
    later: list[tuple[int, int]] = []  # rests of gaps that documents are still too large for
    for at, (size, kind) in enumerate(zip(sizes, kinds)):
        while later and -later[0][0] >= size:
            rest, gap = heapq.heappop(later)
            open_.append((-rest, gap))
        if kind == GAP:
            open_.append((size, at))
        elif not open_:
            waiting.append(at)
        else:
            has, gap = open_.pop()
            pairs.append((at, gap))
            if has - size >= size:
                open_.append((has - size, gap))
            else:
                heapq.heappush(later, (size - has, gap))
    return pairs, waiting, [(gap, has) for has, gap in open_] + [(gap, -rest) for rest, gap in later]


def _sweep_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps every range of a task's rows, which are sorted by range; see _SWEPT."""
    for b, at in in_runs(batches, ["part"]):
        part, size, kind, ids = (b.column(c).to_numpy() for c in ("part", "size", "kind", "id"))
        rows = []
        for s, e in zip(at, at[1:]):
            own, p, floor = ids[s:e].tolist(), int(part[s]), int(size[e - 1])
            sizes = size[s:e].tolist()
            pairs, waiting, gaps = sweep(sizes, kind[s:e].tolist())
            rows += [(PLACED, own[d], sizes[d], p, None, own[g]) for d, g in pairs]
            rows += [(WAITS, own[d], sizes[d], p, n, None) for n, d in enumerate(waiting)]
            # gaps at least as large as all that comes after this range are offered to it, the least first
            gaps.sort(key=lambda g: (g[1], g[0]))
            offered = 0
            for g, has in gaps:
                rows.append((GAP, own[g], has, p, offered if has >= floor else None, None))
                offered += has >= floor
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in _SWEPT.split(", ")])


def sweep_over_ranges(told: dict[int, dict[int, tuple[int, int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of waiting documents take which ranks of gaps of ranges above: (part, from, to, gap part, first gap, documents a gap).

    ``told`` has (count, least, greatest) by range and kind; ranges count from the largest sizes down.
    A gap takes as many documents as the least gap offered has room for the greatest document.
    """
    out, open_ = [], []
    for part in sorted(told):
        n, _, greatest = told[part].get(WAITS, (0, 0, 0))
        done = 0
        while done < n and open_:
            above, first, left, least = open_.pop()
            each = least // greatest
            take = min(n - done, left * each)
            used = -(-take // each)
            out.append((part, done, done + take, above, first, each))
            done += take
            if used < left:
                open_.append((above, first + used, left - used, least))
        if GAP in told[part]:
            count, least, _ = told[part][GAP]
            open_.append((part, 0, count, least))
    return out


def ranges_of(counts: list[tuple[int, int, int]], rows: int, most: int) -> list[tuple[int, int, int, int]]:
    """(size, kind, first part, parts) for (size, kind, n), from large to small; a frequent size has parts of its own."""
    goal, out, part, held = max(rows, -(-sum(c[2] for c in counts) // most)), [], 0, 0
    for size, kind, n in sorted(counts, key=lambda c: (-c[0], c[1])):
        if n >= 2 * goal:
            part += held > 0
            out.append((size, kind, part, -(-n // goal)))
            part, held = part + -(-n // goal), 0
            continue
        out.append((size, kind, part, 1))
        held += n
        if held >= goal:
            part, held = part + 1, 0
    return out


def place(items: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """(uid, length, sequence) for ``items(uid long, length long)``, whose lengths are in 1..capacity.

    Items of full length get a sequence of their own, with a number below 0.
    """
    spark = items.sparkSession
    full = items.where(F.col("length") == capacity).select("uid", "length", (-F.col("uid") - 1).alias("sequence"))
    done = [full]
    state = items.where(F.col("length") < capacity).select(
        F.lit(WAITS).alias("kind"), F.col("uid").alias("id"), F.col("length").cast("int").alias("size"), F.lit(None).cast("long").alias("sequence")
    )
    opened = 0
    while True:
        # a row for each size and kind, so never more than twice the capacity
        counts = [(r[0], r[1], r[2]) for r in state.where(F.col("kind") != PLACED).groupBy("size", "kind").count().collect()]
        docs = [(size, n) for size, kind, n in counts if kind == WAITS]
        if not docs:
            break
        least, widest = min(d[0] for d in docs), max((size for size, kind, _ in counts if kind == GAP), default=0)
        homeless = [(size, n) for size, n in docs if size > widest]
        new = max(-(-sum(size * n for size, n in homeless) // capacity), sum(n for size, n in homeless if 2 * size > capacity))
        counts = [c for c in counts if c[0] >= least] + ([(capacity, GAP, new)] if new else [])
        # bounded by the sizes there are, so it can be sent to all tasks
        bounds = F.broadcast(spark.createDataFrame(ranges_of(counts, range_rows, ranges), "size int, kind int, first int, parts int"))
        fresh = spark.range(opened, opened + new).select(F.lit(GAP).alias("kind"), "id", F.lit(capacity).alias("size"), F.lit(None).cast("long").alias("sequence"))
        opened += new
        rows = state.where((F.col("kind") != PLACED) & (F.col("size") >= least)).unionByName(fresh).drop("sequence").join(bounds, ["size", "kind"])
        rows = rows.select("kind", "id", "size", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"))
        swept = materialize(rows.repartition("part").sortWithinPartitions("part", F.desc("size"), "kind", "id").mapInArrow(_sweep_ranges, _SWEPT))
        told: dict = {}
        for part, kind, *what in swept.where("rank is not null").groupBy("part", "kind").agg(F.count("*"), F.min("size"), F.max("size")).collect():
            told.setdefault(part, {})[kind] = tuple(what)
        links = spark.createDataFrame(sweep_over_ranges(told), "part int, begin long, finish long, above int, first long, each long")
        # a few rows for each range, whose number is bounded
        met = swept.where(F.col("kind") == WAITS).join(
            F.broadcast(links), (swept["part"] == links["part"]) & (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("finish")), "left"
        )
        met = met.select("id", "size", F.col("above").alias("part"), (F.col("first") + F.floor((F.col("rank") - F.col("begin")) / F.col("each"))).alias("rank"))
        gaps = swept.where(F.col("kind") == GAP).select(F.col("id").alias("sequence"), F.col("size").alias("has"), "part", "rank")
        taken = met.where("part is not null").groupBy("part", "rank").agg(F.collect_list(F.struct("id", "size")).alias("docs"), F.sum("size").alias("used"))
        both = gaps.join(taken, ["part", "rank"], "left")
        after = F.array(F.struct(F.lit(GAP).alias("kind"), F.col("sequence").alias("id"), (F.col("has") - F.coalesce("used", F.lit(0))).cast("int").alias("size"), F.lit(None).cast("long").alias("sequence")))
        put = F.transform("docs", lambda d: F.struct(F.lit(PLACED).alias("kind"), d["id"].alias("id"), d["size"].alias("size"), F.col("sequence").alias("sequence")))
        waits = met.where("part is null").select(F.lit(WAITS).alias("kind"), "id", "size", F.lit(None).cast("long").alias("sequence"))
        before, state = state, materialize(both.select(F.inline(F.concat(after, F.coalesce(put, F.slice(after, 1, 0))))).unionByName(waits))
        done.append(swept.where(F.col("kind") == PLACED).select(F.col("id").alias("uid"), F.col("size").cast("long").alias("length"), "sequence"))
        done.append(state.where(F.col("kind") == PLACED).select(F.col("id").alias("uid"), F.col("size").cast("long").alias("length"), "sequence"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def with_places(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS, ranges: int = RANGES) -> DataFrame:
    """The written ``pieces`` with sequence_id and offset; within a sequence the longest come first."""
    placed = place(pieces.select("uid", "length"), capacity, range_rows, ranges).select("uid", F.col("sequence").alias("sequence_id"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "uid")  # a sequence has at most ``capacity`` pieces
    return pieces.join(placed, "uid").withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("uid")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), a row for each piece of ``docs(doc_id, text)``.

    A document is the ids of its text and the id END; one of more than
    ``capacity`` ids is cut into pieces of that many, of which the last may be
    shorter. Null and empty texts are one END. Texts are read whole, whatever
    their length. Rows that repeat an id, and rows without one, are packed like
    others. Ties: of gaps of equal size any takes the document, by a hash of
    numbers; equal lengths in one sequence stand in the order they were read in.
    An empty table gives no rows. Other columns are not read.
    """
    return with_places(materialize(pieces_of(docs, capacity, tokenizer, keep_ids)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_ids=False)
