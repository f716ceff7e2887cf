"""Alignment of two tokenizers over a corpus, by a dictionary of groups.

Where tokens of both tokenizers end at the same byte, a text is cut into groups
of A-ids and B-ids. Groups repeat, so a block of documents is written as its
dictionary and numbers into it. Over the corpus each distinct group is expanded
into links once; how many documents hold a link follows from how many hold its
groups, less what is counted twice where a document holds the link in several of
them. What a group adds to its documents then goes back by the group's key, once
a block, and blocks meet their documents in one sorted stream a task.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import materialize
from loomgraph.llm.textkit import SPACE, _powers, lean, mix, text_chunks
from loomgraph.llm.vocab import CACHED, Chunks, pieces, tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text after which a block ends, rows that are read and bytes that are handled at once.
BLOCK, ROWS, TEXT = 16_000_000, 200, 4_000_000
#: New units that are encoded in one text; groups that a worker may know before it begins anew.
TOGETHER, GROUPS = 256, 600_000
DOC, GROUP, TWICE = 0, 1, 2
_ENCODED = (
    "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "held array<int>, times array<int>, number int, key string, n long, a int, b int"
)
#: Marks that units end before, where a letter stands before them.
_MARKS = ",.;:!?"
#: White space beyond ASCII, and what some take for it: texts with any are encoded whole.
_HARD = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(unseen)}


@functools.lru_cache(2)
def bytes_of_a(name: str) -> list[bytes]:
    """The bytes of each id of A. Only the special token has letters that stand for no byte, and no text gives it."""
    tool, byte = tokenizer(name, True), _byte_letters()
    return [bytes(byte[c] for c in tool.id_to_token(i) if c in byte) for i in range(tool.get_vocab_size())]


@functools.lru_cache(2)
def bytes_of_b(name: str) -> list[bytes]:
    tool = pieces(name)
    found = map(tool.id_to_piece, range(tool.get_piece_size()))
    return [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in found]


@functools.lru_cache(2)
def may_cut(name: str) -> bool:
    """Whether no piece of B reaches over a place where texts are cut: before a space, at a line end, before a mark after a letter."""
    found = map(pieces(name).id_to_piece, range(pieces(name).get_piece_size()))
    return not any("\n" in p or any(y == "▁" != x or (y in _MARKS and x.isalpha()) for x, y in zip(p, p[1:])) for p in found)


def overlaps(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of tokens of two sequences over the same bytes whose ranges overlap, in order."""
    ends_a, ends_b = list(accumulate(len(a_bytes[x]) for x in a)), list(accumulate(len(b_bytes[x]) for x in b))
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i], b[j]))
        x, y = ends_a[i], ends_b[j]
        i += x <= y
        j += y <= x
    return out


def groups_of(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> list[str]:
    """The groups ``a1,a2|b1`` between the bytes where tokens of both end."""
    ends_b = {end: j for j, end in enumerate(accumulate(len(b_bytes[x]) for x in b), 1)}
    out, i, j = [], 0, 0
    for n, end in enumerate(accumulate(len(a_bytes[x]) for x in a), 1):
        if end in ends_b:
            out.append(f"{','.join(map(str, a[i:n]))}|{','.join(map(str, b[j : ends_b[end]]))}")
            i, j = n, ends_b[end]
    return out


def ids_of(key: str) -> tuple[list[int], list[int]]:
    a, b = key.split("|")
    return list(map(int, a.split(","))), list(map(int, b.split(",")))


class Aligner:
    """Groups of whole texts as numbers, put together from the groups of their units.

    A text is cut into chunks at its single spaces, chunks into units at single
    line ends and before marks that follow a letter: no token of either side
    reaches over such a place, so a unit has the same tokens alone. Equal chunks
    and units are looked up once; new units are encoded many at a time.
    """

    def __init__(self, name_a: str, name_b: str):
        self.a, self.b = tokenizer(name_a, True), pieces(name_b)
        self.a_bytes, self.b_bytes = bytes_of_a(name_a), bytes_of_b(name_b)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.cut = may_cut(name_b)
        self.chunks, self.units = Chunks(self._of_chunks), Chunks(self._of_units, 2 * CACHED)
        self.forget()

    def forget(self) -> None:
        """Empty the dictionary of groups, and what counts on its numbers."""
        self.chunks.clear()
        self.units.clear()
        self.number, self.key = {}, []
        self.n_a, self.n_b, self.links = [], [], []

    def _numbers(self, keys: list[str]) -> bytes:
        out = []
        for k in keys:
            i = self.number.get(k)
            if i is None:
                i = self.number[k] = len(self.key)
                self.key.append(k)
                a, b = ids_of(k)
                self.n_a.append(len(a))
                self.n_b.append(len(b))
                pairs = {x << 32 | y for x, y in overlaps(a, b, self.a_bytes, self.b_bytes)} if len(a) > 1 or len(b) > 1 else (a[0] << 32 | b[0],)
                self.links.append(np.array(sorted(pairs), np.int64).tobytes())
            out.append(i)
        return np.array(out, np.int32).tobytes()

    def _alone(self, text: str, space: bool) -> bytes | None:
        """Of one text, after a space or, where B can be made to leave it out, after none; None where bytes differ."""
        raw = (" " * space + text).encode()
        a = self.a.encode(" " * space + text, add_special_tokens=False).ids
        b = self.b.encode(text if space else "\n" + text)[0 if space else 2 :]
        if raw != b"".join([self.a_bytes[x] for x in a]) or raw != b"".join([self.b_bytes[x] for x in b]):
            return None
        return self._numbers(groups_of(a, b, self.a_bytes, self.b_bytes))

    def _together(self, units: list[str], space: bool) -> list[bytes | None]:
        """Of units that neither begin nor end with white space: with a space before each, or parted by line ends."""
        glue = " " if space else "\n"
        text = glue.join(units)
        a = np.array(self.a.encode(glue + text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text if space else glue + text)[0 if space else 1 :], np.int64)
        raw = (glue + text).encode()
        if raw != b"".join([self.a_bytes[x] for x in a]) or raw != b"".join([self.b_bytes[x] for x in b]):
            return [self._alone(u, space) for u in units]
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = (np.append(0, np.searchsorted(ends, both) + 1).tolist() for ends in (ends_a, ends_b))
        ids_a, ids_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        keys = [f"{','.join(ids_a[i:j])}|{','.join(ids_b[k:m])}" for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
        sizes = np.cumsum([len(u.encode()) + 1 for u in units])
        last = np.searchsorted(both, sizes)
        if (last >= len(both)).any() or (both[last] != sizes).any():
            return [self._alone(u, space) for u in units]
        last = np.append(-1, last)
        skip = 0 if space else 1  # the line end before each unit is a group of its own
        return [self._numbers(keys[i + 1 + skip : j + 1]) for i, j in zip(last, last[1:])]

    def _of_units(self, units: list[str]) -> list[bytes | None]:
        made: dict[str, bytes | None] = {}
        for space in (True, False):
            own = [u for u in units if (u[0] == " ") is space]
            bare = [u[1:] if space else u for u in own]
            easy = [u for u in bare if u and not u[0].isspace() and not u[-1].isspace()]
            for i in range(0, len(easy), TOGETHER):
                part = easy[i : i + TOGETHER]
                made.update((" " * space + u, got) for u, got in zip(part, self._together(part, space)))
            made.update((u, self._alone(t, space)) for u, t in zip(own, bare) if u not in made)
        return [made[u] for u in units]

    def _of_chunks(self, chunks: list[str]) -> list[bytes | None]:
        cut = [units_of(c) for c in chunks]
        got = iter(self.units.of([u for own in cut for u in own]))
        out = []
        for own in cut:
            found = [next(got) for _ in own]
            out.append(None if None in found else b"".join(found))
        return out

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The numbers of each text's groups, in order; none for a text without tokens."""
        for _, buf, offs in text_chunks(column, TEXT):
            raw = buf.tobytes()
            hashes, starts, ends, first = chunk_hashes(buf, offs)
            _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
            found = self.chunks.of([raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())]) if self.cut else [None] * len(at)
            bad = np.array([f is None for f in found], bool)
            n = np.array([len(f or b"") // 4 for f in found], np.int64)
            flat, begin = np.frombuffer(b"".join([f for f in found if f]), np.int32), np.cumsum(n) - n
            hard = {int(np.searchsorted(offs, m.start(), side="right")) - 1 for m in _HARD.finditer(raw)}
            for i in range(len(offs) - 1):
                own = which[first[i] : first[i + 1]]
                if not len(own):
                    yield np.zeros(0, np.int32)
                elif i in hard or bad[own].any():  # encoded whole: bytes that differ in a chunk may still agree in the text
                    yield np.frombuffer(self._alone(raw[offs[i] : offs[i + 1]].decode(), True) or b"", np.int32)
                else:
                    k = n[own]
                    to = np.cumsum(k)
                    yield flat[np.repeat(begin[own] - (to - k), k) + np.arange(to[-1])]


def units_of(chunk: str) -> list[str]:
    """Units of a chunk, the first with the space before it."""
    lines = chunk.split("\n") if "\n" in chunk else [chunk]
    if len(lines) > 1 and any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
        lines = [chunk]
    out = []
    for n, line in enumerate(lines):
        if n:
            out.append("\n")
        body = line.rstrip(_MARKS)
        part = body[-1:].isalpha() and len(body) < len(line)
        out.append(" " * (not n) + (body if part else line))
        if part:
            out.append(line[len(body) :])
    return out


def chunk_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first byte, byte after the last, and the first one of each row) of the chunks that a row's single spaces part."""
    n = len(buf)
    space = SPACE[buf]
    single = buf == 32
    single[1:] &= ~space[:-1]
    single[:-1] &= ~space[1:]
    edge = offs[(offs > 0) & (offs < n)]
    single[edge] = False  # the first and the last byte of a row part nothing
    single[edge - 1] = False
    if n:
        single[[0, n - 1]] = False
    cuts = np.flatnonzero(single)
    filled = offs[:-1][np.diff(offs) > 0]
    starts = np.sort(np.concatenate([filled, cuts + 1]))
    ends = np.sort(np.concatenate([offs[1:][np.diff(offs) > 0], cuts]))
    first = np.searchsorted(starts, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, first
    r, inverse = _powers(n + 1)
    with np.errstate(over="ignore"):
        v = (buf.astype(np.uint64) + np.uint64(1)) * r[:n]
        v[cuts] = 0
        return mix(np.add.reduceat(v, starts) * inverse[starts]), starts, ends, first


@functools.lru_cache(2)
def aligner(name_a: str, name_b: str) -> Aligner:
    """What a worker has learnt stays from task to task."""
    return Aligner(name_a, name_b)


def encode(docs: DataFrame, name_a: str = A, name_b: str = B, block: int = BLOCK, keep_groups: bool = False) -> DataFrame:
    """Documents as numbers into the dictionary of their block, the dictionaries, and links to count less; see _ENCODED.

    ``groups`` is the digest of a document's groups, or with ``keep_groups`` the groups themselves.
    """
    names = [x.split()[0] for x in _ENCODED.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = {x.split()[0]: kinds[x.split()[1]] for x in _ENCODED.split(", ")}

    def batch(rows: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[c], types[c]) if c in given else pa.nulls(rows, types[c]) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, at = aligner(name_a, name_b), TaskContext.get().partitionId() << 32
        ids: list = []
        found: list[np.ndarray] = []
        told: list[str] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, found, told, size, at
            n, lengths = len(ids), np.array([len(f) for f in found])
            groups = np.concatenate(found)
            all_a, all_b = np.array(tool.n_a, np.int64), np.array(tool.n_b, np.int64)
            edge = np.append(0, np.cumsum(lengths))
            sums = [np.diff(np.append(0, np.cumsum(x[groups]))[edge]) for x in (all_a, all_b)]
            # each document's different groups and how often it holds them, numbered within the block
            own, number = np.unique(groups, return_inverse=True)
            key, times = np.unique(np.repeat(np.arange(n), lengths) * max(1, len(own)) + number, return_counts=True)
            doc, held = key // max(1, len(own)), (key % max(1, len(own))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (held, times)]
            yield batch(
                n, kind=np.full(n, DOC), block=np.full(n, at), doc_id=ids, n_a=sums[0], n_b=sums[1], n_groups=lengths, n_links=sums[0] + sums[1] - lengths, groups=told, held=lists[0], times=lists[1]
            )  # within a group no ends agree but the last, so it has a link for each token but one
            n_docs = np.bincount(held, minlength=len(own))
            yield batch(len(own), kind=np.full(len(own), GROUP), block=np.full(len(own), at), number=np.arange(len(own)), key=[tool.key[i] for i in own], n=n_docs)
            # links that a document holds in several of its groups would count more than once
            raw = [tool.links[i] for i in own]
            many = np.array([len(x) // 8 for x in raw], np.int64)
            pair, which = np.unique(np.frombuffer(b"".join(raw), np.int64), return_inverse=True)
            k = many[held]
            to = np.cumsum(k)
            rows = which[np.repeat((np.cumsum(many) - many)[held] - (to - k), k) + np.arange(to[-1] if len(to) else 0)]
            single = np.unique(np.repeat(doc, k) * max(1, len(pair)) + rows) % max(1, len(pair))
            more = np.bincount(rows, minlength=len(pair)) - np.bincount(single, minlength=len(pair))
            over = np.flatnonzero(more)
            yield batch(len(over), kind=np.full(len(over), TWICE), block=np.full(len(over), at), a=pair[over] >> 32, b=pair[over] & 0xFFFFFFFF, n=more[over])
            ids, found, told, size, at = [], [], [], 0, at + 1
            if len(tool.key) > GROUPS:
                tool.forget()

        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                if size > block or len(tool.key) > 2 * GROUPS:
                    yield from flush()
                size += b.column(1).nbytes
                ids += b.column(0).to_pylist()
                for got in tool.rows(b.column(1)):
                    found.append(got)
                    text = ";".join([tool.key[i] for i in got.tolist()])
                    told.append(text if keep_groups or not text else hashlib.sha256(text.encode()).hexdigest())
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _ENCODED)


def expand(groups: DataFrame, name_a: str = A, name_b: str = B) -> DataFrame:
    """(key, n, a, b, times), a row for each different link of each row of ``groups(key, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_bytes, b_bytes = bytes_of_a(name_a), bytes_of_b(name_b)
        for b in batches:
            row, pairs, times = [], [], []
            for i, key in enumerate(b.column(0).to_pylist()):
                found = Counter(overlaps(*ids_of(key), a_bytes, b_bytes))
                row += [i] * len(found)
                pairs += found
                times += found.values()
            at, ab = pa.array(row, pa.int64()), np.array(pairs, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.array(times, pa.int64())], ["key", "n", "a", "b", "times"]
            )

    return groups.select("key", "n").mapInArrow(lean(run), "key string, n long, a int, b int, times long")


def pair_counts(encoded: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents hold a link, and whether that is the most of any link of its A-id.

    An A-id has as many links as B has ids at most, so a window of them is bounded.
    """
    more = encoded.where(F.col("kind") == TWICE).select("a", "b", (-F.col("n")).alias("n"))
    counts = links.select("a", "b", "n").unionByName(more).groupBy("a", "b").agg(F.sum("n").alias("docs"))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block's groups give each of its documents; a block's dictionary, in order of numbers, comes before its documents."""
    block, best, total = None, [], []
    for b in batches:
        kinds, blocks = (b.column(c).to_numpy() for c in ("kind", "block"))
        rows, n_best, n_total = [], [], []
        held, times = b.column("held"), b.column("times")
        # runs of one kind and block
        edge = [0, *(np.flatnonzero((np.diff(kinds) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), b.num_rows]
        for s, e in zip(edge, edge[1:]):
            if s == e:
                continue
            if blocks[s] != block:
                block, best, total = blocks[s], [], []
            if kinds[s] == GROUP:
                part = b.slice(s, e - s)
                best.append(part.column("n_best").to_numpy())
                total.append(part.column("count_sum").to_numpy())
                continue
            if len(best) > 1:
                best, total = [np.concatenate(best)], [np.concatenate(total)]
            for i in range(s, e):
                at, n = held[i].values.to_numpy(), times[i].values.to_numpy()
                rows.append(i)
                n_best.append(int((best[0][at] * n).sum()) if len(at) else 0)
                n_total.append(int((total[0][at] * n).sum()) if len(at) else 0)
        if rows:
            kept = b.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n_best, pa.int64()), pa.array(n_total, pa.int64())], [*kept.schema.names, "n_best", "count_sum"])


def align_documents(docs: DataFrame, name_a: str = A, name_b: str = B, block: int = BLOCK, keep_groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum), a row for each row of ``docs(doc_id, text)``.

    Texts are encoded after one space, whole, whatever their length, with strings
    of special tokens as plain text. A text that is null or empty, or whose tokens
    of either side do not give its bytes back, has no tokens: zeros and an empty
    string. ``groups`` are ``a1,a2|b1;a3|b2,b3``, or their SHA-256 without
    ``keep_groups``. Rows that repeat an id, and rows without one, are documents
    of their own. Ties: all links of an A-id with its highest count are best. An
    empty table gives no rows. Other columns are not read.
    """
    encoded = materialize(encode(docs, name_a, name_b, block, keep_groups))
    dictionary = encoded.where(F.col("kind") == GROUP).select("block", "number", "key", "n")
    links = materialize(expand(dictionary.groupBy("key").agg(F.sum("n").alias("n")), name_a, name_b))
    pairs = materialize(pair_counts(encoded, links))
    values = links.join(pairs, ["a", "b"]).groupBy("key").agg(
        F.sum(F.col("times") * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")
    )
    told = dictionary.join(values, "key").select(F.lit(GROUP).alias("kind"), "block", "number", "n_best", "count_sum")
    own = encoded.where(F.col("kind") == DOC).select("kind", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "held", "times")
    both = own.unionByName(told, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.desc("kind"), "number")
    return both.mapInArrow(_add_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_documents(docs, keep_groups=False).withColumnRenamed("groups", "groups_sha256")
