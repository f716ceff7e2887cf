"""Token-ID output: documents as packed rows of one length, without loss.

Each task tokenizes its rows and packs them by best-fit decreasing: the longest
piece first, each into the fullest row that still has room, which a segment tree
over free capacities finds. Longer documents are cut into pieces of a full row.
No shuffle is needed; a window of tokens, not a partition, is held at a time.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.textkit import lean

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50_256
ROW = 2_048
#: Tokens that a task packs at once.
WINDOW = 2_000_000
#: Fixed value: how the byte-level vocabulary divides a text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "pack_id string, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>"
#: Words whose ids a task remembers; they are forgotten at its end, as idle workers would keep them beside those of other stages.
CACHED = 150_000


@functools.lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """Ids of a word that a single space precedes; emptied when it is full."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = encoder(path).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        got = self[word] = np.array(self.encode(" " + word), dtype="<u2").tobytes()
        return got


@functools.lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def token_ids(text: str, path: str = TOKENIZER) -> bytes:
    """Ids as 16-bit numbers. Words parted by single spaces are encoded one by one, which changes nothing:
    the pattern never joins what is before such a space with what is after it."""
    cache = words(path)
    parts = text.split(" ")
    if len(parts) > 2 and "" not in parts and not any(p[0].isspace() or p[-1].isspace() for p in parts):
        first = np.array(cache.encode(parts[0]), dtype="<u2").tobytes()
        return first + b"".join([cache[p] for p in parts[1:]])
    return np.array(cache.encode(text), dtype="<u2").tobytes()


class Capacities:
    """A segment tree over free capacities 0..limit: which ones some row has."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.any = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.size
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of ``need`` at least, and that capacity; it leaves the tree."""
        at = need + self.size
        while not self.any[at]:
            while at & 1:  # a right child: what is greater lies above
                at >>= 1
                if not at:
                    return None
            at |= 1
            if at == 1:
                return None
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        capacity = at - self.size
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self.any[at] = 0
            at >>= 1
            while at:
                self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
                if self.any[at]:
                    break
                at >>= 1
        return row, capacity


def best_fit_decreasing(lengths: list[int], limit: int) -> list[list[int]]:
    """Rows of indices; every length is in 1..limit."""
    tree, rows = Capacities(limit), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        got = tree.take(lengths[i])
        if got is None:
            rows.append([])
            got = len(rows) - 1, limit
        rows[got[0]].append(i)
        tree.put(got[1] - lengths[i], got[0])
    return rows


def pack_documents(docs: DataFrame, row: int = ROW, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """Packed rows of ``docs(doc_id, text)``; see SCHEMA.

    ``ids`` are ``row`` little-endian 16-bit ids, filled up with END; segment i
    of a row is ids[cu_seqlens[i]:cu_seqlens[i+1]], holds tokens from
    doc_starts[i] of a document of doc_tokens[i] in all, and its position ids
    count from 0 at position_resets[i]. Every document ends with END, so a null
    or empty text is one END. Repeated rows and null ids are packed like others.
    Other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pieces: list[tuple] = []  # id, start, tokens of the document, ids
        held = made = 0
        end = np.array([END], dtype="<u2").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal pieces, held, made
            out = []
            for members in best_fit_decreasing([len(p[3]) // 2 for p in pieces], row):
                got = [pieces[i] for i in members]
                cu = np.concatenate([[0], np.cumsum([len(p[3]) // 2 for p in got])])
                ids = b"".join(p[3] for p in got)
                out.append((f"{part}-{made}", int(cu[-1]), ids + end * (row - int(cu[-1])), cu, cu[:-1], [p[0] for p in got], [p[1] for p in got], [p[2] for p in got]))
                made += 1
            pieces, held = [], 0
            types = [pa.string(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 3]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = token_ids(text.as_py() or "", tokenizer) + end
                for at in range(0, len(ids), 2 * row):
                    pieces.append((doc, at // 2, len(ids) // 2, ids[at : at + 2 * row]))
                held += len(ids) // 2
                if held >= window:
                    yield flush()
        if pieces:
            yield flush()
        words(tokenizer).clear()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(lean(pack), SCHEMA)


def unpack(rows: list, tokenizer: str = TOKENIZER) -> list[tuple[int | None, str]]:
    """(doc_id, text) back from packed rows, for tests and small reads."""
    parts: dict = {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u2")
        for i, doc in enumerate(r.doc_ids):
            parts.setdefault((doc, r.doc_tokens[i], r.doc_starts[i]), []).append(ids[r.cu_seqlens[i] : r.cu_seqlens[i + 1]])
    out, open_ = [], {}
    for (doc, total, start), found in sorted(parts.items(), key=lambda x: (repr(x[0][:2]), x[0][2])):
        for n, ids in enumerate(found):
            open_.setdefault((doc, total, n), []).append(ids)
    for (doc, _, _), found in open_.items():
        ids = np.concatenate(found)
        out.append((doc, encoder(tokenizer).decode(ids[:-1].tolist())))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
