"""Secret scans: base patterns and formats inferred from labelled credentials.

Credentials that the base patterns find in a bounded sample of documents are the
labelled ones. Their prefix tree is folded into a probabilistic automaton by
merging states whose outgoing counts agree within a Hoeffding bound, one
automaton a kind, however few credentials there are. Every long token of every
text, those inside base matches included, is then scored by its likelihood
against ordinary tokens; one that a format explains better is a span ``format``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.shared import discard, materialize
from loomgraph.llm.textkit import lean, text_chunks

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "format")
#: Tokens that are scored; ``=`` only pads their end, so a key before it is no part of the value.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}+={0,2}")
ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{8,}+={0,2}")
RUN = np.zeros(256, dtype=bool)
RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True

#: Documents from which credentials and ordinary tokens are taken, and tokens of a kind, at most.
SAMPLE_DOCS, SAMPLE_TOKENS = 20_000, 2_000
#: Nats a symbol by which a format must beat ordinary tokens.
MARGIN = 0.5
#: Classes of symbols; and what a state has seen of each of them, and of an end, before the first credential.
SYMBOLS, PRIOR = "0azA+/_.=-", 0.02


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches in order; failing matches are dropped, not retried."""
    found, low = [], text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if hexes:  # a run of any length is a match, so the long matches are the long runs
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def symbol(c: str) -> str:
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "z"
    if "A" <= c <= "Z":
        return "A"
    return c


@dataclass
class Automaton:
    """States with transition counts, end counts and visits."""

    moves: list[dict[str, int]] = field(default_factory=list)
    counts: list[Counter] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    mass: dict[int, float] = field(default_factory=dict)

    def score(self, word: str) -> float:
        """Log-likelihood of the symbol string; a move that was never seen has its prior only and stays in its state."""
        total, at = 0.0, 0
        for c in word:
            total += math.log((self.counts[at].get(c, 0) + PRIOR) / self._mass(at))
            at = self.moves[at].get(c, at)
        return total + math.log((self.ends[at] + PRIOR) / self._mass(at))

    def _mass(self, at: int) -> float:
        if at not in self.mass:
            self.mass[at] = self.ends[at] + sum(self.counts[at].values()) + PRIOR * (len(SYMBOLS) + 1)
        return self.mass[at]


def infer(words: list[str], alpha: float = 0.05) -> Automaton:
    """State merging over the prefix tree of ``words`` (symbol strings), in breadth-first order."""
    a = Automaton([{}], [Counter()], [0])
    for w in words:
        at = 0
        for c in w:
            a.counts[at][c] += 1
            if c not in a.moves[at]:
                a.moves[at][c] = len(a.moves)
                a.moves.append({}), a.counts.append(Counter()), a.ends.append(0)
            at = a.moves[at][c]
        a.ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))
    visits = lambda q: a.ends[q] + sum(a.counts[q].values())

    def alike(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = visits(p), visits(q)
            if n and m:
                gap = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                pairs = [(a.ends[p], a.ends[q])] + [(a.counts[p][c], a.counts[q][c]) for c in {*a.counts[p], *a.counts[q]}]
                if any(abs(x / n - y / m) > gap for x, y in pairs):
                    return False
            todo += [(a.moves[p][c], a.moves[q][c]) for c in a.moves[p].keys() & a.moves[q].keys() if a.moves[p][c] != a.moves[q][c]]
        return True

    def fold(p: int, q: int) -> None:
        """The tree below q goes into p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            a.ends[p] += a.ends[q]
            a.counts[p].update(a.counts[q])
            for c, t in a.moves[q].items():
                if c in a.moves[p]:
                    if a.moves[p][c] != t:
                        todo.append((a.moves[p][c], t))
                else:
                    a.moves[p][c] = t

    red, known = [0], {0}
    blue = [(0, c, q) for c, q in sorted(a.moves[0].items())]
    while blue:  # ends: each round a tree node becomes red or goes into a red one
        parent, c, q = blue[0]
        for p in red:
            if alike(p, q):
                a.moves[parent][c] = p
                fold(p, q)
                break
        else:
            red.append(q)
            known.add(q)
        blue = [(p, c, t) for p in red for c, t in sorted(a.moves[p].items()) if t not in known]
    return a


class Formats:
    """An automaton for each kind that has a credential, and a chain of symbols, by the two before, of ordinary tokens."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: list[str]):
        self.automata = [infer([*map(self.coded, sorted(v))]) for _, v in sorted(credentials.items()) if v]
        seen: Counter = Counter()
        for w in ordinary:
            w = self.coded(w)
            seen.update(zip("^^" + w, "^" + w, w + "$"))
        after: Counter = Counter()
        for (x, y, _), n in seen.items():
            after[x, y] += n
        ways = len(SYMBOLS) + 1  # one pseudo-count for each
        self.plain = {(x, y, z): math.log((seen.get((x, y, z), 0) + 1) / (after[x, y] + ways)) for x in "^" + SYMBOLS for y in "^" + SYMBOLS for z in SYMBOLS + "$"}

    @staticmethod
    def coded(word: str) -> str:
        return "".join(map(symbol, word))

    def fits(self, word: str) -> bool:
        """Whether some format beats ordinary tokens by MARGIN nats a symbol, the end counted as one."""
        w = self.coded(word)
        plain = sum(map(self.plain.__getitem__, zip("^^" + w, "^" + w, w + "$")))
        return any(a.score(w) - plain > MARGIN * (len(w) + 1) for a in self.automata)


def spans(text: str, formats: Formats | None, hexes: bool = True, candidates: bool = True) -> tuple[list, list]:
    """(base spans, all spans), each a sorted list of (start, kind, end). The flags say what the text can hold at all."""
    base = base_spans(text, hexes)
    more = []
    if candidates and formats is not None and formats.automata:
        more = [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if formats.fits(m.group())]
    return base, sorted(base + more)


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Formats:
    """Formats from whole texts of about ``sample_docs`` documents, taken by a hash of id and text.

    One pass takes the credentials and, as ordinary tokens, all others of eight
    characters and more, whatever they are made of; of each kind the
    ``sample_tokens`` distinct ones of least hash are used.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                found = set()
                base = base_spans(t or "")
                for start, k, end in base:
                    found.add((KINDS[k], ASSIGN.match(t, start).group(2) if k == 0 else t[start:end]))
                inside = np.array([(x, y) for x, _, y in base] or np.zeros((0, 2)), dtype=np.int64)
                for m in ORDINARY.finditer(t or ""):
                    if not ((inside[:, 0] < m.end()) & (inside[:, 1] > m.start())).any():
                        found.add(("ordinary", m.group()))
                kinds, values = zip(*sorted(found)) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    rows = materialize(some.mapInArrow(lean(extract), "kind string, value string").distinct())
    by: dict[str, list[str]] = {}
    for kind in ("access", "assign", "hex", "ordinary"):
        got = rows.where(F.col("kind") == kind)
        by[kind] = [r[0] for r in got.orderBy(F.xxhash64("value"), "value").select("value").limit(sample_tokens).collect()]
    discard(rows)
    return Formats({k: v for k, v in by.items() if k != "ordinary"}, by["ordinary"])


def scan_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of ``docs(doc_id, text)``.

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind, assign, access, hex, format; a format span may lie in a base span. Null
    or empty text: no spans. Whole texts are read, whatever their length. Without
    a labelled credential there is no format and the base spans are all. Repeated
    rows and null ids are scanned row by row; an empty table has no rows; other
    columns are not read. Ties: of the sampled tokens of equal hash the lesser comes first.
    """
    formats = learn(docs) if formats is None else formats

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
        for b in batches:
            ids, text = b.column(0), b.column(1)
            for at, buf, offs in text_chunks(text):
                # what a row can hold follows from its longest run of characters that a secret can have
                run = np.flatnonzero(np.diff(np.concatenate([[0], RUN[buf].view(np.int8), [0]])))
                begin, end = run[::2], run[1::2]
                longest = np.zeros(len(offs) - 1, dtype=np.int64)
                np.maximum.at(longest, np.searchsorted(offs, begin, side="right") - 1, end - begin)  # a run over a row's end counts for the first row
                crossing = np.searchsorted(offs, end - 1, side="right") - 1
                np.maximum.at(longest, crossing, end - np.maximum(begin, offs[crossing]))
                out = []
                raw = buf.tobytes()
                for i in range(len(offs) - 1):
                    t = raw[offs[i] : offs[i + 1]]
                    if longest[i] < 16:
                        low = t.lower()
                        if not any(k.encode() in low for k in KEYS):
                            out.append(empty)
                            continue
                    base, every = spans(t.decode(), formats, longest[i] >= 32, longest[i] >= 16)
                    n = Counter(k for _, k, _ in base)
                    out.append((n[0], n[1], n[2], hashlib.sha256(told(base).encode()).hexdigest(), told(every)))
                cols = [*zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(out)), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {ids}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
