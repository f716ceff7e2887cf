"""N-gram Jaccard join: exact components of documents by their shingle sets.

1. Equal sets are one class. A class with more shingles of its own than a link
   allows can have no partner; a fixed share of the fingerprint space, counted
   over all documents, shows that for almost every unrelated document.
2. The other classes order their shingles by frequency among themselves. Two
   that link share one of the first, so components over those bring them
   together; a class goes to one task, not to one task a shingle. As a corpus
   grows, single shingles chain ever more unrelated classes together, so what a
   task can't hold is told apart once more: cut by fingerprint into more
   segments than two that link may differ in, they share one as a whole.
3. There the sets, ordered alike, are stored in a prefix tree. A traversal sums
   the overlap along shared prefixes once and leaves subtrees whose remaining
   lengths can't reach the limit. The distance is a metric: what is near a
   leader needs no comparison with what is twice the limit away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.shared import connected_components, materialize
from loomgraph.llm.textkit import give_back, lean, shingle_hashes, signed, text_chunks, word_hashes

SHINGLE, SIMILAR = 4, Fraction(85, 100)
#: Classes whose ids may be broadcast to fetch their texts; beyond it the join shuffles.
BROADCAST_ROWS = 250_000
#: Sets and shingles that a task joins at once; a larger component is dealt by blocks.
BLOCK_SETS, BLOCK_SHINGLES = 512, 6_000_000
#: Of such a component so many sets meet all blocks first, those that stand for most others.
LEADERS = 64
STEP = 32
#: Ways to cut a set before one with too few segments that hold a shingle is no longer told apart.
CUTS = 8


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each row."""
    for _, buf, offs in text_chunks(column):
        words, _, first = word_hashes(buf, offs)
        for _, h in shingle_hashes(words, first, k):
            yield np.unique(h)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, dg): size and digest of each document's set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), _digest(s)) for s in sets_of(b.column(1), k)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], ["doc_id", "n", "dg"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(sign), "doc_id long, n long, dg binary")


def own_shingles(docs: DataFrame, k: int, share: Fraction) -> DataFrame:
    """(owner, own): of the shingles in the counted share of the space, how many one set alone has."""
    top = np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, owners = [], []
            for s in sets_of(b.column(0), k):
                few = s[: np.searchsorted(s, top)]
                tokens.append(few)
                owners.append(np.full(len(few), int.from_bytes(_digest(s)[:8], "little", signed=True)))
                if len(tokens) == 2_000:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(owners))], ["token", "owner"])
                    tokens, owners = [], []
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(owners))], ["token", "owner"])

    per = docs.select("text").mapInArrow(lean(emit), "token long, owner long").groupBy("token").agg(F.min("owner").alias("owner"), F.max("owner").alias("o2"))
    return per.where("owner = o2").groupBy("owner").agg(F.count("*").alias("own"))


def differing(n: int, similar: Fraction) -> Iterator[int]:
    """For each band of sizes that the smaller of two linked sets may be of, if the other has ``n`` or that one itself: in how many shingles they differ at most."""
    low = 1
    while low <= n:
        top = max(low, int(low / similar))
        if top >= similar * n:
            yield int((1 - similar) / similar * top)
        low = top + 1


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def segments(s: np.ndarray, similar: Fraction) -> np.ndarray:
    """Fingerprints of which two sets that link share one at least.

    Of ``d + 1`` segments or more that hold a shingle, sets that differ in ``d``
    agree in one. A set with fewer is cut anew; so is what could link with
    nothing but such sets.
    """
    out = []
    for d in differing(len(s), similar):
        m = d + 1 + max(1, d // 4)
        for seed in range(CUTS):
            h = _mixed(s, seed + 1)
            at = (h >> np.uint64(20)) % np.uint64(m)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
            whole = np.add.reduceat(_mixed(h, 0)[order], first)
            out.append(_mixed(whole + at[order][first], (d << 4) + seed + 1))
            if len(first) > d:
                break
        else:
            out.append(np.array([d], dtype=np.uint64))
    return np.unique(np.concatenate(out))


def apart(members: DataFrame, similar: Fraction) -> DataFrame:
    """(node, component): components of ``members(component, rep, shingles)`` over shared segments, within those that they had."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                c = b.slice(at, 1_000)
                found = [segments(s, similar) for s in _views(pa.chunked_array([c.column(2)]))]
                n = [len(f) for f in found]
                within = _mixed(np.repeat(c.column(0).to_numpy(), n).view(np.uint64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found) ^ within)), pa.array(np.repeat(c.column(1).to_numpy(), n))], ["segment", "rep"])

    cuts = members.select("component", "rep", "shingles").mapInArrow(lean(cut_up), "segment long, rep long")
    least = cuts.groupBy("segment").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most").drop("most")
    return connected_components(cuts.join(least, "segment").select(F.col("rep").alias("u"), F.col("least").alias("v")))


class Trie:
    """Sets as a prefix tree whose edges hold STEP shingles, level by level.

    Shingles are numbered by falling frequency, so sets of a group begin alike.
    A node stands for all sets that share the shingles up to its end.
    """

    def __init__(self, sets: list[np.ndarray]):
        known, counts = np.unique(np.concatenate(sets), return_counts=True)
        rank = np.empty(len(counts), dtype=np.int32)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        self.vocabulary = len(counts)
        ranked = [np.sort(rank[np.searchsorted(known, s)]) for s in sets]
        del known, counts, rank
        self.order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes())
        self.sets = [ranked[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        common = np.zeros(len(sets), dtype=np.int64)  # with the set before
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            d = np.flatnonzero(a[:m] != b[:m])
            common[i] = d[0] if len(d) else m
        self.levels = []
        lo = np.zeros(1, dtype=np.int64)
        hi = np.array([len(sets)])
        depth = 0
        while len(lo):
            starts, stops, parents, chunks = [], [], [], []
            for p in range(len(lo)):
                a = lo[p]
                while a < hi[p]:
                    b = a + 1
                    while b < hi[p] and common[b] >= min(depth + STEP, max(self.sizes[a], self.sizes[b])):
                        b += 1
                    if self.sizes[a] > depth:
                        part = self.sets[a][depth : depth + STEP]
                        chunks.append(np.pad(part, (0, STEP - len(part)), constant_values=self.vocabulary))
                        starts.append(a), stops.append(b), parents.append(p)
                    a = b
            if not starts:
                break
            s, e = np.array(starts), np.array(stops)
            least = np.array([self.sizes[x:y].min() for x, y in zip(starts, stops)])
            most = np.array([self.sizes[x:y].max() for x, y in zip(starts, stops)])
            chunk = np.array(chunks)
            last = np.where(chunk == self.vocabulary, -1, chunk).max(axis=1)
            self.levels.append((chunk, np.array(parents), s, e, least, most, last))
            deeper = most > depth + STEP
            lo, hi = s[deeper], e[deeper]
            self.levels[-1] += (np.flatnonzero(deeper),)
            depth += STEP

    def probe(self, i: int, limit: Fraction, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, overlaps) of the active sets whose similarity to set ``i`` is ``limit`` at least."""
        x = self.sets[i]
        member = np.zeros(self.vocabulary + 1, dtype=bool)
        member[x] = True
        alive = np.concatenate([[0], np.cumsum(active)])
        num, den = limit.numerator, limit.denominator
        places, overlaps = [], []
        before, sums = None, None  # nodes of the level above that go on, and their overlaps
        depth = 0
        for chunk, parent, lo, hi, least, most, last, deeper in self.levels:
            if before is None:
                nodes, base = np.arange(len(chunk)), 0
            else:
                at = np.searchsorted(parent, before)
                to = np.searchsorted(parent, before, side="right")
                n = to - at
                if not n.sum():
                    break
                nodes = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                base = np.repeat(sums, n)
            got = base + member[chunk[nodes]].sum(axis=1)
            left = np.minimum(len(x) - np.searchsorted(x, last[nodes], side="right"), np.maximum(most[nodes] - depth - STEP, 0))
            # overlap / (|x| + |y| - overlap) >= num / den, for the smallest set below
            ok = ((got + left) * (num + den) >= num * (len(x) + least[nodes])) & (alive[hi[nodes]] > alive[lo[nodes]])
            nodes, got = nodes[ok], got[ok]
            done = np.flatnonzero(self.sizes[lo[nodes]] <= depth + STEP) if len(nodes) else np.zeros(0, np.int64)
            for j in done:  # equal sets end together
                for y in range(lo[nodes[j]], hi[nodes[j]]):
                    if self.sizes[y] <= depth + STEP and active[y] and got[j] * (num + den) >= num * (len(x) + self.sizes[y]):
                        places.append(y), overlaps.append(got[j])
            go = most[nodes] > depth + STEP
            before, sums = np.searchsorted(deeper, nodes[go]), got[go]
            depth += STEP
        return np.array(places, dtype=np.int64), np.array(overlaps, dtype=np.int64)


def join_sets(sets: list[np.ndarray], similar: Fraction) -> np.ndarray:
    """For each set the number of the least set that links connect it with."""
    trie = Trie(sets)
    m = len(sets)
    root = np.arange(m)

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    def union(a: int, b: int) -> None:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    ring_limit = max(Fraction(0), 2 * similar - 1)
    active = np.ones(m, dtype=bool)
    for leader in range(m):
        if not active[leader]:
            continue
        active[leader] = False
        places, overlaps = trie.probe(leader, ring_limit, active)
        if not len(places):
            continue
        both = len(trie.sets[leader]) + trie.sizes[places] - overlaps
        near = overlaps * similar.denominator >= similar.numerator * both
        for y in places[near]:
            union(leader, int(y))
        active[places[near]] = False
        if near.any() and not near.all():
            # beyond the limit from the leader, but perhaps linked with what is near it
            close = np.zeros(m, dtype=bool)
            close[places[near]] = True
            for y in places[~near]:
                for z in trie.probe(int(y), similar, close)[0]:
                    union(int(y), int(z))
    place = np.empty(m, dtype=np.int64)
    place[trie.order] = np.arange(m)
    roots = np.array([find(int(place[i])) for i in range(m)])
    least: dict[int, int] = {}
    return np.array([least.setdefault(int(r), i) for i, r in enumerate(roots)])


def jaccard_components(docs: DataFrame, k: int = SHINGLE, similar: Fraction = SIMILAR, broadcast_rows: int = BROADCAST_ROWS,
                       block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, dg), a row for each row of ``docs(doc_id, text)``.

    Words are runs of anything but ASCII white space, A-Z lowered; a set holds
    the ``k``-word shingles, or the whole sequence if it is shorter. Null and
    empty texts have no set and link with nothing. component_id is the smallest
    doc_id that links reach. Rows without an id link with nothing unless a row
    of equal text has one; rows that share an id are one node. Texts have any
    length and are read whole; a similarity equal to ``similar`` links, compared in
    whole numbers. An empty table gives no rows. Other columns are not read.
    """
    sig = materialize(signatures(docs, k))
    classes = sig.where("n > 0 and doc_id is not null").groupBy("dg").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    share = min(Fraction(1), 2 * (1 - similar))
    own = own_shingles(docs, k, share)
    num, den = similar.numerator, similar.denominator
    spare = F.expr(f"n - (n * {num} + {den - 1}) div {den}")  # shingles that a partner may lack

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners = [int.from_bytes(d[:8], "little", signed=True) for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(owners, pa.int64())], ["dg", "rep", "n", "owner"])

    tagged = classes.mapInArrow(lean(tag), "dg binary, rep long, n long, owner long")
    need = materialize(tagged.join(own, "owner", "left").where(F.coalesce("own", F.lit(0)) <= spare).select("rep", "dg"))
    few = need.count() <= broadcast_rows
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(F.broadcast(need) if few else need, "rep")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(r, len(s), s.tobytes()) for r, d, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), sets_of(b.column(1), k)) if _digest(s) == d]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.binary())], ["rep", "n", "shingles"])

    sets = materialize(texts.select("rep", "text", "dg").mapInArrow(lean(fetch), "rep long, n long, shingles binary"))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                c = b.slice(at, 1_000)
                n = c.column(1).to_numpy()
                token = np.frombuffer(b"".join(c.column(2).to_pylist()), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(c.column(0).to_numpy(), n)), pa.array(np.repeat(n, n))], ["token", "rep", "n"])

    # a shingle that very many sets have is counted by partial sums, and its rows are joined back wherever they are
    tokens = sets.mapInArrow(lean(flat), "token long, rep long, n long")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    shared = tokens.join(counts.drop("most"), "token").select("rep", "n", "token", "df", "least")

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each class, sorted by frequency: the least class of each of its first shingles."""
        held = None
        for b in _closed(batches):
            t = b if held is None else pa.concat_tables([held, b]) if b is not None else held
            if t is None or not t.num_rows:
                continue
            rep = t.column("rep").to_numpy()
            cut = len(rep) if b is None else int(np.searchsorted(rep, rep[-1]))
            held = t.slice(cut)
            rep, n, least = (t.column(c).to_numpy()[:cut] for c in ("rep", "n", "least"))
            if not cut:
                continue
            start = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]]))
            count = np.diff(np.append(start, cut))
            at = np.arange(cut) - np.repeat(start, count)
            lone = n - np.repeat(count, count)
            allowed = n - (n * num + den - 1) // den + 1  # one of so many first shingles is in a partner's
            keep = (lone + at < allowed) & (rep != least)
            pairs = np.unique(np.stack([rep[keep], least[keep]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    candidates = shared.repartition("rep").sortWithinPartitions("rep", "df", "token").mapInArrow(lean(leading), "u long, v long")
    groups = materialize(connected_components(candidates))

    def measured(groups: DataFrame) -> DataFrame:
        return materialize(
            groups.join(sets.select("rep", "n"), F.col("rep") == F.col("node")).groupBy("component").agg(
                F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks")
            )
        )

    sizes = measured(groups)
    if sizes.where("blocks > 1").count():
        # written, so that their sizes are known and what is small is sent to the sets, not the sets to it
        large = materialize(groups.join(sizes.where("blocks > 1").select("component"), "component"))
        finer = apart(sets.join(large, F.col("rep") == F.col("node")), similar)
        groups = materialize(groups.join(sizes.where("blocks = 1").select("component"), "component").select("node", "component").unionByName(finer))
        sizes = measured(groups)
    members = sets.join(groups, F.col("rep") == F.col("node")).select("rep", "n", "shingles", "component")
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def within(t: pa.Table) -> pa.Table:
        rep = t.column("rep").to_numpy()
        found = join_sets(_views(t.column("shingles")), similar) if len(rep) > 1 else np.zeros(len(rep), np.int64)
        peer = rep[found]
        keep = rep != peer
        give_back()
        return pa.table({"u": rep[keep], "v": peer[keep]})

    links = materialize(dealt.select("component", "block", "rep", "shingles").groupBy("component", "block").applyInArrow(within, "u long, v long"))
    if sizes.where("blocks > 1").count():
        links = links.unionByName(between_blocks(dealt.where("blocks > 1"), links, within, block_sets, block_shingles))
    linked = connected_components(links)
    told = classes.select("dg", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("dg", F.coalesce("component", "rep").alias("component_id"))
    return sig.join(told, "dg", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "dg"
    )


def between_blocks(dealt: DataFrame, links: DataFrame, within, block_sets: int, block_shingles: int) -> DataFrame:
    """(u, v): what links the blocks of ``dealt(component, blocks, block, rep, n, shingles)``, given the links inside them.

    A group of near copies joins in two steps of linear size: the sets that stand
    for most others meet what is not yet joined in each block. Then only sets
    outside the largest group of a component can hold an unknown link. Those are
    compared with every block, so nothing is missed; where sets share shingles
    and do not link, that costs the square of their blocks.
    """
    own = materialize(dealt.join(links.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    roots = own.where("rep = root").select("component", "block", "rep", "shingles")
    stand = own.groupBy("component", F.col("root").alias("rep")).agg(F.count("*").alias("size"))
    first = Window.partitionBy("component").orderBy(F.desc("size"), "rep")  # names and sizes only
    leaders = stand.withColumn("i", F.row_number().over(first)).where(F.col("i") <= LEADERS).select("component", "rep")
    spread = (
        roots.join(leaders, ["component", "rep"], "left_semi").drop("block")
        .join(own.select("component", "blocks").distinct(), "component")
        .select("component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "rep", "shingles")
    )
    met = materialize(roots.unionByName(spread).dropDuplicates(["component", "block", "rep"]).groupBy("component", "block").applyInArrow(within, "u long, v long"))
    inside = own.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))
    label = connected_components(inside.unionByName(met))
    named = own.join(label.withColumnsRenamed({"node": "rep", "component": "label"}), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    groups = named.groupBy("component", "label").agg(F.count("*").alias("size"))
    most = groups.groupBy("component").agg(F.max_by("label", F.struct("size", -F.col("label"))).alias("hub"))
    rest = materialize(named.join(most, "component").where("label <> hub").select("component", "blocks", "rep", "n", "shingles"))
    parts = rest.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("parts"))
    sent = (
        rest.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int"))
        .select("component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "part", "rep", "shingles")
    )
    every = own.join(parts, "component").select("component", "block", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "rep", "shingles")
    last = sent.unionByName(every).dropDuplicates(["component", "block", "part", "rep"]).groupBy("component", "block", "part").applyInArrow(within, "u long, v long")
    return met.unionByName(materialize(last))


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The sets of a binary column, without a copy of its bytes."""
    out = []
    for c in column.chunks:
        _, offsets, data = c.buffers()
        kind = np.int64 if pa.types.is_large_binary(c.type) else np.int32
        offs = np.frombuffer(offsets, dtype=kind)[c.offset : c.offset + len(c) + 1]
        out += [np.frombuffer(data, dtype=np.uint64, count=(b - a) // 8, offset=a) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return out


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    for b in batches:
        yield pa.Table.from_batches([b])
    yield None


def keep_one(docs: DataFrame, k: int = 5, similar: Fraction = Fraction(4, 5), **how) -> DataFrame:
    """The rows and columns of ``docs`` of which each group of linked documents keeps one, the smallest doc_id.

    Rows that share an id are one document and stay or go together. Texts
    without words and rows without an id are all kept.
    """
    found = jaccard_components(docs, k, similar, **how).where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    gone = materialize(found)
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("dg")
