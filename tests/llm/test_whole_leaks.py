"""Decontamination where the item's words come in another order, against every window."""

import random

from pyspark.sql import functions as F

from loomgraph.llm import op10_decontamination
from tests.llm.test_joins import leaks


def test_reordered_passages_are_found(spark):
    rng = random.Random(7)
    vocab = [f"u{i}" for i in range(3000)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([12, 40, 56, 56, 80, 120])))) for i in range(12)] + [(12, "a b a b a b a b a b c d e f g h"), (13, "x " * 30)]
    docs = []
    for d in range(60):
        p = items[d % 12][1].split()
        cut = len(p) // rng.choice([2, 2, 3])
        p = p[cut:] + p[:cut]
        if d % 4 == 3:
            p[rng.randrange(len(p))] = rng.choice(vocab)
        docs.append((d, " ".join(some(rng.randint(0, 90)) + p + some(rng.randint(0, 90)))))
    docs += [(60, "a b " * 40 + "c d e f g h a b a b a b"), (61, "q " * 50 + "x " * 70 + "q " * 20), (62, "x " * 29), (62, "x " * 29)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in op10_decontamination.find_leaks(df, bench).collect()}
    want = leaks(docs, items)
    assert any(0.8 <= s < 0.9 for (d, _), s in want.items() if d < 60)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-6 for x in got)
    kept = {r.doc_id for r in op10_decontamination.drop_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_swapped_halves_at_equal_weights(spark):
    words = [f"w{i}" for i in range(56)]
    around = [f"z{i}" for i in range(70)]
    df = spark.createDataFrame([(1, " ".join(around + words[28:] + words[:28] + around[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    rows = op10_decontamination.find_leaks(df, bench).collect()
    assert [(r.item_id, r.start, r.similarity) for r in rows] == [(9, 70, round(48 / 56, 9))]


def test_each_text_of_an_id_and_null_ids_are_searched(spark):
    texts = {x: " ".join(f"{x}{i}" for i in range(30)) for x in "abcde"}
    items = [(1, texts["a"]), (1, texts["b"]), (1, texts["b"].upper()), (None, texts["c"]), (None, texts["d"]), (2, texts["b"]), (3, None), (None, "")]
    docs = [(n, f"before it {t} and after") for n, t in enumerate(texts.values())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for kind in ("long", "string"):
        bench = spark.createDataFrame([(i if kind == "long" or i is None else str(i), t) for i, t in items], f"item_id {kind}, text string")
        rows = op10_decontamination.find_leaks(df, bench).collect()
        assert sorted((r.doc_id, str(r.item_id)) for r in rows) == [(0, "1"), (1, "1"), (1, "2"), (2, "None"), (3, "None")]
        assert all(r.similarity == 1.0 and r.start == 2 for r in rows)
        assert [r.doc_id for r in op10_decontamination.drop_leaks(df, bench).collect()] == [4]


def test_reach_covers_every_spread_of_the_radius():
    for radius in (3, 14, 19, 23):
        near = op10_decontamination.reach(radius)
        if radius == 19:
            assert near == [4, 4, 4, 4]
        for a in range(radius + 1):
            for b in range(radius + 1 - a):
                for c in range(radius + 1 - a - b):
                    for d in range(radius + 1 - a - b - c):
                        assert any(x <= y for x, y in zip((a, b, c, d), near))


def test_probes_fetch_all_fingerprints_within_the_radius(spark):
    rng = random.Random(11)
    items = [rng.getrandbits(64) for _ in range(4)]
    seen = []
    for n in range(300):
        x = items[n % 4]
        for bit in rng.sample(range(64), rng.randint(0, 30)):
            x ^= 1 << bit
        seen.append(x)
    long = lambda x: x - (1 << 64) if x >> 63 else x
    a = spark.createDataFrame([(long(x),) for x in items], "y long").select("y", op10_decontamination.probes(F.col("y"), 19).alias("p")).select("y", "p.*")
    b = spark.createDataFrame([(i, long(x)) for i, x in enumerate(seen)], "i long, x long").select("i", "x", op10_decontamination.blocks(F.col("x")).alias("p")).select("i", "x", "p.*")
    got = {(r.i, r.y) for r in b.join(a, ["block", "value"]).where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 19).collect()}
    want = {(i, long(y)) for i, x in enumerate(seen) for y in items if (x ^ y).bit_count() <= 19}
    assert got == want and len(want) > 100


def test_large_benchmarks_take_the_sieve(spark, monkeypatch):
    rng = random.Random(12)
    vocab = [f"y{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for i in range(20)]
    docs = [(d, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90))) + (" " + items[d % 20][1] if d % 3 else "")) for d in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, items)
    monkeypatch.setattr(op10_decontamination, "BROADCAST_ROWS", 10)
    got = {(r.doc_id, r.item_id): r.similarity for r in op10_decontamination.find_leaks(df, bench).collect()}
    assert set(got) == set(want) and len(want) >= 40


def test_fingerprints_at_the_limit_are_mostly_within_the_radius():
    """Recall of the radius: sets of similarity 0.8, the least that counts, weighted like shingles that one or two items hold."""
    rng = random.Random(13)
    hit = 0
    for _ in range(400):
        n = rng.choice([18, 45, 90])  # in common; an eighth of that each side has alone
        both, mine, its = ([(rng.getrandbits(64), rng.choice([5.3, 4.6])) for _ in range(m)] for m in (n, n // 9, n // 9))
        sums = [[sum(w if x >> i & 1 else -w for x, w in both + own) for i in range(64)] for own in (mine, its)]
        hit += sum((a > 0) != (b > 0) for a, b in zip(*sums)) <= op10_decontamination.RADIUS
    assert hit >= 0.99 * 400
