"""The Jaccard join and decontamination against brute force."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from loomgraph.llm import op05_jaccard, op10_decontamination

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)] + ["Ünï", "é,", "A"]
    passage = [rng.choice(vocab) for _ in range(30)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(1, 160))] for _ in range(14)]
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.65:
            w = list(rng.choice(bases[:3] if kind < 0.4 else bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                j = rng.randrange(len(w))
                w[j : j + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
                w = w or ["x"]
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
            if kind > 0.8:
                w += passage
        out.append(rng.choice([" ", "\n", "  "]).join(w) if i % 7 else " ".join(w).upper())
    return out + [None, "", " \n", "one", "ONE", "one two", "a b c d", "a  b\tc d", "x " * 3000]


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, sets, similar):
    n = len(ids)
    link = [[a for a in range(n) if a != b and sets[a] and sets[b] and len(sets[a] & sets[b]) * similar.denominator >= similar.numerator * len(sets[a] | sets[b])] for b in range(n)]
    comp = {}
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min(ids[j] for j in seen)
    return comp


@pytest.mark.parametrize("k,similar,how", [(4, Fraction(85, 100), {}), (5, Fraction(4, 5), {"broadcast_rows": 0, "block_sets": 9})])
def test_jaccard_components(spark, k, similar, how):
    for seed in (1, 2):
        texts = corpus(seed)
        ids = random.Random(seed).sample(range(1000), len(texts))
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id long, text string, dg string, n long")
        got = {r.doc_id: r for r in op05_jaccard.jaccard_components(df, k, similar, **how).collect()}
        sets = [shingles(t, k) for t in texts]
        want = components(ids, sets, similar)
        assert len(got) == len(ids)
        for i, (d, s) in enumerate(zip(ids, sets)):
            assert (got[d].n_shingles, got[d].component_id) == (len(s), want[i])


def test_jaccard_repeats_nulls_and_nothing(spark):
    df = spark.createDataFrame([(3, "a b c d e", 1), (3, "a b c d e", 1), (None, "a b c d e", 1), (None, "q", 1), (9, None, 1), (9, None, 1)], "doc_id long, text string, rep int")
    got = sorted(map(repr, op05_jaccard.jaccard_components(df).drop("dg").collect()))
    assert len(got) == 6 and sum("component_id=3" in r for r in got) == 3
    assert op05_jaccard.jaccard_components(df.limit(0)).count() == 0
    kept = op05_jaccard.keep_one(spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 1), (4, "", 1), (5, None, 1)], "doc_id long, text string, gone int"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5] and kept.columns == ["doc_id", "text", "gone"]


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    for limit in (Fraction(85, 100), Fraction(1, 2), Fraction(4, 5)):
        for _ in range(15):
            base = [np.unique(rng.integers(0, 5000, rng.integers(1, 150))).astype(np.uint64) for _ in range(4)]
            sets = []
            for _ in range(rng.integers(2, 45)):
                s = base[rng.integers(4)]
                s = s[rng.random(len(s)) > rng.choice([0, 0.02, 0.05, 0.1, 0.3])]
                sets.append(np.unique(np.append(s, rng.integers(0, 5000, rng.integers(0, 6)).astype(np.uint64))) if len(s) else base[0])
            got = op05_jaccard.join_sets(sets, limit)
            want = components(list(range(len(sets))), [set(s.tolist()) for s in sets], limit)
            assert got.tolist() == [want[i] for i in range(len(sets))]


def leaks(docs, items, k=5, similar=0.8):
    """Every window of an item's size at every start, by the exact measure."""
    words = {i: WORD.findall((t or "").lower()) for i, t in items}
    seqs = {i: [tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] for i, w in words.items() if w}
    holds = {}
    for i, s in seqs.items():
        for x in set(s):
            holds[x] = holds.get(x, 0) + 1
    weight = lambda x: math.log(1 + len(seqs) / holds.get(x, 1))
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, s in seqs.items():
            n = len(words[i])
            for a in range(max(1, len(w) - n + 1) if w else 0):
                v = w[a : a + n]
                mine, its = {tuple(v[j : j + k]) for j in range(max(1, len(v) - k + 1))}, set(s)
                sim = sum(map(weight, mine & its)) / sum(map(weight, mine | its))
                if sim >= similar - 1e-9:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_leaks_equal_every_window(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 60)))) for i in range(25)]
    items += [(100, "short one here"), (101, ""), (102, None), (103, "Two Words")]
    docs = []
    for d in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        if d % 3 == 0:
            p = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                p[rng.choice([0, 1, -1, -2, len(p) // 2])] = rng.choice(vocab)
            a = rng.randint(0, len(w))
            w[a:a] = p
        docs.append((d, " ".join(w).title() if d % 2 else "\n".join(w)))
    docs += [(200, None), (201, ""), (202, "a Short one\there b"), (203, "two words"), (204, items[0][1]), (204, items[0][1]), (None, items[1][1]), (205, "z " * 60_000 + items[2][1])]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.similarity for r in op10_decontamination.find_leaks(df, bench).collect()}
    want = leaks([x for x in docs if x[0] != 205], items) | {(205, 2): 1.0}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-6 for x in got)
    bad = {d for d, _ in want}
    kept = op10_decontamination.drop_leaks(df, bench)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in bad)
    assert op10_decontamination.find_leaks(df.limit(0), bench).count() == 0
    assert op10_decontamination.find_leaks(df, bench.limit(0)).count() == 0


def test_segments_miss_no_link():
    rng = np.random.default_rng(5)
    for similar in (Fraction(85, 100), Fraction(4, 5), Fraction(1, 2)):
        for n in [*range(1, 40), 200, 1_500]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for taken in {0, n // 12, int((1 - similar) * n)}:  # the rest alone, or with as many others as a link allows
                kept = rng.permutation(a)[taken:]
                more = rng.integers(0, 1 << 63, int(len(kept) / similar) - n).astype(np.uint64)
                for b in (kept, np.concatenate([kept, more])):
                    if len(b) and len(kept) >= similar * (n + len(b) - len(kept)):
                        assert np.intersect1d(op05_jaccard.segments(a, similar), op05_jaccard.segments(np.sort(b), similar)).size, (similar, n, taken)


def test_a_chain_of_unrelated_documents_needs_no_blocks(spark, monkeypatch):
    rng = random.Random(9)
    passages = [[f"p{i}x{rng.random()}" for _ in range(50)] for i in range(61)]
    texts = [a + b for a, b in zip(passages, passages[1:])]  # each shares half with the next
    texts += [t[:60] + ["other"] + t[61:] for t in texts[::15]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    monkeypatch.setattr(op05_jaccard, "between_blocks", lambda *a: pytest.fail("all blocks compared"))
    got = {r.doc_id: r.component_id for r in op05_jaccard.jaccard_components(df, block_sets=20).collect()}
    assert got == {i: i for i in range(60)} | {60 + j: 15 * j for j in range(4)}
