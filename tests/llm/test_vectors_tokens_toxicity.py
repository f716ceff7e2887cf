"""Embedding forest, packing and toxicity against plain Python."""

import random
import re

import numpy as np
import pytest

from loomgraph.llm import op02_embeddings, op04_packing, op06_toxicity


def brute(rows, cosine):
    good = {}
    for i, (v, e, lab) in enumerate(rows):
        if v is None or lab is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(e, dtype=np.float32).astype(float)
        good[i] = x / np.linalg.norm(x)
    links = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and rows[i][2] == rows[j][2] and good[i] @ good[j] >= cosine] for i in good}
    comp = {}
    for i, (v, _, _) in enumerate(rows):
        todo, seen = [i], {i}
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((v, len(links.get(i, ())), comp[i], v is None or v == comp[i]) for i, (v, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("leaf,block", [(2000, 1500), (40, 1500), (60, 15)])
def test_forest_finds_every_link(spark, leaf, block):
    rng = np.random.default_rng(1)
    rows, d = [], 16
    centres = rng.standard_normal((12, d))
    for i in range(500):
        c = centres[i % 12] if i % 3 else centres[0]
        rows.append((i, [float(x) for x in c + 0.05 * rng.standard_normal(d) * (i % 5)], i % 2))
    rows += [(900 + i, rows[3][1], rows[3][2]) for i in range(20)] + [rows[4]]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * d, 1), (1003, [None] + [1.0] * (d - 1), 1), (1004, [float("nan")] + [1.0] * (d - 1), 0)]
    rows += [(1005, rows[1][1], None), (None, rows[1][1], 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [1e-30] * d, 1), (1009, [1e30] * d, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = op02_embeddings.dedup_embeddings(df, leaf=leaf, block=block, trees=6).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, op02_embeddings.COSINE)


def test_forest_of_nothing(spark):
    assert op02_embeddings.dedup_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(200):
        limit = rng.choice([1, 7, 16, 100])
        lengths = [rng.randint(1, limit) for _ in range(rng.randrange(60))]
        got = op04_packing.best_fit_decreasing(lengths, limit)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in r) <= limit for r in got)
        free = []
        for n in sorted(lengths, reverse=True):
            fit = [f for f in free if f >= n]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - n)
            else:
                free.append(limit - n)
        assert sorted(free) == sorted(limit - sum(lengths[i] for i in r) for r in got)


def test_packing_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", " ", "a", "a  b", " a b c", "x\n y z", "don't we'll  ", "naïve — ünï 日本語 🙂", "w " * 9000, "tab\tb c d", "a b c  d e"]
    texts += [" ".join(rng.choice(["the", "ab,", "Qué", "\n", "12x", "'s", "!!"]) for _ in range(rng.randrange(300))) for _ in range(80)]
    rows = [(i if i % 9 else None, t, "en") for i, t in enumerate(texts)] + [(5, texts[5], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = op04_packing.pack_documents(df, row=256, window=3000).collect()
    assert sorted(map(repr, op04_packing.unpack(got))) == sorted(repr((d, t or "")) for d, t, _ in rows)
    enc = op04_packing.encoder(op04_packing.TOKENIZER)
    for t in texts:
        assert np.frombuffer(op04_packing.token_ids(t or ""), "<u2").tolist() == enc.encode_ordinary(t or "")
    for r in got:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == op04_packing.END).all()
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.position_resets)
    assert op04_packing.pack_documents(df.limit(0)).count() == 0


def test_segments_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(1, 14)
        place = sorted(rng.sample(range(30), n))
        weight = [rng.uniform(0.2, 3) for _ in range(n)]
        score = {p: w for p, w in zip(place, weight)}
        line = [score.get(i, -0.4) for i in range(31)]

        def best(lo, hi):  # the definition: the best segment, then those left and right of it
            found = [(sum(line[a : b + 1]), a, b) for a in range(lo, hi) for b in range(a, hi)]
            top = max(found, key=lambda x: (x[0], -x[1]), default=(0, 0, 0))
            return [] if top[0] <= 1e-9 else best(lo, top[1]) + [(top[1], top[2], round(top[0], 6))] + best(top[2] + 1, hi)

        got = [(a, b, round(s, 6)) for a, b, s in op06_toxicity.segments(np.array(place), np.array(weight), 0.4 * (np.diff(place, prepend=-1) - 1))]
        assert got == best(0, 31)


def test_toxicity_of_the_fixture_held_out(spark):
    """The measure of the README: rows that the model has not seen, over three languages."""
    folder = "/root/testdata/sf0.1"
    got = op06_toxicity.query(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null"), "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r.score for r in got if r.toxic == y] for y in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    found = sum(r.predicted for r in got if r.toxic)
    print("held out", len(got), "area", area, "recall", found / len(toxic), "precision", found / sum(r.predicted for r in got))
    assert area >= 0.95 and found >= 0.9 * len(toxic) and found >= 0.9 * sum(r.predicted for r in got)


def test_toxicity_held_out_and_edge_cases(spark):
    rng = random.Random(4)
    plain = ["".join(rng.choice(["the", "on", "er", "ti", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["scumbag", "verdammt", "ÖdesPack", "moronic"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(5, 120))]
        for _ in range(toxic * rng.randint(2, 6)):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None, "en", "s", 1), (5001, "", "en", "s", 1), (None, "scumbag moronic " * 5, "en", "s", 1), (5002, "\n \t", "en", "s", 1), (5003, "on " * 100_000, None, None, 1), (3, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, n_chars long")
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = op06_toxicity.train(docs, lab)
    got = op06_toxicity.score_documents(docs, model, passages=True).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    right = [by[i].predicted == t for i, _, t in labels]
    assert sum(right) >= 0.98 * len(right)
    assert by[None].predicted == 1 and not any(by[i].predicted for i in (5000, 5001, 5002, 5003))
    for i in range(0, 200, 8):
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1])
        for p in by[i].passages:
            assert words[p["first"]] in bad and words[p["last"]] in bad
    kept = op06_toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)
    assert op06_toxicity.train(docs, lab.limit(0)).score(1, 1) < 0.3
    assert op06_toxicity.score_documents(docs.limit(0), model).count() == 0
