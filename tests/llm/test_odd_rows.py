"""Clashing names, ties, repeats, empty and long inputs of the operators, and formats on the fixture."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from loomgraph.llm import op01_mixing, op02_embeddings, op03_chat, op04_packing, op06_toxicity, op07_urls, op08_secrets


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["mix_source", "mix_size", "MIX_N", "mix_copies", "_mix_size", "a.b", "row"]
    df = spark.createDataFrame(
        [(i, "w " * (i % 9 + 1) + "long " * (i == 7) * 100_000, f"s{i % 3}", *(77 + i + j for j in range(len(names)))) for i in range(60)],
        "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names),
    )
    want = {r.doc_id: tuple(r) for r in df.collect()}
    copies = {r.doc_id: r.mix_copies for r in op01_mixing.with_copies(df.drop("mix_source", "mix_size", "MIX_N", "mix_copies")).collect()}
    out = op01_mixing.mix_sources(df)
    rows = out.collect()
    assert out.columns == df.columns and all(tuple(r) == want[r.doc_id] for r in rows)
    assert Counter(r.doc_id for r in rows) == Counter({d: n for d, n in copies.items() if n})
    assert op01_mixing.mix_sources(df.limit(0)).columns == df.columns


def unit(rng, n, d=64):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def beside(rng, x, cos):
    g = rng.standard_normal(x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    return cos * x + math.sqrt(1 - cos * cos) * g / np.linalg.norm(g, axis=1, keepdims=True)


def test_forest_at_its_defaults_over_several_levels(spark):
    rng = np.random.default_rng(1)
    x = unit(rng, 2_400)
    x = np.concatenate([x, beside(rng, x[:600], 0.9802), beside(rng, x[:200], 0.99), x[:20]]).astype(np.float32)
    label = np.arange(len(x)) % 2_400 % 3
    df = spark.createDataFrame([(i, v, int(a)) for i, (v, a) in enumerate(zip(x.tolist(), label))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in op02_embeddings.dedup_embeddings(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    assert all(got[i] <= n for i, n in enumerate(link.sum(1)))  # none below the limit
    assert sum(got.values()) >= 0.99 * link.sum()
    forest = op02_embeddings.Forest(u, len(u), 0.98, op02_embeddings.TREES, op02_embeddings.LEAF, 7)
    assert forest.depth == 5
    _, leaves = forest.leaves(u)
    assert np.unique(leaves, return_counts=True)[1].max() < len(u) / 6


def test_forest_is_as_deep_as_its_vectors_need(spark):
    rng = np.random.default_rng(2)
    x = unit(rng, 4_000)
    forest = op02_embeddings.Forest(x, 10**7, 0.98, op02_embeddings.TREES, op02_embeddings.LEAF, 7)
    assert forest.depth == 17 and forest.fitted == 6
    near = beside(rng, x, 0.9801)
    found = [defaultdict(set), defaultdict(set)]
    for side, v in zip(found, (x, near)):
        for r, leaf in zip(*(a.tolist() for a in forest.leaves(v))):
            side[r].add(leaf)
    assert sum(bool(found[0][r] & found[1][r]) for r in range(len(x))) >= 0.98 * len(x)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert op02_embeddings.dedup_embeddings(empty).count() == 0


def test_deep_conversations_share_all_their_turns(spark):
    rows = []
    for c in range(40):  # two trunks of 70 turns, then one turn of their own; neighbours by the first turns alone are of either trunk
        trunk = c % 2
        rows += [(c, t, "user", f"turn {t}" if t < 40 else f"trunk {trunk} turn {t}", "x") for t in range(70)]
        rows.append((c, 70, "assistant", f"own {c % 5}", "x"))
    rows += [(100, t, "user", f"turn {t}", "x") for t in range(32)] + [(101, 0, "user", "y" * 300_000, "x")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string").repartition(3)
    segments = op03_chat.format_chats(chats).coalesce(1)
    nodes = [r for r in segments.collect() if not r.last]
    borders = op03_chat.format_chats(chats).rdd.getNumPartitions()
    assert len({r.text for r in nodes}) == 40 + 60 + 5 + 1
    assert len(nodes) <= 40 + 60 + 10 + 1 + borders * 71
    got = {r.conv_id: r for r in op03_chat.read_back(op03_chat.format_chats(chats)).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((role, text))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    ended = [r for r in op03_chat.format_chats(chats, key_turns=4, max_sequence=100).collect() if not r.last]
    assert len(ended) > len(nodes) and {r.text for r in ended} == {r.text for r in nodes}


def test_labels_that_repeat(spark):
    docs = spark.createDataFrame([(i, "scumbag " * 3 + f"w{i}" if i % 4 == 0 else f"on the w{i}", 1, 1) for i in range(400)], "doc_id long, text string, toxic int, k int")
    once = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    twice = once.unionByName(once).unionByName(once.where("doc_id % 8 = 0").selectExpr("doc_id", "0 as toxic"))
    scores = [sorted(map(tuple, op06_toxicity.score_documents(docs, op06_toxicity.train(docs, lab)).collect())) for lab in (once, twice)]
    assert scores[0] == scores[1] and sum(r[2] for r in scores[0]) >= 95
    kept = op06_toxicity.drop_toxic(docs, once)
    assert kept.columns == docs.columns and kept.count() == 400 - sum(r[2] for r in scores[0])
    assert op06_toxicity.drop_toxic(docs.limit(0), once).count() == 0


def test_equally_long_rules_and_long_urls(spark):
    rules = (op07_urls.site_rule("block", "a.com", "/"), op07_urls.site_rule("allow", "a.com", "/"), op07_urls.pattern_rule("block", "zz", "zz"), op07_urls.pattern_rule("allow", "zz|q", "zz"))
    urls = ["http://a.com/x", "http://b.org/zz", "http://b.org/" + "y" * 1_000_000 + "/zz", "http://b.org/" + "y" * 100_000]
    for some in (rules, rules[1::-1] + rules[:1:-1]):
        first = some[0].verdict
        other = next(r.verdict for r in some if not r.site)
        got = op07_urls.filter_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, verdict string"), some).collect()
        assert [r.verdict for r in got] == [first, other, other, "allow"]
    assert op07_urls.filter_urls(spark.createDataFrame([], "page_id int, url string")).count() == 0


def fits(formats, word):
    """The definition: some automaton beats the ordinary chain by MARGIN nats a symbol."""
    w = "".join("0" if c in "0123456789" else "a" if c in "abcdef" else "z" if "g" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in word)
    ordinary = sum(formats.plain[x] for x in zip("^^" + w, "^" + w, w + "$"))
    for a in formats.automata:
        total, at = 0.0, 0
        for c in [*w, None]:
            seen = a.ends[at] if c is None else a.counts[at].get(c, 0)
            total += math.log((seen + 0.02) / (a.ends[at] + sum(a.counts[at].values()) + 0.02 * 11))
            at = at if c is None else a.moves[at].get(c, at)
        if total - ordinary > 0.5 * (len(w) + 1):
            return True
    return False


def test_formats_on_the_fixture(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    formats = op08_secrets.learn(docs.select("doc_id", "text"))
    assert {len(a.moves) > 1 for a in formats.automata} == {True} and len(formats.automata) >= 2
    want, n = {}, 0
    for d, t in zip(table["doc_id"], table["text"]):
        tokens = [m for m in re.finditer(r"[A-Za-z0-9+/_.-]+={0,2}", t or "") if len(m[0].rstrip("=")) >= 16]
        want[d] = [f"format:{m.start()}:{m.end()}" for m in tokens if fits(formats, m[0])]
        n += len(want[d])
    got = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("format")] for r in op08_secrets.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and n >= 10
    token = hashlib.sha1(b"new").hexdigest()  # no key before it, and cut below the base pattern's length
    r = op08_secrets.scan_secrets(spark.createDataFrame([(1, f"see {token[:30]} here")], "doc_id long, text string"), formats).first()
    assert (r.n_hex, r.spans) == (0, "format:4:34")
    assert op08_secrets.scan_secrets(docs.limit(0), formats).count() == 0


def test_state_merging_by_hand():
    a = op08_secrets.infer(["0" * n for n in (3, 4, 5, 6)] * 30)
    assert a.moves[0].get("0") is not None and a.score("0000") > a.score("aaaa") and a.score("0000") > a.score("0" * 20)
    b = op08_secrets.infer(["A0"] * 500)  # one A, one digit, the end: no two states agree
    at = b.moves[0]["A"]
    assert b.ends[0] == b.ends[at] == 0 and b.counts[at] == {"0": 500} and b.ends[b.moves[at]["0"]] == 500


def test_one_very_long_word_is_packed(spark):
    text = "ab" * 150_000
    df = spark.createDataFrame([(1, text, 5), (2, "x", 6), (3, None, 7)], "doc_id long, text string, length int")
    assert dict(op04_packing.unpack(op04_packing.pack_documents(df).collect())).get(1) == text
