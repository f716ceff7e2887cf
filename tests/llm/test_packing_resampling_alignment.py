"""Best-fit rounds, importance resampling and tokenizer alignment against plain Python."""

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loomgraph.llm import op11_best_fit, op12_resampling, op13_alignment
from loomgraph.llm.shared import materialize

FIXTURE = "/root/testdata/sf0.001"
#: Texts that break rules of thumb: runs and kinds of white space, controls, scripts, special tokens, marks that combine.
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na\tb \r\n c", "x\x1c y\x85 z  q", "a  b", "don't  we'll 's",
    "<|endoftext|> <|startoftext|>x <s> </s> <unk> <0x41>", "café café ́x ﬁn", "中文字 日本語", "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467 ok",
    "has ▁ mark", "▁", "nul\x00byte \x00 x", "1234 12,345.67 x=1;y=2", "ΣΑΣ İI ẞ", "a" * 3_000, "word " * 9_000, "z\n" * 5_000 + " .", "بسم الله", "​ ᠎ ﻿ b",
]


def odd_docs(spark, extra=""):
    rng = random.Random(5)
    words = ["the", "of,", "thonere.", "Ünd", "x1", "é", "\n", "", "–", "ing"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) for _ in range(60)] + ["the of, x1"] * 5
    rows = [((1 << 60) + 1 + i // 2 * 2 if i % 9 else None, t, "c", 7) for i, t in enumerate(texts)]  # some without an id, none changed
    rows += rows[-3:]
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, rank int").repartition(3), rows


def least_sequences(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(gaps, x)
        g = gaps.pop(i) if i < len(gaps) else capacity
        n += i == len(gaps) and g == capacity
        insort(gaps, g - x)
    return n


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_pieces_give_their_ids_back(spark):
    docs, want = odd_docs(spark)
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = op11_best_fit.pack_documents(docs, capacity=512).collect()
    parts, ids = Counter(), Counter()
    for doc, text, *_ in want:
        all_ids = [*tool.encode(text or "", add_special_tokens=False).ids, 1]
        for n in range(0, len(all_ids), 512):
            ids[doc, n // 512, n, np.array(all_ids[n : n + 512], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == ids
    assert all(r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    n = check_packing(rows, 512)
    assert n <= least_sequences([r.length for r in rows], 512) + 1
    digest = op11_best_fit.pack_documents(docs, capacity=512, keep_ids=False)
    assert sorted(map(str, ((r.doc_id, r.piece, r.ids_crc32) for r in digest.collect()))) == sorted(map(str, ((r.doc_id, r.piece, r.ids_crc32) for r in rows)))
    assert op11_best_fit.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["mixed", "large", "thirds", "one", "small"])
def test_rounds_over_many_ranges_come_near_best_fit(spark, kind):
    rng = random.Random(3)
    make = {
        "mixed": lambda: min(4_096, int(rng.lognormvariate(5.5, 1.2)) + 1), "large": lambda: rng.randrange(1_800, 2_600), "thirds": lambda: rng.choice([1_365, 1_366, 700]),
        "one": lambda: 300, "small": lambda: rng.randrange(1, 40),
    }[kind]
    lengths = [make() for _ in range(3_000)]
    pieces = materialize(spark.createDataFrame([(i, i, x) for i, x in enumerate(lengths)], "uid long, doc_id long, length long"))
    rows = op11_best_fit.with_places(pieces, range_rows=150).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    best = least_sequences(lengths, 4_096)
    assert check_packing(rows, 4_096) <= best + 1 + best // 50


def test_a_sweep_takes_the_least_gap_and_waits_without_one():
    # by position: gap 9, document 8, gap 5, document 5, document 3, gap 2, documents 2, 1, 1
    sizes, kinds = [9, 8, 5, 5, 3, 2, 2, 1, 1], [0, 1, 0, 1, 1, 0, 1, 1, 1]
    pairs, waiting, gaps = op11_best_fit.sweep(sizes, kinds)
    assert pairs == [(1, 0), (3, 2), (6, 5), (7, 0)] and waiting == [4, 8] and sorted(gaps) == [(0, 0), (2, 0), (5, 0)]
    told = {0: {0: (3, 10, 12)}, 1: {1: (2, 4, 5), 0: (1, 4, 4)}, 2: {1: (4, 1, 2)}}
    assert op11_best_fit.sweep_over_ranges(told) == [(1, 0, 2, 0, 0, 2), (2, 0, 2, 1, 0, 2), (2, 2, 4, 0, 1, 5)]


def plain_resample(docs, target, ngram=1, least=20, percent=10):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10_000

    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out, may = [], []
    for doc, text in docs:
        n, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                may.append(len(out))
        out.append([doc, len(f), weight, score, None])
    for rank, i in enumerate(sorted(may, key=lambda i: (-out[i][3], out[i][0], out[i][1]))[: percent * len(may) // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("ngram", "percent"), [(1, 10), (2, 60)])
def test_resampling_draws_what_a_sort_draws(spark, ngram, percent):
    docs, rows = odd_docs(spark)
    rng = random.Random(8)
    more = [(i, " ".join(rng.choice(["Alpha", "beta", "ga-mma", "δ", "x9"]) for _ in range(rng.randrange(15, 40)))) for i in range(400)]
    more += [(1_000 + i, more[0][1]) for i in range(200)]  # copies
    rows = [(d, t) for d, t, *_ in rows] + more
    target = ["beta beta x9", None, "", "ALPHA δ"]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "1 score", "2 n_words")
    bench = spark.createDataFrame([(t, 0) for t in target], "text string, bucket int")
    got = op12_resampling.resample(docs, bench, ngram=ngram, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(rows, target, ngram, percent=percent)
    assert op12_resampling.resample(docs.limit(0), bench).count() == 0
    assert sorted(map(tuple, op12_resampling.resample(docs, bench.limit(0), percent=percent).collect()), key=repr) == plain_resample(rows, [], percent=percent)


def test_first_ranks_count_what_is_above(spark):
    rng = random.Random(1)
    scores = [rng.randrange(-3_000, 3_000) // 7 for _ in range(2_000)]
    got = {r.score: r.start for r in op12_resampling.first_ranks(spark.createDataFrame([(s,) for s in scores], "score long"), span=16).collect()}
    assert got == {s: sum(x > s for x in scores) for s in set(scores)}


def plain_alignment(docs):
    a_tool, b_tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_tool.encode_special_tokens = True
    letter = op13_alignment._byte_letters()

    def of_b(x):
        p = b_tool.id_to_piece(x)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    told, count = [], Counter()
    for doc, text in docs:
        a, b = (a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)) if text else ([], [])
        sides = [bytes(letter[c] for c in a_tool.id_to_token(x)) for x in a], [of_b(x) for x in b]
        if not text or any(b"".join(s) != (" " + text).encode() for s in sides):
            told.append((doc, None))
            continue
        spans = [[(e - len(x), e) for x, e in zip(s, np.cumsum([len(x) for x in s]).tolist())] for s in sides]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[], []] for _ in cuts]
        for side, ids in enumerate((a, b)):
            for x, (_, e) in zip(ids, spans[side]):
                groups[bisect_left(cuts, e)][side].append(x)
        links, first = [], 0
        for x, (s, e) in zip(a, spans[0]):
            while spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(b) and spans[1][j][0] < e:
                links.append((x, b[j]))
                j += 1
        count.update(set(links))
        told.append((doc, (len(a), len(b), links, ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups), len(groups))))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc, t in told:
        if t is None:
            out.append((doc, 0, 0, 0, 0, "", 0, 0))
        else:
            n_a, n_b, links, groups, n = t
            out.append((doc, n_a, n_b, n, len(links), groups, sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links)))
    return sorted(out, key=repr)


def test_alignment_of_odd_texts_in_small_blocks(spark):
    docs, rows = odd_docs(spark)
    want = plain_alignment([r[:2] for r in rows])
    for block in (1_000, op13_alignment.BLOCK):
        assert sorted(map(tuple, op13_alignment.align_documents(docs, block=block).collect()), key=repr) == want
    digests = op13_alignment.align_documents(docs, keep_groups=False).collect()
    assert sorted((str(r.doc_id), r.groups) for r in digests) == sorted((str(r[0]), hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "") for r in want)
    assert op13_alignment.align_documents(docs.limit(0)).count() == 0


def test_alignment_of_the_fixture(spark):
    table = pq.read_table(f"{FIXTURE}/documents.parquet", columns=["doc_id", "text"])
    want = plain_alignment(list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())))
    got = op13_alignment.query(spark, FIXTURE).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got) == sorted((*w[:5], *w[6:]) for w in want)
    assert {r.doc_id: r.groups_sha256 for r in got} == {w[0]: hashlib.sha256(w[5].encode()).hexdigest() if w[5] else "" for w in want}
