"""Mixing, chat, url and secret operators against plain Python."""

import hashlib
import random
import re

from loomgraph.llm import op01_mixing, op03_chat, op07_urls, op08_secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_targets_and_edge_cases(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), "en", rng.choice(["a", "b", "ü", "z", None]), 1) for i in range(800)]
    rows += [(None, "x y", "en", "a", 1), (5, None, "en", "q", 1), (6, "", None, "q", 1), (7, "t t", "en", "b", 1), (7, "t t", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("lang", "mix_size")
    got = op01_mixing.with_copies(df).collect()
    assert len(got) == len(rows)
    size, target, taken = {}, {}, {}
    for r in got:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.mix_size == words and 0 <= r.mix_copies <= 3
        size[r.source] = size.get(r.source, 0) + words
        target[r.source] = r.mix_target
        taken[r.source] = taken.get(r.source, 0) + words * r.mix_copies
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, full = {}, set()
    while True:  # the plain procedure: share, cap, share the excess again
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        want = {s: 3 * size[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and want[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    for s in order:
        assert abs(want[s] - target[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= max(0.25 * target[s], 60)
    again = {(r.doc_id, r.text): r.mix_copies for r in op01_mixing.with_copies(df.repartition(7)).collect()}
    assert all(again[(r.doc_id, r.text)] == r.mix_copies for r in got)
    assert op01_mixing.mix_sources(df).count() == sum(r.mix_copies for r in got)
    assert op01_mixing.with_copies(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(2)
    odd = ["<|im_end|>", "<||im_start|>x", "<", "|", "<|", "a\nb", "", None, "ünï", "<|im_start|>assistant\nhi<|im_end|>\n", "x<"]
    rows = []
    for c in range(60):
        shared = rng.randrange(3)
        for t in range(rng.choice([1, 2, 3, 40, 70])):
            role = ["user", "assistant", "system", None, "we\nird<|r"][0 if t == 0 else rng.choice([0, 1, 1, 1, 2, 3, 4])]
            text = f"root {shared}" if t < 2 else f"same {t}" if t < 36 and c % 2 else rng.choice(odd)
            rows.append((c, t, role, text))
    rows += [(None, 0, "user", "n"), (None, 1, "assistant", "m"), (3, 0, "user", "tie"), (3, 0, "user", "tie")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = op03_chat.format_chats(chats)
    got = {r.conv_id: r for r in op03_chat.read_back(segments).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(op03_chat.turn_text(r, t)[0]) for r, t in turns)
    nodes = [r for r in segments.collect() if not r.last]
    assert len(nodes) < len(rows)  # shared turns are written once
    seqs = {}
    for r in nodes:
        seqs.setdefault(r.seq_id, {})[r.node] = r
    for seq in seqs.values():
        for r in seq.values():
            path, p = [], r.parent
            while p >= 0:
                path.append(seq[p])
                p = seq[p].parent
            assert r.position == sum(len(x.text) for x in path)
            assert sum(b - a for a, b in r.attends) == r.position
            assert {i for a, b in r.attends for i in range(a, b)} == {i for x in path for i in range(x.start, x.stop)}
    assert op03_chat.read_back(op03_chat.format_chats(chats.limit(0))).count() == 0


def test_escape_is_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice(["<", "|", "<|", "im_start", ">", "\n", "\\", "n", "é"]) for _ in range(rng.randrange(9)))
        assert op03_chat.unescape(op03_chat.escape(s)) == s
        assert op03_chat.unescape_role(op03_chat.escape_role(s)) == s
        assert op03_chat.START not in op03_chat.escape(s) and op03_chat.STOP not in op03_chat.escape(s)


def test_urls_index_equals_every_rule(spark):
    rng = random.Random(4)
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.EXAMPLE.COM/en/x", "http://example.com", "x://a.com/", "ftp://net/es/", "a://b://c.com/"]
    for _ in range(500):
        host = rng.choice(["", "www.", "a.www.", "m.", "ads."]) + rng.choice(["example.com", "Example.net", "notexample.com", "example.org", "com", "net"])
        urls.append("https://" + host + rng.choice(["", "/", "/en/", "/EN/", "/en", "/fr/1.html", "/es/2", "/casino/"]) + rng.choice(["", "?utm_source=feed", "?page=2&ref=x", "#top"]))
    rows = [(i if i % 50 else None, u, "h") for i, u in enumerate(urls)]
    got = [tuple(r) for r in op07_urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()]
    want = []
    for i, u, _ in rows:
        host, path = op07_urls.split_url(u)
        low = (u or "").translate(op07_urls._FOLD)
        fit = [r for r in op07_urls.SITES if host and re.match(r.pattern, host + path)]
        best = max(fit, key=lambda r: len(r.name), default=None)
        rest = next((r for r in op07_urls.PATTERNS if re.search(r.pattern, low)), None)
        verdict = best.verdict if best else rest.verdict if rest else "allow"
        want.append((i, host, path, best and best.name, verdict))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert op07_urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_secrets_against_plain_scan(spark):
    rng = random.Random(5)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    akia = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))
    rows = [(i, f"ü text {akia()} Password : '{hexed(18)}' and {hexed(40)} end", "x") for i in range(60)]
    rows += [(100, None, "x"), (101, "", "x"), (101, "", "x"), (None, "token=secret: abcdefgh1", "x"), (102, "token=short", "x"),
             (103, "PAſſWORD=abcdefgh1 paßword", "x"), (104, "z " * 50_000 + "API_KEY=abcd/efgh+1", "x"), (105, f"new ASIA{hexed(4)} {hexed(31)}", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_hex): r for r in op08_secrets.scan_secrets(df).collect()}
    assert op08_secrets.scan_secrets(df).count() == len(rows)
    for i, text, _ in rows:
        text = text or ""
        base = [(m.start(), 0, m.end()) for m in re.finditer(op08_secrets.ASSIGN, text) if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(base))
        r = got[(i, sum(k == 2 for _, k, _ in base))]
        assert (r.n_assign, r.n_access) == (sum(k == 0 for _, k, _ in base), sum(k == 1 for _, k, _ in base))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))


def test_inferred_formats_generalise():
    rng = random.Random(6)
    make = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))
    words = ["thentionshing", "Weltanschauung", "responsabilidad"] * 50
    f = op08_secrets.Formats({"access": [make() for _ in range(200)]}, words)
    new = ["ASIA" + make()[4:] for _ in range(100)]
    new = [w for w in new if any(map(str.isdigit, w))]  # a token without digits is never a credential
    assert sum(map(f.fits, new)) >= 0.95 * len(new)
    assert not any(map(f.fits, ["thentionshingandmore", "2024-01-01-report-final", "internationalization"]))
    assert len(f.automata[0].moves) and not op08_secrets.Formats({}, []).fits("ASIA" + "B2" * 8)
