"""Operators that SQL cannot express, against plain Python."""

import collections
import hashlib
import html as references
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import html, jaccard, langid, linededup, packing, pii, quality, shared, topk, toxicity
from gridloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("bits", [64, 5])
def test_jaccard_components_with_long_lists(spark, bits, monkeypatch):
    monkeypatch.setattr(jaccard, "NAME", np.uint64((1 << bits) - 1))  # few bits: different sets have one name and get others
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 90]))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for d in range(300):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = passage + w[: rng.randint(0, 30)]
        rows.append((d, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(300) for j in range(i) if sets[i] and (c := len(sets[i] & sets[j])) * 100 >= 75 * (len(sets[i]) + len(sets[j]) - c)]
    root = roots(300, links)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: (len(sets[i]), least[root[i]]) for i in range(300)}


def test_divide_skip():
    rng = random.Random(1)
    for _ in range(200):
        lists = [sorted(rng.sample(range(20), rng.randint(1, 20))) for _ in range(rng.randint(1, 15))]
        least = rng.randint(1, 8)
        counts = collections.Counter(x for one in lists for x in one)
        assert jaccard.divide_skip(lists, least) == {x: c for x, c in counts.items() if c >= least}


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(3)
    kept = similar = 0
    for _ in range(400):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0.3, 0.8, 0.95])], rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64)]))
        c = len(np.intersect1d(x, y))
        near = 100 * c >= 75 * (len(x) + len(y) - c)
        may = jaccard.may_be_similar(len(x), jaccard.sketch(x), len(y), jaccard.sketch(y))
        assert may or not near
        similar, kept = similar + near, kept + may
    assert 0 < similar <= kept < 350


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = roots(400, edges)
    least = {}
    for x in sorted(got):
        least.setdefault(root[x], x)
    assert got == {x: least[root[x]] for x in got}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in pii.PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]():  # noqa: B023
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    rows += [(-1, "mail bob@x.example.com 😀 a@b.c_x@d.e 1.2.3.4.5 0001.2.3.255 1.2.3.256 4111 1111 1111 1111 4111-1111-1111-1112 +1 (988) 555-2485 +12 3"), (-2, "9" * 300)]
    rows += [(-10 - i, f"Contact Wintermute {'xyz' * i} today via neo@matrix.org please, filler{i} words") for i in range(4)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        spans = base_spans(text)
        assert got[doc_id]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert got[doc_id]["spans"].split(",")[: len(spans)] == (spans or [""])[: len(spans)]
        assert [got[doc_id][f"n_{k}"] for k in pii.PATTERNS] == [sum(s.startswith(k) for s in spans) for k in pii.PATTERNS]
    assert all("term:8:18" in got[-10 - i]["spans"] for i in range(4))


def test_line_edits(spark):
    rng = random.Random(3)
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            n = rng.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 12])
            w = ["abcde"[(i * i + n // 4) % 5] for i in range(n)]
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice("abcdex")
            if rng.random() < 0.3:
                w.insert(rng.randrange(len(w)), "y")
            lines.append((" " if rng.random() < 0.9 else "  ").join(w))
        rows.append((d, "\n".join(lines)))

    def near(a, b):
        if a == b or 0.25 * max(len(a), len(b)) < 1 or abs(len(a) - len(b)) > 1:
            return a == b
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    lines = [(d, k, tuple(line.split())) for d, t in rows for k, line in enumerate(t.split("\n")) if line.split()]
    gone = {(d, k) for d, k, w in lines if any((e, m) < (d, k) and near(w, v) for e, m, v in lines)}
    got = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], int(k)) for r in got for k in r["removed"].split(",") if k} == gone
    kept = {r["doc_id"]: r["text"] for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        left = "\n".join(line for k, line in enumerate(t.split("\n")) if (d, k) not in gone)
        assert kept.get(d, "") == left


def test_long_near_lines(spark):
    words = [f"w{i * i % 997}" for i in range(60_000)]
    changed = [*words[:31_000], "other", *words[31_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join([*changed[:50_000], "more", *changed[50_000:]])), (4, " ".join(words[2:]))]
    got = {r["doc_id"]: r["n_removed"] for r in linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_lines_of_repeated_ids(spark):
    rows = [(1, "the same line\nof two texts"), (1, "other words\nthe same line"), (2, "the same line")]
    got = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("n", [0, 1, 5, 32, 33, 64, 1024, 1025, 3000])
def test_running(spark, n):
    values = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n)
    (row,) = spark.createDataFrame([(values.tolist(),)], "x array<long>").select(shared.running(F.col("x"), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias("r")).collect()
    assert row["r"] == [0, *np.bitwise_xor.accumulate(values)[:-1].tolist()][:n]


def test_quality_figures(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in quality.quality(documents).collect():
        t = texts[r["doc_id"]]
        w = WORD.findall(t)
        counts = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) if counts[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_packing_round_trip(spark, documents):
    words = packing.WordIds(packing.tokenizer_json())
    encode = lambda t: [*words.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]
    odd = ["Ünïcode <|endoftext|> it's 12.5% ` mark\x1cfs ΣΑΣ İx café ", "don't. we'll, U.S.A. éa."]
    assert [x.tolist() for x in words.encode(odd)] == [encode(t) for t in odd]
    rows = packing.pack(documents).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for doc_id, found in pieces.items():
        ids, at = encode(texts[doc_id]), 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], np.uint32).tobytes())
        assert at == len(ids)
    padding = total = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding < 0.005 * total


def test_plan_is_the_cheapest():
    rng = np.random.default_rng(4)
    old, packing.WINDOW = packing.WINDOW, 16
    try:
        for _ in range(50):
            marks = np.unique(rng.integers(1, 60, 25))
            cost = rng.integers(0, 4, len(marks)) * 3
            at = [0, *marks.tolist()]
            if max(np.diff(at)) > 16:
                continue
            best = [0.0] + [np.inf] * len(marks)
            for j in range(1, len(at)):
                for i in range(j):
                    n = at[j] - at[i]
                    if n <= 16:
                        free = n & (n - 1) == 0 and at[j] >= at[-1] - 16
                        best[j] = min(best[j], best[i] + (0 if free else 16 - n) + cost[j - 1] + packing.SEQUENCE)
            total, a = 0, 0
            for b in packing.plan(marks, cost, at[-1] - 16):
                n = b - a
                total += (0 if n & (n - 1) == 0 and b >= at[-1] - 16 else 16 - n) + cost[list(marks).index(b)] + packing.SEQUENCE
                a = b
            assert total == best[-1]
    finally:
        packing.WINDOW = old


def test_sliced_index():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, d, m = int(rng.integers(1, 300)), int(rng.integers(1, 9)), int(10 ** rng.integers(0, 6))
        matrix, ids, q = rng.integers(-m, m + 1, (n, d)), rng.integers(0, n, n), rng.integers(-m, m + 1, d)
        got, scores = topk.SlicedIndex(matrix).best(q, ids, int(ids[0]), 10)
        exact = matrix @ q
        order = [j for j in np.lexsort((ids, -exact)) if ids[j] != ids[0]][:10]
        assert got.tolist() == ids[order].tolist() and scores.tolist() == exact[order].tolist()


def test_pages_against_their_markup(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article[^>]*>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", references.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_page_without_article():
    page = """<body class="has-sidebar"><div id="wrap"><header><h1>Site</h1></header><div class="menu"><a href=x>Home</a></div><div class="main"><h2>Title</h2>
    <p>First paragraph with a good many words in it, quite enough to be sure.<div class="advert-box">Buy now</div><p>Second &eacute; paragraph with many more words of text.</p>
    <aside>Side</aside><p>Third.</p></div><div class="comments"><p>Great post I like it very much indeed.</p></div><section id="cookie-notice">Cookies</section><form><p>Mail</p></form><footer>c</footer></div>"""
    assert html.main_text(page, html.Weights(-1.0, -1.0)) == "Title\nFirst paragraph with a good many words in it, quite enough to be sure.\nSecond é paragraph with many more words of text.\nThird."


def test_best_region_against_all_intervals():
    rng = random.Random(4)
    for _ in range(300):
        runs = [(rng.randrange(6), -rng.randrange(4), rng.randrange(12), rng.randrange(5)) for _ in range(rng.randrange(1, 12))]
        tag, link = rng.choice([-0.5, -1.0, -4.0]), rng.choice([1.0, -1.0, -3.0])

        def score(a, b):
            return sum(p + link * q for _, _, p, q in runs[a:b]) + sum(tag * t + left for t, left, _, _ in runs[a + 1 : b])  # noqa: B023

        best = max((score(a, b) for a in range(len(runs)) for b in range(a + 1, len(runs) + 1)), default=0)
        a, b = html.best_region(runs, tag, link)
        assert (score(a, b) if a < b else 0) == pytest.approx(max(best, 0))


def test_names_are_evidence_not_a_list():
    page = "<body><nav>x</nav><article><h1>Title</h1><p>Some words of an article.</p><section class='menu-history'><p>How menus came about.</p></section><div class='ad'>Buy this now</div><ul class='comment-list'><li>Nice one</li></ul><p>End.</p></article></body>"
    assert html.main_text(page) == "Title\nSome words of an article.\nHow menus came about.\nEnd."


def test_names_are_learned():
    page = lambda k: f"<body><div class='zork'><p>Words beside it number {k} and more</p></div><article><p>Some words of article {k} and a few others.</p><div class='zork'>odd {k}</div></article></body>"
    weights = html.fit([page(k) for k in range(30)])
    assert weights.names["zork"] < -1
    assert html.main_text("<body><div><p>All of the words here.</p><div class='zork'>Left out words are here.</div><p>And those.</p></div></body>", html.Weights(-0.5, -1.0, weights.names | {"zork": -8.0})) == "All of the words here.\nAnd those."


def test_odd_pages_take_linear_time():
    began = time.perf_counter()
    deep = "<div>word " * 60_000
    assert html.main_text(deep + "</div>" * 60_000, html.Weights(-0.1)).count("word") == 60_000
    assert html.main_text('<a "' * 100_000) is not None
    assert html.main_text("<p>" + '<a "' * 100_000 + ">") is not None
    assert time.perf_counter() - began < 20


def test_fold():
    assert toxicity.fold("You 1d10t, w0rthl3ss МORОN 555!") == " you idiot worthless moron 555 "


def test_toxicity_held_out():
    rng = random.Random(7)
    neutral = [f"{a}{b}" for a in "ba be bi bo bu da de di do du".split() for b in "la le li lo lu ra re ri ro ru".split()]
    texts, labels = [], []
    for k in range(600):
        w = [rng.choice(neutral) for _ in range(rng.randint(5, 80))]
        label = int(k % 5 == 0)
        if label:
            w[rng.randrange(len(w))] = rng.choice(["moron", "scum", "idiot"] + [f"zorq{x}" for x in neutral[:30]])
        texts.append(" ".join(w))
        labels.append(label)
    matcher = toxicity.learn(texts[:450], labels[:450]).matcher()
    predicted = [int(matcher.score(toxicity.fold(t))[1] >= toxicity.THRESHOLD) for t in texts[450:]]
    wrong = sum(p != y for p, y in zip(predicted, labels[450:], strict=True))
    assert wrong <= 3


def test_network_learns_and_its_gradient_is_right():
    rng = np.random.default_rng(0)
    one = langid.Direction.fresh(rng)
    x = rng.integers(0, 256, (7, 5))
    pull = rng.standard_normal((7, 5, langid.UNITS)).astype(np.float32)
    kept = []
    one.states(x, kept)
    grads = one.gradients(x, kept, pull)
    for values, grad in zip((one.rows, one.gates, one.cell), grads, strict=True):
        k = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, step = values[k], 1e-2
        values[k] = old + step
        up = float((one.states(x, []) * pull).sum())
        values[k] = old - step
        down = float((one.states(x, []) * pull).sum())
        values[k] = old
        assert (up - down) / (2 * step) == pytest.approx(float(grad[k]), rel=0.05)
    assert np.abs(one.sweep(x) - one.states(x, [])).max() < 1e-5


def test_language_held_out(spark, documents):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1 and r[1]]
    net = langid.train([r[1] for r in learn], [r[2] for r in learn])
    got = {r["doc_id"]: r for r in langid.languages(documents, net).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1 and len(r[1]) > 40]
    assert all(got[r[0]]["held_out"] for r in held)
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
