"""What is learned from long texts and repeated ids, and texts of extreme sizes."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, pii, quality, shared, toxicity
from gridloom.llm.wordhash import buffer_of

DOCS = "doc_id long, text string, lang string, source string"


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_long_texts_are_learned_from(spark):
    rng = random.Random(1)
    of = {"aa": "ka to mi ra ne so".split(), "bb": "schl ung keit zw ich".split()}
    rows = []
    for k in range(60):
        lang = "aa" if k % 2 else "bb"
        text = prose(rng, of[lang], 12_000)
        if k % 5 == 0:
            words = text.split()
            for _ in range(400):
                words[rng.randrange(len(words))] = "vileword" + rng.choice(["", "s", "er"])
            text = " ".join(words)
        rows.append((k, text, lang, "s"))
    assert min(len(r[1]) for r in rows) > 50_000
    docs = spark.createDataFrame(rows, DOCS)
    net = langid.train(*langid.training_rows(docs))
    named = {r["doc_id"]: r["lang_pred"] for r in langid.languages(docs, net).collect()}
    assert named == {r[0]: r[2] for r in rows}
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(*toxicity.training_rows(docs, labels))
    assert any("vile" in e for e in lexicon.weights)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, lexicon).collect()}
    assert found == {k: int(k % 5 == 0) for k in range(60)}


@pytest.mark.parametrize("doc_id", [5, 7, 11, 12])
def test_rows_of_one_id_are_sampled(spark, doc_id):
    rows = spark.range(3000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("text of number "), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    assert shared.first_by_hash(rows, ["doc_id", "text"], 50).count() == 50
    assert shared.first_by_hash(rows.select("doc_id"), ["doc_id"], 50).count() == 50
    texts, languages = langid.training_rows(rows)
    wanted = 0 if zlib.crc32(str(doc_id).encode()) % 3 == 1 else langid.SAMPLE
    assert len(texts) == wanted and len(set(texts)) == wanted
    if wanted:
        assert set(collections.Counter(languages).values()) == {langid.SAMPLE // 2}


def test_short_and_rare_languages_are_learned(spark):
    rows = [(k, "oui", "short", None) for k in range(40)] + [(k, "the words of a longer text in the other language", "long", None) for k in range(40, 2000)]
    net = langid.train(*langid.training_rows(spark.createDataFrame(rows, DOCS)))
    assert net.languages == ["long", "short"]
    got = langid.languages(spark.createDataFrame([(1, "oui", None, None), (2, "the other words", None, None)], DOCS), net).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "short", 2: "long"}


def test_probabilities_pooled_over_windows():
    rng = np.random.default_rng(5)
    draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    net = langid.Network(["a", "b", "c"], langid.Direction.fresh(rng), langid.Direction.fresh(rng), draw(2 * langid.UNITS, 3) * 60, draw(3) * 60)
    fill = lambda t: (t * langid.SPAN)[: langid.SPAN * int(rng.integers(1, 6))]
    texts = ["", "12 34", "short", *(fill(t) for t in ("a text of some length ", "x", "1 b 22 c ", "Words, and MORE words. ", "0 "))]
    got = net.of_texts(*buffer_of(pa.array(texts)))
    assert np.isfinite(got).all()
    for text, p in zip(texts, got, strict=True):
        raw, total, letters = text.encode(), np.zeros(3), 0
        for k in range(0, len(raw), langid.SPAN):
            window = np.frombuffer(raw[k : k + langid.SPAN], np.uint8).astype(np.int64)
            full = np.zeros((langid.SPAN, 1), np.int64)
            full[: len(window), 0] = window
            ahead = net.ahead.states(full, [])[: len(window), 0]
            behind = net.behind.states(window[::-1, None], [])[::-1, 0]
            scores = np.concatenate([ahead, behind], axis=1) @ net.weights + net.bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            each = scores / scores.sum(axis=1, keepdims=True)
            here = np.array([bool(65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in window])
            total += each[here].sum(axis=0)
            letters += here.sum()
        if len(raw) % langid.SPAN == 0:  # shorter windows are padded to the longest beside them
            assert p == pytest.approx(total / max(letters, 1), abs=2e-3)


def test_matcher_against_all_entries():
    rng = random.Random(9)
    words = ["bad", "badly", "worse", "badge", "fine", "word", "words"]
    lexicon = toxicity.Lexicon({" bad ": 2.0, " badl": 1.5, " wors": 1.0, " word ": 0.5}, [" fine word ", " bad badge "], (-2.0, 1.0, 0.3))
    matcher = lexicon.matcher()
    for _ in range(300):
        text = " " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) + " "
        spared = set()
        for p in lexicon.exceptions:
            for k in range(len(text)):
                if text.startswith(p, k):
                    spared |= {k, text.index(" ", k + 1)}
        want = []
        for k in [m.start() for m in re.finditer(" ", text)]:
            hits = [w for e, w in lexicon.weights.items() if text.startswith(e, k)]
            if hits and k not in spared:
                want.append(max(hits))
        assert sorted(matcher.matches(text)) == sorted(want)
        n, score = matcher.score(text)
        total, count = sum(want), max(1, len(text.split()))
        z = -2.0 + math.log1p(total) + 0.3 * math.log1p(100 * total / count)
        assert n == len(want) and score == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_verdict_by_hand(spark):
    rng = random.Random(2)
    texts = [prose(rng, "ba be bi bo bu la le li lo lu".split(), 120) for _ in range(20)]
    for k in range(40):
        w = rng.choice(texts).split()
        a, n = rng.randrange(60), rng.randrange(2, 30)
        texts.append("\n".join(" ".join(w[a : a + n] if rng.random() < 0.4 else w[j * 10 : j * 10 + 10]) for j in range(12)))
    texts += ["# $ % | < > & * " * 10 + texts[0], texts[1] + "\n" + texts[1]]
    rows = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    verdicts = set()
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        chars = sum(map(len, w))
        top = 0.0
        failed = rows[k]["base_failed"]
        for n, most in quality.TOP_SHARE.items():
            grams = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            share = max((min(1.0, c * sum(map(len, g)) / chars) for g, c in grams.items() if c > 1), default=0.0)
            top, failed = max(top, share), failed or share > most
        repeated = 0.0
        for n, most in quality.REPEATED_SHARE.items():
            seen, inside = set(), set()
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in seen:
                    inside |= set(range(i, i + n))
                seen.add(g)
            share = sum(len(w[i]) for i in inside) / chars
            repeated, failed = max(repeated, share), failed or share > most
        seen, again, lines = set(), 0, [x for x in t.split("\n") if x.split()]
        for line in lines:
            again += sum(map(len, line.split())) * (line in seen)
            seen.add(line)
        r = rows[k]
        assert (r["top_share"], r["repeated_share"], r["dup_line_char_share"]) == pytest.approx((top, repeated, again / chars))
        failed = failed or r["n_dup_lines"] / len(lines) > quality.LINE_SHARE or again / chars > quality.LINE_CHAR_SHARE or r["n_symbols"] > quality.SYMBOL_SHARE * chars
        assert r["kept"] == (not failed)
        verdicts.add(r["kept"])
    assert verdicts == {True, False}


def spans_by_scan(text):
    """Base spans with the patterns as given."""
    from test_brute_force import base_spans

    return base_spans(text)


def test_personal_data_patterns(spark):
    rng = random.Random(6)
    pieces = ["a@b.c", "x.y@z-1.co", "_", ".", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (22) 333-4444", "7", "99", " ", "-", "q", "\U0001f600", "5.6", "+", "w@v"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", pii._written(pii.base_spans(F.col("text"))).alias("s")).collect()
    for r in got:
        assert r["s"] == ",".join(spans_by_scan(texts[r["k"]])), texts[r["k"]]


def test_personal_data_of_extreme_texts(spark):
    many = " ".join(f"user{k}@example{k % 7}.org" for k in range(100_000))
    rows = [(1, "9" * 10_000_000), (2, many), (3, "a." * 1_000_000 + "@"), (4, "a@" + "b." * 300_000 + "c"), (5, "1." * 500_000), (6, "1 " * 500_000 + "@")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["n_card"] for k in (1, 6)] == [0, 0]
    assert got[2]["n_email"] == 100_000 and got[4]["n_email"] == 1 and got[3]["n_email"] == 0
    assert got[2]["spans"].endswith(f"email:{len(many) - 22}:{len(many)}")
    assert got[5]["n_ip"] == 125_000
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(rows[1:2], "doc_id long, text string")).collect()}
    assert clean[2] == " ".join(["[EMAIL]"] * 100_000)


def test_terms_against_counts_by_hand(spark):
    rng = random.Random(12)
    common, names, mails = [f"w{c}" for c in "abcdefghij"], ["Orlando", "Zed", "Quu"], ["o@x.org", "z@x.org", "q@x.org"]
    rows = []
    for k in range(90):
        words = [rng.choice(common) + rng.choice("xyz") for _ in range(30)]
        if k % 6 == 0:
            at = rng.randrange(3)
            for _ in range(2):
                words.insert(rng.randrange(len(words)), names[at])
            words.insert(rng.randrange(len(words)), mails[at])
            if rng.random() < 0.4:
                words.insert(0, names[(at + 1) % 3])
        rows.append((k, " ".join(words)))
    mark = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    letters = re.compile(r"[^\W\d_\u0345]+")
    holds, beside, has = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    for k, t in rows:
        for w in {x.lower() for x in letters.findall(t)}:
            has[w].add(k)
        masked = mark.sub(lambda m: "\0" * len(m[0]), t)
        for m in mark.finditer(t):
            holds[m[0].lower()].add(k)
        for m in letters.finditer(masked):
            beside[k].add(m[0].lower())
    n, want = len(rows), {}
    for e, docs in holds.items():
        if not 2 <= len(docs) < n:
            continue
        for w in set().union(*(beside[k] for k in docs)):
            both = [k for k in docs if w in beside[k]]
            strength = math.log(n * len(both) / (len(has[w]) * len(docs))) / math.log(n / len(docs))
            if len(both) >= 2 and strength >= pii.GENERALISE:
                for k in both:
                    want[k, w] = max(want.get((k, w), 0), strength)
    expected = collections.defaultdict(list)
    for (k, w), _ in want.items():
        masked = mark.sub(lambda m: "\0" * len(m[0]), rows[k][1])
        expected[k] += [(m.start(), m.end()) for m in letters.finditer(masked) if m[0].lower() == w]
    got = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any(expected.values())
    assert got == {k: sorted(expected[k]) for k, _ in rows}


def test_sanitised_keeps_the_rest(spark):
    rows = [(k, f"Orlando writes{'x' * k} to o@x.org and 1.2.3.4, card 4111 1111 1111 1111; bye{k}.") for k in range(5)] + [(k, f"plain words to and card bye of text {k}") for k in range(10, 60)]
    got = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == t for k, t in rows if k >= 10)
    for k in range(5):
        assert got[k].endswith(f" to [EMAIL] and [IP], card [CARD]; bye{k}.")
        assert "orlando" not in got[k].lower()
