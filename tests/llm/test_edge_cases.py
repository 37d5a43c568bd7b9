"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import html, jaccard, langid, linededup, mixing, packing, pii, quality, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["key", "n", "row", "at", "node", "_row", "gone", "k", "epoch", "block_turn", "words", "v", "dim", "base", "terms", "held_out", "score", "_at", "part", "place"]
LONG = "a very long line of words that goes on and on " * 20_000
ROWS = [
    (1, None, None, None, None), (None, "some words without an id here", "en", "a", 5), (2, "", "en", None, 0), (3, " \n\t\n ", None, "a", 5),
    (4, LONG, "en", "b", len(LONG)), (5, "the same row twice, word for word", "en", "b", 33), (5, "the same row twice, word for word", "en", "b", 33),
    (6, "you idiot 😀 write to me@example.org", "en", "c", 30), (7, "x" * 50_000, None, "c", 50_000),
]


def tables(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    return docs, docs.withColumns({c: F.lit("clash") for c in CLASHES}), docs.where("false")


def lexicon():
    bad = [f"{w} you idiot {w}{k}" for k, w in enumerate("alpha beta gamma delta kappa omega sigma theta".split())]
    return toxicity.learn(bad + [f"a kind text number {k} here" for k in range(40)], [1] * len(bad) + [0] * 40)


LABELS = "doc_id long, quality int, toxic int"


def learned(d):
    """The query's own path, labels and training rows included."""
    labels = d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 0), (4, None, 0), (5, 1, 1), (5, 1, 0), (6, 0, 1), (None, 1, 1), (9, 1, None)], LABELS)
    return toxicity.toxicity(d, toxicity.learn(*toxicity.training_rows(d, labels)))


def named(d):
    return langid.languages(d, langid.train(*langid.training_rows(d)))


OPERATORS = {
    "op1": lambda d: mixing.mixture(d, max_repeats=4.0),
    "op1 entropy": lambda d: mixing.mixture(d, entropy=1.2, budget=0.5),
    "op2": jaccard.jaccard_components,
    "op3": pii.personal_data,
    "op3 text": pii.sanitised,
    "op4": linededup.line_report,
    "op5": lambda d: toxicity.toxicity(d, lexicon()),
    "op5 learned": learned,
    "op6": quality.quality,
    "op7": lambda d: langid.languages(d, None),
    "op7 learned": named,
    "op10": packing.pack,
}
STAGES = {
    "toxicity": lambda d: toxicity.without_toxic(d, lexicon()),
    "line_dedup": linededup.deduplicated,
    "ngram_jaccard": jaccard.one_of_each,
    "mixing": lambda d: mixing.mixed(d, max_repeats=2.0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name):
    docs, clashing, empty = tables(spark)
    plain = sorted(map(str, OPERATORS[name](docs).select("doc_id").collect()))
    assert plain
    assert sorted(map(str, OPERATORS[name](clashing).select("doc_id").collect())) == plain
    assert OPERATORS[name](empty).count() == 0
    same = [c for c in OPERATORS[name](docs).columns if c not in ("sequence_id", "offset")]
    values = lambda d: sorted((str(r) for r in OPERATORS[name](d).select(*same).collect()))
    assert values(clashing) == values(docs)


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, name):
    docs, clashing, empty = tables(spark)
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    assert STAGES[name](clashing).columns == clashing.columns
    assert STAGES[name](clashing).count() == out.count()
    assert STAGES[name](empty).count() == 0
    rows = lambda d: sorted(str(r) for r in d.select(*docs.columns).collect())
    assert rows(STAGES[name](clashing)) == rows(out)


def test_packing_stage(spark):
    docs, clashing, empty = tables(spark)
    pieces = lambda d: sorted(str(r) for r in packing.pack(d, keep_words=False).drop("sequence_id", "offset").collect())
    assert pieces(docs) == pieces(clashing) and len(pieces(docs)) >= len(ROWS)
    assert packing.pack(empty, keep_words=False).count() == 0


def test_stage_results(spark):
    docs, _, _ = tables(spark)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    assert 6 not in ids(STAGES["toxicity"](docs))
    assert ids(STAGES["line_dedup"](docs)).count(5) == 2  # neither of two rows at one place is earlier
    assert ids(STAGES["ngram_jaccard"](docs)).count(5) == 1
    assert {1, 2, 3, 4, 5, 6, 7} <= set(ids(STAGES["mixing"](docs)))


def test_pages(spark):
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>" + "w " * 200_000), (3, "u", "<div <p> & &amp; < <b"), (3, "u", "<div <p> & &amp; < <b")], schema)
    got = html.extract(pages.withColumns({c: F.lit("clash") for c in ("text", "n_chars", "key", "place")})).collect()
    assert len(got) == 5
    assert {r["page_id"]: r["text"] for r in got}[1] == ""
    assert max(r["n_chars"] for r in got) == 399_999
    assert html.extract(pages.where("false")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [-1.0, 0.25]), (9, [-1.0, 0.25]), (100, [1e30, 1e30])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("shard", "v", "dim", "query", "score", "rank")})
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(vectors).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [100, 1, 2, 9, 9]
    assert topk.top_k(vectors.where("false")).count() == 0
