"""The queries of these operators, and SQL that gives the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as many tokens as there are, sources flattened until one is repeated 4 times."""
    from gridloom.llm.mixing import mixture

    return mixture(_table(spark, sf_dir, "documents"), max_repeats=4.0, budget=1.0)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.linededup import line_report

    return line_report(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.toxicity import learn, toxicity, training_rows

    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, learn(*training_rows(docs, _table(spark, sf_dir, "labels"))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.langid import languages, train, training_rows

    docs = _table(spark, sf_dir, "documents")
    return languages(docs, train(*training_rows(docs)))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_temperature_mixing, op2_ngram_jaccard, op3_personal_data, op4_line_dedup, op5_toxicity,
        op6_quality_rules, op7_language_id, op8_exact_top_k, op9_html_extraction, op10_packing,
    )
}

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op1_temperature_mixing": f"""
WITH RECURSIVE slim AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS n_tokens,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS place
  FROM documents
), sizes AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM slim GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS n FROM sizes WHERE tokens > 0),
search(step, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN flat THEN (low + high) / 2 ELSE low END, CASE WHEN flat THEN high ELSE (low + high) / 2 END
  FROM (SELECT step, low, high,
          (SELECT max(pow(tokens / n, (low + high) / 2) / tokens) / sum(pow(tokens / n, (low + high) / 2)) * max(n) FROM sizes, total WHERE tokens > 0) > 4.0 AS flat
        FROM search WHERE step < 40)
), alpha AS (SELECT high AS a FROM search WHERE step = 40),
z AS (SELECT sum(pow(tokens / n, a)) AS z FROM sizes, total, alpha WHERE tokens > 0),
weights AS (SELECT source, tokens, round(pow(tokens / n, a) / z, 9) AS weight, CAST(round(pow(tokens / n, a) / z * n) AS BIGINT) AS quota FROM sizes, total, alpha, z WHERE tokens > 0
  UNION ALL SELECT source, tokens, 0.0, 0 FROM sizes WHERE tokens = 0),
passes AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM weights),
spun AS (SELECT s.*, p.passes, p.rest, p.weight, md5('17:' || s.source || ':' || CAST(p.passes AS VARCHAR) || ':' || place[1:2]) || place[3:4] || place AS turn FROM slim s JOIN passes p USING (source)),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY turn RANGE UNBOUNDED PRECEDING) AS upto FROM spun),
over_at AS (SELECT source, min(turn) AS over_at FROM upto WHERE upto > rest GROUP BY source),
times AS (SELECT u.*, u.passes + CASE WHEN rest > 0 AND (over_at IS NULL OR turn < over_at) THEN 1 ELSE 0 END AS times FROM upto u LEFT JOIN over_at USING (source)),
drawn AS (SELECT *, unnest(range(0, times)) AS e FROM times)
SELECT doc_id, source, n_tokens, CAST(e AS INT) AS epoch, md5('17:' || source || ':' || CAST(e AS VARCHAR) || ':' || place[1:2]) AS block_turn, place, CAST(weight AS DOUBLE) AS weight FROM drawn
""",
    "op2_ngram_jaccard": f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), each AS (SELECT r, unnest(s) AS g FROM sets),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM each a JOIN each b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM shared JOIN sets p ON p.r = x JOIN sets q ON q.r = y WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(r, other) AS (SELECT r, r FROM sets UNION SELECT reach.r, b.y FROM reach JOIN both_ways b ON b.x = reach.other),
least AS (SELECT reach.r, min(s.doc_id) AS component_id, count(*) AS component_size FROM reach JOIN sets s ON s.r = reach.other GROUP BY reach.r)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (r)
""",
    "op4_line_dedup": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, k, {_WORDS.format("ls[k + 1]")} AS w FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS k FROM docs)),
long AS (SELECT doc_id, k, w, len(w) AS n, (doc_id, k) AS pos FROM lines WHERE len(w) >= 1),
classes AS (SELECT w, n, min(pos) AS pos FROM long GROUP BY w, n),
variants AS (SELECT pos, n, p, w[1:p] || w[p + 2:n] AS v FROM (SELECT pos, n, w, unnest(range(0, n)) AS p FROM classes WHERE 0.25 * n >= 1)),
by_place AS (SELECT n, p, v, min(pos) AS low FROM variants GROUP BY n, p, v),
near AS (
  SELECT a.pos FROM variants a JOIN by_place b USING (n, p, v) WHERE b.low < a.pos
  UNION SELECT c.pos FROM classes c JOIN variants a ON a.v = c.w WHERE a.pos < c.pos
  UNION SELECT a.pos FROM classes c JOIN variants a ON a.v = c.w WHERE c.pos < a.pos
),
gone AS (SELECT l.doc_id, list(DISTINCT l.k ORDER BY l.k) AS gone FROM long l JOIN classes c USING (w, n) WHERE c.pos < l.pos OR c.pos IN (SELECT pos FROM near) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed FROM docs d LEFT JOIN gone USING (doc_id)
""",
    "op8_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 10
""",
}
