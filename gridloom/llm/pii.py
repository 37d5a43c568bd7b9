"""Personal data: pattern spans, and terms that reveal them by corpus co-occurrence.

Base spans are emails, IP addresses, card and phone numbers by fixed patterns. The method
then asks which other words disclose a protected entity (a base value): over all documents,
the pointwise mutual information of word and entity, PMI = log(N * both / (word * entity)),
against the entity's own information, IC = log(N / entity). Counts are of documents; both
counts those that hold the word anywhere beside the entity, in at least CONTEXTS different
contexts (what surrounds the entity, and the words next to the word), so copies of one text
are no evidence. In every text that holds the entity, each occurrence of the word is
generalised (its kind is written instead) from GENERALISE * IC on and removed from
REMOVE * IC on. Words are runs of letters of any length that touch no base span. Style:
DataFrame functions only; of texts only those that hold a finding need be gathered, besides
them only words, counts and base spans are. Patterns and positions take time linear in a text,
whatever runs of digits or letters and however many matches it holds.

Edge cases: a null or empty text has no span (the digest is that of the empty string);
texts are searched whole; rows with the same id and text share their added spans; a null
doc_id is like any other; an empty table gives an empty result; further columns are kept
by `sanitised`, which writes spaces for the noncharacters U+FDD0 to U+FDD7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import few, let, release, row_key, running, written

#: The kinds in their order, by their patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches without recursion and without trying every place of a long run: a match begins where a run of
#: its first characters does, or where the last match ended, and what it repeats is never given back. Then a character that every match holds.
SEARCHED = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (PATTERNS["phone"], "+"),
}
KINDS = [*PATTERNS, "term"]
#: Characters on either side of a base span that tell its contexts apart; different contexts a finding needs.
WINDOW, CONTEXTS = 48, 2
#: Disclosure thresholds as multiples of the entity's information.
GENERALISE, REMOVE = 0.7, 0.9
#: Rows up to which the smaller side of a join is broadcast; they hold a word, or a key and a few numbers.
BROADCAST = 1 << 18
#: Stand for the first and every further character of a base span, by kind, so that words keep their places.
FIRST = {kind: chr(0xFDD0 + 2 * k) for k, kind in enumerate(PATTERNS)}
FURTHER = {kind: chr(0xFDD1 + 2 * k) for k, kind in enumerate(PATTERNS)}
MARKS = "".join(FIRST[k] + FURTHER[k] for k in PATTERNS)
#: A run of letters and of what touches it of base spans.
WORD = rf"[\p{{L}}{MARKS}]+"
_SPANS = "array<struct<kind:string,start:int,end:int,value:string,around:bigint>>"


def _accepted(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _cut(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and what is before, between and after them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _may(kind: str, text: Column) -> Column:
    sign = SEARCHED[kind][1]
    if kind == "ip":
        return text.rlike("[0-9][.][0-9]") & text.rlike(SEARCHED[kind][0])
    return F.contains(text, F.lit(sign)) & text.rlike(SEARCHED[kind][0]) if sign else text.rlike("[0-9]{2}|[0-9][ -][0-9]")


def _starts(found: Column, gaps: Column) -> Column:
    """Where each match begins, in code points."""
    steps = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    return F.zip_with(running(steps, F.lit(0), lambda x, y: x + y), gaps, lambda at, g: at + F.length(g))


def spans_of(kind: str, text: Column) -> Column:
    """The accepted matches of a kind: array of (kind, start, end, value, around), end exclusive, in code points; around
    is a hash of up to WINDOW characters on either side, as far as the next match of the kind."""
    found, gaps = _cut(text, SEARCHED[kind][0])
    around = lambda x: F.xxhash64(F.right(x["g"], F.lit(WINDOW)), F.left(x["h"], F.lit(WINDOW)))
    span = lambda x: F.struct(F.lit(kind).alias("kind"), x["at"].alias("start"), (x["at"] + F.length(x["m"])).alias("end"), x["m"].alias("value"), around(x).alias("around"))

    def spans(cut: Column) -> Column:
        m, g = cut["found"], cut["gaps"]
        part = lambda x, k: F.slice(x, F.lit(k), F.size(m))
        rows = F.arrays_zip(m.alias("m"), part(_starts(m, g), 1).alias("at"), part(g, 1).alias("g"), part(g, 2).alias("h"))
        return F.transform(F.filter(rows, lambda x: _accepted(kind, x["m"])), span)

    return F.when(_may(kind, text), let(F.struct(found.alias("found"), gaps.alias("gaps")), spans)).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    return F.when(text.rlike("[0-9@]"), F.concat(*(spans_of(k, text) for k in PATTERNS))).otherwise(F.array().cast(_SPANS))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked_kind(kind: str, text: Column) -> Column:
    """The text, as long as before, with marks for the characters of the accepted matches."""
    found, gaps = _cut(text, SEARCHED[kind][0])
    marked = F.transform(found, lambda m: F.when(_accepted(kind, m), F.concat(F.lit(FIRST[kind]), F.repeat(F.lit(FURTHER[kind]), F.length(m) - 1))).otherwise(m))
    return F.when(_may(kind, text), F.array_join(F.zip_with(gaps, marked, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")).otherwise(text)


def _words(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def disclosing_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of a text that reveal an entity it holds, as written rows (key, word, strength), strength = PMI / IC, and the texts with base spans (key, masked, entities)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), text.alias("text"))
    near = rows.where(text.rlike("[0-9@]")).select("key", "text", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    entities = F.transform("spans", lambda s: F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), s["around"].alias("around")))
    near = near.select("key", "text", entities.alias("entities"))
    masked = near
    for k, kind in enumerate(PATTERNS):  # step by step, or each would hold all before it several times
        masked = masked.withColumn("text", _masked_kind(kind, F.translate("text", MARKS, " " * len(MARKS)) if k == 0 else F.col("text")))
    near = written(masked.select("key", F.col("text").alias("masked"), "entities"))
    n = docs.count()
    held = near.select("key", F.explode("entities").alias("e")).groupBy("key", "e.entity").agg(F.min("e.around").alias("around"))
    counted = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity").between(2, n - 1))
    held = written(held.join(few(counted, BROADCAST), "entity"))
    most = held.agg(F.max("n_entity")).first()[0] or 1
    # words of texts that hold an entity which others hold, with the words next to them
    words = near.select("key", "masked").join(few(held.select("key").distinct(), BROADCAST), "key", "left_semi").select("key", _words(F.col("masked")).alias("w"))
    none = F.array(F.lit(""))
    beside = F.arrays_zip(F.col("w").alias("w"), F.concat(none, "w").alias("l"), F.concat(F.slice("w", F.lit(2), F.size("w")), none).alias("r"))
    words = words.where(F.size("w") > 0).select("key", F.explode(beside).alias("x")).select("key", F.col("x.w").alias("word"), F.xxhash64("x.l", "x.r").alias("beside"))
    words = words.where(F.col("word").isNotNull() & ~F.col("word").rlike(f"[{MARKS}]"))
    words = written(words.groupBy("key", "word").agg(F.min("beside").alias("beside")))
    # both <= n_entity, so a word of more documents than this cannot reach GENERALISE; one of a single document has one context
    may = lambda n_entity: F.log(n / F.col("n_word")) >= GENERALISE * F.log(n / n_entity) - 1e-9
    wanted = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= CONTEXTS).select("word"))
    each = rows.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower))).alias("word"))
    # counted before any join by shuffle, so a frequent word is a row a task
    df = each.join(few(wanted, BROADCAST), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n_word"))
    df = written(df.where((F.col("n_word") >= CONTEXTS) & may(F.lit(most))))
    release(wanted)
    pairs = words.join(few(df, BROADCAST), "word").join(held, "key").where(may(F.col("n_entity")))
    pairs = written(pairs.select("key", "entity", "word", "n_word", "n_entity", F.xxhash64("around", "beside").alias("context")))
    release(words, df, held)
    # documents and contexts counted in two steps, so that no pair is gathered in one task
    pair = ["entity", "word", "n_word", "n_entity"]
    by_context = pairs.groupBy(*pair, "context").agg(F.count(F.lit(1)).alias("c"))
    judged = by_context.groupBy(*pair).agg(F.sum("c").alias("both"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= CONTEXTS)
    pmi = F.log(n * F.col("both") / (F.col("n_word") * F.col("n_entity")))
    judged = judged.select("entity", "word", (pmi / F.log(n / F.col("n_entity"))).alias("strength")).where(F.col("strength") >= GENERALISE)
    judged = written(judged)
    found = written(pairs.select("key", "entity", "word").join(few(judged, BROADCAST), ["entity", "word"]).groupBy("key", "word").agg(F.max("strength").alias("strength")))
    release(pairs, judged)
    return found, near


def _added(docs: DataFrame) -> DataFrame:
    """Rows (key, terms) of the texts with terms, to be broadcast up to BROADCAST terms in all; terms: ascending (start, end, strength)."""
    found, near = disclosing_terms(docs)
    by_key = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "strength"))).alias("strengths"))
    masked = near.select("key", "masked").join(few(by_key.select("key"), BROADCAST), "key", "left_semi").dropDuplicates(["key"])
    cut, gaps = _cut(F.col("masked"), WORD)
    rows = masked.select("key", cut.alias("cut"), gaps.alias("gaps")).select("key", "cut", _starts(F.col("cut"), F.col("gaps")).alias("at"))
    rows = rows.join(by_key, "key").withColumn("cut", F.arrays_zip("cut", F.slice("at", F.lit(1), F.size("cut")).alias("at")))
    terms = F.transform("cut", lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["cut"])).alias("end"), F.element_at("strengths", F.lower(x["cut"])).alias("strength")))
    added = written(rows.select("key", F.filter(terms, lambda t: t["strength"].isNotNull()).alias("terms")))
    release(found, near)
    total = added.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    return F.broadcast(added) if total <= BROADCAST else added


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document its base counts and digest, and all spans."""
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    rows = rows.join(_added(docs), "key", "left")
    rows = rows.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,strength:double>>")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.lit("").alias("value"), F.lit(0).cast("long").alias("around")))
    return rows.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", terms)).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns; in text base spans are [KIND], generalised words [TERM], removed words nothing."""
    found, near = disclosing_terms(docs)
    release(near)
    by_key = found.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "strength"))).alias("strengths"))
    key = row_key(F.col("doc_id"), F.col("text")).alias("key")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key, F.translate("text", MARKS, " " * len(MARKS)).alias("text"))
    for kind in PATTERNS:
        rows = rows.withColumn("text", _masked_kind(kind, F.col("text")))
    rows = rows.join(F.broadcast(by_key) if found.limit(BROADCAST + 1).count() <= BROADCAST else by_key, "key", "left")
    cut, gaps = _cut(F.col("text"), WORD)
    strength = lambda w: F.element_at("strengths", F.lower(w))
    put = lambda w: F.when(strength(w).isNull(), w).when(strength(w) >= REMOVE, "").otherwise("[TERM]")
    rows = rows.withColumn("text", F.when(F.col("strengths").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(gaps, cut, lambda g, w: F.concat(g, F.coalesce(put(w), F.lit("")))), "")))
    new = F.col("text")
    for kind in PATTERNS:
        new = F.regexp_replace(new, f"{FIRST[kind]}{FURTHER[kind]}*+", f"[{kind.upper()}]")
    return rows.select(*(new.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
