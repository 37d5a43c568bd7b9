"""Line dedup: lines equal to, or one word's edit from, an earlier line of the corpus go.

Deletion-neighbourhood join. A line is its sequence of words. Equal lines are one class, by
hash. Two different lines are near if their edit distance in words (a word substituted,
inserted or deleted) is 1 and their similarity, 1 - distance / words of the longer one, is
`SIMILAR` or more. Every class emits the hash of each variant with one word deleted; variants
equal at the same place (a substitution), or equal to a whole line (an insertion), meet in a
group, whose earliest line is the witness against all later ones, so a group of any size
gives one row a member. The witness is compared word by word before a line goes. A line is
kept if no earlier line (by doc_id, then a hash of the text, then line number) is equal or
near, whether or not that earlier line is itself kept.

Only lines that share their first or last half of words with a different line emit variants:
an edit leaves one of the halves whole, so this loses nothing. Groups are counted by their
key with partial sums and joined back: broadcast up to `BROADCAST` rows of a fixed size,
counted first, beyond that by a shuffle whose hot keys adaptive execution splits. Style:
DataFrame functions only; lines and variants are written to the shared folder and deleted
when they have been read.

Edge cases: a null or empty text has one empty line, which is kept; white space inside a
line does not matter for comparing but kept lines stay as they are; a null doc_id comes
last in the order; rows with the same id and text have the same places, so neither is
earlier; an empty table gives an empty result; further columns are kept by `deduplicated`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import few, release, running, written

#: Least similarity of two near lines.
SIMILAR = 0.75
#: Rows up to which the smaller side of a join is broadcast; they hold a few numbers each.
BROADCAST = 1 << 18
#: Lines that go, a number each, up to which they are broadcast to the texts.
GONE = 1 << 20
_LAST = 9223372036854775807


def may_edit(n: Column) -> Column:
    """Whether two lines one word apart, the longer one of n words, are similar enough."""
    return F.lit(1 - SIMILAR) * n >= 1


def normal(text: Column) -> Column:
    """A text whose lines are words with single spaces; most texts are that already."""
    text = F.coalesce(text, F.lit(""))
    odd = text.rlike(r"[\x09\x0B-\x0D]|\x20[\x20\n]|\n\x20|^\x20|\x20$")
    one = F.regexp_replace(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), r"\x20?\n\x20?", "\n")
    return F.when(odd, F.trim(one)).otherwise(text)


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (d, t, number, line, n) of the lines that hold a word: t tells rows of one id apart, line is its words, n how many."""
    rows = docs.select(place(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.split(normal(F.col("text")), "\n")).alias("number", "line"))
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return rows.where(F.col("line") != "").withColumn("n", n.cast("int"))


def place(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST))


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit("2nd"), line).alias("b")]


def _halves() -> Column:
    """Keys of the first and last words that an edit may leave, for this many words and for one less, as the other line may have."""
    n = F.col("n")
    h, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    key = lambda name, k: F.xxhash64(F.lit(name), F.abs(k), F.call_function("substring_index", "line", F.lit(" "), k))
    keys = F.array_distinct(F.array(key("first", h), key("first", less), key("last", h - n), key("last", less - n + 1)))
    return F.when(may_edit(n + 1), keys).alias("halves")


def _variants(emitting: DataFrame) -> DataFrame:
    """Rows (a, b, at, n, p, v): v is the hash of the words without the p-th; p = -1: of all words.

    The hash of a sequence is the exclusive or of hashes of (word, place), so one running value
    gives all variants of a line.
    """
    at = lambda less: F.transform("words", lambda w, k: F.xxhash64(w, k - less))
    xor = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s.bitwiseXOR(y))
    rows = emitting.select("a", "b", "at", F.size("words").alias("n"), at(0).alias("here"), at(1).alias("before"))
    rows = rows.withColumn("moved", F.zip_with("here", "before", lambda x, y: x.bitwiseXOR(y)))
    rows = rows.select("a", "b", "at", "n", xor("here").alias("whole"), xor("before").alias("rest"), "before", running(F.col("moved"), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y)).alias("running"))
    without = F.zip_with("before", "running", lambda x, y: x.bitwiseXOR(y))
    without = F.transform(without, lambda x, k: F.struct(F.col("n"), k.alias("p"), x.bitwiseXOR(F.col("rest")).alias("v")))
    whole = F.array(F.struct((F.col("n") + 1).alias("n"), F.lit(-1).alias("p"), F.col("whole").alias("v")))
    each = F.explode(F.when(may_edit(F.col("n")), F.concat(whole, without)).otherwise(whole))
    return rows.select("a", "b", "at", each.alias("x")).select("a", "b", "at", "x.*")


def _met(rows: DataFrame, key: str) -> DataFrame:
    """The values of `key` that rows of different classes have."""
    found = rows.groupBy(key).agg(F.min("a").alias("low"), F.max("a").alias("high"), F.min("b").alias("low_b"), F.max("b").alias("high_b"))
    return written(found.where("low <> high or low_b <> high_b").select(key))


def removed_lines(docs: DataFrame) -> DataFrame:
    """Rows (d, t, number) of the lines that go, as a written table."""
    lines = lines_of(docs)
    at = F.struct("d", "t", "number")
    slim = written(lines.select(*_identity(F.col("line")), "d", "t", "number", _halves()))
    repeated = slim.groupBy("a", "b").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    repeated = written(repeated.select("a", "b", "first"))
    # lines that share a half with another class
    halves = slim.where("halves is not null").withColumn("half", F.explode("halves"))
    shared = _met(halves.select("a", "b", "half"), "half")
    chosen = halves.join(few(shared, BROADCAST), "half", "left_semi").groupBy("a", "b").agg(F.min(at).alias("at"))
    chosen = written(chosen)
    release(shared)
    texts = lines_of(docs.withColumn("d_", place(F.col("doc_id"))).join(few(chosen.select(F.col("at.d").alias("d_")).distinct(), BROADCAST), "d_", "left_semi"))
    texts = texts.select("line", *_identity(F.col("line")), at.alias("at"))
    emitting = texts.join(few(chosen, BROADCAST), ["a", "b", "at"], "left_semi").groupBy("a", "b", "at").agg(F.min("line").alias("line"))
    emitting = written(emitting.select("a", "b", "at", F.split("line", " ").alias("words")))
    release(chosen)
    # variants met by another class
    met = _met(_variants(emitting).select("a", "b", "v"), "v")
    every = written(_variants(emitting).join(few(met, BROADCAST), "v", "left_semi"))
    release(met)
    variants, wholes = every.where("p >= 0"), every.where("p < 0")
    # substitutions: the same place deleted, the rest equal
    by_place = variants.groupBy("n", "p", "v").agg(F.min("at").alias("first")).join(variants, ["n", "p", "v"])
    # insertions: a variant equal to a whole line of one word less
    longer = variants.groupBy("n", "v").agg(F.min("at").alias("first")).join(wholes, ["n", "v"])
    shorter = variants.join(wholes.select("n", "v", F.col("at").alias("first")), ["n", "v"])
    found = [x.where("first < at").select("a", "b", "first") for x in (by_place, longer, shorter)]
    found = reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.min("first").alias("first"))
    # word by word against the witness
    other = emitting.select(F.col("at").alias("first"), F.col("words").alias("other"))
    pairs = found.join(emitting.select("a", "b", "words"), ["a", "b"]).join(other, "first")
    near = written(pairs.where(within_one(F.col("words"), F.col("other"))).select("a", "b").distinct())
    release(every, emitting)
    # every line of a near class goes, of others all but the first
    none = F.lit(None).cast(repeated.schema["first"].dataType)
    decided = repeated.join(near, ["a", "b"], "left_anti").unionByName(near.withColumn("first", none))
    decided = written(decided)
    gone = slim.select("a", "b", "d", "t", "number").join(few(decided, BROADCAST), ["a", "b"]).where(F.col("first").isNull() | (at > F.col("first")))
    gone = written(gone.select("d", "t", "number"))
    release(slim, repeated, near, decided)
    return gone


def within_one(a: Column, b: Column) -> Column:
    """Whether one word substituted, inserted or deleted, or none, makes two word sequences equal."""
    long, short = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    gap = F.size(long) - F.size(short)
    k = F.size(short)
    agree = F.zip_with(F.slice(long, F.lit(1), k), short, lambda x, y: x == y)
    first = F.array_position(agree, False).cast("int")  # from 1; 0: none
    rest_long = F.slice(long, first + 1, F.greatest(F.size(long) - first, F.lit(0)))
    rest_short = F.slice(short, F.when(gap == 0, first + 1).otherwise(F.greatest(first, F.lit(1))), F.size(short))
    return F.when(gap > 1, F.lit(False)).when(first == 0, F.lit(True)).otherwise(rest_long == rest_short)


def _with_gone(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with the numbers of their lines that go, null if none do."""
    gone = removed_lines(docs)
    each = gone.distinct().groupBy("d", "t").agg(F.array_sort(F.collect_list("number")).alias("gone"))
    if gone.count() <= GONE:
        each = F.broadcast(each)
    return rows.join(each, ["d", "t"], "left")


def _keyed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    return docs.select(*columns, place(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("t"))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document its lines, how many go, and their numbers (from 0) comma-joined."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")
    rows = _with_gone(docs, _keyed(docs, "doc_id", n))
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without the lines that go.

    A document that loses every line that held a word goes; the others keep their place, and
    n_chars, where there is one, is the length of what is left.
    """
    rows = _with_gone(docs, _keyed(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text"))
    changed = F.col("gone").isNotNull()
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.transform(left, lambda k: F.get(F.col("lines"), k))
    rows = rows.withColumn("lines", F.when(changed, lines)).withColumn("text", F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text")))
    rows = rows.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
