"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights are the sources' token shares to a power between 0 (all alike) and 1 (as they
are), normalised. The exponent is bisected: either the least that keeps every source
within a limit of repetitions, or the largest whose weights reach an entropy. A source's
quota, its weight times the budget, is met by whole passes over its documents and a part
of one more: blocks of documents in an order drawn for that pass, the block at the limit
cut again by smaller blocks and at last by document, so nothing larger than 1/65536 of a
source is ever sorted. Sources may be any number: the driver sees sums over them only.
Style: DataFrame functions only; one slim table (id, source, tokens, hash) is written to the
shared folder and read again, texts are never shuffled.

Edge cases: a null source is the source named by the empty string; a null or blank text
has no token and comes with every whole pass (and in the partial one if its place is
within the quota); a source without tokens comes once; rows with the same id share their
place and are taken or left together; an empty table gives an empty result; further
columns are kept by `mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.shared import SPACE, release, written

#: Bisection steps, and how many of them one aggregation over the sources decides; the hash's first two and next two hex digits name the blocks.
STEPS, AT_ONCE, SEED = 40, 6, "17"
#: Sources up to which their table is broadcast; it has one row of a few numbers a source.
BROADCAST_SOURCES = 20_000


def n_tokens(text: Column) -> Column:
    """Words of a text, counted without making them."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.rlike(r"[\x09-\x0D]|\x20\x20|^\x20|\x20$"), F.trim(F.regexp_replace(t, SPACE, " "))).otherwise(t)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def place(doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary"))


def turn(source: Column, epoch: Column, block: Column) -> Column:
    """Where a block stands in a pass over its source."""
    return F.md5(F.concat_ws(":", F.lit(SEED), source, epoch.cast("string"), block).cast("binary"))


def weights(sizes: DataFrame, max_repeats: float | None, entropy: float | None, budget: float | None) -> DataFrame:
    """Per source (source, tokens): its weight, the exponent and its quota of tokens.

    budget: tokens as a multiple of all tokens; None: as many as give every source one pass at least.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    live = sizes.where("tokens > 0").select(F.col("tokens").cast("double").alias("tokens"))
    n = live.agg(F.sum("tokens")).first()[0] or 1.0

    def at(alphas: list[float]) -> list[dict[str, float]]:
        """Sums and extremes of the powers for several exponents, from one aggregation."""
        grid = live.withColumn("a", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("alpha")) for i, x in enumerate(alphas)))))
        power = F.pow(F.col("tokens") / F.lit(n), F.col("a.alpha"))
        stats = {"z": F.sum(power), "logs": F.sum(power * F.log(power)), "most": F.max(power / F.col("tokens")), "least": F.min(power / F.col("tokens"))}
        return [r.asDict() for r in grid.groupBy("a.i").agg(*(c.alias(k) for k, c in stats.items())).orderBy("i").collect()]

    def too_flat(r: dict[str, float]) -> bool:
        if entropy is not None:
            return math.log(r["z"]) - r["logs"] / r["z"] > entropy
        if budget is None:
            return r["most"] / r["least"] > max_repeats
        return budget * n / r["z"] * r["most"] > max_repeats

    low, high = 0.0, 1.0
    for begin in range(0, STEPS, AT_ONCE) if live.limit(1).count() else ():
        depth = min(AT_ONCE, STEPS - begin)
        # the middles that so many halvings could come to, as a tree: the children of k are 2k + 1 (lower) and 2k + 2
        ends = [(low, high)]
        for k in range((1 << depth) - 1):
            lo, hi = ends[k]
            ends += [(lo, (lo + hi) / 2), ((lo + hi) / 2, hi)]
        found = at([(lo + hi) / 2 for lo, hi in ends[: (1 << depth) - 1]])
        k = 0
        for _ in range(depth):
            k = 2 * k + (2 if too_flat(found[k]) else 1)
        low, high = ends[k]
    # above `high` the limit holds; for an entropy, below `low` it is reached
    alpha = low if entropy is not None else high
    (last,) = at([alpha]) or [{"z": 1.0, "least": 1.0}]
    whole = last["z"] / last["least"] if budget is None else budget * n
    t = F.col("tokens").cast("double")
    w = F.when(t > 0, F.pow(t / F.lit(n), F.lit(alpha)) / F.lit(last["z"])).otherwise(0.0)
    rows = sizes.select("source", F.col("tokens").cast("long").alias("tokens"), F.round(F.lit(alpha), 9).alias("alpha"), F.round(w, 9).alias("weight"), F.round(w * F.lit(whole)).cast("long").alias("quota"))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(1)).cast("int")
    return rows.withColumn("passes", passes).withColumn("left", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))


def _cut(rows: DataFrame, order: Column, *carried: str) -> DataFrame:
    """Per source the first block (by `order`) at which the tokens before and in it exceed `left`, and what is left for it."""
    w = Window.partitionBy("source").orderBy("at")
    sums = rows.groupBy("source", order.alias("at"), "left", *carried).agg(F.sum("n_tokens").alias("here"))
    sums = sums.withColumn("upto", F.sum("here").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    first = sums.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("at", (F.col("left") - F.col("upto") + F.col("here")).alias("rest"))).alias("m"))
    return first.select("source", F.col("m.at").alias("cut"), F.col("m.rest").alias("left"))


def plan(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: float | None = 1.0) -> tuple[DataFrame, DataFrame]:
    """The slim table of documents, and per source its passes and the place where its partial pass ends."""
    source = F.coalesce("source", F.lit("")).alias("source")
    slim = written(docs.select("doc_id", source, n_tokens(F.col("text")).alias("n_tokens"), place(F.col("doc_id")).alias("place")))
    sizes = written(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    per = written(weights(sizes, max_repeats, entropy, budget))
    few = F.broadcast if per.count() <= BROADCAST_SOURCES else (lambda x: x)
    rows = slim.join(few(per.select("source", "passes", "left")), "source")
    block, small = F.substring("place", 1, 2), F.substring("place", 3, 2)
    spin = turn(F.col("source"), F.col("passes"), block)
    one = written(_cut(rows, spin))
    in_block = rows.drop("left").join(few(one), "source").where(spin == F.col("cut")).drop("cut")
    two = written(_cut(in_block, small))
    in_small = in_block.drop("left").join(few(two), "source").where(small == F.col("cut")).drop("cut")
    three = _cut(in_small, F.col("place"))
    ends = per
    for name, at in (("block_cut", one), ("small_cut", two), ("place_cut", three)):
        ends = ends.join(few(at.select("source", F.col("cut").alias(name))), "source", "left")
    ends = written(ends)
    release(sizes, per, one, two)
    return slim, ends


def drawn(rows: DataFrame, ends: DataFrame, source: Column, at: Column) -> DataFrame:
    """Each row as often as it is drawn: adds epoch and block_turn (its block's place in that pass), and what `ends` has."""
    few = F.broadcast if ends.count() <= BROADCAST_SOURCES else (lambda x: x)
    e = ends.select(*(F.col(c).alias(f"_{c}") for c in ends.columns))
    rows = rows.withColumns({"_at": at, "_of": source}).join(few(e), F.col("_of") == F.col("_source"))
    spin, small = turn(F.col("_of"), F.col("_passes"), F.substring("_at", 1, 2)), F.substring("_at", 3, 2)
    before = lambda x, cut: F.coalesce(x < F.col(cut), F.lit(True))
    same = lambda x, cut: x == F.col(cut)
    part = before(spin, "_block_cut") | (same(spin, "_block_cut") & (before(small, "_small_cut") | (same(small, "_small_cut") & before(F.col("_at"), "_place_cut"))))
    part = part & (F.col("_left") > 0)
    times = F.col("_passes") + F.coalesce(part, F.lit(False)).cast("int")
    rows = rows.withColumn("_times", times).where(F.col("_times") > 0)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return rows.withColumn("block_turn", turn(F.col("_of"), F.col("epoch"), F.substring("_at", 1, 2)))


def mixture(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: float | None = 1.0) -> DataFrame:
    """One row for each time a document is drawn: doc_id, source, n_tokens, epoch, block_turn, place, weight."""
    slim, ends = plan(docs, max_repeats, entropy, budget)
    out = drawn(slim, ends, F.col("source"), F.col("place"))
    return out.select("doc_id", "source", "n_tokens", "epoch", "block_turn", "place", F.col("_weight").alias("weight"))


def mixed(docs: DataFrame, max_repeats: float | None = None, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """The rows of `docs`, all columns, each as often as it is drawn."""
    slim, ends = plan(docs, max_repeats, entropy, budget)
    release(slim)
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "source")
    out = drawn(marked, ends, F.coalesce("source", F.lit("")), place(F.col("doc_id")))
    return out.select("_row.*")
