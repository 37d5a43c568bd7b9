"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding: lower case, compatibility forms, look-alike letters of other scripts, digits and
signs that stand for letters inside words. The lexicon is learned from labelled texts:
folded words, and beginnings of words shared by several of them, that come far more often
in toxic texts, each weighted by its log odds; two-word phrases of clean texts that hold
a lexicon word are exceptions, under which a match does not count. The score is a logistic
function of the matched weight, plain and per word of the text. Style: Arrow batches for
scoring, no shuffle of texts; the model is fitted on a bounded sample (`SAMPLE` labelled
rows, in the order of a hash of their id; of a text longer than `SAMPLE_CHARS` as many
characters, in pieces spread over all of it).

Edge cases: a null, blank or very short text has a score like any other (no match gives
the base score); no labelled row, or none of one kind, gives an empty lexicon and score 0;
a document labelled both ways counts as toxic; repeated rows are scored one by one, and of
rows with one id but several texts the one of the smallest hash is learned from; a null
doc_id is not held out and never learned from; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import first_by_hash, slices, windows_of

#: Labelled rows that are learned from at most, and characters of each.
SAMPLE, SAMPLE_CHARS = 6000, 30_000
#: Texts that must hold a lexicon entry, and how many times likelier it must be in toxic ones.
SUPPORT, RATIO = 5, 12.0
#: Letters of a word's beginning that may be an entry.
PREFIXES = range(4, 8)
THRESHOLD = 0.3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_matches long"

#: Letters of other scripts and digits by the Latin letter they look like.
LOOK_ALIKES = {
    "a": "аαɑ", "b": "ƄЬ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һ", "i": "іιı",
    "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "η", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ",
    "u": "υ", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s"}
_FOLD = str.maketrans({x: k for k, v in LOOK_ALIKES.items() for x in v} | dict.fromkeys("​‌‍⁠﻿­", ""))
_DIGITS = str.maketrans(DIGITS | SIGNS)
_MIXED = re.compile(r"[a-z0-9@$\xdf-\xff]*(?:[a-z\xdf-\xff][0-9@$]|[0-9@$][a-z\xdf-\xff])[a-z0-9@$\xdf-\xff]*")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The folded words with a space before, between and after them."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if any(c in text for c in "0134578@$"):
        text = _MIXED.sub(_unmask, text)
    return " " + _GAPS.sub(" ", text).strip() + " "


def _unmask(found: re.Match) -> str:
    """Digits and signs as letters, if letters prevail; signs after the last letter or digit stay signs."""
    word = found[0]
    core = word.rstrip("@$")
    letters = sum(c.isalpha() for c in core)
    return core.translate(_DIGITS) + word[len(core) :] if 2 * letters + 1 >= len(core) else word


@dataclass
class Lexicon:
    weights: dict[str, float]  # " word " or " beginning"
    exceptions: list[str]  # " word word "
    scale: tuple[float, float, float]  # of the logistic function: bias, plain weight, weight per word

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for p in lexicon.exceptions:
            self.automaton.add_word(p, (len(p), None))
        for p, w in lexicon.weights.items():
            self.automaton.add_word(p, (len(p), w))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[float]:
        """The weight of each word that matches, the heaviest entry a word, outside exceptions."""
        if not len(self.automaton):
            return []
        heaviest: dict[int, float] = {}
        spared: set[int] = set()
        for last, (size, weight) in self.automaton.iter(folded):
            begin = last - size + 1
            if weight is None:
                spared.add(begin)
                spared.add(folded.index(" ", begin + 1))
            elif weight > heaviest.get(begin, 0.0):
                heaviest[begin] = weight
        return [w for begin, w in heaviest.items() if begin not in spared]

    def features(self, folded: str) -> tuple[int, float, float]:
        found = self.matches(folded)
        total = sum(found)
        return len(found), np.log1p(total), np.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, folded: str) -> tuple[int, float]:
        n, plain, per_word = self.features(folded)
        bias, a, b = self.lexicon.scale
        z = bias + a * plain + b * per_word
        return n, float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn(texts: list[str], toxic: list[int]) -> Lexicon:
    """Entries, exceptions and the score's scale from labelled texts."""
    folded = [fold(t) for t in texts]
    bad, good = sum(map(bool, toxic)), sum(not t for t in toxic)
    if not bad or not good:
        return Lexicon({}, [], (-30.0, 0.0, 0.0))
    counts: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
    for text, label in zip(folded, toxic, strict=True):
        words = set(text.split())
        entries = {f" {w} " for w in words}
        for w in words:
            entries.update(" " + w[:n] for n in PREFIXES if n < len(w))
        counts[bool(label)].update(entries)
    odds = lambda e: np.log((counts[True][e] + 0.5) / (bad + 1)) - np.log((counts[False][e] + 0.5) / (good + 1))
    least = np.log(RATIO)
    weights = {e: float(odds(e)) for e, n in counts[True].items() if n >= SUPPORT and n > counts[False][e] and odds(e) > least}
    # of beginnings with the same texts the longest; support counts different words before, as copies have the same
    before: dict[str, set[str]] = {e: set() for e in weights}
    holds: dict[str, set[int]] = {e: set() for e in weights}
    for k, (text, label) in enumerate(zip(folded, toxic, strict=True)):
        if label:
            words = text.split()
            for last, w in zip(["", *words], words, strict=False):
                for e in (f" {w} ", *(" " + w[:n] for n in PREFIXES if n < len(w))):
                    if e in before:
                        before[e].add(last)
                        holds[e].add(k)
    supported = [e for e in weights if len(before[e]) >= SUPPORT and not any(len(holds.get(e + c, ())) >= 0.95 * len(holds[e]) for c in {x[len(e)] for x in weights if len(x) == len(e) + 1 and x.startswith(e)} - {" "})]
    # the frequent ones, then those that explain texts which no other explains; chance finds explain none
    chosen, left = {}, {k for k, label in enumerate(toxic) if label}
    for e in sorted(supported, key=lambda e: (-len(holds[e]), e)):
        frequent = len(holds[e]) >= max(SUPPORT, 0.05 * bad) and counts[False][e] <= 0.01 * len(holds[e])
        if frequent or len(left & holds[e]) >= max(SUPPORT, 0.01 * bad):
            chosen[e] = weights[e]
            left -= holds[e]
    # exceptions: phrases with a chosen word in clean texts, and in no toxic text
    probe = Lexicon(chosen, [], (0.0, 0.0, 0.0)).matcher()
    clean, dirty = Counter(), set()
    for text, label in zip(folded, toxic, strict=True):
        if not probe.matches(text):
            continue
        words = text.split()
        pairs = {f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if probe.matches(f" {a} ") or probe.matches(f" {b} ")}
        dirty.update(pairs) if label else clean.update(pairs)
    exceptions = [p for p, n in clean.items() if n >= 3 and p not in dirty]
    lexicon = Lexicon(chosen, exceptions, (0.0, 0.0, 0.0))
    matcher = lexicon.matcher()
    x = np.array([(1.0, *matcher.features(t)[1:]) for t in folded])
    y = np.array([bool(t) for t in toxic], float)
    beta = np.array([-3.0, 1.0, 0.1])
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(3)
        beta += np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * beta)
    beta[1:] = np.maximum(beta[1:], 0.0)
    return Lexicon(chosen, exceptions, tuple(map(float, beta)))


def remainder(doc_id, n: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """At most SAMPLE labelled rows that are not held out, in the order of a hash of the id.

    The chosen ids (SAMPLE at most) are the only thing that is broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    ids = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = first_by_hash(ids, ["doc_id"], SAMPLE)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("at"), windows_of(F.col("text"), SAMPLE_CHARS).alias("text"))).alias("x"))
    rows = found.orderBy("doc_id").select("toxic", "x.text").limit(SAMPLE).collect()
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows]


def toxicity(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """One row per document with its score."""

    def run(batches):
        matcher = lexicon.matcher()
        for batch in slices(batches):
            found = [matcher.score(fold(t)) for t in batch.column("text").to_pylist()]
            score = np.array([s for _, s in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array([n for n, _ in found], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_matches"],
            )

    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below the threshold."""

    def run(batches):
        matcher = lexicon.matcher()
        for batch in slices(batches):
            yield batch.filter(pa.array([matcher.score(fold(t))[1] < THRESHOLD for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
