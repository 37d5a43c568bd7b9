"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

The network reads the bytes of a text in windows, labels every position, and the document
gets the mean of the probabilities at its letters. It is trained here by backpropagation
through time on a bounded sample: of each language `SAMPLE` rows divided by the number of
languages, in the order of a hash of id and text, and of a text longer than `SAMPLE_CHARS` as many
characters, in pieces spread over all of it. At most `LANGUAGES` languages, the most frequent ones, are
learned. Style: Arrow batches, no shuffle; every byte of every text is
read, windows of many texts side by side.

Edge cases: a null text or one without a letter is `und` with score 0, as is every text if
no row can be learned from; a language whose texts are all empty is not learned; a single language is predicted with score 1; repeated rows are
labelled one by one; a null doc_id is not held out and never learned from; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.shared import slices, windows_of
from gridloom.llm.toxicity import remainder
from gridloom.llm.wordhash import buffer_of

UNKNOWN = "und"
SAMPLE, SAMPLE_CHARS, LANGUAGES = 2000, 20_000, 200
#: Units a direction, bytes a window, windows side by side.
UNITS, SPAN, LANES = 12, 128, 1024
STEPS, BATCH, RATE, SEED = 260, 256, 0.012, 7

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")
_LETTER_BYTE = np.zeros(256, np.float32)
_LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Direction:
    """A gated recurrent unit: input rows by byte, weights of both gates, weights of the candidate."""

    rows: np.ndarray
    gates: np.ndarray
    cell: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Direction:
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        return cls(draw(256, 3 * UNITS), draw(UNITS, 2 * UNITS), draw(UNITS, UNITS))

    def states(self, x: np.ndarray, kept: list) -> np.ndarray:
        """The state after each byte; x has one row a time step."""
        h = np.zeros((x.shape[1], UNITS), np.float32)
        out = np.empty((*x.shape, UNITS), np.float32)
        for t, now in enumerate(x):
            a = self.rows[now]
            zr = _sigmoid(a[:, : 2 * UNITS] + h @ self.gates)
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            rh = r * h
            c = np.tanh(a[:, 2 * UNITS :] + rh @ self.cell)
            kept.append((h, z, r, rh, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def sweep(self, x: np.ndarray) -> np.ndarray:
        """The same states without what training needs: buffers are used again, halves are folded into the weights."""
        n, two = x.shape[1], 2 * UNITS
        rows, gates = self.rows.copy(), self.gates * np.float32(0.5)
        rows[:, :two] *= 0.5
        h, out = np.zeros((n, UNITS), np.float32), np.empty((*x.shape, UNITS), np.float32)
        a, g, c = np.empty((n, 3 * UNITS), np.float32), np.empty((n, two), np.float32), np.empty((n, UNITS), np.float32)
        for t, now in enumerate(x):
            np.take(rows, now, axis=0, out=a, mode="clip")
            np.matmul(h, gates, out=g)
            g += a[:, :two]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            np.multiply(g[:, UNITS:], h, out=c)
            np.matmul(c, self.cell, out=out[t])
            np.add(out[t], a[:, two:], out=c)
            np.tanh(c, out=c)
            c -= h
            c *= g[:, :UNITS]
            np.add(h, c, out=out[t])
            h = out[t]
        return out

    def gradients(self, x: np.ndarray, kept: list, pull: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time; pull is the loss's gradient at each state."""
        d_gates, d_cell = np.zeros_like(self.gates), np.zeros_like(self.cell)
        d_in = np.empty((*x.shape, 3 * UNITS), np.float32)
        carry = np.zeros((x.shape[1], UNITS), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, rh, c = kept[t]
            d = pull[t] + carry
            d_c = d * z * (1 - c * c)
            d_rh = d_c @ self.cell.T
            d_g = np.concatenate([d * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            carry = d * (1 - z) + d_rh * r + d_g @ self.gates.T
            d_cell += rh.T @ d_c
            d_gates += h.T @ d_g
            d_in[t, :, : 2 * UNITS], d_in[t, :, 2 * UNITS :] = d_g, d_c
        order = np.argsort(x, axis=None, kind="stable")
        values, first = np.unique(x.ravel()[order], return_index=True)
        d_rows = np.zeros_like(self.rows)
        d_rows[values] = np.add.reduceat(d_in.reshape(-1, 3 * UNITS)[order], first, axis=0)
        return [d_rows, d_gates, d_cell]


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, x: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each language at each position of windows (time, lane); also the states."""
        if kept is None:
            f, b = self.ahead.sweep(x), self.behind.sweep(x[::-1])[::-1]
            scores = f @ self.weights[:UNITS] + b @ self.weights[UNITS:] + self.bias
            scores -= scores.max(axis=2, keepdims=True)
            np.exp(scores, out=scores)
            return scores / scores.sum(axis=2, keepdims=True), f
        f = self.ahead.states(x, kept[0])
        b = self.behind.states(x[::-1], kept[1])[::-1]
        states = np.concatenate([f, b], axis=2)
        scores = states @ self.weights + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        return scores / scores.sum(axis=2, keepdims=True), states

    def of_texts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each text the mean probability of each language at its letters."""
        size = np.diff(at)
        spans = -(-size // SPAN)
        doc = np.repeat(np.arange(len(size)), spans)
        begin = np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)
        begin = at[doc] + SPAN * begin
        left = np.minimum(at[doc + 1] - begin, SPAN)
        out, letters = np.zeros((len(size), len(self.languages))), np.zeros(len(size))
        order = np.argsort(-left, kind="stable")  # windows of like length together, so little is padding
        for k in range(0, len(order), LANES):
            lane = order[k : k + LANES]
            steps = np.arange(left[lane[0]])[:, None]
            inside = steps < left[lane]
            x = np.where(inside, raw[np.minimum(begin[lane] + steps, len(raw) - 1)], 0)
            weight = _LETTER_BYTE[x] * inside
            p, _ = self.probabilities(x)
            np.add.at(out, doc[lane], np.einsum("tlc,tl->lc", p, weight))
            np.add.at(letters, doc[lane], weight.sum(axis=0))
        return out / np.maximum(letters, 1)[:, None]


def train(texts: list[str], languages: list[str]) -> Network | None:
    """Fits the network by Adam on windows drawn from the texts, each language as often."""
    texts, languages = zip(*((t, n) for t, n in zip(texts, languages, strict=True) if t), strict=True) if any(texts) else ((), ())
    names = sorted(set(languages))
    if not names:
        return None
    rng = np.random.default_rng(SEED)
    net = Network(names, Direction.fresh(rng), Direction.fresh(rng), (rng.standard_normal((2 * UNITS, len(names))) * 0.3).astype(np.float32), np.zeros(len(names), np.float32))
    raw = [t.encode() for t in texts]
    by = [[k for k, name in enumerate(languages) if name == n] for n in names]
    values = [net.ahead.rows, net.ahead.gates, net.ahead.cell, net.behind.rows, net.behind.gates, net.behind.cell, net.weights, net.bias]
    m, v = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
    for step in range(1, STEPS + 1):
        y = rng.integers(len(names), size=BATCH)
        x = np.zeros((SPAN, BATCH), np.int64)
        for lane, label in enumerate(y):
            text = raw[by[label][rng.integers(len(by[label]))]]
            k = rng.integers(max(1, len(text) - SPAN + 1))
            part = text[k : k + SPAN]
            x[: len(part), lane] = np.frombuffer(part, np.uint8)
        kept: tuple[list, list] = ([], [])
        p, states = net.probabilities(x, kept)
        weight = _LETTER_BYTE[x]
        pull = p.copy()
        pull[:, np.arange(BATCH), y] -= 1
        pull *= (weight / max(1.0, float(weight.sum())))[:, :, None]
        back = pull @ net.weights.T
        d = [
            *net.ahead.gradients(x, kept[0], back[:, :, :UNITS]),
            *net.behind.gradients(x[::-1], kept[1], back[::-1, :, UNITS:]),
            np.einsum("tls,tlc->sc", states, pull, optimize=True),
            pull.sum(axis=(0, 1)),
        ]
        rate = RATE * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for k, g in enumerate(d):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            values[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def training_rows(docs: DataFrame) -> tuple[list[str], list[str]]:
    """At most about SAMPLE rows with a language that are not held out, as many of each language.

    Their number by language is broadcast; only rows whose hash is small for their language are sorted.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1) & (F.col("text") != "")).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    each = max(1, SAMPLE // max(1, len(counts)))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    w = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    rows, share = [], {r["lang"]: 4 * each / r["n"] for r in counts}
    while share:  # a language most of whose rows are alike may need more than its share
        upto = F.broadcast(docs.sparkSession.createDataFrame([(k, int(min(1.0, v) * (1 << 40))) for k, v in share.items()], "lang string, upto long"))
        some = usable.join(upto, "lang").withColumn("place", place).where("place < upto")
        some = some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= each).orderBy("lang", "k")
        found = some.select("lang", windows_of(F.col("text"), SAMPLE_CHARS).alias("text")).collect()
        got = Counter(r["lang"] for r in found)
        enough = {r["lang"] for r in counts if r["lang"] in share and (share[r["lang"]] >= 1 or got[r["lang"]] >= min(each, r["n"]))}
        rows += [r for r in found if r["lang"] in enough]
        share = {k: 8 * v for k, v in share.items() if k not in enough}
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def languages(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per document with its language."""

    def run(batches):
        for batch in slices(batches, most=4 << 20):
            texts = batch.column("text")
            known = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
            if net is None:
                name, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                p = net.of_texts(*buffer_of(texts))
                name = [net.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), known, strict=True)]
                score = np.clip(p.max(axis=1) * known, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(run, SCHEMA)
