"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

For every text, words get rolling hashes of 2 to 10 words in numpy; the characters of
words inside n-grams that were seen before in the same text, and of lines seen before,
are measured against all characters of words. Style: Arrow batches, no shuffle at all.

Edge cases: a null or blank text has no word and fails (fewer than `min_words`); texts
of any length are handled whole; repeated rows each give their own row; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.shared import slices
from gridloom.llm.wordhash import Words, slabs

#: Share of word characters in the most frequent 2-, 3- and 4-gram above which a text is rejected.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
#: Share of word characters inside repeated n-grams above which a text is rejected.
REPEATED_SHARE = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Share of lines, and of characters in lines, that repeat an earlier line.
LINE_SHARE, LINE_CHAR_SHARE = 0.50, 0.30
#: Share of word characters that are one of #*$%&|<>; above it a text is taken for debris of tables or markup.
SYMBOL_SHARE = 0.10
MIN_WORDS = 50

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, top_share double, repeated_share double, dup_line_share double, dup_line_char_share double"

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number of occurrences, and whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    group = np.cumsum(fresh) - 1
    count, later = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    count[order] = np.bincount(group)[group] if len(keys) else 0
    later[order] = ~fresh
    return count, later


def _covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in one of the n-word windows that begin at `at`."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + n, total), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base figures and repetition coverage of each text."""
    parts = [_measure_slab(raw, at) for _, raw, at in slabs(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _measure_slab(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    rows = len(at) - 1
    w = Words(raw, at)
    n = len(w.hash)
    per = lambda values, doc: np.bincount(doc, weights=values, minlength=rows).astype(np.int64)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = points[w.end] - points[w.start]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    out = {"n_words": np.diff(w.first).astype(np.int64), "word_chars": per(chars, w.doc), "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}
    total = np.maximum(out["word_chars"], 1)
    top, repeated, over = np.zeros(rows), np.zeros(rows), np.zeros(rows, bool)
    out["n_repeat_words"] = np.zeros(rows, np.int64)
    with np.errstate(over="ignore"):
        rolling = w.hash ^ (w.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))  # equal n-grams of two texts must differ
        begins = np.arange(n)  # windows that may occur twice; those of n words begin where two of n - 1 do
        for length in range(2, 11):
            rolling = (rolling[: max(0, n - length + 1)] * _MULTIPLY) ^ w.hash[length - 1 :]
            rolling = (rolling << np.uint64(29)) | (rolling >> np.uint64(35))
            begins = begins[begins + length <= n]
            begins = begins[w.doc[begins] == w.doc[begins + length - 1]]
            count, later = _groups(rolling[begins] ^ (w.doc[begins].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            twice = begins[count > 1]
            if length == 3:
                out["n_repeat_words"] = per(_covered(twice, 3, n), w.doc)
            if length in TOP_SHARE and len(twice):
                inside = np.cumsum(np.concatenate([[0], chars]))
                size = (inside[twice + length] - inside[twice]) * count[count > 1]
                most = np.zeros(rows)
                np.maximum.at(most, w.doc[twice], size)
                share = np.minimum(most / total, 1.0)
                top = np.maximum(top, share)
                over |= share > TOP_SHARE[length]
            if length in REPEATED_SHARE:
                share = per(chars * _covered(begins[later], length, n), w.doc) / total
                repeated = np.maximum(repeated, share)
                over |= share > REPEATED_SHARE[length]
            both = np.zeros(n + 1, bool)
            both[twice] = True
            begins = twice[both[np.minimum(twice + 1, n)]]
    # lines: split at \n, only those with a word
    cut = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], cut[cut + 1 < len(raw)] + 1])) if len(raw) else np.zeros(0, np.int64)
    line_end = np.concatenate([line_start[1:], [len(raw)]]) if len(line_start) else line_start
    line_doc = np.searchsorted(at, line_start, "right") - 1
    w_first, w_last = np.searchsorted(w.start, line_start), np.searchsorted(w.start, line_end)
    full = w_first < w_last
    text = raw.tobytes()
    seen: set[tuple[int, bytes]] = set()
    dup = np.zeros(len(line_start), bool)
    for i in np.flatnonzero(full):
        line = text[line_start[i] : line_end[i]]
        key = (int(line_doc[i]), line[:-1] if line.endswith(b"\n") else line)
        dup[i] = key in seen
        seen.add(key)
    words_before = np.cumsum(np.concatenate([[0], chars]))
    line_chars = words_before[w_last] - words_before[w_first]
    out["n_dup_lines"] = per(dup, line_doc)
    lines = np.maximum(per(full, line_doc), 1)
    out["dup_line_share"] = out["n_dup_lines"] / lines
    out["dup_line_char_share"] = per(dup * line_chars, line_doc) / total
    out["top_share"], out["repeated_share"] = top, repeated
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~(out["base_failed"] | over | (out["dup_line_share"] > LINE_SHARE) | (out["dup_line_char_share"] > LINE_CHAR_SHARE) | (out["n_symbols"] > SYMBOL_SHARE * total))
    return out


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: base figures, repetition shares and whether it is kept."""

    def run(batches):
        for batch in slices(batches):
            m = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(m[k]) for k in _ORDER)], names=["doc_id", *_ORDER])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


_ORDER = [x.split()[0] for x in SCHEMA.split(", ")][1:]
