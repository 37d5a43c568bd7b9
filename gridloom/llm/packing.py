"""Packing of token sequences: order-preserving dynamic programming with monotone-queue transitions.

The documents of an input partition, in their order, form one stream of token ids (each
document ends with id 2). Window cuts are chosen by dynamic programming: the cost of a
window is its padding, of a cut inside a document a penalty (less at a sentence end), and
the best predecessor within 4096 tokens is the head of a monotone queue, so a block takes
time linear in its cut positions. A window whose length is a power of two needs no padding;
at the end of a partition these transitions and every single position are tried as well.
The stream is planned in blocks; what follows a block's last cut goes on into the next one, so
memory holds one block and one text. Style: Arrow batches, no shuffle; a lost task is
redone from its own input split, with the same sequence ids.

Edge cases: a null or blank text is the single id 2; a text longer than a window is cut
into several; repeated rows and ids are packed one by one; a null doc_id stays null; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.llm.shared import give_back, kept_in_worker, slices

WINDOW = 4096
END_ID = 2
#: Costs in tokens: a cut at a sentence end, a cut elsewhere, a further sequence.
SENTENCE_CUT, OTHER_CUT, SEQUENCE = 2, 6, 8
#: Tokens planned at once; cuts elsewhere are tried every GAP tokens.
BLOCK, GAP = 1 << 18, 16
#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's content, read on the driver and sent with the task (1.7 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordIds:
    """Ids of whole texts, word by word: white space always ends a pre-token here, so words are remembered."""

    MARK = "`"

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.known: dict[str, bytes] = {}
        self.stops = {"": b""} | {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32).tobytes() for c in ".,"}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        #: How byte-level vocabularies write a byte: itself if printable, else the next free letter from U+0100 on.
        self.shown = {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in plain)}
        (self.mark,) = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        ends = [i for t, i in self.tokenizer.get_vocab().items() if (core := t.removesuffix("</w>")) and set(core) <= set(".!?")]
        self.sentence = np.zeros(1 << 16, bool)
        self.sentence[ends] = True

    def _learn(self, fresh: list[str]) -> None:
        """Words of letters, perhaps with a full stop or comma behind, are one pre-token or two and go to the model; others to `_learn_odd`.

        ASCII letters are lower-cased anyway, others as the tokenizer does it, letter by letter.
        """
        known, stops, tokenize, odd, later = self.known, self.stops, self.tokenizer.model.tokenize, [], []
        for w in fresh:
            core, stop = (w, "") if w.isalpha() else (w[:-1], w[-1]) if w[-1] in ".," and w[:-1].isalpha() else ("", "")
            if not core:
                odd.append(w)
                continue
            if plain := w.isascii():
                core = core.lower()
            elif is_normalized("NFC", core):
                if not ("\u03a3" in core or "\u0130" in core):
                    core = core.lower()
                plain = core.islower() and is_normalized("NFC", core)
            ids = known.get(core)
            if ids is None:
                if not plain:
                    odd.append(core)
                    later.append((w, core, stop))
                    continue
                shown = core if w.isascii() else core.encode().decode("latin-1").translate(self.shown)
                ids = known[core] = array("I", [t.id for t in tokenize(shown)]).tobytes()
            known[w] = ids + stops[stop]
        self._learn_odd(list(dict.fromkeys(odd)))
        for w, core, stop in later:
            known[w] = known[core] + stops[stop]

    def _learn_odd(self, fresh: list[str]) -> None:
        """All at once, MARK between them, or by themselves where that would not part them."""
        known = self.known
        alone = [w for w in fresh if self.MARK in w or "<" in w]
        for w in alone:
            known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
        if alone:
            fresh = [w for w in fresh if w not in known]
        if not fresh:
            return
        ids = np.array(self.tokenizer.encode(f" {self.MARK} ".join(fresh), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark).tolist()
        data, a = ids.tobytes(), 0
        for w, b in zip(fresh, [*cuts, len(ids)], strict=True):
            known[w] = data[4 * a : 4 * b]
            a = b + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, then END_ID."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        lists = [self._words(t) for t in texts]
        self._learn(list(set().union(*lists).difference(known)))
        end = END_ID.to_bytes(4, "little")
        return [np.frombuffer(b"".join(map(known.__getitem__, words)) + end, np.uint32) for words in lists]

    @staticmethod
    def _words(text: str) -> list[str]:
        """Split where the tokenizer's \\s is; \x1c-\x1f are white space to str.split only."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return re.findall(r"[^\x09-\x0d\x20]+", text)
        return text.split()


def cut_positions(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a window may end, ascending, and what a cut there costs; the last is len(ids)."""
    n = len(ids)
    sentences = np.flatnonzero(sentence[ids]) + 1
    kind = np.zeros(n + 1, np.uint8)  # 1: elsewhere, 2: the end of a sentence, 3: of a document
    kind[GAP::GAP] = 1
    kind[max(1, n - 2 * WINDOW) if last else n :] = 1
    kind[sentences] = 2
    kind[ends] = 3
    kind[0] = 0
    marks = np.flatnonzero(kind)
    cost = np.array([0, OTHER_CUT, SENTENCE_CUT, 0])[kind[marks]]
    return marks, cost


def plan(marks: np.ndarray, cost: np.ndarray, tail: int, whole: bool = True) -> list[int]:
    """The cheapest window ends. Windows that end at or after `tail` may have a power of two of tokens unpadded.

    Not `whole`: the last end is where the cost a token is least among the last window's positions.
    """
    at, pay = [0, *marks.tolist()], [0, *cost.tolist()]
    best, back = [0] * len(at), [0] * len(at)
    place = {p: k for k, p in enumerate(at) if p >= tail - WINDOW} if at[-1] >= tail else {}
    queue: deque[tuple[int, int]] = deque()  # (best + position, index), ascending
    for j in range(1, len(at)):
        v = best[j - 1] + at[j - 1]
        while queue and queue[-1][0] >= v:
            queue.pop()
        queue.append((v, j - 1))
        here = at[j]
        while at[queue[0][1]] < here - WINDOW:
            queue.popleft()
        v, i = queue[0]
        v += WINDOW - here
        if here >= tail:
            k = 1
            while k < WINDOW:
                at_k = place.get(here - k)
                if at_k is not None and best[at_k] < v:
                    v, i = best[at_k], at_k
                k += k
        best[j], back[j] = v + pay[j] + SEQUENCE, i
    ends, j = [], len(at) - 1
    if not whole:
        j = min((k for k in range(1, len(at)) if at[k] >= at[-1] - WINDOW), key=lambda k: best[k] / at[k])
    while j:
        ends.append(at[j])
        j = back[j]
    return ends[::-1]


class Packer:
    """Takes documents one after the other; gives rows of SCHEMA."""

    def __init__(self, sentence: np.ndarray, first_sequence: int):
        self.sentence, self.sequence = sentence, first_sequence
        self.parts: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, tokens of the document, ids before, ids
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray):
        for k in range(0, len(ids), BLOCK):
            part = ids[k : k + BLOCK]
            self.parts.append((doc_id, len(ids), k, part))
            self.held += len(part)
            if self.held >= BLOCK:
                yield from self._pack(last=False)

    def close(self):
        if self.held:
            yield from self._pack(last=True)

    def _pack(self, last: bool):
        ids = np.concatenate([p[3] for p in self.parts])
        bounds = np.cumsum([0, *(len(p[3]) for p in self.parts)])
        whole = np.array([bounds[k + 1] for k, p in enumerate(self.parts) if p[2] + len(p[3]) == p[1]], np.int64)
        marks, cost = cut_positions(ids, whole, self.sentence, last)
        ends = plan(marks, cost, len(ids) - WINDOW if last else len(ids) + 1, last)
        k, begin = 0, 0
        for end in ends:
            a = begin
            while a < end:
                while bounds[k + 1] <= a:
                    k += 1
                doc_id, tokens, before, _ = self.parts[k]
                b = min(end, int(bounds[k + 1]))
                yield doc_id, before + a - int(bounds[k]), b - a, zlib.crc32(ids[a:b].tobytes()), tokens, self.sequence, a - begin
                a = b
            self.sequence += 1
            begin = end
        if last:
            self.parts, self.held = [], 0
            return
        rest = []
        for k, (doc_id, tokens, before, part) in enumerate(self.parts):
            if bounds[k + 1] > begin:
                cut = max(0, begin - int(bounds[k]))
                rest.append((doc_id, tokens, before + cut, part[cut:]))
        self.parts, self.held = rest, len(ids) - begin


def pack(docs: DataFrame, tokenizer_path: str | None = None, keep_words: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence of at most 4096 tokens.

    keep_words: a worker's next task finds the learned words again, which takes some 200 MB while it is idle.
    """
    content = tokenizer_json(tokenizer_path)

    def run(batches):
        words = kept_in_worker(("words", hash(content)), lambda: WordIds(content))
        packer = Packer(words.sentence, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
            rows.clear()
            return made

        for batch in slices(batches, most=1 << 20):  # words of a slice are held as Python strings, many times its size
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(texts), strict=True):
                rows.extend(packer.add(doc_id, ids))
                if len(rows) >= 10_000:
                    yield batch_of()
        rows.extend(packer.close())
        if not keep_words:
            words.known.clear()
            give_back()
        if rows:
            yield batch_of()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
