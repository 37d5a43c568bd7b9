"""N-gram Jaccard join: every pair of texts whose sets of word shingles are similar enough.

A text is the set of hashes of its five-word shingles; texts with the same set are one
node from the start. Two nodes of sizes m <= n can only reach the similarity if a shingle
is among the first m - ceil(6m/7) + 1 of the smaller and the first n - ceil(3n/4) + 1 of
the larger, in any order common to all: here rare before frequent (by a sketch of fixed
size that counts hash cells over all texts), then by hash. Only those leading shingles and one
in `EVIDENCE` more are shuffled, packed as bytes, each task sending a node once; with these,
similar sets must share several, so a node with fewer shingles known to any other text is
passed over (passages that texts share seldom get that far).

Inverted lists with the same nodes are one list, so a passage or a group of copies is
handled once and not once a shingle; lists of frequent shingles are never gathered. In
every list and class of fitting sizes each node is first paired with one leader, and
leaders of neighbouring classes with each other; once components are known, only nodes of
different components are paired, long lists in pairs of chunks of about `CHUNK` nodes. So a
group of thousands of copies costs its size, not its square, no list lies in one task, and no
link between different components is lost.

Pairs whose sketches leave room for the overlap are searched by T-occurrence: the
candidates of a query set are indexed, shingle to ascending list of candidates, and
DivideSkip merges the short ones of the query's lists by a heap and probes the long ones by
binary search. What it gives are the candidates that reach the overlap, with their counts;
of these, those with 100 * intersection >= 75 * union are links. Components are found by
stars over the links, never on the driver. Style: Arrow batches with numpy, plain DataFrame
joins between; intermediate tables are in the shared folder and go when they are read.

Sets are told apart by 128 bits: a node's name has 64, and the few different sets that share a
name (among 2e10 sets some ten pairs) are found by a second hash and renamed.

Edge cases: a null or blank text has an empty set and is its own component; fewer than
five words make one shingle; texts of any length are used whole; rows with the same id are
rows of their own, and a null doc_id does not name a component unless all its members have
none; an empty table gives an empty result; further columns are kept by `one_of_each`.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.shared import few, give_back, release, slices, written
from gridloom.llm.wordhash import mix, shingle_sets

WIDTH = 5
#: Similarity as a fraction: MET / OF.
MET, OF = 75, 100
#: Cells of the sketch, in how many parts it is added up.
CELLS, PARTS = 1 << 20, 16
#: Nodes of a list that are paired in one group; nodes of a list whose pairs are screened there.
CHUNK, SCREENED = 512, 32
#: One shingle in so many is sent besides those that find a similar set.
EVIDENCE = 16
#: Shingles of candidates searched in one group, postings sent in one row.
GROUP, SENT = 1 << 19, 1 << 18
#: Groups that shingles are dealt into, at least; rows of a few numbers up to which the smaller side of a join is broadcast.
BUCKETS, BROADCAST = 64, 1 << 18
#: Least and most bits of a document id's hash that say whether its text is wanted; eight flags a wanted id between.
FLAG_BITS = (16, 28)
#: The bits of a node's name that are used; fewer only in tests.
NAME = np.uint64(0xFFFFFFFFFFFFFFFF)
_NONE = -9223372036854775808


def hashes_of(tokens: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set; the first is its node's name unless another set has it."""
    if not len(tokens):
        return 0, 0
    with np.errstate(over="ignore"):
        one = mix(tokens + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        other = mix(tokens ^ np.uint64(len(tokens))).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        name, check = mix(np.array([one ^ other, one + other * np.uint64(3)]))
    return int((name & NAME).astype(np.int64)), int(check.astype(np.int64))


def node_of(tokens: np.ndarray, renamed: dict[tuple[int, int], int]) -> int:
    both = hashes_of(tokens)
    return renamed.get(both, both[0])


def told_apart(scanned: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The scanned rows with other names for different sets of one name, and these names by both hashes: a few at most, as names are 64 bits."""
    same = scanned.where("n > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node")
    found = scanned.join(same, "node", "left_semi").select("node", "check").distinct().collect()
    if not found:
        return scanned, {}
    fresh = mix(np.array([r["check"] for r in found], np.int64).view(np.uint64) + np.uint64(1)).view(np.int64).tolist()
    renamed = {(r["node"], r["check"]): name for r, name in zip(found, fresh, strict=True)}
    names = F.broadcast(scanned.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "node long, check long, name long"))
    rows = scanned.join(names, ["node", "check"], "left").withColumn("node", F.coalesce("name", "node")).select(*scanned.columns)
    return written(rows), renamed


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)


def sketch(tokens: np.ndarray) -> bytes:
    """How many shingles fall in each of as many cells as there are shingles or more, up to 3, two bits a cell."""
    cells = 1 << max(4, (len(tokens) - 1).bit_length())
    counts = np.minimum(np.bincount((tokens >> np.uint64(65 - cells.bit_length())).astype(np.int64), minlength=cells), 3).astype(np.uint8)
    return (counts[0::4] | counts[1::4] << 2 | counts[2::4] << 4 | counts[3::4] << 6).tobytes()


def _cells_of(packed: bytes) -> np.ndarray:
    x = np.frombuffer(packed, np.uint8)
    return np.stack([x & 3, x >> 2 & 3, x >> 4 & 3, x >> 6], axis=1).ravel()


def may_be_similar(n: int, one: bytes, m: int, other: bytes) -> bool:
    """Whether two sets' sketches leave room for the overlap: cells bound it from above, so no similar pair is lost."""
    return bool(_room(np.array([0]), np.array([1]), np.array([n, m]), [one, other])[0])


def _room(ia: np.ndarray, ib: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """The same for pairs (ia, ib) of sets with these sizes and sketches."""
    keep = np.zeros(len(ia), bool)
    if not len(ia):
        return keep
    width = np.array([4 * len(s) for s in sketches])
    need = -(-MET * (n[ia] + n[ib]) // (MET + OF))
    row = np.empty(len(sketches), np.int64)
    matrix: dict[int, np.ndarray] = {}
    beyond = np.empty(len(sketches), np.int64)  # shingles beyond 3 in a cell
    for w in np.unique(width):
        these = np.flatnonzero(width == w)
        row[these] = np.arange(len(these))
        matrix[int(w)] = np.stack([_cells_of(sketches[k]) for k in these])
        beyond[these] = n[these] - matrix[int(w)].sum(axis=1, dtype=np.int64)
    for wa, wb in {(int(x), int(y)) for x, y in zip(width[ia], width[ib], strict=True)}:
        pairs = np.flatnonzero((width[ia] == wa) & (width[ib] == wb))
        step = max(1, (1 << 22) // max(wa, wb))
        for k in range(0, len(pairs), step):
            at = pairs[k : k + step]
            a, b = matrix[wa][row[ia[at]]], matrix[wb][row[ib[at]]]
            while a.shape[1] != b.shape[1]:
                a, b = (a[:, 0::2] + a[:, 1::2], b) if a.shape[1] > b.shape[1] else (a, b[:, 0::2] + b[:, 1::2])
            x, y = beyond[ia[at]], beyond[ib[at]]
            spare = np.minimum(x, y) if wa == wb else x + y
            keep[at] = np.minimum(a, b).sum(axis=1, dtype=np.int64) + spare >= need[at]
    return keep


def scan(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, node, check, sketch) of all documents, and the cell counts' parts of each task (part, cells).

    The set's sketch comes with the first document of a node in a task.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        cells = np.zeros(CELLS, np.uint32)
        for batch in slices(batches):
            ns, names, fresh, sketches = [], [], [], []
            for s in shingle_sets(batch.column("text"), WIDTH):
                name = hashes_of(s)
                ns.append(len(s))
                names.append(name)
                new = len(s) and name not in seen
                sketches.append(sketch(s) if new else None)
                if new:
                    seen.add(name)
                    fresh.append(_cell(s))
            if fresh:
                cells += np.bincount(np.concatenate(fresh), minlength=CELLS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)), pa.array(sketches, pa.binary()), pa.nulls(len(ns), pa.int32()), pa.nulls(len(ns), pa.binary())], names=_SCAN)
        if seen:
            parts = [zlib.compress(p.tobytes(), 1) for p in np.split(cells, PARTS)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, pa.int64())] * 4, pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=_SCAN)

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, check long, sketch binary, part int, cells binary"))


_SCAN = ["doc_id", "n", "node", "check", "sketch", "part", "cells"]


def frequent_cells(scanned: DataFrame) -> np.ndarray:
    """Which cells of the sketch are far above the mean of their part: 2**20 flags, whatever the input's size."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                now = np.frombuffer(zlib.decompress(cells), np.uint32).astype(np.int64)
                sums[part] = sums[part] + now if part in sums else now
        rows = [(part, np.packbits(c > c.mean() + 8 * np.sqrt(c.mean()) + 30).tobytes()) for part, c in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "flags"])

    parts = scanned.where("part is not null").select("part", "cells").repartition(PARTS, "part").mapInArrow(add, "part int, flags binary").collect()
    flags = np.zeros((PARTS, CELLS // PARTS), bool)
    for r in parts:
        flags[r["part"]] = np.unpackbits(np.frombuffer(r["flags"], np.uint8)).astype(bool)
    return flags.ravel()


def leading(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The shingles by which a set is found, and how many of them count when it is the smaller one."""
    n = len(tokens)
    often = frequent[_cell(tokens)]
    both = -(-2 * MET * n // (MET + OF))
    order = np.concatenate([tokens[~often], tokens[often]])
    return order[: int(sent_of(np.array([n]))[0])].copy(), n - both + 1


def sent_of(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of n are sent: what finds a similar set, and a few more as evidence."""
    return np.minimum(n, n + (-MET * n) // OF + 1 + n // EVIDENCE)


def postings(docs: DataFrame, frequent: np.ndarray, buckets: int, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """Rows of _SENT: 40 bits of each shingle, packed (more could only part lists, not lose one), and runs of them that belong to one node, the first `inner` of which count when it is the smaller one.

    A shingle's postings have one bucket, but those of frequent shingles are dealt by node as well.
    """
    packed = np.packbits(frequent)

    def run(batches):
        flags = np.unpackbits(packed).astype(bool)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int, int]] = []
        count = 0

        def sent() -> pa.RecordBatch:
            tokens = np.concatenate([h[0] for h in held])
            lengths = [len(h[0]) for h in held]
            of = np.repeat(np.arange(len(held)), lengths)
            inner = np.concatenate([np.arange(k) for k in lengths]) < np.repeat([h[3] for h in held], lengths)
            nodes, sizes = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.uint32)
            often = flags[_cell(tokens)]
            bucket = (mix(np.where(often, tokens ^ mix(nodes.view(np.uint64))[of], tokens)) % np.uint64(buckets)).astype(np.int64) * 2 + often
            order = np.argsort(bucket, kind="stable")
            tokens, bucket, of, inner = tokens[order], bucket[order], of[order], inner[order]
            fresh = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (of[1:] != of[:-1])])
            place = np.arange(len(tokens))
            run = np.flatnonzero((place - np.maximum.accumulate(np.where(fresh, place, 0))) % 255 == 0)
            here, first = np.unique(bucket, return_index=True)
            at = np.searchsorted(run, first)
            cut = lambda x, at: pa.array([p.tobytes() for p in np.split(x, at[1:])], pa.binary())
            counts, inner = np.diff([*run, len(tokens)]).astype(np.uint8), np.add.reduceat(inner, run, dtype=np.uint8)
            held.clear()
            runs = [cut(x, at) for x in (nodes[of[run]], sizes[of[run]], counts, inner)]
            return pa.RecordBatch.from_arrays([pa.array(here >> 1, pa.int64()), pa.array((here & 1).astype(bool)), cut(tokens.astype(np.uint32), first), cut((tokens >> np.uint64(32)).astype(np.uint8), first), *runs], names=[c.split()[0] for c in _SENT.split(", ")])

        for batch in slices(batches):
            for s in shingle_sets(batch.column("text"), WIDTH):
                node = node_of(s, renamed)
                if len(s) and node not in seen:
                    seen.add(node)
                    front, inner = leading(s, flags)
                    held.append((front, node, len(s), inner))
                    count += len(front)
                    if count >= SENT:
                        yield sent()
                        count = 0
        if held:
            yield sent()

    return docs.select("text").mapInArrow(run, _SENT)


_SENT = "bucket long, often boolean, low binary, high binary, nodes binary, sizes binary, counts binary, inner binary"


def merged_lists(tokens: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, often: bool) -> tuple[np.ndarray, ...]:
    """(list, node, size, times) of the postings of whole lists: those with the same nodes are one, `times` how many it stands for.

    Shingles of one node alone are left out. `often`: lists may be in parts, each is named by its shingle.
    """
    order = np.lexsort((nodes, tokens))
    tokens, nodes, sizes = tokens[order], nodes[order], sizes[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes, sizes = tokens[new], nodes[new], sizes[new]
    if often:
        return tokens.view(np.int64), nodes, sizes, np.ones(len(nodes), np.int64)
    same = tokens[1:] == tokens[:-1]
    more = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    tokens, nodes, sizes = tokens[more], nodes[more], sizes[more]
    if not len(tokens):
        return tokens.view(np.int64), nodes, sizes, sizes
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    length = np.diff([*first, len(tokens)])
    names = np.repeat(mix(np.add.reduceat(mix(nodes.view(np.uint64)), first) + length.astype(np.uint64)).view(np.int64), length)
    order = np.lexsort((nodes, names))
    names, nodes, sizes = names[order], nodes[order], sizes[order]
    first = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (nodes[1:] != nodes[:-1])]))
    return names[first], nodes[first], np.maximum.reduceat(sizes, first), np.diff([*first, len(names)])


def shared_lists(sent: DataFrame) -> DataFrame:
    """Rows (list, node, size, times) of the lists that two nodes or more have in common."""

    def lists(table: pa.Table) -> pa.Table:
        out = []
        for often in (False, True):
            rows = table.filter(pa.compute.equal(table.column("often"), often))
            if rows.num_rows:
                read = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()])  # noqa: B023, E731
                counts = read("counts", np.uint8).astype(np.int64)
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                sizes = np.repeat(read("sizes", np.uint32).astype(np.int64) * 2, counts) + (place < np.repeat(read("inner", np.uint8), counts))
                tokens = read("low", np.uint32) | read("high", np.uint8).astype(np.uint64) << np.uint64(32)
                out.append(merged_lists(tokens, np.repeat(read("nodes", np.int64), counts), sizes, often))
        give_back()
        return pa.table({name: np.concatenate([x[k] for x in out]) for k, name in enumerate(("list", "node", "size", "times"))})

    return written(sent.groupBy("bucket").applyInArrow(lists, "list long, node long, size long, times long"))


def least_known(n: Column) -> Column:
    """The least `shared_least` of a set of n and any that can be similar to it: the overlap is at least ceil(3/4 of the larger),
    of which a set keeps back ceil(3/4 n) - 1 - n // EVIDENCE."""
    return 1 + F.floor(n / EVIDENCE)


def strong_lists(shared: DataFrame) -> DataFrame:
    """Rows (list, node, size, known): the lists without nodes that share too few shingles with others; known is how many."""
    known = shared.groupBy("node").agg(F.sum("times").alias("known"))
    n = F.floor(F.col("size") / 2)
    known = written(known)
    rows = shared.select("list", "node", "size").join(few(known, BROADCAST), "node").where(F.col("known") >= least_known(n))
    strong = written(rows.groupBy("list", "node").agg(F.max("size").alias("size"), F.first("known").alias("known")))
    release(known)
    return strong


def first_candidates(strong: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): in every list and class of sizes that fit each other each node with a leader,
    the one that shares the largest part of its shingles: what others were copied from, if it is there, is
    nearer to all of them than they are to each other. Leaders of neighbouring classes are paired as well.
    """
    n = F.floor(F.col("size") / 2)
    rows = strong.select("list", "node", n.alias("n"), "known", F.floor(F.log(n) / F.log(F.lit(OF / MET))).cast("int").alias("class"))
    leaders = rows.groupBy("list", "class").agg(F.max(F.struct((F.col("known") / F.col("n")).alias("share"), F.col("node"))).alias("x"))
    # as a table, so that adaptive execution can split the join with a list that many nodes have
    leaders = written(leaders.select("list", "class", F.col("x.node").alias("leader")))
    pairs = rows.join(few(leaders, BROADCAST), ["list", "class"]).select("node", "leader")
    next_to = leaders.join(leaders.select("list", (F.col("class") - 1).alias("class"), F.col("leader").alias("node")), ["list", "class"]).select("node", "leader")
    pairs = pairs.unionByName(next_to).where("node <> leader")
    return pairs.select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct()


def shared_least(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many shingles two similar sets of n and m surely share among those sent: what is not sent cannot make up for less."""
    overlap = -(-MET * (n + m) // (MET + OF))
    return np.maximum(1, overlap - np.maximum(n - sent_of(n), m - sent_of(m)))


def _pairs(nodes, sizes, inner, known, root, part) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different roots, and parts if there are two, that fit in size, the smaller's posting counting for it,
    both with enough shingles known to others for what they must share."""
    order = np.lexsort((nodes, sizes))
    nodes, sizes, inner, known, root, part = (x[order] for x in (nodes, sizes, inner, known, root, part))
    upto = np.searchsorted(sizes, sizes * OF // MET, "right")
    two = part.min() != part.max()
    left, right = [], []
    for k in range(len(nodes) - 1):
        j = np.arange(k + 1, upto[k])
        j = j[(root[j] != root[k]) & (inner[k] | (inner[j] & (sizes[j] == sizes[k])))]
        if two:
            j = j[part[j] != part[k]]
        j = j[np.minimum(known[k], known[j]) >= shared_least(sizes[k], sizes[j])]
        if len(j):
            left.append(np.full(len(j), nodes[k]))
            right.append(nodes[j])
    none = np.zeros(0, np.int64)
    a, b = np.concatenate(left or [none]), np.concatenate(right or [none])
    return np.maximum(a, b), np.minimum(a, b)


def later_candidates(strong: DataFrame, found: DataFrame, at: DataFrame, buckets: int) -> DataFrame:
    """Candidate pairs (a, b) of lists whose components (node, root) differ; a list within one component is done.

    A list is dealt into chunks by node, and every two chunks, or one with itself, meet in a group. Of lists
    of more than `SCREENED` nodes only pairs whose sketches leave room for the overlap leave the group.
    """
    rows = strong.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("k"))
    mixed = written(mixed.where("low <> high").select("list", F.ceil(F.col("k") / CHUNK).cast("int").alias("chunks"), (F.col("k") > SCREENED).alias("long")))
    rows = rows.join(few(mixed, BROADCAST), "list")
    part = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    name = F.xxhash64("list", F.least("part", "other"), F.greatest("part", "other"))
    rows = written(rows.select(F.pmod(name, F.lit(buckets)).alias("bucket"), name.alias("name"), "node", "size", "known", "root", "part", "long"))
    sketches = rows.where("long").select(F.col("bucket").alias("there"), F.col("node").alias("of")).distinct().join(at.select(F.col("node").alias("of"), "n", "sketch"), "of")

    def lists(table: pa.Table, of: pa.Table) -> pa.Table:
        nodes, ns = of.column("of").to_numpy(), of.column("n").to_numpy()
        order, sketches = np.argsort(nodes), of.column("sketch").to_pylist()

        def room(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ia, ib = (order[np.searchsorted(nodes[order], x)] for x in (a, b))
            return _room(ia, ib, ns, sketches)

        a, b = _per_list(table, room) if table.num_rows else (np.zeros(0, np.int64),) * 2
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pairs = written(rows.groupBy("bucket").cogroup(sketches.groupBy("there")).applyInArrow(lists, "a long, b long").distinct())
    release(rows, mixed)
    return pairs


def _per_list(table: pa.Table, room) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of every list, those of long ones for which `room` (of a, b) holds."""
    names = table.column("name").to_numpy()
    order = np.argsort(names, kind="stable")
    names = names[order]
    size, long = table.column("size").to_numpy()[order], table.column("long").to_numpy()[order]
    columns = [table.column("node").to_numpy()[order], size >> 1, (size & 1).astype(bool), *(table.column(c).to_numpy()[order] for c in ("known", "root", "part"))]
    first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    none = np.zeros(0, np.int64)
    a, b, long_a, long_b, held = [none], [none], [none], [none], 0

    def screened_ones() -> None:
        """The long lists' pairs are screened once each and then kept or forgotten; a pair may come again from a later list."""
        (x,), (y,) = _distinct(long_a, long_b)
        if len(x):
            keep = room(x, y)
            a.append(x[keep])
            b.append(y[keep])
        long_a[:], long_b[:] = [none], [none]

    for x, y in zip(first, [*first[1:], len(names)], strict=True):
        p = _pairs(*(c[x:y] for c in columns))
        (long_a if long[x] else a).append(p[0])
        (long_b if long[x] else b).append(p[1])
        held += len(p[0])
        if held > SENT:
            screened_ones()
            a, b = _distinct(a, b)
            held = 0
    screened_ones()
    a, b = _distinct(a, b)
    return a[0], b[0]


def _distinct(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    x, y = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return [x[new]], [y[new]]


def places(scanned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, at, n, sketch) of the wanted nodes; at is the id of one document."""
    known = scanned.where("sketch is not null").select("node", F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("at"), "n", "sketch").alias("x"))
    return known.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("x").alias("x")).select("node", "x.*")


def screened(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs whose sketches leave room for the overlap."""
    of = lambda c: at.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            n = np.concatenate([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()])
            keep = _room(np.arange(k), np.arange(k, 2 * k), n, batch.column("s_a").to_pylist() + batch.column("s_b").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return written(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long"))


def texts_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (at, text) of documents whose id may be among the wanted: a bitmap sized by their number, so most others are never shuffled."""
    ids = wanted.select("at").distinct()
    bits = min(FLAG_BITS[1], max(FLAG_BITS[0], (8 * ids.count()).bit_length()))
    place = lambda at: (mix(at.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def flags(batches):
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[place(batch.column("at").to_numpy())] = True
        yield _flags(np.packbits(seen))

    def either(batches):
        seen = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            for part in batch.column("flags").to_pylist():
                seen |= np.frombuffer(zlib.decompress(part), np.uint8)
        yield _flags(seen)

    each = ids.coalesce(64).mapInArrow(flags, "flags binary")
    (row,) = each.repartition(8, "flags").mapInArrow(either, "flags binary").coalesce(1).mapInArrow(either, "flags binary").collect()
    packed = row["flags"]

    def run(batches):
        seen = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(seen[place(batch.column("at").to_numpy())]))

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("at"), "text")
    return rows.mapInArrow(run, "at long, text string")


def _flags(packed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(packed.tobytes(), 1)], pa.binary())], names=["flags"])


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids on at least `least` lists, with their exact counts: short lists merged by a heap, long ones probed."""
    lists = sorted(lists, key=len, reverse=True)
    if not lists or least > len(lists):
        return {}
    n_long = min(least - 1, int(least / (0.0085 * np.log2(len(lists[0]) + 1) + 1)))
    long, short = lists[:n_long], lists[n_long:]
    out = {}
    for x, run in groupby(heapq.merge(*short)):
        count = sum(1 for _ in run)
        if count < least - n_long:
            continue
        for k, probed in enumerate(long):
            if count + n_long - k < least:
                break
            at = bisect_left(probed, x)
            count += at < len(probed) and probed[at] == x
        if count >= least:
            out[x] = count
    return out


class Inverted:
    """The inverted lists of some sets: shingle to the ascending numbers of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(tokens, kind="stable")
        self.ids = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.tokens, self.first = np.unique(tokens[order], return_index=True)
        self.first = np.append(self.first, len(tokens))

    def lists(self, query: np.ndarray) -> list[list[int]]:
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (np.append(self.tokens, np.uint64(0))[at] == query)]
        return [self.ids[self.first[k] : self.first[k + 1]].tolist() for k in at]


def similar(query: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Which of the other sets are similar to the query set, by T-occurrence."""
    if not others:
        return []
    n, index = len(query), Inverted(others)
    least = min(-(-MET * (n + m) // (MET + OF)) for m in index.sizes)
    return [k for k, c in divide_skip(index.lists(query), least).items() if OF * c >= MET * (n + index.sizes[k] - c)]


def verified(docs: DataFrame, pairs: DataFrame, at: DataFrame, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar: texts are sent to the groups they are searched in.

    A query set with many candidates is searched in several groups.
    """
    of = lambda c: at.select(F.col("node").alias(c), "at", "n")
    sized = pairs.join(of("b"), "b")
    load = sized.groupBy("a").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("groups"))
    others = sized.join(load, "a").select("at", "a", F.pmod(F.xxhash64("b"), "groups").cast("int").alias("g"), "b")
    queries = load.join(of("a"), "a").select("at", "a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("long").alias("b"))
    routes = written(queries.unionByName(others))

    def run(batches):
        key, query, ids, held = None, None, [], []

        def close():
            return [(key[0], ids[k]) for k in similar(query, held)] if query is not None else []

        for batch in slices(batches):
            out = []
            for a, g, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "g", "b")), shingle_sets(batch.column("text"), WIDTH), strict=True):
                if (a, g) != key:
                    out += close()
                    key, query, ids, held = (a, g), None, [], []
                if node_of(s, renamed) != (a if b is None else b):
                    continue  # another text of the same id
                if b is None:
                    query = s
                else:
                    ids.append(b)
                    held.append(s)
            if out:
                yield _edges(out)
        if out := close():
            yield _edges(out)

    rows = texts_at(docs, routes).join(few(routes, BROADCAST), "at").select("a", "g", "b", "text")
    rows = rows.repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())
    out = written(rows.mapInArrow(run, "a long, b long"))
    release(routes)
    return out


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, component_size, set_id."""
    docs = docs.select("doc_id", "text")
    scanned, renamed = told_apart(scan(docs))
    spark = docs.sparkSession
    total = scanned.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) >> 22)
    shared = shared_lists(postings(docs, frequent_cells(scanned), buckets, renamed))
    strong = strong_lists(shared)
    release(shared)
    at = written(places(scanned, strong.select("node").distinct()))
    pairs = written(first_candidates(strong))
    likely = screened(pairs, at)
    links = verified(docs, likely, at, renamed)
    release(likely)
    found = components(links)
    later = later_candidates(strong, found, at, buckets)
    more = screened(later.join(pairs, ["a", "b"], "left_anti"), at)
    release(strong, pairs, later)
    if more.limit(1).count():
        others = verified(docs, more, at, renamed)
        found = components(links.unionByName(others))
        release(others)
    release(at, more, links)
    rows = scanned.where("node is not null").select("doc_id", "n", "node")
    rows = rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("members"))
    smallest = written(smallest.where("members > 1"))
    rows = rows.join(few(smallest, BROADCAST), "root", "left")
    alone = (F.col("n") == 0) | F.col("members").isNull()
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("members")).cast("long").alias("component_size"),
        F.col("node").alias("set_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns: of every component the document of the smallest id."""
    report = written(jaccard_components(docs).select("doc_id", "n_shingles", "component_id"))
    at = F.coalesce("doc_id", F.lit(_NONE)).alias("_at")
    stay = report.where("doc_id = component_id or component_id is null or n_shingles = 0").select(at)
    # those that go are fewer as a rule; an id that several rows have stays if one of them does
    go = written(report.select(at).join(stay, "_at", "left_anti").distinct())
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("_at"), F.xxhash64("text").alias("text"))
    repeated = stay.groupBy("_at").count().where("count > 1").limit(1).count() > 0
    release(report)
    kept = kept.join(few(go, BROADCAST), "_at", "left_anti")
    if repeated:  # rows of one id: the first of each text
        w = Window.partitionBy("_at", "text").orderBy("row")
        kept = kept.withColumn("k", F.row_number().over(w)).where("k = 1")
    return kept.select("row.*")
