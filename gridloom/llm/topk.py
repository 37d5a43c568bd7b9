"""Exact top-k search by inner product on a bit-sliced index.

Components are quantised to integers floor(1024 x). A shard of rows keeps, for every
dimension, bitmaps of the leading bits of its values. For a query these slices are added
with its own leading bits as factors (shifts by signed binary digits, carry-save adders on
bitmaps), which gives the slices of a coarse score; the k-th coarse score is found from
the most significant slice downward, and every row that could still beat it, by bounds on
what the left-out bits can add, is resolved exactly with integers. Nothing is approximate.

Rows are dealt into shards of at most about `SHARD` and sent once; a shard is indexed once, and
all queries pass by it as a stream, so memory is bounded by a shard and a batch. Every shard
gives k rows a query, merged by a window. Style: Arrow batches with numpy.

Edge cases: vectors that are null, empty or hold a null or non-finite component take no
part, nor do rows without an id; vectors of another length than the query's are no
candidates of it; of rows with one id the first vector in order is the query and all are
its own; ties go to the smaller vec_id; fewer rows than k give all; an empty table gives
an empty result; scores beyond a long are cut to its range; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE, K = 1024, 10
#: Rows of a shard at most, and at least where there are more tasks than shards.
SHARD, SMALL = 65_536, 4096
#: Leading bits of row and query components in the index, besides the sign.
ROW_BITS, QUERY_BITS = 6, 5
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~odd


def _bits(a: np.ndarray) -> int:
    return int(np.abs(a).max(initial=0)).bit_length()


class SlicedIndex:
    """Bit slices of a shard of integer vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.rows = vectors, len(vectors)
        self.shift = max(0, _bits(vectors) - ROW_BITS)
        lead = vectors >> self.shift
        self.width = _bits(lead) + 1
        words = -(-self.rows // 64)
        planes = np.zeros((vectors.shape[1], self.width, words * 64), np.uint8)
        for b in range(self.width):
            planes[:, b, : self.rows] = ((lead >> b) & 1).T
        self.planes = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)
        rest = (vectors - (lead << self.shift)).astype(float) - ((1 << self.shift) - 1) / 2
        self.lead_norm = float(np.sqrt((lead.astype(float) ** 2).sum(axis=1)).max(initial=0))
        self.rest_norm = float(np.sqrt((rest**2).sum(axis=1)).max(initial=0))
        self.all = np.zeros(words * 64, np.uint8)
        self.all[: self.rows] = 1
        self.all = np.packbits(self.all, bitorder="little").view(np.uint64)

    def coarse(self, query: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Slices of the coarse score, least first, and how far twice an exact score can be from its place, in coarse units."""
        shift = max(0, _bits(query) - QUERY_BITS)
        factor = (query + (1 << shift >> 1)) >> shift
        error = (query - (factor << shift)).astype(float)
        bound = float(np.sqrt((error**2).sum())) * self.lead_norm * 2.0**self.shift + float(np.sqrt((query.astype(float) ** 2).sum())) * self.rest_norm
        bags: dict[int, list[np.ndarray]] = {}
        at, digit = 0, factor.copy()
        while digit.any():  # signed digits, none of two neighbours both set
            d = np.where(digit & 1, 2 - (digit & 3), 0)
            digit = (digit - d) >> 1
            for sign in (1, -1):
                where = np.flatnonzero(d == sign)
                if len(where):
                    for b in range(self.width):
                        plane = self.planes[where, b]
                        negative = (b == self.width - 1) != (sign < 0)
                        bags.setdefault(at + b, []).append(plane ^ _FULL if negative else plane)
            at += 1
        slices = []
        j = 0
        while bags:
            bag = bags.pop(j, None)
            if bag is None:
                slices.append(np.zeros_like(self.all))
            else:
                x = np.concatenate(bag)
                while len(x) > 1:
                    if len(x) == 2:
                        total, carry, left = x[:1] ^ x[1:], x[:1] & x[1:], x[:0]
                    else:
                        third = len(x) // 3
                        a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
                        half = a ^ b
                        total, carry, left = half ^ c, (a & b) | (half & c), x[3 * third :]
                    bags.setdefault(j + 1, []).append(carry)
                    x = np.concatenate([total, left])
                slices.append(x[0])
            j += 1
        return slices, 2 * bound / 2.0 ** (shift + self.shift)

    def candidates(self, query: np.ndarray, k: int, live: np.ndarray) -> np.ndarray:
        """Rows among which the k best surely are."""
        if int(np.bitwise_count(live).sum()) <= k:
            chosen = live
        else:
            slices, slack = self.coarse(query)
            above, equal, value = np.zeros_like(live), live, 0
            for j in range(len(slices) - 1, -1, -1):
                more = above | (equal & slices[j])
                if int(np.bitwise_count(more).sum()) >= k:
                    equal, value = equal & slices[j], value | 1 << j
                else:
                    above, equal = more, equal & ~slices[j]
            least = max(0, value - int(np.ceil(slack)) - 1)
            above, equal = np.zeros_like(live), live
            for j in range(len(slices) - 1, -1, -1):
                if least >> j & 1:
                    equal = equal & slices[j]
                else:
                    above, equal = above | (equal & slices[j]), equal & ~slices[j]
            chosen = above | equal
        return np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little")[: self.rows])

    def best(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but those with the id `own`, ties to the smaller id."""
        live = self.all
        mine = np.flatnonzero(ids == own)
        if len(mine):
            live = live.copy()
            np.bitwise_and.at(live, mine // 64, ~(np.uint64(1) << (mine % 64).astype(np.uint64)))
        rows = self.candidates(query, k, live)
        if _bits(self.vectors) + _bits(query) + len(query).bit_length() < 63:
            scores = self.vectors[rows] @ query
        else:
            exact = self.vectors[rows].astype(object) @ query.astype(object)
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in exact], np.int64)
        order = np.lexsort((ids[rows], np.invert(scores)))[:k]
        return ids[rows[order]], scores[order]


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("vec_id").to_numpy()
    return ids, batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _found(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cat = lambda x: pa.array(np.concatenate(x), pa.int64())
    return pa.RecordBatch.from_arrays([cat([np.full(len(i), q, np.int64) for q, i, _ in parts]), cat([i for _, i, _ in parts]), cat([s for _, _, s in parts])], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """For each row whose vec_id is divisible by `every` the k other rows of the highest score."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
    rows = rows.withColumn("dim", F.size("v"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("x")).select("vec_id", "x.v", "x.dim")
    n = vectors.count()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // SHARD), min(tasks, n // SMALL))
    dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    both = rows.select(dealt, "dim", F.lit(0).alias("query"), "vec_id", "v").unionByName(queries.select(every_shard, "dim", F.lit(1).alias("query"), "vec_id", "v"))

    def run(batches):
        key, parts, index, ids = None, [], None, None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("shard", "dim", "query")]
            # stretches of one shard, length and kind
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
                if a == b:
                    continue
                if (here := (int(columns[0][a]), int(columns[1][a]))) != key:
                    key, parts, index = here, [], None
                stretch = batch.slice(a, b - a)
                if not columns[2][a]:
                    parts.append(_matrix(stretch))
                elif parts or index:
                    if index is None:
                        ids, index, parts = np.concatenate([p[0] for p in parts]), SlicedIndex(np.concatenate([p[1] for p in parts])), []
                    yield _found([(q, *index.best(vector, ids, q, k)) for q, vector in zip(*_matrix(stretch), strict=True)])

    dealt_out = both.repartition(shards, "shard", "dim").sortWithinPartitions("shard", "dim", "query")
    found = dealt_out.mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
