"""Helpers of the operators: word splitting in SQL, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import gridloom.llm

#: Executors get the functions of this package with the task, so they need no copy of it.
cloudpickle.register_pickle_by_value(gridloom.llm)

#: White space of every word rule here: space and \x09-\x0D.
SPACE = r"[\x20\x09-\x0D]+"

#: Elements of an array whose running values are made one by one.
STEP = 32


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Equal for rows with the same id and text only, so repeated ids do not mix; never null."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.xxhash64(text).cast("string"), F.length(F.coalesce(text, F.lit(""))).cast("string"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine only in local mode where none is set, as in tests."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/gridloom-shared"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, outlives lost executors.

    It stays until `release`; all tables of an application are in one folder of its name.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["written_at"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing is going to read any more."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__["written_at"]
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once, however often `use` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What `add` makes of the elements before each, for an array: as many elements, the first being `zero`.

    Arrays of more than STEP elements go by blocks of so many, and blocks of blocks, so the cost is linear in practice.
    """
    block_of = lambda x: F.aggregate(x, F.array(zero), lambda s, y: F.concat(s, F.array(add(F.element_at(s, -1), y))))
    blocks = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STEP).cast("int")), lambda k: block_of(F.slice(x, k * STEP + 1, F.lit(STEP))))
    totals = lambda parts: F.transform(parts, lambda part: F.element_at(part, -1))
    head = lambda x, n: F.slice(x, F.lit(1), n)

    def joined(parts: Column, before: Column) -> Column:
        return F.flatten(F.zip_with(parts, head(before, F.size(parts)), lambda part, by: F.transform(head(part, F.size(part) - 1), lambda y: add(by, y))))

    def long(x: Column) -> Column:
        return let(blocks(x), lambda parts: joined(parts, let(blocks(totals(parts)), lambda upper: joined(upper, block_of(totals(upper))))))

    return let(values, lambda x: F.when(F.size(x) <= STEP, head(block_of(x), F.size(x))).otherwise(long(x)))


def few(df: DataFrame, most: int) -> DataFrame:
    """The rows, to be broadcast if they are at most so many; they are counted, so should be cheap to read."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_by_hash(rows: DataFrame, keys: list[str], n: int, share: float = 1.0) -> DataFrame:
    """The first n rows in the order of a hash of `keys`, all of them if there are fewer.

    Only about 4 n / `share` rows of the smallest hashes, `share` being a low guess of how many
    rows a caller's filters leave, are sorted at all, so no task sends n rows to the driver;
    more are if these do not suffice, as where many rows are alike.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    total = rows.count()
    part = 4 * n / share / max(1, total)
    while part < 1 and rows.where(place < int(part * (1 << 40))).limit(n).count() < min(n, total):
        part *= 8
    some = rows if part >= 1 else rows.where(place < int(part * (1 << 40)))
    return some.orderBy(place, *keys).limit(n)


def windows_of(text: Column, most: int, pieces: int = 10) -> Column:
    """The text, or of a longer one as many characters as `most` in pieces spread over all of it, their places drawn by its hash."""
    n, size = F.length(text), most // pieces
    slot = F.floor(n / pieces)
    piece = lambda k: F.substring(text, (k * slot + F.pmod(F.xxhash64(text, k), slot - size + 1) + 1).cast("int"), F.lit(size))
    return F.when(n <= most, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), piece), " "))


def give_back() -> None:
    """Returns freed memory to the system: an idle Python worker is not to hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds about `most` bytes of text; a longer text stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = max(1, batch.column(text).nbytes)
        step = max(1, int(batch.num_rows * most / size))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)
        del batch
    give_back()


def kept_in_worker(key: object, make):
    """What `make` gives, made once in a Python worker process and found again by its next tasks."""
    store = sys.modules.setdefault("_gridloom_kept", types.ModuleType("_gridloom_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
