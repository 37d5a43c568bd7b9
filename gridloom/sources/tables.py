"""Scans and sinks of Parquet tables, stage boundaries, and a census of their files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, *, merge: bool = False, recursive: bool = False, schema: StructType | str | None = None) -> DataFrame:
    """A file, a directory of files or a hive-partitioned table.

    `recursive` reads files at any depth and, as Spark does, leaves partition columns out;
    `merge` unites differing schemas by name.
    """
    reader = spark.read.option("mergeSchema", str(merge).lower())
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def scan_tagged(spark: SparkSession, paths: dict[str, str], column: str) -> DataFrame:
    """Several files, each with its name as a literal column, united by name."""
    return union_by_name(scan(spark, p).withColumn(column, F.lit(tag)) for tag, p in paths.items())


def union_by_name(frames: Iterable[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def observations(spark: SparkSession, mode: str, path: str, parts: dict[str, str] | None = None, regions=None) -> DataFrame:
    """`sample`: one file as it is, of region "sample"; `regions`: a file a region; `full`: one table, regions by boxes."""
    if mode == "sample":
        return scan(spark, path).withColumn("regional_subset_id", F.lit("sample"))
    if mode == "regions":
        return scan_tagged(spark, {k: f"{path}/{v}" for k, v in (parts or {}).items()}, "regional_subset_id")
    if mode == "full":
        from gridloom.functions.keys import region_of

        return scan(spark, path).withColumn("regional_subset_id", region_of("x", "y", regions)).where(F.col("regional_subset_id") != "other")
    raise ValueError(f"no mode {mode!r}")


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    found, it = [], fs.listFiles(hadoop, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()
        if name.endswith(".parquet"):
            found.append((name, f.getLen()))
    return sorted(found)


def discover(spark: SparkSession, directories: Iterable[str]) -> tuple[list[str], list[str]]:
    """Parquet files below the directories, sorted, and the directories that hold none."""
    found, without = [], []
    for d in directories:
        files = [name for name, _ in _files(spark, d)]
        found += files
        if not files:
            without.append(d)
    return sorted(found), without


def census(spark: SparkSession, path: str) -> DataFrame:
    """Per partition directory its files and bytes; only file names and sizes are read."""
    rows = [(name.rsplit("/", 1)[0].rsplit("/", 1)[-1] if "=" in name.rsplit("/", 1)[0].rsplit("/", 1)[-1] else "", size) for name, size in _files(spark, path)]
    files = spark.createDataFrame(rows, "partition string, bytes long")
    return files.groupBy("partition").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))


def human(size: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024 or unit == "TiB":
            return f"{size:.1f} {unit}"
        size /= 1024
    return ""


def schema_rows(spark: SparkSession, path: str) -> DataFrame:
    """Columns and types from the footers alone."""
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in scan(spark, path).schema], "column string, type string")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def save(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Zstandard Parquet; `by`: hive partitions, each written by as many tasks as its bytes call for (adaptive execution splits large ones)."""
    if by:
        df = df.hint("rebalance", *by)
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def save_sorted(df: DataFrame, path: str, order: list[str]) -> None:
    """Globally sorted files: ranges of the order, each sorted."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(path)


def stage(df: DataFrame, path: str, resume: bool = False) -> DataFrame:
    """Written and read again: cuts the lineage, outlives lost executors; `resume` takes a finished table as it is."""
    if not (resume and exists(df.sparkSession, path)):
        save(df, path)
    return scan(df.sparkSession, path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; in local mode, where none is set, one of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/gridloom-shared"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, outlives lost executors."""
    return stage(df, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}")


@contextmanager
def kept_on_disk(df: DataFrame) -> Iterator[DataFrame]:
    """The rows held on the executors' disks while several results are computed from them, and let go afterwards."""
    df = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield df
    finally:
        df.unpersist()


def views(spark: SparkSession, paths: dict[str, str]) -> None:
    """Temporary views over tables of files, for SQL."""
    for name, path in paths.items():
        scan(spark, path).createOrReplaceTempView(name)


def partition_of(spark: SparkSession, path: str, column: str, value: str) -> DataFrame:
    """One hive partition, with its value as a literal column again."""
    return scan(spark, f"{path}/{column}={value}").withColumn(column, F.lit(value))


def save_sample(df: DataFrame, path: str, rows: int, keys: list[str], seed: int = 42) -> None:
    """About so many rows in one file, drawn by a hash of keys; a table of no more rows is saved whole."""
    from gridloom.operators.sampling import sample

    total = df.count()
    out = df if total <= rows else sample(df, min(1.0, 1.2 * rows / total), keys, seed)
    out.repartition(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def save_first(df: DataFrame, path: str, columns: list[str], order: list[str], n: int = 500) -> None:
    """The first n rows in a total order, only the columns there are."""
    df.orderBy(*order).limit(n).select(*(c for c in columns if c in df.columns)).write.mode("overwrite").parquet(path)
