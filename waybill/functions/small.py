"""Helpers for inputs whose size is fixed or checked before use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` only after seeing that it has at most `max_rows` rows.

    A larger table comes back unhinted, so the join shuffles both sides and AQE splits
    hot keys.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def broadcast_up_to(stored_rows: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint for rows counted to be at most `max_rows`; more rows go unhinted.

    For tables read back from storage: the count reads no column, nothing is collected.
    """
    return F.broadcast(stored_rows) if stored_rows.count() <= max_rows else stored_rows


def scalar(one_row: DataFrame) -> dict[str, Column]:
    """The columns of a one-row table (a global aggregate) as literals.

    Read once: a scalar subquery would be planned again at every mention.
    """
    row = one_row.first()
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in one_row.schema.fields}


def shuffle_width(df: DataFrame, least: int = 8, most: int = 4096) -> int:
    """Number of range buckets to aim for: the session's shuffle width, within limits."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, width))


def spread(scan: DataFrame) -> DataFrame:
    """Deals out the rows of a scan that has fewer files than the session has cores.

    One large row group is one task, and everything up to the next shuffle stays in it.
    Tables of many files are left as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.isStreaming or len(scan.inputFiles()) >= cores:
        return scan
    return scan.repartition(cores)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds derived columns behind a one-row generator.

    Catalyst copies a projected expression into every filter that mentions it. For long
    formulas the copies add up to methods the JIT refuses to compile; a generator is not
    copied, so each formula runs once per row. What the formulas have in common is shared
    only in a projection, so they are worked out in one below the generator.
    """
    cell = F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, cell).select(*kept, F.inline(F.array("_once")))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a session inside one process may go without the setting; it gets a temporary
    folder, which its executor threads do share. Elsewhere a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="waybill-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


#: Removes what a query shuffled as soon as it ends; else that stays on disk until the driver's garbage is collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For queries that run once: a second run of the same query would have to shuffle again."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    Later passes read the files instead of redoing the work, and a lost executor loses
    nothing. The files go when the driver ends, what was shuffled for them at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(tables: list[DataFrame]) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {os.path.dirname(f) for f in table.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folder_at(spark: SparkSession, path: str) -> bool | None:
    """Whether a path is a folder, by whatever store it is in; None if nothing is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getFileStatus(where).isDirectory() if store.exists(where) else None


def fresh_path(spark: SparkSession) -> str:
    """A new folder name in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/waybill-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialised(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, so later passes read it instead of redoing it."""
    return stored(df)
