"""Constraint audits on streams. Row rules are row-local, so the batch Columns are reused."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from waybill import schema as S
from waybill.functions.small import folder_at, shared_folder
from waybill.operators.audit import flag_hard


def flag_stream(stream: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Adds `quarantined` to a stream; the vocabulary is a static table."""
    return flag_hard(stream, vocabulary)


def write_split(flagged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes clean and quarantined rows below `path`, in folders by flag."""
    return (
        flagged.writeStream.format("parquet")
        .partitionBy("quarantined")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def window_rates(
    flagged: DataFrame, time: str = S.CREATED, size: str = "7 days", late: str = "1 day"
) -> DataFrame:
    """(window_start, n, violations): tumbling windows; rows later than `late` are dropped."""
    return (
        flagged.withWatermark(time, late)
        .groupBy(F.window(time, size).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("quarantined").alias("violations"))
        .select(F.col("w.start").alias("window_start"), "n", "violations")
    )


def drop_repeats(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """One row per key among rows at most `late` apart in event time."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def parquet_stream(
    spark: SparkSession, path: str, columns=None, files_per_batch: int | None = None
) -> DataFrame:
    """A parquet file or folder as a stream, with the schema of the files there now.

    The file source watches folders, so a single file is matched by name in its folder.
    `files_per_batch` cuts a backlog into micro-batches.
    """
    stored = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(stored.schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if folder_at(spark, path) is False:
        stream = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = reader.parquet(path)
    return stream if columns is None else stream.select(*columns)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Processes what is available into a table in the shared folder and reads it back.

    In append mode the file sink commits each batch once. In update and complete mode each
    batch overwrites its own folder, so a repeated batch leaves no second copy, and the
    newest value per batch is what `batch` tells apart.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out, marks = f"{base}/rows", f"{base}/progress"
    writer = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    if folder_at(spark, out) is None:  # no batch had anything to write
        return spark.createDataFrame([], T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())]))
    return spark.read.parquet(out)


def latest_batch(rows: DataFrame, keys) -> DataFrame:
    """Final value per key of a table written in update mode."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest: list[Column] = [F.max_by(c, "batch").alias(c) for c in values]
    return rows.groupBy(*keys).agg(*newest)


MARK = "_mark"


def rates_with_late(
    stream: DataFrame,
    folder: str,
    time: str = S.CREATED,
    size: str = "7 days",
    late: str = "1 day",
) -> DataFrame:
    """(window_start, n, violations, n_late) of a stream of flagged rows, late rows counted.

    A row is late if its window ended at or before the watermark: the newest time of the earlier
    micro-batches less `late`. Late rows don't change the window's counts, they add to `n_late`.
    Each micro-batch writes its counts per window, and the newest time it knows, as a table of its
    own below `folder`; a batch that is repeated after a failure overwrites that table, and reads the
    mark of the batch before it. A later call with the same folder goes on where the last one
    ended. A row without a time is in no window; a NULL flag is no violation.
    """
    spark = stream.sparkSession
    out = f"{folder.rstrip('/')}/counts"

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = None
        if number > 0:
            before = session.read.parquet(f"{out}/batch={number - 1}").agg(F.max(MARK)).first()[0]
        window = F.window(time, size)
        flagged = F.coalesce(F.col("quarantined"), F.lit(False))
        mark = F.lit(before).cast("timestamp")
        behind = F.coalesce(F.col("w.end") <= mark - F.expr(f"INTERVAL {late}"), F.lit(False))
        counted = (
            batch.where(F.col(time).isNotNull())
            .select(F.col(time).cast("timestamp").alias("_time"), window.alias("w"), flagged.alias("_flag"))
            .groupBy("w")
            .agg(
                F.count_if(~behind).alias("n"),
                F.count_if(~behind & F.col("_flag")).alias("violations"),
                F.count_if(behind).alias("n_late"),
                F.greatest(F.max("_time"), mark).alias(MARK),
            )
            .select(F.col("w.start").alias("window_start"), "n", "violations", "n_late", MARK)
        )
        # A batch without a row still hands its mark on.
        carried = session.range(1).select(
            F.lit(None).cast("timestamp").alias("window_start"),
            *[F.lit(0).cast("long").alias(c) for c in ("n", "violations", "n_late")],
            mark.alias(MARK),
        )
        counted.unionByName(carried).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{folder.rstrip('/')}/progress")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    shape = "window_start timestamp, n long, violations long, n_late long"
    if folder_at(spark, out) is None:
        return spark.createDataFrame([], shape)
    rows = spark.read.schema(shape).parquet(out).where("window_start IS NOT NULL")
    return rows.groupBy("window_start").agg(*[F.sum(c).alias(c) for c in ("n", "violations", "n_late")])
