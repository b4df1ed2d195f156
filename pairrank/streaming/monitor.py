"""Streaming forms of the monitoring counters.

Each micro-batch is reduced to its partial counts and written under its own batch
id, so a replayed batch overwrites itself; reading adds the partials up. Late rows
simply count in the batch that brings them, as a process-local counter would.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairrank.session import scratch_path


def read_stream(
    spark: SparkSession, folder: str, glob: str, schema: T.StructType, files_per_batch: int | None = 64
) -> DataFrame:
    """A folder as a stream; without ``files_per_batch`` all files that are there form one batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_counters(stream: DataFrame, labels: Sequence[str], path: str | None = None) -> DataFrame:
    """Run the available input to its end and return exact totals per label set."""
    spark = stream.sparkSession
    target = path or scratch_path(spark, "counters")

    def reduce_batch(batch: DataFrame, batch_id: int) -> None:
        partial = batch.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
        partial.write.mode("overwrite").parquet(f"{target}/data/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(reduce_batch)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{target}/data").groupBy(*labels).agg(F.sum("n").alias("n"))


def stream_feature_moments(stream: DataFrame, names: Sequence[str], path: str | None = None) -> DataFrame:
    """Drift snapshot of a stream: per-batch count, mean and squared deviation, merged on read."""
    spark = stream.sparkSession
    target = path or scratch_path(spark, "moments")

    def reduce_batch(batch: DataFrame, batch_id: int) -> None:
        partial = batch.agg(
            *[
                F.struct(
                    F.lit(n).alias("feature"),
                    F.count(n).alias("n"),
                    F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"),
                    F.coalesce(F.var_pop(n) * F.count(n), F.lit(0.0)).alias("m2"),
                ).alias(n)
                for n in names
            ]
        ).select(F.inline(F.array(*names)))
        partial.write.mode("overwrite").parquet(f"{target}/data/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(reduce_batch)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    parts = spark.read.parquet(f"{target}/data")
    overall = parts.groupBy("feature").agg(
        F.sum("n").alias("n"), (F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean")
    )
    # Parallel-variance merge: within-batch deviations plus the batch means around the overall mean.
    spread = (
        parts.join(overall.select("feature", F.col("mean").alias("overall")), "feature")
        .groupBy("feature")
        .agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("overall"), 2)).alias("m2"))
    )
    return overall.join(spread, "feature").where(F.col("n") > 0).select(
        "feature",
        "n",
        "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / F.nullif(F.col("n") - 1, F.lit(0)))).otherwise(0.0).alias("stdev"),
    )


def windowed_counters(stream: DataFrame, time: str, labels: Sequence[str], window: str, late: str) -> DataFrame:
    """Tumbling-window counts with a watermark, for an append sink."""
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window).alias("window"), *labels)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), *labels, "n")
    )


def windowed_with_late(
    stream: DataFrame, time: str, labels: Sequence[str], window: str, delay: str, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run the available input to its end: (counts of every window, the rows that came too late for theirs).

    Native windowed counts drop late rows without a trace. Here the watermark is kept
    beside the counts: after each micro-batch the newest time seen so far, less ``delay``.
    A row whose window had ended at or before the watermark of the earlier batches is
    written out whole, as is a row without a time; all others are counted, so both outputs
    together hold every row. ``closed`` says that a window has ended at the present watermark.

    Every output of a batch lies in a folder of its own, so a replayed batch writes the same
    again. With the same ``path`` a new run goes on from the checkpoint, watermark included.
    What is kept between batches is one time; counts are merged when they are read.
    """
    spark = stream.sparkSession
    target = path or scratch_path(spark, "windows")

    def counted(rows: DataFrame) -> DataFrame:
        by_window = rows.groupBy(F.window(time, window).alias("window"), *labels).agg(F.count(F.lit(1)).alias("n"))
        return by_window.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *labels, "n")

    def read(part: str) -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{target}/{part}")

    def write(rows: DataFrame, part: str, batch_id: int, mode: str = "overwrite") -> None:
        rows.write.mode(mode).parquet(f"{target}/{part}/batch={batch_id}")

    def split_batch(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{target}/marks/batch={batch_id - 1}")
        watermark = before.select(F.expr(f"high - INTERVAL {delay}")).scalar()
        batch = batch.persist()
        # The row travels as one value, so that no name can clash; a row without a time is in no window.
        windowed = batch.select(F.struct("*").alias("row"), F.window(time, window).alias("window"))
        judged = windowed.select("row", F.coalesce(F.col("window.end") > watermark, F.lit(True)).alias("in_time"))
        write(counted(judged.where("in_time").select("row.*")), "counts", batch_id)
        late = judged.where("NOT in_time").select("row.*")
        write(late.unionByName(batch.where(F.col(time).isNull())), "late", batch_id)
        write(batch.agg(F.greatest(F.max(time), before.select("high").scalar()).alias("high")), "marks", batch_id)
        batch.unpersist()

    none = spark.createDataFrame([], stream.schema)
    for part, rows in (("counts", counted(none)), ("late", none), ("marks", none.agg(F.max(time).alias("high")))):
        write(rows, part, -1, "ignore")
    query = (
        stream.writeStream.foreachBatch(split_batch)
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    now = read("marks").agg(F.max("high").alias("high")).select(F.expr(f"high - INTERVAL {delay}")).scalar()
    totals = read("counts").groupBy("window_start", "window_end", *labels).agg(F.sum("n").alias("n"))
    return totals.withColumn("closed", F.coalesce(F.col("window_end") <= now, F.lit(False))), read("late")
