"""Profiling and monitoring aggregates, all built from mergeable partial sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bucket bounds.
SCORE_BUCKETS = (-5.0, -3.0, -2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0, 3.0, 5.0)
BATCH_BUCKETS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
LATENCY_BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.3, 0.5, 1.0, 2.0, 5.0, 10.0)


def feature_drift_snapshot(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of the known values per feature; all-null features absent."""
    stats = rows.agg(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.count(n).alias("n"),
                F.avg(n).alias("mean"),
                F.when(F.count(n) > 1, F.stddev_samp(n)).otherwise(0.0).alias("stdev"),
            ).alias(n)
            for n in names
        ]
    )
    return stats.select(F.inline(F.array(*names))).where(F.col("n") > 0)


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative ``le`` buckets with total count and sum, per label set.

    Conditional counts in a single aggregation, so each task ships one row per
    label set and no range join is needed.
    """
    labels = [_bound_label(b) for b in bounds] + ["+Inf"]
    known = F.col(value).isNotNull()
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count_if(known)]
    sums = rows.groupBy(*by).agg(
        F.array(*counts).alias("counts"), F.count_if(known).alias("n"), F.sum(value).alias("total")
    )
    zipped = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("le"), F.col("counts").alias("cumulative"))
    return sums.select(*by, "n", "total", F.inline(zipped)).toDF(*by, "n", "total", "le", "cumulative")


def _bound_label(bound: float) -> str:
    return str(float(bound))


def batch_size_histogram(pairs: DataFrame, by: str) -> DataFrame:
    sizes = pairs.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("batch_size"))
    return histogram(sizes, "batch_size", BATCH_BUCKETS)


def event_counters(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def pairwise_check(pairs: DataFrame, item: str, grade: str = "grade", at_least: int = 3) -> DataFrame:
    """Of the items seen in enough postings, how many carry differing grades."""
    per_item = pairs.groupBy(item).agg(
        F.count(F.lit(1)).alias("n"), (F.min(grade) < F.max(grade)).alias("varies")
    )
    counted = per_item.where(F.col("n") >= at_least)
    return counted.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if("varies").alias("n_varying"),
        (F.count_if("varies") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("share_varying"),
    )


def group_depth(pairs: DataFrame, by: str, grade: str = "grade", top: int = 3) -> DataFrame:
    per_group = pairs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(grade) == top).alias("n_top")
    )
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("n").alias("smallest"),
        F.max("n").alias("largest"),
        F.percentile("n_top", F.lit(0.5)).alias("median_top_grade"),
    )


def text_profile(docs: DataFrame, text: str, facts: dict[str, Column]) -> DataFrame:
    """Length range and median, and the share of documents stating each fact."""
    length = F.length(F.col(text))
    return docs.agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.min(length).alias("shortest"),
        F.max(length).alias("longest"),
        F.percentile(length, F.lit(0.5)).alias("median_length"),
        *[F.avg(F.coalesce(stated, F.lit(False)).cast("double")).alias(name) for name, stated in facts.items()],
    )
