"""Ranks, shortlists and ranking-quality metrics inside each posting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.functions.stats import gain, ideal_dcg, position_exposure

#: A posting above this many rows is ranked in several tasks instead of one.
MAX_GROUP_ROWS = 4_000_000
RELEVANT_GRADE = 2
CIRCULARITY_LIMIT = 0.95


def _place(score: str, ids: Sequence[str]) -> Column:
    """What decides the place of a row in its group, for :func:`_ahead`."""
    return F.struct(F.col(score).alias("score"), F.struct(*[F.col(i) for i in ids]).alias("ids"))


def _ahead(a: Column, b: Column) -> Column:
    """Whether place ``a`` comes before ``b`` in the order of the rank window: score descending, nulls last, then ids.

    Scores are only compared, never computed with, so any type that can be ordered will do. NaN is the largest number.
    """
    higher = F.coalesce(a["score"] > b["score"], a["score"].isNotNull() & b["score"].isNull())
    return higher | (a["score"].eqNullSafe(b["score"]) & (a["ids"] < b["ids"]))


def has_crowded_group(df: DataFrame, by: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS) -> bool:
    """Whether any group is too large for one task: a map-side merged count of ``by`` alone."""
    return not _crowded_groups(df, by, max_group_rows).isEmpty()


def _crowded_groups(df: DataFrame, by: Sequence[str], max_group_rows: int) -> DataFrame:
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("group_rows"))
    return counted.where(F.col("group_rows") > max_group_rows)


def rank_within(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    ids: Sequence[str],
    running: Mapping[str, Column] | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
    crowded: bool | None = None,
) -> DataFrame:
    """Add ``rank`` (1..n by score descending, then ids) and running sums per group.

    One lazy plan, built without starting a job. Groups above ``max_group_rows`` are
    counted inside it, from the ``by`` columns alone (``sizes`` may supply a cheaper
    source of the same rows), and ranked in several tasks by :func:`_rank_split`; all
    others take one exchange on ``by`` and one sort. Where the count finds no such
    group, adaptive execution drops the split branch before it runs. Ranks are the
    same either way. ``crowded=False`` leaves the branch out for a caller that knows.
    """
    by, ids, running = list(by), list(ids), dict(running or {})
    if crowded is False:
        return _rank_window(df, by, score, ids, running)
    # At most (all rows / max_group_rows) groups are that large, so the side is small at any scale.
    hot = F.broadcast(_crowded_groups(sizes if sizes is not None else df, by, max_group_rows))
    cold = _join_on(df, hot, by, "left_anti")
    packed = _join_on(df, hot, by, "inner")
    return _rank_window(cold, by, score, ids, running).unionByName(
        _rank_split(packed, by, score, ids, running, max_group_rows)
    )


def _join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Null-safe equi-join, so that a null group keeps its rows."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    condition = F.col(keys[0]).eqNullSafe(F.col(f"right_{keys[0]}"))
    for k in keys[1:]:
        condition = condition & F.col(k).eqNullSafe(F.col(f"right_{k}"))
    joined = left.join(renamed, condition, how)
    return joined if how == "left_anti" else joined.drop(*[f"right_{k}" for k in keys])


def _rank_window(df, by, score, ids, running) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *[F.col(i) for i in ids])
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        F.row_number().over(order).alias("rank"),
        *[F.sum(value).over(so_far).alias(name) for name, value in running.items()],
    )


def _rank_split(df, by, score, ids, running, max_group_rows) -> DataFrame:
    """Exact rank of groups that do not fit one task.

    A hash-chosen set of rows of the group serves as split points: each row finds
    its slice by binary search, slices are ranked independently, and the sizes of
    the slices before it are added. The split points decide only where the cuts
    fall, never the result, and are a pure function of the data, so a recomputed
    task cuts in the same places. Rows never travel by the crowded key: group sizes
    and split points are broadcast, and the exchange is by (group, slice). There are
    at most some eight split points for every ``max_group_rows`` rows; equal ones count once.
    """
    key = _place(score, ids)
    slices = F.ceil(F.col("group_rows") / F.lit(max_group_rows)) * 4
    stride = F.greatest(F.lit(1), (F.col("group_rows") / slices).cast("bigint"))
    chosen = df.where(F.pmod(F.xxhash64(*[F.col(c) for c in [*by, *ids, score]]), stride) == 0)
    cuts = chosen.groupBy(*by).agg(F.array_sort(F.collect_set(key), lambda a, b: F.when(_ahead(a, b), -1).when(_ahead(b, a), 1).otherwise(0)).alias("cuts"))
    placed = _join_on(df.drop("group_rows"), F.broadcast(cuts), by, "left")
    placed = placed.withColumn("slice", _slices_before(F.col("cuts"), key)).drop("cuts")

    totals = placed.groupBy(*by, "slice").agg(
        F.count(F.lit(1)).alias("slice_rows"),
        *[F.sum(value).alias(f"slice_{name}") for name, value in running.items()],
    )
    earlier = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "slice",
        F.coalesce(F.sum("slice_rows").over(earlier), F.lit(0)).alias("rows_before"),
        *[F.coalesce(F.sum(f"slice_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in running],
    )
    ranked = _join_on(_rank_window(placed, [*by, "slice"], score, ids, running), offsets, [*by, "slice"], "inner")
    kept = [c for c in df.columns if c != "group_rows"]
    return ranked.select(
        *kept,
        (F.col("rank") + F.col("rows_before")).cast("int").alias("rank"),
        *[(F.col(n) + F.col(f"before_{n}")).alias(n) for n in running],
    )


def _slices_before(cuts: Column, key: Column, steps: int = 20) -> Column:
    """How many sorted ``cuts`` lie strictly before ``key`` (binary search, 2^20 cuts)."""
    return F.aggregate(
        F.array(*[F.lit(1 << s) for s in range(steps - 1, -1, -1)]),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= F.coalesce(F.size(cuts), F.lit(0))) & _ahead(F.get(cuts, low + step - 1), key), low + step
        ).otherwise(low),
    )


def top_k(df: DataFrame, by: Sequence[str], score: str, ids: Sequence[str], k: int = 10) -> DataFrame:
    """First ``k`` per group.

    ``row_number() <= k`` is limited on the map side before the exchange, so a
    crowded group sends at most k rows per task.
    """
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), *[F.col(i) for i in ids])
    return df.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def with_exposure(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("exposure", position_exposure(F.col("rank")))


def _dcg(rank: Column, grade: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, gain(grade) * position_exposure(rank)))


def unknown_grades(grade: str, max_grade: int) -> Column:
    """How many rows have a grade that is no whole number from 0 to ``max_grade``."""
    return F.count_if(~F.col(grade).isin(*range(max_grade + 1)))


def known(ideal: Column, max_grade: int) -> Column:
    """``ideal``, or an error where ``n_unknown`` grades are missing from it."""
    error = F.raise_error(F.lit(f"grades must be whole numbers from 0 to {max_grade}"))
    return F.when(F.col("n_unknown") > 0, error.cast("double")).otherwise(ideal)


def posting_metrics(
    df: DataFrame,
    by: Sequence[str],
    score: str,
    ids: Sequence[str],
    grade: str = "grade",
    cutoffs: Sequence[int] = (5, 10),
    max_grade: int = 3,
    **rank_options,
) -> DataFrame:
    """NDCG at each cutoff, average precision and reciprocal rank, one row per group.

    One exchange: the rank window, the running hit count and the final
    aggregation all share the partitioning on ``by``; the ideal order comes from
    grade counts, so it needs no second sort. A grade that is no whole number from 0 to
    ``max_grade`` is an error where an NDCG is asked for.
    """
    relevant = F.when(F.col(grade) >= RELEVANT_GRADE, 1).otherwise(0)
    spine = df.select(*by, *[i for i in ids if i not in by], score, grade)
    ranked = rank_within(spine, by, score, ids, {"hits": relevant}, **rank_options)
    rank, is_hit = F.col("rank"), F.col(grade) >= RELEVANT_GRADE
    counts = [F.count_if(F.col(grade) == g).alias(f"n_{g}") for g in range(1, max_grade + 1)]
    counts.append(unknown_grades(grade, max_grade).alias("n_unknown"))
    per_group = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *counts,
        *[F.coalesce(_dcg(rank, F.col(grade), k), F.lit(0.0)).alias(f"dcg_at_{k}") for k in cutoffs],
        F.coalesce(F.sum(F.when(is_hit, F.col("hits") / rank)), F.lit(0.0)).alias("precision_sum"),
        F.sum(relevant).alias("n_relevant"),
        F.min(F.when(is_hit, rank)).alias("first_hit"),
    )
    grade_counts = {g: F.col(f"n_{g}") for g in range(1, max_grade + 1)}
    ideals = {k: known(ideal_dcg(grade_counts, k), max_grade) for k in cutoffs}
    return per_group.select(
        *by,
        "n_rows",
        "n_relevant",
        *[f"dcg_at_{k}" for k in cutoffs],
        *[
            F.when(ideals[k] > 0, F.col(f"dcg_at_{k}") / ideals[k]).otherwise(0.0).alias(f"ndcg_at_{k}")
            for k in cutoffs
        ],
        F.when(F.col("n_relevant") > 0, F.col("precision_sum") / F.nullif(F.col("n_relevant"), F.lit(0)))
        .otherwise(0.0)
        .alias("average_precision"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def evaluate_ranking(per_posting: DataFrame) -> DataFrame:
    """Macro-average over postings, with the circularity flag.

    Empty input is an error, raised by the plan itself rather than by a probe.
    """
    summary = per_posting.agg(
        F.avg("ndcg_at_5").alias("ndcg_at_5"),
        F.avg("ndcg_at_10").alias("ndcg_at_10"),
        F.avg("average_precision").alias("mean_average_precision"),
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    checked = F.when(F.col("n_groups") > 0, F.col("n_groups")).otherwise(
        F.raise_error("cannot evaluate an empty set of postings").cast("bigint")
    )
    return summary.withColumn("n_groups", checked).withColumn(
        "circularity_suspected", F.col("ndcg_at_10") > CIRCULARITY_LIMIT
    )


def compare_scorers(evaluations: DataFrame, scorer: str = "scorer", model="model", baseline="baseline") -> DataFrame:
    """One row from a (scorer, metrics) frame: both sides, delta, lift and verdict."""
    metrics = ("ndcg_at_5", "ndcg_at_10", "mean_average_precision", "mean_reciprocal_rank", "n_groups")
    sides = evaluations.agg(
        *[F.max(F.when(F.col(scorer) == model, F.col(m))).alias(f"model_{m}") for m in metrics],
        *[F.max(F.when(F.col(scorer) == baseline, F.col(m))).alias(f"baseline_{m}") for m in metrics],
    )
    delta = F.col("model_ndcg_at_10") - F.col("baseline_ndcg_at_10")
    return sides.select(
        "*",
        delta.alias("ndcg_at_10_delta"),
        F.coalesce(delta / F.nullif(F.col("baseline_ndcg_at_10"), F.lit(0.0)), F.lit(0.0)).alias("ndcg_at_10_lift"),
        (delta >= 0.01).alias("model_beats_baseline"),
    )


def long_scores(df: DataFrame, keys: Sequence[str], scorers: Mapping[str, str]) -> DataFrame:
    """(keys, scorer, score): one row per scorer so that both share one exchange."""
    pairs = [F.struct(F.lit(name).alias("scorer"), F.col(column).alias("score")) for name, column in scorers.items()]
    return df.select(*keys, F.inline(F.array(*pairs)))


def split_consistency(ranked: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """Postings whose ranked rows do not line up with the held-out group sizes."""
    seen = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("ranked_rows"), F.max("rank").alias("last_rank"))
    return seen.join(expected, by, "full_outer").select(
        by,
        F.coalesce("ranked_rows", F.lit(0)).alias("ranked_rows"),
        F.coalesce("group_size", F.lit(0)).alias("group_size"),
        (
            F.col("ranked_rows").eqNullSafe(F.col("group_size")) & F.col("last_rank").eqNullSafe(F.col("group_size"))
        ).alias("consistent"),
    )


def discount(position: int) -> float:
    return 1.0 / math.log2(position + 1)
