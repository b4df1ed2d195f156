"""Group outcomes of a ranking and the audit built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.functions.stats import bonferroni, comparisons, fixed, position_exposure, two_proportion_p

# Default thresholds.
TOP_K = 10
QUALIFIED_GRADE = 2
MIN_GROUP_SIZE = 30
FOUR_FIFTHS = 0.80
MAX_GAP = 0.10
SIGNIFICANCE = 0.05


def attach_groups(ranked: DataFrame, groups: DataFrame, on: Sequence[str]) -> DataFrame:
    """Ranked rows with their group values.

    Rows without a record drop out, but ranks were taken over the full list, so
    the positions of the others do not move. The join side is left to Catalyst:
    broadcast when its size allows, else a shuffle join with skew handling.
    """
    return ranked.join(groups, list(on), "inner")


def long_attributes(df: DataFrame, attributes: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """(attribute, group) rows so that all attributes share one scan and aggregation."""
    pairs = [F.struct(F.lit(n).alias("attribute"), F.col(c).cast("string").alias("group")) for n, c in attributes.items()]
    return df.select(*keep, F.inline(F.array(*pairs))).where(F.col("group").isNotNull())


def group_tallies(rows: DataFrame, keys: Sequence[str] = ("attribute", "group"), k: int = TOP_K) -> DataFrame:
    """Additive counts per group; partial aggregation leaves a few rows per task."""
    top = F.col("rank") <= k
    qualified = F.col("grade") >= QUALIFIED_GRADE
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_appearances"),
        F.count_if(top).alias("n_in_top_k"),
        F.count_if(qualified).alias("n_qualified"),
        F.count_if(qualified & top).alias("n_qualified_in_top_k"),
        F.sum(position_exposure(F.col("rank"))).alias("exposure_sum"),
    )


def group_outcomes(tallies: DataFrame) -> DataFrame:
    none_as_null = F.nullif(F.col("n_qualified"), F.lit(0))
    return tallies.select(
        *[c for c in tallies.columns if c != "exposure_sum"],
        (F.col("n_in_top_k") / F.col("n_appearances")).alias("selection_rate"),
        (F.col("n_qualified_in_top_k") / none_as_null).alias("qualified_selection_rate"),
        (F.col("exposure_sum") / F.col("n_appearances")).alias("mean_exposure"),
    )


def split_small(outcomes: DataFrame, min_group_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Flag groups too small for a rate to mean anything."""
    return outcomes.withColumn("suppressed", F.col("n_appearances") < min_group_size)


def _lowest(rate: Column, *payload: str) -> Column:
    """Record of the lowest rate; the first group name wins a tie."""
    return F.min(F.when(rate.isNotNull(), F.struct(rate.alias("rate"), F.col("group").alias("group"), *payload)))


def _highest(rate: Column, *payload: str) -> Column:
    return F.min(
        F.when(rate.isNotNull(), F.struct((-rate).alias("neg_rate"), F.col("group").alias("group"), *payload))
    )


def audit_attributes(
    outcomes: DataFrame,
    min_group_size: int = MIN_GROUP_SIZE,
    four_fifths: float = FOUR_FIFTHS,
    max_gap: float = MAX_GAP,
) -> DataFrame:
    """Every ratio, gap, test and finding: one row per attribute.

    Works on the outcome table (one row per group), so nothing here grows with
    the ranked data.
    """
    shown = split_small(outcomes, min_group_size)
    visible = ~F.col("suppressed")
    rate = F.when(visible, F.col("selection_rate"))
    qualified = F.when(visible, F.col("qualified_selection_rate"))
    exposure = F.when(visible, F.col("mean_exposure"))
    base = shown.groupBy("attribute").agg(
        F.count_if(visible).cast("int").alias("n_groups"),
        F.array_sort(F.collect_set(F.when(F.col("suppressed"), F.col("group")))).alias("suppressed_groups"),
        (F.min(rate) / F.nullif(F.max(rate), F.lit(0.0))).alias("adverse_impact_ratio"),
        (F.max(rate) - F.min(rate)).alias("demographic_parity_gap"),
        (F.max(qualified) - F.min(qualified)).alias("equal_opportunity_gap"),
        (F.min(exposure) / F.nullif(F.max(exposure), F.lit(0.0))).alias("exposure_ratio"),
        _lowest(rate, "n_in_top_k", "n_appearances").alias("low"),
        _highest(rate, "n_in_top_k", "n_appearances").alias("high"),
        _lowest(qualified, "n_qualified_in_top_k", "n_qualified").alias("q_low"),
        _highest(qualified, "n_qualified_in_top_k", "n_qualified").alias("q_high"),
        F.count_if(qualified.isNotNull()).alias("n_with_qualified"),
        F.min(F.when(visible, F.col("n_appearances"))).alias("smallest_group"),
    )
    comparable = F.col("n_groups") >= 2
    tested = base.select(
        "*",
        F.when(
            comparable,
            two_proportion_p(
                F.col("low.n_in_top_k"), F.col("low.n_appearances"), F.col("high.n_in_top_k"), F.col("high.n_appearances")
            ),
        ).alias("selection_p_value"),
        F.when(
            comparable & (F.col("n_with_qualified") >= 2),
            two_proportion_p(
                F.col("q_low.n_qualified_in_top_k"),
                F.col("q_low.n_qualified"),
                F.col("q_high.n_qualified_in_top_k"),
                F.col("q_high.n_qualified"),
            ),
        ).alias("qualified_p_value"),
        F.when(comparable, bonferroni(F.col("n_groups"), SIGNIFICANCE))
        .otherwise(F.lit(SIGNIFICANCE))
        .alias("significance_threshold"),
        F.when(comparable, comparisons(F.col("n_groups"))).otherwise(F.lit(1)).alias("n_comparisons"),
    )
    failures, notes = _findings(min_group_size, four_fifths, max_gap)
    judged = tested.withColumn("failures", failures).withColumn("inconclusive", notes)
    return judged.select(
        "attribute",
        "n_groups",
        "suppressed_groups",
        "adverse_impact_ratio",
        "demographic_parity_gap",
        "equal_opportunity_gap",
        "exposure_ratio",
        F.col("low.group").alias("lowest_group"),
        F.col("high.group").alias("highest_group"),
        "selection_p_value",
        "qualified_p_value",
        "significance_threshold",
        "n_comparisons",
        (F.size("failures") == 0).alias("passes"),
        "failures",
        "inconclusive",
    )


def _findings(min_group_size: int, four_fifths: float, max_gap: float) -> tuple[Column, Column]:
    """Failure and inconclusive message arrays."""
    threshold = F.col("significance_threshold")
    attribute = F.col("attribute")
    comparable = F.col("n_groups") >= 2

    # (breach, message, p-value) of the tested findings, in reporting order.
    tested = [
        (
            F.col("adverse_impact_ratio") < four_fifths,
            F.concat(
                attribute,
                F.lit(": adverse impact ratio "),
                fixed(F.col("adverse_impact_ratio"), 3),
                F.lit(f" is below the four-fifths threshold of {four_fifths:.2f}"),
            ),
            F.col("selection_p_value"),
        ),
        (
            F.col("demographic_parity_gap") > max_gap,
            F.concat(
                attribute,
                F.lit(": demographic parity gap "),
                fixed(F.col("demographic_parity_gap"), 3),
                F.lit(f" exceeds {max_gap:.2f}"),
            ),
            F.col("selection_p_value"),
        ),
        (
            F.col("equal_opportunity_gap") > max_gap,
            F.concat(
                attribute,
                F.lit(": equal opportunity gap "),
                fixed(F.col("equal_opportunity_gap"), 3),
                F.lit(
                    f" exceeds {max_gap:.2f} — qualified candidates are being shortlisted at materially different rates"
                ),
            ),
            F.col("qualified_p_value"),
        ),
    ]
    failed, noted = [], []
    for breach, message, p_value in tested:
        significant = F.coalesce(p_value < threshold, F.lit(False))
        failed.append(
            F.when(
                comparable & breach & significant,
                F.concat(message, F.lit(" (p="), fixed(p_value, 4), F.lit(" < "), fixed(threshold, 4), F.lit(")")),
            )
        )
        evidence = F.coalesce(F.concat(F.lit("p="), fixed(p_value, 4)), F.lit("test undefined"))
        noted.append(
            F.when(
                comparable & breach & ~significant,
                F.concat(
                    message,
                    F.lit(" — but not distinguishable from noise once corrected for "),
                    F.col("n_comparisons").cast("string"),
                    F.lit(" possible group comparisons ("),
                    evidence,
                    F.lit(", threshold "),
                    fixed(threshold, 4),
                    F.lit("); smallest group n="),
                    F.col("smallest_group").cast("string"),
                ),
            )
        )
    untested = F.when(
        comparable & (F.col("exposure_ratio") < four_fifths),
        F.concat(
            attribute,
            F.lit(": exposure ratio "),
            fixed(F.col("exposure_ratio"), 3),
            F.lit(
                f" is below {four_fifths:.2f} — one group is admitted to the shortlist but placed consistently lower "
                "within it (not significance-tested)"
            ),
        ),
    )
    single = F.when(
        ~comparable,
        F.concat(
            attribute,
            F.lit(
                f": fewer than two groups met the minimum size of {min_group_size}; no comparison was possible"
            ),
        ),
    )
    return F.array_compact(F.array(single, *failed, untested)), F.array_compact(F.array(*noted))


def audit_report(audits: DataFrame, ranked: DataFrame, posting: str, attribute_order: Sequence[str]) -> DataFrame:
    """One row: overall verdict, flattened findings and the extent of the data."""
    order = F.array_position(F.array(*[F.lit(a) for a in attribute_order]), F.col("attribute"))
    verdict = audits.agg(
        F.bool_and("passes").alias("passes"),
        F.array_sort(F.collect_list(F.struct(order.alias("at"), "failures", "inconclusive"))).alias("found"),
    )
    # Distinct postings first, so the exact count merges map-side.
    extent = ranked.groupBy(posting).agg(F.count(F.lit(1)).alias("rows")).agg(
        F.count(F.lit(1)).alias("n_postings"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows")
    )
    failures = F.flatten(F.col("found.failures"))
    notes = F.flatten(F.col("found.inconclusive"))
    return verdict.withColumn("extent", extent.select(F.struct("n_postings", "n_rows")).scalar()).select(
        "passes",
        F.when(F.size(failures) > 0, "fail").when(F.size(notes) > 0, "inconclusive").otherwise("pass").alias("state"),
        failures.alias("failures"),
        notes.alias("inconclusive"),
        "extent.n_postings",
        "extent.n_rows",
    )


def conditional_rate_by_group(rows: DataFrame, group: str, flag: Column, domain: DataFrame) -> DataFrame:
    """Rate of a flag per group over the closed domain, 0.0 where nothing maps there."""
    rates = rows.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_flagged")
    )
    return domain.join(rates, group, "left").select(
        group,
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"),
        F.coalesce(F.col("n_flagged") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias("rate"),
    )


def rate_gap(rates: DataFrame, expected_biased: bool, small: float = 0.15, large: float = 0.10) -> DataFrame:
    """Spread of the rates and whether it contradicts what was expected."""
    gap = rates.agg((F.max("rate") - F.min("rate")).alias("gap"))
    warning = (
        F.when(F.col("gap") < small, "expected gap is small")
        if expected_biased
        else F.when(F.col("gap") > large, "unexpected gap")
    )
    return gap.withColumn("warning", warning)
