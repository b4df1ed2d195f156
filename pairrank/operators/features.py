"""Pair construction and the twelve match features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The feature contract, in canonical order, and the tail caps.
FEATURE_NAMES = (
    "exp_gap",
    "exp_ratio",
    "licence_match",
    "cert_overlap_ratio",
    "cert_overlap_count",
    "missing_critical_cert",
    "shift_match",
    "site_type_match",
    "driving_required_match",
    "extra_cert_count",
    "role_count",
    "recency_months",
)
MAX_EXPERIENCE_RATIO = 5.0
MAX_ROLE_COUNT = 6
MAX_RECENCY_MONTHS = 240

PROFILE_COLUMNS = (
    "years_experience",
    "certifications",
    "driving_licence",
    "shift_availability",
    "site_experience",
    "previous_role_count",
    "months_since_last_role",
)
POSTING_COLUMNS = (
    "required_certifications",
    "min_years_experience",
    "shift_pattern",
    "site_type",
    "driving_required",
)


def pair_join(pairs: DataFrame, profiles: DataFrame, postings: DataFrame) -> DataFrame:
    """Labelled pairs with both sides attached; ids without a match drop out.

    No broadcast is forced: Catalyst broadcasts a side whose measured size allows
    it and otherwise shuffles, splitting skewed keys at run time.
    """
    return pairs.join(profiles, "candidate_id").join(postings, "job_id")


def pair_request(candidates: DataFrame, postings: DataFrame, request: str) -> DataFrame:
    """Every candidate of a request against the request's one posting."""
    return candidates.join(postings, request)


def _number(flag: Column) -> Column:
    return flag.cast("double")


def required_critical(critical: Sequence[str]) -> Column:
    return F.array_intersect("required_certifications", F.array(*[F.lit(c) for c in critical]))


def feature_columns(gate: str, critical: Sequence[str]) -> dict[str, Column]:
    """The twelve features, keyed by name. Unknown stays null throughout."""
    required, held = F.col("required_certifications"), F.col("certifications")
    years, minimum = F.col("years_experience"), F.col("min_years_experience")
    overlap = F.size(F.array_intersect(required, held))
    roles, months = F.col("previous_role_count"), F.col("months_since_last_role")
    ratio = years / F.greatest(minimum, F.lit(1.0))
    return {
        "exp_gap": years - minimum,
        # least() skips nulls, so the null case is kept out of it.
        "exp_ratio": F.when(years.isNotNull(), F.least(ratio, F.lit(MAX_EXPERIENCE_RATIO))),
        "licence_match": F.when(
            F.array_contains(required, gate), _number(F.array_contains(held, gate))
        ).otherwise(1.0),
        "cert_overlap_ratio": F.coalesce(overlap / F.nullif(F.size(required), F.lit(0)), F.lit(1.0)),
        "cert_overlap_count": _number(overlap),
        "missing_critical_cert": _number(F.size(F.array_except(required_critical(critical), held)) > 0),
        "shift_match": F.when(
            F.size("shift_availability") > 0, _number(F.array_contains("shift_availability", F.col("shift_pattern")))
        ),
        "site_type_match": F.when(
            roles.isNotNull(), _number(F.array_contains("site_experience", F.col("site_type")))
        ),
        "driving_required_match": F.when(~F.col("driving_required"), 1.0).otherwise(_number(F.col("driving_licence"))),
        "extra_cert_count": _number(F.size(F.array_except(held, required))),
        "role_count": _number(F.when(roles.isNotNull(), F.least(roles, F.lit(MAX_ROLE_COUNT)))),
        "recency_months": _number(F.when(months.isNotNull(), F.least(months, F.lit(MAX_RECENCY_MONTHS)))),
    }


def build_features(paired: DataFrame, gate: str, critical: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """All twelve features in one narrow projection, guarded against protected names."""
    from pairrank.operators.guards import assert_clean

    assert_clean([*PROFILE_COLUMNS, *POSTING_COLUMNS, *FEATURE_NAMES])
    columns = feature_columns(gate, critical)
    return paired.select(*keep, *[columns[name].alias(name) for name in FEATURE_NAMES])


def check_contract(names: Sequence[str]) -> None:
    """Raise unless ``names`` is the contract, in order."""
    if tuple(names) == FEATURE_NAMES:
        return
    if set(names) == set(FEATURE_NAMES):
        raise ValueError(f"feature order differs: {list(names)}")
    raise ValueError(
        f"feature set differs: missing={sorted(set(FEATURE_NAMES) - set(names))} "
        f"unexpected={sorted(set(names) - set(FEATURE_NAMES))}"
    )


def to_vector(features: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Canonical positional vector; nulls stay null. Missing or unexpected columns are an error."""
    names = [c for c in features.columns if c not in keep]
    if set(names) != set(FEATURE_NAMES):
        check_contract(names)
    return features.select(*keep, F.array(*FEATURE_NAMES).alias("vector"))


def ml_columns() -> dict[str, Column]:
    """Value-or-zero and is-missing pairs for learners that reject nulls."""
    columns: dict[str, Column] = {}
    for name in FEATURE_NAMES:
        columns[name] = F.coalesce(F.col(name), F.lit(0.0))
        columns[f"{name}_missing"] = F.col(name).isNull().cast("double")
    return columns


def contract_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Compare two (position, name) lists: identical, reordered, or different with both sides.

    Two counting aggregates over one full-outer join by name; no list is collected
    beyond the names that differ.
    """
    both = stored.select("name", F.col("position").alias("stored_at")).join(
        current.select("name", F.col("position").alias("current_at")), "name", "full_outer"
    )
    return both.agg(
        F.when(F.count_if(F.col("stored_at").isNull() | F.col("current_at").isNull()) > 0, "set differs")
        .when(F.count_if(F.col("stored_at") != F.col("current_at")) > 0, "order differs")
        .otherwise("identical")
        .alias("status"),
        F.array_sort(F.collect_list(F.when(F.col("current_at").isNull(), F.col("name")))).alias("only_stored"),
        F.array_sort(F.collect_list(F.when(F.col("stored_at").isNull(), F.col("name")))).alias("only_current"),
    )


def baseline_terms() -> dict[str, Column]:
    """Additive terms of the rule scorer, keyed by the feature they come from."""
    terms = {name: F.lit(0.0) for name in FEATURE_NAMES}
    # Hand-set weights.
    terms["cert_overlap_ratio"] = 2.0 * F.coalesce("cert_overlap_ratio", F.lit(0.0))
    terms["exp_gap"] = F.when(F.col("exp_gap") >= 0, 1.0).otherwise(0.0)
    terms["shift_match"] = 0.5 * F.coalesce("shift_match", F.lit(0.0))
    terms["missing_critical_cert"] = -1.5 * F.coalesce("missing_critical_cert", F.lit(0.0))
    return terms


def baseline_score() -> Column:
    terms = baseline_terms()
    return terms["cert_overlap_ratio"] + terms["exp_gap"] + terms["shift_match"] + terms["missing_critical_cert"]


# Weights and interactions of the weak-label rule.
FIT_WEIGHTS = {"cert": 0.30, "exp": 0.20, "shift": 0.15, "site": 0.08, "driving": 0.07, "latent_a": 0.12, "latent_b": 0.08}
MISSING_GATE_FACTOR = 0.25
GATE_AND_YEARS_BONUS = 0.10
SHIFT_PENALTY_CRITICAL = 0.12
SHIFT_PENALTY = 0.04
GRADE_LADDER = ((0.82, 3), (0.68, 2), (0.50, 1))
NOISE_RATE = 0.12


def fit_score(gate: str, critical_sites: Sequence[str], latent_a: str, latent_b: str) -> Column:
    """Weak-label score of a joined pair: weighted sum, then gate, bonus, penalty, clamp."""
    required, held = F.col("required_certifications"), F.col("certifications")
    years, minimum = F.coalesce("years_experience", F.lit(0.0)), F.col("min_years_experience")
    coverage = F.coalesce(F.size(F.array_intersect(required, held)) / F.nullif(F.size(required), F.lit(0)), F.lit(1.0))
    seniority = F.least(years / F.greatest(minimum, F.lit(1.0)), F.lit(1.5)) / 1.5
    shift_ok = F.array_contains("shift_availability", F.col("shift_pattern"))
    site_ok = F.array_contains("site_experience", F.col("site_type"))
    drives = ~F.col("driving_required") | F.coalesce("driving_licence", F.lit(False))
    has_gate = F.array_contains(held, gate)
    w = FIT_WEIGHTS
    total = (
        w["cert"] * coverage
        + w["exp"] * seniority
        + w["shift"] * _number(shift_ok)
        + w["site"] * _number(site_ok)
        + w["driving"] * _number(drives)
        + w["latent_a"] * F.col(latent_a)
        + w["latent_b"] * F.col(latent_b)
    )
    gated = F.when(F.array_contains(required, gate) & ~has_gate, total * MISSING_GATE_FACTOR).otherwise(total)
    with_bonus = gated + F.when(has_gate & (years >= minimum), GATE_AND_YEARS_BONUS).otherwise(0.0)
    penalty = F.when(shift_ok, 0.0).otherwise(
        F.when(F.col("site_type").isin(*critical_sites), SHIFT_PENALTY_CRITICAL).otherwise(SHIFT_PENALTY)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), with_bonus - penalty))


def to_grade(score: Column, ladder: Sequence[tuple[float, int]] = GRADE_LADDER) -> Column:
    steps = F.when(score >= ladder[0][0], ladder[0][1])
    for threshold, grade in ladder[1:]:
        steps = steps.when(score >= threshold, grade)
    return steps.otherwise(0)


def hash_unit(seed: int, *keys: str | Column) -> Column:
    """Replayable uniform number in [0, 1) from a seed and row keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)


def noisy_grade(grade: Column, seed: int, keys: Sequence[str], rate: float = NOISE_RATE) -> Column:
    """Shift a grade by one with the given probability, clamped to 0..3."""
    shifted = grade + F.when(hash_unit(seed, F.lit("sign"), *keys) < 0.5, -1).otherwise(1)
    return F.when(hash_unit(seed, F.lit("hit"), *keys) < rate, F.greatest(F.lit(0), F.least(F.lit(3), shifted))).otherwise(grade)


def sample_group(pairs: DataFrame, by: str, ids: Sequence[str], seed: int, low: int = 40, high: int = 80) -> DataFrame:
    """Between ``low`` and ``high`` rows per group without replacement, replayable.

    The literal upper limit is applied map-side before the exchange; the group's
    own limit trims what is left.
    """
    from pyspark.sql import Window

    drawn = pairs.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), by, *ids)))
    order = Window.partitionBy(by).orderBy("draw", *ids)
    limited = drawn.withColumn("draw_rank", F.row_number().over(order)).where(F.col("draw_rank") <= high)
    size = F.lit(low) + F.floor(hash_unit(seed, F.lit("size"), by) * (high - low + 1)).cast("int")
    return limited.where(F.col("draw_rank") <= size).drop("draw", "draw_rank")


def group_split(postings: DataFrame, by: str, seed: int, valid_fraction: float = 0.25) -> DataFrame:
    """Assign whole groups to train or valid: exactly ``int(n * (1 - f))`` train.

    Groups are ordered by a seeded md5. The first three hex digits cut that order
    into 4,096 equal slices, so the exact rank is a small prefix sum plus a rank
    inside a slice; no task ever sorts all groups.
    """
    from pyspark.sql import Window

    keyed = postings.select(by).distinct().withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), by)))
    keyed = keyed.withColumn("slice", F.substring("draw", 1, 3))
    counts = keyed.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    prefix = counts.select(
        "slice",
        F.coalesce(
            F.sum("n").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    total = counts.agg(F.sum("n").alias("n")).scalar()
    place = F.row_number().over(Window.partitionBy("slice").orderBy("draw", by)) + F.col("before")
    train_until = F.floor(total * F.lit(1.0 - valid_fraction))
    return keyed.join(prefix, "slice").select(
        by, F.when(place <= train_until, "train").otherwise("valid").alias("split")
    )


def group_sizes(pairs: DataFrame, by: str) -> DataFrame:
    return pairs.groupBy(by).agg(F.count(F.lit(1)).alias("group_size"))


def proxy_report(importance: DataFrame, register: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Watched features with what they may leak and the mitigation, beside their importance."""
    rows = [F.struct(F.lit(f).alias("feature"), F.lit(a).alias("leaks"), F.lit(b).alias("mitigation")) for f, (a, b) in register.items()]
    leaks = F.filter(F.array(*rows), lambda r: r["feature"] == F.col("feature"))
    return importance.withColumn("proxy", F.get(leaks, F.lit(0))).select(
        *importance.columns, F.col("proxy").isNotNull().alias("watched"), "proxy.leaks", "proxy.mitigation"
    )
