"""Additive score explanations, reasons and requirement views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.functions.stats import fixed
from pairrank.operators.features import FEATURE_NAMES, baseline_terms

# Reason selection, strength steps, tolerances.
TOP_REASONS = 5
MIN_SHARE = 0.02
STRONG_SHARE = 0.25
MODERATE_SHARE = 0.10
ADDITIVITY_TOLERANCE = 1e-6
NO_FACTOR = "No individual factor moved this candidate away from the average."


def expected_terms(reference: DataFrame, terms: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: the mean of every additive term over the reference rows."""
    terms = dict(terms or baseline_terms())
    return reference.agg(*[F.avg(term).alias(name) for name, term in terms.items()])


def attribute_additive(
    features: DataFrame, means: DataFrame, keep: Sequence[str], terms: Mapping[str, Column] | None = None
) -> DataFrame:
    """Exact contributions on the raw score: term minus its expected value.

    ``base_value`` is the expected score. The means enter as a scalar subquery (one
    struct computed once), so explaining the pairs is a narrow projection.
    """
    terms = dict(terms or baseline_terms())
    expected = means.select(F.struct(*terms).alias("expected")).scalar()
    items = [
        F.struct(
            F.lit(name).alias("feature"),
            F.lit(position).alias("position"),
            F.col(name).alias("value"),
            (term - F.col("expected")[name]).alias("contribution"),
        )
        for position, (name, term) in enumerate(terms.items())
    ]
    base = F.col("expected")[next(iter(terms))]
    for name in list(terms)[1:]:
        base = base + F.col("expected")[name]
    return features.withColumn("expected", expected).select(
        *keep, base.alias("base_value"), F.array(*items).alias("contributions")
    )


def ranked_contributions(column: str = "contributions") -> Column:
    """All contributions by absolute effect, canonical order on ties.

    ``sort_array`` compares in compiled code; ``array_sort`` would interpret its comparator for every two items.
    """
    keyed = F.transform(
        F.col(column),
        lambda c: F.struct((-F.abs(c["contribution"])).alias("effect"), c["position"].alias("at"), c.alias("item")),
    )
    return F.transform(F.sort_array(keyed), lambda k: k["item"])


def contribution_sum(column: str = "contributions") -> Column:
    return F.aggregate(F.col(column), F.lit(0.0), lambda total, c: total + c["contribution"])


def total_effect(column: str = "contributions") -> Column:
    return F.aggregate(F.col(column), F.lit(0.0), lambda total, c: total + F.abs(c["contribution"]))


def additivity_check(explained: DataFrame, score: str, tolerance: float = ADDITIVITY_TOLERANCE) -> DataFrame:
    total = F.col("base_value") + contribution_sum()
    delta = F.abs(total - F.col(score))
    return explained.select("*", total.alias("sum"), delta.alias("delta"), (delta <= tolerance).alias("holds"))


def describe_value(feature: Column, value: Column) -> Column:
    """Sentence for a (feature, value); unknown is named as unknown."""
    # Sentence templates.
    text = F.lit
    flag = lambda yes, no: F.when(value >= 1.0, text(yes)).otherwise(text(no))
    years_unknown = "Years of experience could not be determined from the CV"
    history_unknown = "No employment history was found in the CV"
    known = {
        "exp_gap": F.concat(
            fixed(F.abs(value), 1),
            F.when(value >= 0, " years above the minimum experience requirement").otherwise(
                " years below the minimum experience requirement"
            ),
        ),
        "exp_ratio": F.concat(text("Experience is "), fixed(value, 1), text(" times the stated minimum")),
        "licence_match": flag("Holds the required security licence", "Does not hold the required security licence"),
        "cert_overlap_ratio": F.concat(
            text("Holds "), fixed(value * 100, 0), text("% of the certifications this role requires")
        ),
        "cert_overlap_count": F.concat(text("Holds "), fixed(value, 0), text(" of the required certifications")),
        "missing_critical_cert": flag(
            "Missing a certification this role treats as mandatory", "Holds every mandatory certification"
        ),
        "shift_match": flag(
            "Available for the shift pattern this role needs", "Not available for the shift pattern this role needs"
        ),
        "site_type_match": flag(
            "Has prior experience at this type of site", "No prior experience at this type of site"
        ),
        "driving_required_match": flag(
            "Meets the driving requirement for this role", "Does not hold a driving licence, which this role requires"
        ),
        "extra_cert_count": F.when(
            value > 0, F.concat(text("Holds "), fixed(value, 0), text(" relevant certifications beyond those required"))
        ).otherwise("No relevant certifications beyond those required"),
        "role_count": F.when(value == 0, "No previous security roles").otherwise(
            F.concat(fixed(value, 0), text(" previous security roles"))
        ),
        "recency_months": F.when(value <= 0, "Currently or very recently employed").otherwise(
            F.concat(text("Most recent role ended around "), fixed(value, 0), text(" months ago"))
        ),
    }
    unknown = {
        "exp_gap": years_unknown,
        "exp_ratio": years_unknown,
        "licence_match": "Security licence status is unknown",
        "cert_overlap_ratio": "Certification coverage is unknown",
        "cert_overlap_count": "Certification count is unknown",
        "missing_critical_cert": "Mandatory certification status is unknown",
        "shift_match": "Shift availability was not stated in the CV",
        "site_type_match": history_unknown,
        "driving_required_match": "Driving licence status was not stated in the CV",
        "extra_cert_count": "No relevant certifications beyond those required",
        "role_count": history_unknown,
        "recency_months": "Date of the most recent role could not be determined",
    }
    sentence = F.concat(feature, text(" = "), F.coalesce(value.cast("string"), text("None")))
    for name in FEATURE_NAMES:
        sentence = F.when(
            feature == name, F.when(value.isNull(), text(unknown[name])).otherwise(known[name])
        ).otherwise(sentence)
    return sentence


def effect_phrase(contribution: Column, share: Column) -> Column:
    strength = F.when(share >= STRONG_SHARE, "strong").when(share >= MODERATE_SHARE, "moderate").otherwise("slight")
    direction = F.when(contribution >= 0, "in favour").otherwise("against")
    return F.concat(F.lit("counted "), strength, F.lit("ly "), direction)


def build_reasons(ranked: Column, total: Column, top_n: int = TOP_REASONS) -> Column:
    """Sentences for the top ``top_n`` contributions, then the marginal ones dropped.

    A plain column for each place, and no function with a lambda above them: Spark interprets such a function and all that stands in it.
    """
    nothing = F.array().cast("array<string>")

    def sentence(place: int) -> Column:
        item = F.get(ranked, F.lit(place))
        share = F.abs(item["contribution"]) / F.nullif(total, F.lit(0.0))
        told = F.concat(describe_value(item["feature"], item["value"]), F.lit(" — "), effect_phrase(item["contribution"], share))
        return F.when(share >= MIN_SHARE, F.array(told)).otherwise(nothing)

    sentences = F.flatten(F.array(*[sentence(p) for p in range(top_n)]))
    return F.when(total == 0, F.array(F.lit(NO_FACTOR))).when(ranked.isNotNull(), sentences)


def global_importance(explained: DataFrame, names: Sequence[str] = FEATURE_NAMES) -> DataFrame:
    """Mean absolute contribution per feature and its share, most important first.

    Twelve averages in one partial aggregation; only then turned into rows.
    """
    means = explained.agg(
        *[F.avg(F.abs(F.col("contributions")[i]["contribution"])).alias(name) for i, name in enumerate(names)]
    )
    rows = [F.struct(F.lit(n).alias("feature"), F.col(n).alias("importance")) for n in names]
    total = F.col(names[0])
    for n in names[1:]:
        total = total + F.col(n)
    return means.select(F.inline(F.transform(F.array(*rows), lambda r: F.struct(
        r["feature"].alias("feature"),
        r["importance"].alias("importance"),
        F.coalesce(r["importance"] / F.nullif(total, F.lit(0.0)), F.lit(0.0)).alias("share"),
    )))).orderBy(F.desc("importance"), "feature")


def contribution_tally(column: str = "contributions") -> list[Column]:
    """Counts in favour, against and neutral, and the widest effect for bar widths."""
    effects = F.transform(F.col(column), lambda c: c["contribution"])
    return [
        F.size(F.filter(effects, lambda e: e > 0)).alias("in_favour"),
        F.size(F.filter(effects, lambda e: e < 0)).alias("against"),
        F.size(F.filter(effects, lambda e: e == 0)).alias("no_effect"),
        F.array_max(F.transform(effects, lambda e: F.abs(e))).alias("widest"),
    ]


def years_from_gap(gap: Column, minimum: Column) -> Column:
    """Years shown, rebuilt from the gap, one decimal, halves upward."""
    return F.floor((gap + minimum) * 10 + 0.5) / 10


def _state(value: Column, met: Column) -> Column:
    return F.when(value.isNull(), "not-stated").when(met, "met").otherwise("unmet")


def requirement_states(gate: str) -> Column:
    """Array of (feature, label, state, detail) for what the posting asked, nothing else.

    What was not asked is left out by ``flatten``; ``array_compact`` would have all items interpreted.
    """
    nothing = F.array().cast("array<struct<feature: string, label: string, state: string, detail: string>>")
    required = F.col("required_certifications")
    gate_asked = F.array_contains(required, gate)
    others = F.size(F.array_remove(required, gate))
    held_others = F.col("cert_overlap_count") - F.when(gate_asked, F.col("licence_match")).otherwise(0.0)
    held_others = F.when(held_others.isNotNull(), F.greatest(F.lit(0.0), held_others))
    minimum = F.col("min_years_experience")
    years = years_from_gap(F.col("exp_gap"), minimum)

    def item(asked, feature, label, state, detail):
        return F.when(
            asked,
            F.array(
                F.struct(
                    F.lit(feature).alias("feature"),
                    (label if isinstance(label, Column) else F.lit(label)).alias("label"),
                    state.alias("state"),
                    detail.cast("string").alias("detail"),
                )
            ),
        ).otherwise(nothing)

    def flag(name):
        return _state(F.col(name), F.col(name) >= 1)

    asked = [
        item(
            minimum > 0,
            "exp_gap",
            "Minimum experience",
            _state(F.col("exp_gap"), F.col("exp_gap") >= 0),
            F.when(
                years.isNull(), F.concat(_plain(minimum), F.lit(" years needed; the CV did not say"))
            ).otherwise(F.concat(_plain(years), F.lit(" years, "), _plain(minimum), F.lit(" needed"))),
        ),
        item(
            gate_asked,
            "licence_match",
            "Security licence",
            flag("licence_match"),
            F.lit("Gates eligibility; its absence is scored separately"),
        ),
        item(
            others > 0,
            "cert_overlap_count",
            F.when(others == 1, "Other required certification").otherwise("Other required certifications"),
            _state(held_others, held_others >= others),
            F.when(
                held_others.isNull(), F.concat(others.cast("string"), F.lit(" asked for; the CV did not say"))
            ).otherwise(F.concat(_plain(held_others), F.lit(" of "), others.cast("string"), F.lit(" held"))),
        ),
        item(
            F.lit(True), "shift_match", "Shift availability", flag("shift_match"),
            F.concat("shift_pattern", F.lit(" shift")),
        ),
        item(
            F.lit(True), "site_type_match", "Site experience", flag("site_type_match"),
            F.concat(F.replace("site_type", F.lit("_"), F.lit(" ")), F.lit(" site")),
        ),
        item(
            F.col("driving_required"), "driving_required_match", "Driving licence", flag("driving_required_match"),
            F.lit(None),
        ),
    ]
    return F.flatten(F.array(*asked))


def _plain(number: Column) -> Column:
    """Shortest text: integers bare, otherwise the decimals there are."""
    whole = number == F.floor(number)
    return F.when(whole, F.floor(number).cast("string")).otherwise(number.cast("string"))


def requirement_summary(column: str = "requirements") -> list[Column]:
    def with_state(state):
        return F.filter(F.col(column), lambda r: r["state"] == state)

    return [
        F.size(column).alias("asked"),
        F.size(with_state("met")).alias("met"),
        F.size(with_state("unmet")).alias("unmet"),
        F.size(with_state("not-stated")).alias("not_stated"),
        F.transform(with_state("met"), lambda r: r["label"]).alias("met_list"),
        F.transform(F.filter(F.col(column), lambda r: r["state"] != "met"), lambda r: r["label"]).alias("outstanding"),
    ]


def requirement_badge(met: Column, asked: Column, not_stated: Column) -> Column:
    base = F.concat(met.cast("string"), F.lit(" of "), asked.cast("string"), F.lit(" requirements met"))
    return F.when(not_stated > 0, F.concat(base, F.lit(" · "), not_stated.cast("string"), F.lit(" not stated"))).otherwise(base)


def format_feature(value: Column) -> Column:
    return F.when(value.isNull(), "not stated").when(value == F.floor(value), fixed(value, 0)).otherwise(fixed(value, 2))


def format_contribution(value: Column) -> Column:
    sign = F.when(value > 0, "+").when(value < 0, "−").otherwise("±")
    return F.concat(sign, fixed(F.abs(value), 4))
