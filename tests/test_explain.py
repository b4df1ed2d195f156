import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairrank.operators import explain as ex
from pairrank.operators import features as ft
from pairrank.operators import training as tr

COLUMNS = "job_id INT, candidate_id INT, grade INT, " + ", ".join(f"{n} DOUBLE" for n in ft.FEATURE_NAMES)


def frame(spark, n_jobs=6, n_items=20, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for j in range(n_jobs):
        for c in range(n_items):
            values = [float(v) for v in rng.integers(0, 4, 12)]
            grade = min(3, int(values[0] / 2 + values[3] / 2))
            for k in range(12):
                if rng.random() < 0.1:
                    values[k] = None
            rows.append((j, j * 100 + c, grade, *values))
    return spark.createDataFrame(rows, COLUMNS)


def explained(spark):
    rows = frame(spark)
    means = ex.expected_terms(rows)
    return ex.attribute_additive(rows.withColumn("score", ft.baseline_score()), means, ["job_id", "candidate_id", "score"])


def test_rule_contributions_add_up(spark):
    checked = ex.additivity_check(explained(spark), "score")
    assert checked.where(~F.col("holds")).count() == 0
    assert all(len(r["contributions"]) == 12 for r in checked.select("contributions").collect())


def test_order_is_by_effect_then_canonical(spark):
    for row in explained(spark).select(ex.ranked_contributions().alias("r")).limit(20).collect():
        keys = [(-abs(c["contribution"]), c["position"]) for c in row["r"]]
        assert keys == sorted(keys)


def contributions(spark, values):
    items = [(n, i, 1.0, float(v)) for i, (n, v) in enumerate(zip(ft.FEATURE_NAMES, values, strict=False))]
    return spark.createDataFrame([(items,)], "contributions ARRAY<STRUCT<feature: STRING, position: INT, value: DOUBLE, contribution: DOUBLE>>")


def reasons(spark, values):
    df = contributions(spark, values)
    return df.select(ex.build_reasons(ex.ranked_contributions(), ex.total_effect()).alias("r")).first()["r"]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_and_requirements_are_compiled(spark):
    """A function with a lambda is interpreted, with all that stands in it."""
    df = spark.createDataFrame([], "ranked ARRAY<STRUCT<feature: STRING, position: INT, value: DOUBLE, contribution: DOUBLE>>, total DOUBLE")
    assert "lambda" not in optimized(df.select(ex.build_reasons(F.col("ranked"), F.col("total"))))
    asked = "required_certifications ARRAY<STRING>, min_years_experience DOUBLE, shift_pattern STRING, site_type STRING, driving_required BOOLEAN"
    df = spark.createDataFrame([], asked + ", " + ", ".join(f"{n} DOUBLE" for n in ft.FEATURE_NAMES))
    assert "lambda" not in optimized(df.select(ex.requirement_states("g")))


def test_more_than_five_reasons_and_none(spark):
    got = reasons(spark, [1, 2, 3, 4, 5, 6, -7])
    assert len(got) == 5 and got[0].endswith("against") and all(g.endswith("in favour") for g in got[1:])
    assert reasons(spark, [0, 0]) == [ex.NO_FACTOR]
    df = spark.createDataFrame([(None, None)], "ranked ARRAY<STRUCT<feature: STRING, position: INT, value: DOUBLE, contribution: DOUBLE>>, total DOUBLE")
    assert df.select(ex.build_reasons(F.col("ranked"), F.col("total")).alias("r")).first()["r"] is None


def test_reasons_take_five_then_drop_marginal(spark):
    got = reasons(spark, [10, -5, 3, 0.1, 0.1, 0.1])
    assert len(got) == 3
    assert got[0] == "1.0 years above the minimum experience requirement — counted strongly in favour"
    assert got[1].endswith("counted strongly against")
    assert got[2].endswith("counted moderately in favour")
    assert len(reasons(spark, [1] * 8)) == 5


def test_no_effect_says_so(spark):
    assert reasons(spark, [0] * 12) == [ex.NO_FACTOR]


def test_no_probability_words(spark):
    rows = [(n, v) for n in ft.FEATURE_NAMES for v in (None, -1.0, 0.0, 0.25, 1.0, 3.0)]
    told = spark.createDataFrame(rows, "f STRING, v DOUBLE").select(ex.describe_value(F.col("f"), F.col("v")).alias("s")).collect()
    for row in told:
        assert row["s"] is not None
        for word in ("probab", "likely", "confidence", "chance"):
            assert word not in row["s"].lower()


def test_half_even_numbers(spark):
    df = spark.createDataFrame([("exp_gap", 0.25), ("exp_gap", -0.35), ("other", None)], "f STRING, v DOUBLE")
    got = [r["s"] for r in df.select(ex.describe_value(F.col("f"), F.col("v")).alias("s")).collect()]
    assert got == ["0.2 years above the minimum experience requirement", "0.3 years below the minimum experience requirement" if f"{0.35:.1f}" == "0.3" else "0.4 years below the minimum experience requirement", "other = None"]


REQUIRED = "required_certifications ARRAY<STRING>, min_years_experience DOUBLE, shift_pattern STRING, site_type STRING, driving_required BOOLEAN, exp_gap DOUBLE, licence_match DOUBLE, cert_overlap_count DOUBLE, shift_match DOUBLE, site_type_match DOUBLE, driving_required_match DOUBLE"


def requirements(spark, *row):
    df = spark.createDataFrame([row], REQUIRED).select(ex.requirement_states("g").alias("requirements"))
    return df, {r["label"]: (r["state"], r["detail"]) for r in df.first()["requirements"]}


def test_requirements_only_what_was_asked(spark):
    _, got = requirements(spark, [], 0.0, "night", "high_street", False, None, 1.0, 0.0, None, 0.0, 1.0)
    assert got == {"Shift availability": ("not-stated", "night shift"), "Site experience": ("unmet", "high street site")}


def test_requirements_full(spark):
    df, got = requirements(spark, ["g", "a", "b"], 3.0, "day", "retail", True, 2.0, 1.0, 2.0, 1.0, None, None)
    assert got == {
        "Minimum experience": ("met", "5 years, 3 needed"),
        "Security licence": ("met", "Gates eligibility; its absence is scored separately"),
        "Other required certifications": ("unmet", "1 of 2 held"),
        "Shift availability": ("met", "day shift"),
        "Site experience": ("not-stated", "retail site"),
        "Driving licence": ("not-stated", None),
    }
    row = df.select(*ex.requirement_summary()).select("*", ex.requirement_badge(F.col("met"), F.col("asked"), F.col("not_stated")).alias("badge")).first()
    assert (row["asked"], row["met"], row["unmet"], row["not_stated"]) == (6, 3, 1, 2)
    assert row["badge"] == "3 of 6 requirements met · 2 not stated"


def gradients_by_hand(rows, scale):
    """All pairs of one posting, straight from the formula."""
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(order)}
    ideal = sorted((r[2] for r in rows), reverse=True)[:10]
    idcg = sum((2**g - 1) / math.log2(i + 2) for i, g in enumerate(ideal))
    out = {r[0]: [0.0, 0.0] for r in rows}
    for a, b in itertools.permutations(rows, 2):
        if a[2] <= b[2] or min(rank[a[0]], rank[b[0]]) > 10 or idcg == 0:
            continue
        delta = abs((2 ** a[2] - 2 ** b[2]) * (1 / math.log2(rank[a[0]] + 1) - 1 / math.log2(rank[b[0]] + 1))) / idcg
        rho = 1 / (1 + math.exp((a[1] - b[1]) / scale))
        out[a[0]][0] += delta * rho
        out[b[0]][0] -= delta * rho
        for side in (a, b):
            out[side[0]][1] += delta * rho * (1 - rho)
    return out


@pytest.mark.parametrize("max_group_rows", [1_000_000, 12])
def test_gradients_equal_all_pairs(spark, max_group_rows):
    rng = np.random.default_rng(4)
    groups = {0: 40, 1: 7, 2: 15}
    rows = [(j, int(i), float(rng.integers(0, 9)), int(rng.integers(0, 4))) for j, n in groups.items() for i in range(n)]
    rows += [(3, i, 1.0, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "job_id INT, item INT, score DOUBLE, grade INT")
    got = tr.lambda_gradients(df, "job_id", "score", ["item"], scale=2.0, max_group_rows=max_group_rows).collect()
    assert len(got) == len(rows)
    want = {j: gradients_by_hand([r[1:] for r in rows if r[0] == j], 2.0) for j in {r[0] for r in rows}}
    for r in got:
        g, h = want[r["job_id"]][r["item"]]
        assert r["gradient"] == pytest.approx(g, abs=1e-9)
        assert r["hessian"] == pytest.approx(h, abs=1e-9)
