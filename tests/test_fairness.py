import math

import pytest
from pyspark.sql import functions as F

from pairrank.functions.stats import erfc
from pairrank.operators import fairness as fr

# Recorded group counts of a published audit and what they determine.
GOLDEN = [
    ("gender", "female", 1275, 214, 428, 191, 0.23912699158019346),
    ("gender", "male", 1766, 286, 648, 264, 0.24338017029568967),
    ("age_band", "25_34", 893, 153, 311, 138, 0.23976635046573536),
    ("age_band", "35_44", 839, 140, 283, 123, 0.24047424378795731),
    ("age_band", "45_54", 532, 101, 209, 93, 0.2550569008849975),
    ("age_band", "55_plus", 319, 38, 106, 37, 0.2315234482681349),
    ("age_band", "under_25", 458, 68, 167, 64, 0.23860437169123405),
    ("nationality", "group_a", 1696, 278, 593, 255, 0.23948465957334183),
    ("nationality", "group_b", 892, 145, 319, 130, 0.24330534191279307),
    ("nationality", "group_c", 453, 77, 164, 70, 0.24614116420383217),
]
EXPECTED = {
    "gender": (0.9648765360231157, 0.005895232385139781, 0.03885427483558329, 0.9825245470478187, 0.6651709378516926, 0.2066942419038484, 0.05),
    "age_band": (0.6274558490331792, 0.07072736700685885, 0.09591947278143903, 0.9077325391502596, 0.006896157587032595, 0.1022758025709791, 0.005),
    "nationality": (0.9563362646322286, 0.0074218711331531795, 0.02249335243462125, 0.972956556649021, 0.7289451164507406, 0.5118875040842128, 0.05 / 3),
}
TALLIES = "attribute STRING, `group` STRING, n_appearances BIGINT, n_in_top_k BIGINT, n_qualified BIGINT, n_qualified_in_top_k BIGINT, mean_exposure DOUBLE"


def outcomes(spark, rows):
    df = spark.createDataFrame(rows, TALLIES)
    return fr.group_outcomes(df.withColumn("exposure_sum", F.col("mean_exposure") * F.col("n_appearances")).drop("mean_exposure"))


def test_recorded_audit_is_reproduced(spark):
    for row in fr.audit_attributes(outcomes(spark, GOLDEN)).collect():
        want = EXPECTED[row["attribute"]]
        got = tuple(row[c] for c in ("adverse_impact_ratio", "demographic_parity_gap", "equal_opportunity_gap", "exposure_ratio", "selection_p_value", "qualified_p_value", "significance_threshold"))
        assert got == pytest.approx(want, rel=1e-12)
        assert row["passes"]
        assert row["failures"] == []
        if row["attribute"] == "age_band":
            assert row["n_comparisons"] == 10
            assert row["inconclusive"] == [
                "age_band: adverse impact ratio 0.627 is below the four-fifths threshold of 0.80 — but not distinguishable "
                "from noise once corrected for 10 possible group comparisons (p=0.0069, threshold 0.0050); smallest group n=319"
            ]
        else:
            assert row["inconclusive"] == []


def ranked(spark, postings):
    """postings: list of ordered (item, grade)."""
    rows = [(j, item, i + 1, grade) for j, order in enumerate(postings) for i, (item, grade) in enumerate(order)]
    return spark.createDataFrame(rows, "job_id INT, item STRING, rank INT, grade INT")


def audit(spark, postings, group_of, **options):
    groups = spark.createDataFrame(list(group_of.items()), "item STRING, value STRING")
    rows = fr.attach_groups(ranked(spark, postings), groups, ["item"])
    long = fr.long_attributes(rows, {"attr": "value"}, ["rank", "grade"])
    return fr.audit_attributes(fr.group_outcomes(fr.group_tallies(long)), **options)


def test_equal_selection_with_lower_placement_fails_on_exposure(spark):
    order = [(f"a{i}", 2) for i in range(5)] + [(f"b{i}", 2) for i in range(5)]
    row = audit(spark, [order] * 20, {f"{g}{i}": g.upper() for g in "ab" for i in range(5)}).first()
    assert row["adverse_impact_ratio"] == 1.0
    assert row["demographic_parity_gap"] == 0.0
    assert row["exposure_ratio"] < 0.8
    assert not row["passes"]


def test_four_fifths_breach_is_a_failure(spark):
    order = [(f"a{i}", 2) for i in range(10)] + [(f"b{i}", 2) for i in range(10)]
    row = audit(spark, [order] * 20, {f"{g}{i}": g for g in "ab" for i in range(10)}).first()
    assert row["adverse_impact_ratio"] == 0.0
    assert any("four-fifths" in f for f in row["failures"])


def test_small_group_is_suppressed_and_one_group_never_passes(spark):
    order = [("r", 2)] + [(f"a{i}", 2) for i in range(40)]
    row = audit(spark, [order], {"r": "rare", **{f"a{i}": "a" for i in range(40)}}).first()
    assert row["suppressed_groups"] == ["rare"]
    assert not row["passes"]
    assert row["selection_p_value"] is None
    assert row["significance_threshold"] == 0.05
    assert row["n_comparisons"] == 1
    assert "fewer than two groups" in row["failures"][0]


def test_unmapped_rows_keep_the_positions_of_the_others(spark):
    order = [(f"x{i}", 1) for i in range(10)] + [(f"m{i}", 1) for i in range(40)]
    groups = spark.createDataFrame([(f"m{i}", "m") for i in range(40)], "item STRING, value STRING")
    rows = fr.attach_groups(ranked(spark, [order] * 4), groups, ["item"])
    tally = fr.group_tallies(fr.long_attributes(rows, {"attr": "value"}, ["rank", "grade"])).first()
    assert tally["n_appearances"] == 160
    assert tally["n_in_top_k"] == 0


def test_no_qualified_candidates_leaves_the_gap_unknown(spark):
    order = [(f"{g}{i}", 0) for i in range(20) for g in "ab"]
    row = audit(spark, [order] * 2, {f"{g}{i}": g for g in "ab" for i in range(20)}).first()
    assert row["equal_opportunity_gap"] is None
    assert row["qualified_p_value"] is None


@pytest.mark.parametrize("x", [0.0, 1e-3, 0.5, 1.0, 2.0, 2.499, 2.5, 3.0, 5.0, 8.0, 20.0])
def test_normal_tail(spark, x):
    value = spark.range(1).select(erfc(F.lit(x)).alias("v")).first()["v"]
    assert value == pytest.approx(math.erfc(x), rel=1e-9, abs=1e-15)


def test_report_states(spark):
    audits = fr.audit_attributes(outcomes(spark, GOLDEN))
    spine = spark.range(3041).select((F.col("id") % 50).alias("job_id"))
    row = fr.audit_report(audits, spine, "job_id", ["gender", "age_band", "nationality"]).first()
    assert (row["passes"], row["state"], row["n_postings"], row["n_rows"]) == (True, "inconclusive", 50, 3041)


def test_rate_gap_warnings(spark):
    rates = spark.createDataFrame([("f", 10, 5, 0.5), ("m", 10, 6, 0.62)], "g STRING, n INT, k INT, rate DOUBLE")
    assert fr.rate_gap(rates, expected_biased=True).first()["warning"] is not None
    assert fr.rate_gap(rates, expected_biased=False).first()["warning"] is not None
