import pytest
from pyspark.sql import functions as F

from pairrank.operators import features as ft

PROFILE = (
    "candidate_id STRING, years_experience DOUBLE, certifications ARRAY<STRING>, driving_licence BOOLEAN, "
    "shift_availability ARRAY<STRING>, site_experience ARRAY<STRING>, previous_role_count INT, months_since_last_role INT"
)
POSTING = (
    "job_id STRING, required_certifications ARRAY<STRING>, min_years_experience DOUBLE, shift_pattern STRING, "
    "site_type STRING, driving_required BOOLEAN"
)
GATE = "security_licence"


def pair(spark, profile=None, posting=None):
    person = {
        "candidate_id": "c", "years_experience": 5.0, "certifications": [GATE, "first_aid"], "driving_licence": True,
        "shift_availability": ["night"], "site_experience": ["retail"], "previous_role_count": 3, "months_since_last_role": 6,
        **(profile or {}),
    }
    job = {
        "job_id": "j", "required_certifications": [GATE, "first_aid"], "min_years_experience": 3.0, "shift_pattern": "night",
        "site_type": "retail", "driving_required": False, **(posting or {}),
    }
    profiles = spark.createDataFrame([tuple(person.values())], PROFILE)
    postings = spark.createDataFrame([tuple(job.values())], POSTING)
    pairs = spark.createDataFrame([("j", "c", 2)], "job_id STRING, candidate_id STRING, grade INT")
    return ft.pair_join(pairs, profiles, postings)


def features(spark, profile=None, posting=None):
    return ft.build_features(pair(spark, profile, posting), GATE, [GATE], ["job_id", "candidate_id"]).first()


def test_strong_pair(spark):
    row = features(spark)
    want = {
        "exp_gap": 2.0, "exp_ratio": 5 / 3, "licence_match": 1.0, "cert_overlap_ratio": 1.0, "cert_overlap_count": 2.0,
        "missing_critical_cert": 0.0, "shift_match": 1.0, "site_type_match": 1.0, "driving_required_match": 1.0,
        "extra_cert_count": 0.0, "role_count": 3.0, "recency_months": 6.0,
    }
    assert {n: row[n] for n in ft.FEATURE_NAMES} == pytest.approx(want)


def test_weak_pair(spark):
    row = features(spark, {"years_experience": 0.5, "certifications": [], "shift_availability": ["day"], "site_experience": ["event"]})
    assert row["exp_gap"] == -2.5
    assert row["licence_match"] == row["cert_overlap_ratio"] == row["shift_match"] == row["site_type_match"] == 0.0
    assert row["missing_critical_cert"] == 1.0


def test_unknown_is_null_not_zero(spark):
    row = features(
        spark,
        {"years_experience": None, "driving_licence": None, "shift_availability": [], "previous_role_count": None, "months_since_last_role": None},
        {"driving_required": True},
    )
    for name in ("exp_gap", "exp_ratio", "driving_required_match", "shift_match", "site_type_match", "role_count", "recency_months"):
        assert row[name] is None, name


def test_caps_and_no_requirements(spark):
    row = features(
        spark,
        {"years_experience": 60.0, "previous_role_count": 9, "months_since_last_role": 900, "site_experience": []},
        {"required_certifications": [], "min_years_experience": 0.0},
    )
    assert (row["exp_ratio"], row["role_count"], row["recency_months"]) == (5.0, 6.0, 240.0)
    assert (row["cert_overlap_ratio"], row["licence_match"], row["missing_critical_cert"], row["extra_cert_count"]) == (1.0, 1.0, 0.0, 2.0)
    assert row["site_type_match"] == 0.0


def test_unmatched_ids_drop_out(spark):
    joined = pair(spark)
    assert joined.count() == 1
    stray = spark.createDataFrame([("none", "c", 1)], "job_id STRING, candidate_id STRING, grade INT")
    assert ft.pair_join(stray, joined.drop("job_id", "grade").limit(1), joined.drop("candidate_id", "grade").limit(1)).count() == 0


def test_contract_is_enforced(spark):
    ft.check_contract(ft.FEATURE_NAMES)
    with pytest.raises(ValueError, match="order differs"):
        ft.check_contract(ft.FEATURE_NAMES[::-1])
    with pytest.raises(ValueError, match="missing=\\['exp_gap'\\]"):
        ft.check_contract(ft.FEATURE_NAMES[1:])


def test_unknowns_are_neutral_in_the_baseline(spark):
    columns = ", ".join(f"{n} DOUBLE" for n in ft.FEATURE_NAMES)
    base = {n: 0.0 for n in ft.FEATURE_NAMES}
    rows = [tuple({**base, **over}.values()) for over in ({"exp_gap": None, "shift_match": None}, {"exp_gap": -5.0, "shift_match": 0.0})]
    scores = [r["s"] for r in spark.createDataFrame(rows, columns).select(ft.baseline_score().alias("s")).collect()]
    assert scores[0] == scores[1] == 0.0


def test_grade_ladder(spark):
    df = spark.createDataFrame([(0.82,), (0.81,), (0.68,), (0.5,), (0.49,)], "s DOUBLE")
    assert [r["g"] for r in df.select(ft.to_grade(F.col("s")).alias("g")).collect()] == [3, 2, 2, 1, 0]


def test_fit_score_interactions(spark):
    paired = lambda **over: pair(spark, **over).withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    score = lambda df: df.select(ft.fit_score(GATE, ["industrial"], "a", "b").alias("s")).first()["s"]
    full = 0.30 + 0.20 + 0.15 + 0.08 + 0.07
    assert score(paired()) == pytest.approx(0.30 + 0.20 * (5 / 3 / 1.5 if 5 / 3 < 1.5 else 1) + 0.15 + 0.08 + 0.07 + 0.10)
    no_gate = score(paired(profile={"certifications": ["first_aid"]}))
    assert no_gate == pytest.approx((full - 0.15) * 0.25)
    off_shift = score(paired(profile={"shift_availability": ["day"]}))
    assert off_shift == pytest.approx(full - 0.15 + 0.10 - 0.04)


def test_split_holds_out_whole_postings(spark):
    rows = spark.range(4000).select((F.col("id") % 37).alias("job_id"), F.col("id").alias("item"))
    split = ft.group_split(rows, "job_id", seed=9)
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert counts == {"train": int(37 * 0.75), "valid": 37 - int(37 * 0.75)}
    assert split.select("job_id").distinct().count() == 37
    again = ft.group_split(rows.repartition(7), "job_id", seed=9)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, split.collect()))


def test_sampling_respects_limits_and_repeats(spark):
    rows = spark.range(600).select((F.col("id") % 3).alias("job_id"), F.col("id").alias("item"))
    drawn = ft.sample_group(rows, "job_id", ["item"], seed=3, low=10, high=20)
    sizes = [r["count"] for r in drawn.groupBy("job_id").count().collect()]
    assert all(10 <= n <= 20 for n in sizes)
    again = ft.sample_group(rows.repartition(5), "job_id", ["item"], seed=3, low=10, high=20)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, drawn.collect()))


def test_noise_rate_is_close_and_clamped(spark):
    rows = spark.range(20000).select(F.col("id"), (F.col("id") % 4).cast("int").alias("grade"))
    noisy = rows.withColumn("noisy", ft.noisy_grade(F.col("grade"), 1, ["id"]))
    row = noisy.agg(F.avg((F.col("noisy") != F.col("grade")).cast("double")), F.min("noisy"), F.max("noisy")).first()
    assert 0.07 < row[0] < 0.11  # 12% drawn, a quarter of which is clamped back
    assert (row[1], row[2]) == (0, 3)


def test_vector_follows_the_contract_whatever_the_column_order(spark):
    built = ft.build_features(pair(spark), GATE, [GATE], ["candidate_id"])
    shuffled = built.select("candidate_id", *ft.FEATURE_NAMES[::-1])
    assert ft.to_vector(shuffled, ["candidate_id"]).first()["vector"] == list(built.select(*ft.FEATURE_NAMES).first())
    with pytest.raises(ValueError, match="set differs"):
        ft.to_vector(built.drop("exp_gap"), ["candidate_id"])


def test_contract_diff_names_both_sides(spark):
    listed = lambda names: spark.createDataFrame(list(enumerate(names)), "position INT, name STRING")
    diff = lambda a, b: tuple(ft.contract_diff(listed(a), listed(b)).first())
    assert diff("abc", "abc") == ("identical", [], [])
    assert diff("abc", "acb") == ("order differs", [], [])
    assert diff("abc", "abd") == ("set differs", ["c"], ["d"])
