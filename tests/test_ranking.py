import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from pairrank.operators import ranking as rk


def graded(spark, grades, job="j"):
    """Rows whose score order is the order given."""
    rows = [(job, i, float(-i), g) for i, g in enumerate(grades)]
    return spark.createDataFrame(rows, "job_id STRING, item INT, score DOUBLE, grade INT")


def metrics(spark, grades):
    return rk.posting_metrics(graded(spark, grades), ["job_id"], "score", ["item"]).first()


@pytest.mark.parametrize(
    ("grades", "ndcg5", "ndcg10"),
    [([3, 2, 1, 0], 1.0, 1.0), ([0, 0, 0], 0.0, 0.0), ([0, 0, 0, 0, 0, 3], 0.0, 1 / math.log2(7))],
)
def test_ndcg_by_hand(spark, grades, ndcg5, ndcg10):
    row = metrics(spark, grades)
    assert row["ndcg_at_5"] == pytest.approx(ndcg5)
    assert row["ndcg_at_10"] == pytest.approx(ndcg10)


@pytest.mark.parametrize(("grades", "rr"), [([0, 2, 3], 0.5), ([1, 1, 1], 0.0), ([3], 1.0)])
def test_reciprocal_rank(spark, grades, rr):
    assert metrics(spark, grades)["reciprocal_rank"] == pytest.approx(rr)


def test_average_precision_counts_all_relevant(spark):
    assert metrics(spark, [2, 0, 3, 0, 2])["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert metrics(spark, [1, 0])["average_precision"] == 0.0


def test_ties_do_not_depend_on_input_order(spark):
    rows = [("j", "b", 1.0), ("j", "a", 1.0), ("j", "c", 2.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "job_id STRING, item STRING, score DOUBLE").repartition(3)
        ranked = {r["item"]: r["rank"] for r in rk.rank_within(df, ["job_id"], "score", ["item"]).collect()}
        assert ranked == {"c": 1, "a": 2, "b": 3}


def test_crowded_groups_rank_the_same_in_several_tasks(spark):
    """One posting holds most rows, scores repeat, one group is null, some scores are null."""
    rng = random.Random(5)
    rows = []
    for i in range(4000):
        job = "hot" if i % 3 else (None if i % 2 else f"j{i % 17}")
        score = None if i % 97 == 0 else float(rng.randrange(40))
        rows.append((job, i, score, rng.randrange(4)))
    df = spark.createDataFrame(rows, "job_id STRING, item INT, score DOUBLE, grade INT").repartition(5)
    hits = {"hits": F.when(F.col("grade") >= 2, 1).otherwise(0)}
    key = lambda df: sorted(((r["item"], r["rank"], r["hits"]) for r in df.collect()))
    plain = rk.rank_within(df, ["job_id"], "score", ["item"], hits, crowded=False)
    split = rk.rank_within(df, ["job_id"], "score", ["item"], hits, max_group_rows=100)
    assert key(split) == key(plain)
    assert rk.has_crowded_group(df, ["job_id"], 100)
    assert not rk.has_crowded_group(df, ["job_id"], 10_000)


def test_crowded_group_is_cut_into_slices(spark):
    df = spark.range(5000).select(F.lit("j").alias("job_id"), F.col("id").alias("item"), (F.col("id") % 7).cast("double").alias("score"))
    ranked = rk.rank_within(df, ["job_id"], "score", ["item"], max_group_rows=500)
    plan = ranked._jdf.queryExecution().toString()
    assert "slice" in plan
    assert [r[0] for r in ranked.select("rank").orderBy("rank").collect()] == list(range(1, 5001))


def test_top_k_is_limited_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("job_id"), F.col("id").alias("item"), F.rand(1).alias("score"))
    top = rk.top_k(df, ["job_id"], "score", ["item"], 10)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 30


def test_metrics_take_one_exchange(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select((F.col("id") % 5).alias("job_id"), F.col("id").alias("item"), F.rand(3).alias("score"), (F.col("id") % 4).cast("int").alias("grade")).write.parquet(path)
    df = spark.read.parquet(path)
    result = rk.posting_metrics(df, ["job_id"], "score", ["item"])
    result.collect()
    # What ran: the split branch is in the plan until the count has found no crowded group.
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_scaling_scores_changes_no_metric(spark):
    df = graded(spark, [1, 3, 0, 2, 2])
    scaled = df.withColumn("score", F.col("score") * 17.0)
    a, b = (rk.posting_metrics(d, ["job_id"], "score", ["item"]).first() for d in (df, scaled))
    assert a == b


def test_empty_input_is_an_error(spark):
    per = rk.posting_metrics(graded(spark, [1]).where("false"), ["job_id"], "score", ["item"])
    with pytest.raises(Exception, match="empty set"):
        rk.evaluate_ranking(per).collect()


def test_comparison_verdict(spark):
    rows = [("model", 0.9, 0.90, 0.8, 1.0, 5), ("baseline", 0.8, 0.80, 0.7, 0.9, 5)]
    df = spark.createDataFrame(rows, "scorer STRING, ndcg_at_5 DOUBLE, ndcg_at_10 DOUBLE, mean_average_precision DOUBLE, mean_reciprocal_rank DOUBLE, n_groups BIGINT")
    row = rk.compare_scorers(df).first()
    assert row["ndcg_at_10_delta"] == pytest.approx(0.1)
    assert row["ndcg_at_10_lift"] == pytest.approx(0.125)
    assert row["model_beats_baseline"]


def test_split_plan_orders_as_the_window(spark):
    from pairrank.operators.ranking import rank_within

    nan, inf = float("nan"), float("inf")
    rows = [("p", i, s) for i, s in enumerate([nan, 1.0, None, inf, -inf, 0.0, -0.0, nan, None, 1.0] * 4)]
    df = spark.createDataFrame(rows, "job string, id int, score double")
    whole = rank_within(df, ["job"], "score", ["id"]).select("id", "rank").orderBy("id").collect()
    split = rank_within(df, ["job"], "score", ["id"], max_group_rows=5).select("id", "rank").orderBy("id").collect()
    assert whole == split


def test_ranking_is_lazy_and_drops_the_idle_branch(spark):
    df = spark.range(3000).select(F.pmod("id", F.lit(7)).alias("job"), "id", (F.col("id") * 37 % 1009).cast("double").alias("score"))
    spark.sparkContext.setJobGroup("lazy", "plan only")
    ranked = rk.rank_within(df, ["job"], "score", ["id"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    ranked.collect()
    final = ranked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Union" not in final and "BroadcastHashJoin" not in final and final.count("hashpartitioning(job") == 1


def test_a_grade_beyond_the_scale_is_an_error_or_counts(spark):
    from pairrank.operators import training as tr

    df = graded(spark, [0, 4, 2])
    with pytest.raises(Exception, match="whole numbers from 0 to 3"):
        rk.posting_metrics(df, ["job_id"], "score", ["item"]).collect()
    with pytest.raises(Exception, match="whole numbers from 0 to 3"):
        tr.lambda_gradients(df, "job_id", "score", ["item"]).collect()
    row = rk.posting_metrics(df, ["job_id"], "score", ["item"], max_grade=4).first()
    assert row["ndcg_at_10"] == pytest.approx((15 / math.log2(3) + 3 / 2) / (15 + 3 / math.log2(3)))
    got = {r["item"]: r["gradient"] for r in tr.lambda_gradients(df, "job_id", "score", ["item"], max_grade=4).collect()}
    assert sum(got.values()) == pytest.approx(0) and got[1] > 0 > got[0]


@pytest.mark.parametrize(
    ("kind", "scores"),
    [
        ("BIGINT", [-(2**63), 2**63 - 1, 0, None, 5]),
        ("STRING", ["b", "", None, "ä", "zz"]),
        ("DOUBLE", [float("nan"), float("-inf"), None, -0.0, 1e300]),
        ("DATE", [datetime.date(2020, 1, 1), None, datetime.date(1, 1, 1), datetime.date(9999, 12, 31), None]),
    ],
)
def test_any_orderable_score_ranks_alike_however_crowded(spark, kind, scores):
    rows = [(1, scores[k % 5], None if k % 17 == 0 else k // 3, k) for k in range(200)]
    df = spark.createDataFrame(rows, f"job INT, score {kind}, id INT, id2 INT")
    plain = rk.rank_within(df, ["job"], "score", ["id", "id2"], crowded=False).collect()
    split = rk.rank_within(df, ["job"], "score", ["id", "id2"], max_group_rows=5).collect()
    assert {r["id2"]: r["rank"] for r in split} == {r["id2"]: r["rank"] for r in plain} and len(split) == 200
