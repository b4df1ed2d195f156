"""Ranking, top-k and ranking-quality queries over the appearances."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairrank.functions.stats import round6
from pairrank.operators import features as ft
from pairrank.operators import ranking as rk
from pairrank.plans.entities import APPEARANCES_SQL, RANK_IDS, RANKED_SQL, appearances
from pairrank.plans.registry import query

BY = ["job_id"]


@query(
    "rank_within_posting",
    f"WITH {RANKED_SQL} SELECT job_id, l_orderkey, l_linenumber, l_partkey, score, rank FROM ranked",
)
def rank_within_posting(spark, sf_dir):
    rows = appearances(spark, sf_dir).select(*BY, *RANK_IDS, "score")
    return rk.rank_within(rows, BY, "score", RANK_IDS)


@query(
    "top_k",
    f"WITH {RANKED_SQL} SELECT job_id, l_orderkey, l_linenumber, l_partkey, score, rank FROM ranked WHERE rank <= 10",
)
def top_k(spark, sf_dir):
    return rk.top_k(appearances(spark, sf_dir).select(*BY, *RANK_IDS, "score"), BY, "score", RANK_IDS, 10)


@query(
    "position_exposure",
    f"""WITH {RANKED_SQL} SELECT job_id, grade, count(*) AS n, round(sum(1.0 / log2(rank + 1)), 6) AS exposure
    FROM ranked GROUP BY job_id, grade""",
)
def position_exposure(spark, sf_dir):
    ranked = rk.rank_within(appearances(spark, sf_dir).select(*BY, *RANK_IDS, "score", "grade"), BY, "score", RANK_IDS)
    return (
        rk.with_exposure(ranked)
        .groupBy("job_id", "grade")
        .agg(F.count(F.lit(1)).alias("n"), round6(F.sum("exposure")).alias("exposure"))
    )


METRICS_SQL = f"""{RANKED_SQL},
ideal AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY grade DESC, l_orderkey, l_linenumber, l_partkey, score) AS best,
  sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY rank) AS hits FROM ranked),
dcg AS (SELECT job_id, count(*) AS n_rows, count(*) FILTER (grade >= 2) AS n_relevant,
  coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 5), 0) AS dcg5,
  coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg10,
  coalesce(sum((2 ** grade - 1) / log2(best + 1)) FILTER (best <= 5), 0) AS ideal5,
  coalesce(sum((2 ** grade - 1) / log2(best + 1)) FILTER (best <= 10), 0) AS ideal10,
  coalesce(sum(hits / CAST(rank AS DOUBLE)) FILTER (grade >= 2), 0) AS precisions,
  min(rank) FILTER (grade >= 2) AS first_hit FROM ideal GROUP BY job_id),
metrics AS (SELECT job_id, n_rows, n_relevant, dcg5, dcg10,
  CASE WHEN ideal5 > 0 THEN dcg5 / ideal5 ELSE 0 END AS ndcg5, CASE WHEN ideal10 > 0 THEN dcg10 / ideal10 ELSE 0 END AS ndcg10,
  CASE WHEN n_relevant > 0 THEN precisions / n_relevant ELSE 0 END AS ap, coalesce(1.0 / first_hit, 0) AS rr FROM dcg)"""


def _metrics(spark, sf_dir):
    return rk.posting_metrics(appearances(spark, sf_dir), BY, "score", RANK_IDS)


@query("dcg_at_k", f"WITH {METRICS_SQL} SELECT job_id, round(dcg5, 6) AS dcg_at_5, round(dcg10, 6) AS dcg_at_10 FROM metrics")
def dcg_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir).select("job_id", round6("dcg_at_5").alias("dcg_at_5"), round6("dcg_at_10").alias("dcg_at_10"))


@query(
    "ndcg_at_k", f"WITH {METRICS_SQL} SELECT job_id, round(ndcg5, 6) AS ndcg_at_5, round(ndcg10, 6) AS ndcg_at_10 FROM metrics"
)
def ndcg_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        "job_id", round6("ndcg_at_5").alias("ndcg_at_5"), round6("ndcg_at_10").alias("ndcg_at_10")
    )


@query(
    "average_precision",
    f"WITH {METRICS_SQL} SELECT job_id, n_relevant, round(ap, 6) AS average_precision FROM metrics",
)
def average_precision(spark, sf_dir):
    return _metrics(spark, sf_dir).select("job_id", "n_relevant", round6("average_precision").alias("average_precision"))


@query("reciprocal_rank", f"WITH {METRICS_SQL} SELECT job_id, round(rr, 6) AS reciprocal_rank FROM metrics")
def reciprocal_rank(spark, sf_dir):
    return _metrics(spark, sf_dir).select("job_id", round6("reciprocal_rank").alias("reciprocal_rank"))


@query(
    "evaluate_ranking",
    f"""WITH {METRICS_SQL} SELECT round(avg(ndcg5), 6) AS ndcg_at_5, round(avg(ndcg10), 6) AS ndcg_at_10,
    round(avg(ap), 6) AS mean_average_precision, round(avg(rr), 6) AS mean_reciprocal_rank, count(*) AS n_groups,
    avg(ndcg10) > 0.95 AS circularity_suspected FROM metrics""",
)
def evaluate_ranking(spark, sf_dir):
    return _rounded(rk.evaluate_ranking(_metrics(spark, sf_dir)))


def _rounded(df):
    return df.select(*[round6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    "evaluate_labelled_documents",
    """WITH rows AS (SELECT source AS job_id, d.doc_id, n_chars AS score, quality * 2 + toxic AS grade
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, doc_id) AS rank,
      row_number() OVER (PARTITION BY job_id ORDER BY grade DESC, doc_id) AS best FROM rows),
    per AS (SELECT job_id, coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg,
      coalesce(sum((2 ** grade - 1) / log2(best + 1)) FILTER (best <= 10), 0) AS ideal, count(*) AS n_rows FROM ordered GROUP BY job_id)
    SELECT job_id, n_rows, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg_at_10 FROM per""",
)
def evaluate_labelled_documents(spark, sf_dir):
    """The same metrics on graded documents: uneven groups, ties in the score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.join(labels, "doc_id").select(
        F.col("source").alias("job_id"), "doc_id", F.col("n_chars").cast("double").alias("score"),
        (F.col("quality") * 2 + F.col("toxic")).alias("grade"),
    )
    return rk.posting_metrics(rows, BY, "score", ["doc_id"]).select("job_id", "n_rows", round6("ndcg_at_10").alias("ndcg_at_10"))


COMPARE_SQL = """WITH rows AS (
  SELECT 'model' AS scorer, l_suppkey AS job_id, l_extendedprice AS s, * FROM lineitem
  UNION ALL SELECT 'baseline', l_suppkey, l_discount, * FROM lineitem),
graded AS (SELECT scorer, job_id, s, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  CASE WHEN l_quantity >= 44 THEN 3 WHEN l_quantity >= 36 THEN 2 WHEN l_quantity >= 21 THEN 1 ELSE 0 END AS grade FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scorer, job_id ORDER BY s DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rank,
  row_number() OVER (PARTITION BY scorer, job_id ORDER BY grade DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS best FROM graded),
hit AS (SELECT *, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY scorer, job_id ORDER BY rank) AS hits FROM ranked),
per AS (SELECT scorer, job_id,
  coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 5), 0) AS d5, coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS d10,
  coalesce(sum((2 ** grade - 1) / log2(best + 1)) FILTER (best <= 5), 0) AS i5, coalesce(sum((2 ** grade - 1) / log2(best + 1)) FILTER (best <= 10), 0) AS i10,
  coalesce(sum(hits / CAST(rank AS DOUBLE)) FILTER (grade >= 2), 0) AS p, count(*) FILTER (grade >= 2) AS nr, min(rank) FILTER (grade >= 2) AS f
  FROM hit GROUP BY scorer, job_id),
ev AS (SELECT scorer, avg(CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0 END) AS ndcg5, avg(CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END) AS ndcg10,
  avg(CASE WHEN nr > 0 THEN p / nr ELSE 0 END) AS map, avg(coalesce(1.0 / f, 0)) AS mrr, count(*) AS n FROM per GROUP BY scorer)
SELECT round(m.ndcg5, 6) AS model_ndcg_at_5, round(m.ndcg10, 6) AS model_ndcg_at_10, round(m.map, 6) AS model_mean_average_precision,
  round(m.mrr, 6) AS model_mean_reciprocal_rank, m.n AS model_n_groups,
  round(b.ndcg5, 6) AS baseline_ndcg_at_5, round(b.ndcg10, 6) AS baseline_ndcg_at_10, round(b.map, 6) AS baseline_mean_average_precision,
  round(b.mrr, 6) AS baseline_mean_reciprocal_rank, b.n AS baseline_n_groups,
  round(m.ndcg10 - b.ndcg10, 6) AS ndcg_at_10_delta,
  round(CASE WHEN b.ndcg10 = 0 THEN 0 ELSE (m.ndcg10 - b.ndcg10) / b.ndcg10 END, 6) AS ndcg_at_10_lift,
  m.ndcg10 - b.ndcg10 >= 0.01 AS model_beats_baseline
FROM ev m JOIN ev b ON m.scorer = 'model' AND b.scorer = 'baseline'"""


@query("compare_scorers", COMPARE_SQL)
def compare_scorers(spark, sf_dir):
    rows = appearances(spark, sf_dir).withColumnRenamed("score", "price")
    scored = rk.long_scores(rows, [*BY, *RANK_IDS, "price", "grade"], {"model": "price", "baseline": "other_score"})
    metrics = rk.posting_metrics(scored, ["scorer", "job_id"], "score", [*RANK_IDS, "price"])
    evaluations = metrics.groupBy("scorer").agg(
        F.avg("ndcg_at_5").alias("ndcg_at_5"),
        F.avg("ndcg_at_10").alias("ndcg_at_10"),
        F.avg("average_precision").alias("mean_average_precision"),
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"),
        F.count(F.lit(1)).alias("n_groups"),
    )
    return _rounded(rk.compare_scorers(evaluations))


SPLIT_SQL = """drawn AS (SELECT l_suppkey AS job_id, md5('42|' || l_suppkey) AS draw FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
split AS (SELECT job_id, CASE WHEN row_number() OVER (ORDER BY draw, job_id) <= floor((SELECT count(*) FROM drawn) * 0.75)
  THEN 'train' ELSE 'valid' END AS split FROM drawn)"""


@query(
    "split_consistency",
    f"""WITH {APPEARANCES_SQL}, {SPLIT_SQL}
    SELECT a.job_id, count(*) AS ranked_rows, count(*) AS group_size, true AS consistent
    FROM appearances a JOIN split s ON a.job_id = s.job_id WHERE split = 'valid' GROUP BY a.job_id""",
)
def split_consistency(spark, sf_dir):
    rows = appearances(spark, sf_dir).select(*BY, *RANK_IDS, "score")
    valid = ft.group_split(rows, "job_id", seed=42).where("split = 'valid'").select("job_id")
    held_out = rows.join(valid, "job_id")
    ranked = rk.rank_within(held_out, BY, "score", RANK_IDS)
    return rk.split_consistency(ranked, ft.group_sizes(rows, "job_id").join(valid, "job_id"), "job_id")
