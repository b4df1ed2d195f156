"""Fairness audit queries: ranked appearances against separate group records."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairrank.functions.stats import round6
from pairrank.operators import fairness as fr
from pairrank.operators import ranking as rk
from pairrank.plans.entities import (
    DEMOGRAPHICS_SQL,
    RANK_IDS,
    RANKED_SQL,
    appearances,
    demographics,
    grade_of_quantity,
    table,
)
from pairrank.plans.registry import query

BY = ["job_id"]
ATTRIBUTES = {"segment": "segment", "priority": "priority", "status": "status"}


def _ranked(spark, sf_dir):
    rows = appearances(spark, sf_dir).select(*BY, *RANK_IDS, "score", "grade")
    return rk.rank_within(rows, BY, "score", RANK_IDS)


def _attached(spark, sf_dir):
    return fr.attach_groups(_ranked(spark, sf_dir), demographics(spark, sf_dir), ["l_orderkey"])


def _tallies(spark, sf_dir):
    return fr.group_tallies(fr.long_attributes(_attached(spark, sf_dir), ATTRIBUTES, ["rank", "grade"]))


def _audits(spark, sf_dir):
    return fr.audit_attributes(fr.group_outcomes(_tallies(spark, sf_dir)))


LONG_SQL = f"""{RANKED_SQL}, {DEMOGRAPHICS_SQL},
attached AS (SELECT r.*, segment, priority, status FROM ranked r JOIN demographics d ON r.l_orderkey = d.l_orderkey),
long AS (SELECT 'segment' AS attribute, segment AS "group", rank, grade FROM attached
  UNION ALL SELECT 'priority', priority, rank, grade FROM attached
  UNION ALL SELECT 'status', status, rank, grade FROM attached)"""

TALLIES_SQL = """tallies AS (SELECT attribute, "group", count(*) AS n_appearances, count(*) FILTER (rank <= 10) AS n_in_top_k,
  count(*) FILTER (grade >= 2) AS n_qualified, count(*) FILTER (grade >= 2 AND rank <= 10) AS n_qualified_in_top_k,
  sum(1.0 / log2(rank + 1)) AS exposure_sum FROM long GROUP BY attribute, "group"),
outcomes AS (SELECT *, n_in_top_k / CAST(n_appearances AS DOUBLE) AS selection_rate,
  CASE WHEN n_qualified > 0 THEN n_qualified_in_top_k / CAST(n_qualified AS DOUBLE) END AS qualified_rate,
  exposure_sum / n_appearances AS mean_exposure, n_appearances < 30 AS suppressed FROM tallies)"""


def _p_sql(hits_a, n_a, hits_b, n_b):
    pooled = f"(({hits_a} + {hits_b}) / CAST(({n_a} + {n_b}) AS DOUBLE))"
    return f"""CASE WHEN {n_a} > 0 AND {n_b} > 0 AND {pooled} > 0 AND {pooled} < 1 THEN
      abs({hits_a} / CAST({n_a} AS DOUBLE) - {hits_b} / CAST({n_b} AS DOUBLE))
      / sqrt({pooled} * (1 - {pooled}) * (1.0 / {n_a} + 1.0 / {n_b})) / sqrt(2.0) END"""


# erf by its logarithmic series near zero and the continued fraction in the tail:
# a different evaluation from the engine's fold.
ERFC_SQL = """CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN 1.0 WHEN {x} < 2.5 THEN
    1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 80),
      lambda n: exp((2 * n + 1) * ln({x}) + 2 * n * ln(2.0) + lgamma(n + 1) - lgamma(2 * n + 2))))
  ELSE exp(-{x} * {x}) / ({x} * sqrt(pi()) * list_reduce(list_transform(range(120, 0, -1), lambda k: CAST(k AS DOUBLE)),
      lambda acc, k: 1 + (k / (2 * {x} * {x})) / acc, CAST(1.0 AS DOUBLE))) END"""

AUDIT_SQL = f"""{TALLIES_SQL},
shown AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY selection_rate, "group") AS lo,
  row_number() OVER (PARTITION BY attribute ORDER BY selection_rate DESC, "group") AS hi,
  row_number() OVER (PARTITION BY attribute ORDER BY qualified_rate NULLS LAST, "group") AS qlo,
  row_number() OVER (PARTITION BY attribute ORDER BY qualified_rate DESC NULLS LAST, "group") AS qhi
  FROM outcomes WHERE NOT suppressed),
summary AS (SELECT o.attribute, count(s."group") AS n_groups,
  min(s.selection_rate) / nullif(max(s.selection_rate), 0) AS adverse_impact_ratio,
  max(s.selection_rate) - min(s.selection_rate) AS demographic_parity_gap,
  max(s.qualified_rate) - min(s.qualified_rate) AS equal_opportunity_gap,
  min(s.mean_exposure) / nullif(max(s.mean_exposure), 0) AS exposure_ratio,
  max(s."group") FILTER (lo = 1) AS lowest_group, max(s."group") FILTER (hi = 1) AS highest_group,
  max(s.n_in_top_k) FILTER (lo = 1) AS lk, max(s.n_appearances) FILTER (lo = 1) AS ln,
  max(s.n_in_top_k) FILTER (hi = 1) AS hk, max(s.n_appearances) FILTER (hi = 1) AS hn,
  max(s.n_qualified_in_top_k) FILTER (qlo = 1) AS qlk, max(s.n_qualified) FILTER (qlo = 1) AS qln,
  max(s.n_qualified_in_top_k) FILTER (qhi = 1) AS qhk, max(s.n_qualified) FILTER (qhi = 1) AS qhn,
  count(s.qualified_rate) AS n_q, min(s.n_appearances) AS smallest,
  coalesce(string_agg(o."group", '|' ORDER BY o."group") FILTER (o.suppressed), '') AS suppressed_groups
  FROM outcomes o LEFT JOIN shown s ON o.attribute = s.attribute AND o."group" = s."group" GROUP BY o.attribute),
zs AS (SELECT *, CASE WHEN n_groups >= 2 THEN {_p_sql("lk", "ln", "hk", "hn")} END AS x,
  CASE WHEN n_groups >= 2 AND n_q >= 2 THEN {_p_sql("qlk", "qln", "qhk", "qhn")} END AS qx,
  CASE WHEN n_groups >= 2 THEN 0.05 / (n_groups * (n_groups - 1) / 2.0) ELSE 0.05 END AS threshold,
  CASE WHEN n_groups >= 2 THEN n_groups * (n_groups - 1) // 2 ELSE 1 END AS n_comparisons FROM summary),
tested AS (SELECT *, {ERFC_SQL.format(x="x")} AS p, {ERFC_SQL.format(x="qx")} AS qp FROM zs),
found AS (SELECT *,
  CASE WHEN n_groups >= 2 AND adverse_impact_ratio < 0.8 THEN attribute || ': adverse impact ratio ' ||
    format('{{:.3f}}', adverse_impact_ratio) || ' is below the four-fifths threshold of 0.80' END AS m1,
  CASE WHEN n_groups >= 2 AND demographic_parity_gap > 0.1 THEN attribute || ': demographic parity gap ' ||
    format('{{:.3f}}', demographic_parity_gap) || ' exceeds 0.10' END AS m2,
  CASE WHEN n_groups >= 2 AND equal_opportunity_gap > 0.1 THEN attribute || ': equal opportunity gap ' ||
    format('{{:.3f}}', equal_opportunity_gap) || ' exceeds 0.10 — qualified candidates are being shortlisted at materially different rates' END AS m3,
  CASE WHEN n_groups >= 2 AND exposure_ratio < 0.8 THEN attribute || ': exposure ratio ' || format('{{:.3f}}', exposure_ratio) ||
    ' is below 0.80 — one group is admitted to the shortlist but placed consistently lower within it (not significance-tested)' END AS m4,
  CASE WHEN n_groups < 2 THEN attribute || ': fewer than two groups met the minimum size of 30; no comparison was possible' END AS m0,
  coalesce(p < threshold, false) AS sig, coalesce(qp < threshold, false) AS qsig,
  ' (p=' || format('{{:.4f}}', p) || ' < ' || format('{{:.4f}}', threshold) || ')' AS yes,
  ' (p=' || format('{{:.4f}}', qp) || ' < ' || format('{{:.4f}}', threshold) || ')' AS qyes,
  ' — but not distinguishable from noise once corrected for ' || n_comparisons || ' possible group comparisons (' AS no1,
  ', threshold ' || format('{{:.4f}}', threshold) || '); smallest group n=' || smallest AS no2 FROM tested),
audits AS (SELECT *,
  list_filter([m0, CASE WHEN sig THEN m1 || yes END, CASE WHEN sig THEN m2 || yes END, CASE WHEN qsig THEN m3 || qyes END, m4],
    lambda m: m IS NOT NULL) AS failures,
  list_filter([CASE WHEN NOT sig THEN m1 || no1 || coalesce('p=' || format('{{:.4f}}', p), 'test undefined') || no2 END,
    CASE WHEN NOT sig THEN m2 || no1 || coalesce('p=' || format('{{:.4f}}', p), 'test undefined') || no2 END,
    CASE WHEN NOT qsig THEN m3 || no1 || coalesce('p=' || format('{{:.4f}}', qp), 'test undefined') || no2 END],
    lambda m: m IS NOT NULL) AS inconclusive FROM found)"""


@query(
    "attach_groups",
    f"WITH {LONG_SQL} SELECT job_id, l_orderkey, l_linenumber, l_partkey, rank, segment, priority, status FROM attached",
)
def attach_groups(spark, sf_dir):
    return _attached(spark, sf_dir).select(*BY, *RANK_IDS, "rank", "segment", "priority", "status")


@query(
    "group_tallies",
    f"""WITH {LONG_SQL}, {TALLIES_SQL} SELECT attribute, "group", n_appearances, n_in_top_k, n_qualified,
    n_qualified_in_top_k, round(exposure_sum, 6) AS exposure_sum FROM tallies""",
)
def group_tallies(spark, sf_dir):
    return _tallies(spark, sf_dir).withColumn("exposure_sum", round6("exposure_sum"))


BRACKET_SQL = f"""{RANKED_SQL},
long AS (SELECT 'bracket' AS attribute, CASE WHEN o_totalprice >= 499900 THEN 'top' WHEN o_totalprice >= 250000 THEN 'high'
  ELSE 'low' END AS "group", rank, grade FROM ranked JOIN orders ON l_orderkey = o_orderkey)"""


def _bracketed(spark, sf_dir, only_top=False):
    price = F.col("o_totalprice")
    bracket = F.when(price >= 499900, "top")
    bracket = bracket.otherwise("other") if only_top else bracket.when(price >= 250000, "high").otherwise("low")
    groups = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), bracket.alias("bracket"))
    rows = fr.attach_groups(_ranked(spark, sf_dir), groups, ["l_orderkey"])
    return fr.group_outcomes(fr.group_tallies(fr.long_attributes(rows, {"bracket": "bracket"}, ["rank", "grade"])))


@query(
    "suppress_small",
    f"""WITH {BRACKET_SQL}, {TALLIES_SQL} SELECT attribute, "group", n_appearances, suppressed,
    round(CASE WHEN NOT suppressed THEN selection_rate END, 6) AS selection_rate FROM outcomes""",
)
def suppress_small(spark, sf_dir):
    shown = fr.split_small(_bracketed(spark, sf_dir))
    return shown.select(
        "attribute", "group", "n_appearances", "suppressed",
        round6(F.when(~F.col("suppressed"), F.col("selection_rate"))).alias("selection_rate"),
    )


@query(
    "group_outcomes",
    f"""WITH {LONG_SQL}, {TALLIES_SQL} SELECT attribute, "group", n_appearances, round(selection_rate, 6) AS selection_rate,
    round(qualified_rate, 6) AS qualified_selection_rate, round(mean_exposure, 6) AS mean_exposure FROM outcomes""",
)
def group_outcomes(spark, sf_dir):
    rates = ("selection_rate", "qualified_selection_rate", "mean_exposure")
    return fr.group_outcomes(_tallies(spark, sf_dir)).select(
        "attribute", "group", "n_appearances", *[round6(r).alias(r) for r in rates]
    )


def _measure(key, column):
    sql = f"WITH {LONG_SQL}, {AUDIT_SQL} SELECT attribute, round({column}, 6) AS {column} FROM audits"

    @query(key, sql)
    def build(spark, sf_dir):
        return _audits(spark, sf_dir).select("attribute", round6(column).alias(column))

    return build


_measure("adverse_impact_ratio", "adverse_impact_ratio")
_measure("demographic_parity_gap", "demographic_parity_gap")
_measure("equal_opportunity_gap", "equal_opportunity_gap")
_measure("exposure_ratio", "exposure_ratio")


@query(
    "two_proportion_p",
    f"""WITH {LONG_SQL}, {AUDIT_SQL} SELECT attribute, round(p, 6) AS selection_p_value, round(qp, 6) AS qualified_p_value FROM audits""",
)
def two_proportion_p(spark, sf_dir):
    return _audits(spark, sf_dir).select(
        "attribute", round6("selection_p_value").alias("selection_p_value"), round6("qualified_p_value").alias("qualified_p_value")
    )


@query(
    "bonferroni",
    f"""WITH {LONG_SQL}, {AUDIT_SQL} SELECT attribute, n_groups, n_comparisons, round(threshold, 6) AS significance_threshold FROM audits""",
)
def bonferroni(spark, sf_dir):
    return _audits(spark, sf_dir).select(
        "attribute", "n_groups", "n_comparisons", round6("significance_threshold").alias("significance_threshold")
    )


@query("extreme_pair", f"WITH {LONG_SQL}, {AUDIT_SQL} SELECT attribute, lowest_group, highest_group FROM audits")
def extreme_pair(spark, sf_dir):
    return _audits(spark, sf_dir).select("attribute", "lowest_group", "highest_group")


def _texts(df):
    return df.withColumn("failures", F.array_join("failures", " || ")).withColumn("inconclusive", F.array_join("inconclusive", " || "))


@query(
    "classify_breach",
    f"""WITH {LONG_SQL}, {AUDIT_SQL} SELECT attribute, len(failures) = 0 AS passes,
    array_to_string(failures, ' || ') AS failures, array_to_string(inconclusive, ' || ') AS inconclusive FROM audits""",
)
def classify_breach(spark, sf_dir):
    return _texts(_audits(spark, sf_dir).select("attribute", "passes", "failures", "inconclusive"))


@query(
    "single_group_rule",
    f"""WITH {BRACKET_SQL.replace("WHEN o_totalprice >= 250000 THEN 'high'", "").replace("'low'", "'other'")}, {AUDIT_SQL}
    SELECT attribute, n_groups, suppressed_groups, round(p, 6) AS selection_p_value, round(threshold, 6) AS significance_threshold,
    n_comparisons, len(failures) = 0 AS passes, array_to_string(failures, ' || ') AS failures FROM audits""",
)
def single_group_rule(spark, sf_dir):
    audits = _texts(fr.audit_attributes(_bracketed(spark, sf_dir, only_top=True)))
    return audits.select(
        "attribute", "n_groups", F.array_join("suppressed_groups", "|").alias("suppressed_groups"),
        round6("selection_p_value").alias("selection_p_value"),
        round6("significance_threshold").alias("significance_threshold"), "n_comparisons", "passes", "failures",
    )


@query(
    "audit_attributes",
    f"""WITH {LONG_SQL}, {AUDIT_SQL} SELECT attribute, n_groups, suppressed_groups,
    round(adverse_impact_ratio, 6) AS adverse_impact_ratio, round(demographic_parity_gap, 6) AS demographic_parity_gap,
    round(equal_opportunity_gap, 6) AS equal_opportunity_gap, round(exposure_ratio, 6) AS exposure_ratio, lowest_group,
    highest_group, round(p, 6) AS selection_p_value, round(qp, 6) AS qualified_p_value,
    round(threshold, 6) AS significance_threshold, n_comparisons, len(failures) = 0 AS passes,
    array_to_string(failures, ' || ') AS failures, array_to_string(inconclusive, ' || ') AS inconclusive FROM audits""",
)
def audit_attributes(spark, sf_dir):
    audits = _texts(_audits(spark, sf_dir)).withColumn("suppressed_groups", F.array_join("suppressed_groups", "|"))
    return audits.select(*[round6(c).alias(c) if t == "double" else F.col(c) for c, t in audits.dtypes])


REPORT_SQL = """SELECT bool_and(len(failures) = 0) AS passes,
  CASE WHEN sum(len(failures)) > 0 THEN 'fail' WHEN sum(len(inconclusive)) > 0 THEN 'inconclusive' ELSE 'pass' END AS state,
  array_to_string(flatten(list(failures ORDER BY list_position({order}, attribute))), ' || ') AS failures,
  array_to_string(flatten(list(inconclusive ORDER BY list_position({order}, attribute))), ' || ') AS inconclusive,
  (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS n_postings, (SELECT count(*) FROM lineitem) AS n_rows FROM audits"""


@query("audit_report", f"WITH {LONG_SQL}, {AUDIT_SQL} " + REPORT_SQL.format(order="['segment', 'priority', 'status']"))
def audit_report(spark, sf_dir):
    spine = appearances(spark, sf_dir).select("job_id")
    return _texts(fr.audit_report(_audits(spark, sf_dir), spine, "job_id", list(ATTRIBUTES)))


POWER_SQL = """ranked AS (SELECT l_suppkey AS job_id, o_orderstatus AS clean,
    CASE WHEN l_quantity >= 26 THEN 'bulk' ELSE 'small' END AS skewed,
    CASE WHEN l_quantity >= 44 THEN 3 WHEN l_quantity >= 36 THEN 2 WHEN l_quantity >= 21 THEN 1 ELSE 0 END AS grade,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
long AS (SELECT 'clean' AS attribute, clean AS "group", rank, grade FROM ranked
  UNION ALL SELECT 'skewed', skewed, rank, grade FROM ranked)"""


@query(
    "audit_power",
    f"""WITH {POWER_SQL}, {AUDIT_SQL} SELECT attribute, round(adverse_impact_ratio, 6) AS adverse_impact_ratio,
    round(p, 6) AS selection_p_value, len(failures) = 0 AS passes, array_to_string(failures, ' || ') AS failures FROM audits""",
)
def audit_power(spark, sf_dir):
    """A group unrelated to the score must not fail; one tied to it must."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("job_id"), *RANK_IDS, F.col("l_extendedprice").alias("score"),
        grade_of_quantity(F.col("l_quantity")).alias("grade"),
        F.when(F.col("l_quantity") >= 26, "bulk").otherwise("small").alias("skewed"),
    )
    ranked = rk.rank_within(lines, BY, "score", RANK_IDS)
    clean = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("clean"))
    rows = fr.long_attributes(
        fr.attach_groups(ranked, clean, ["l_orderkey"]), {"clean": "clean", "skewed": "skewed"}, ["rank", "grade"]
    )
    audits = _texts(fr.audit_attributes(fr.group_outcomes(fr.group_tallies(rows))))
    return audits.select(
        "attribute", round6("adverse_impact_ratio").alias("adverse_impact_ratio"),
        round6("selection_p_value").alias("selection_p_value"), "passes", "failures",
    )


@query(
    "conditional_rate_by_group",
    """WITH domain AS (SELECT DISTINCT o_orderpriority AS priority FROM orders UNION SELECT 'NEVER USED'),
    rates AS (SELECT o_orderpriority AS priority, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY 1)
    SELECT d.priority, coalesce(n, 0) AS n, coalesce(k, 0) AS n_flagged, round(coalesce(k / CAST(n AS DOUBLE), 0), 6) AS rate
    FROM domain d LEFT JOIN rates r ON d.priority = r.priority""",
)
def conditional_rate_by_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    rows = lines.join(demographics(spark, sf_dir), "l_orderkey")
    orders = table(spark, sf_dir, "orders")
    domain = orders.select(F.col("o_orderpriority").alias("priority")).distinct().unionByName(
        orders.agg(F.lit("NEVER USED").alias("priority"))
    )
    rates = fr.conditional_rate_by_group(rows, "priority", F.col("l_returnflag") == "R", domain)
    return rates.withColumn("rate", round6("rate"))
