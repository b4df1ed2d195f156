"""Explanations, requirement views and shortlist views of the scored pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairrank.functions.stats import fixed, round6
from pairrank.operators import explain as ex
from pairrank.operators import features as ft
from pairrank.operators import guards as gd
from pairrank.operators import ranking as rk
from pairrank.operators import shortlist as sl
from pairrank.plans.entities import FEATURES_SQL, GATE, pairs, table
from pairrank.plans.q_pairs import KEYS, features, scored
from pairrank.plans.registry import ORACLES, query
from pairrank.session import materialise, scratch_path

VERSION = "v1"
REQUEST = "r1"
ASKED = ["required_certifications", "min_years_experience", "shift_pattern", "site_type", "driving_required"]
NAMES = ft.FEATURE_NAMES

# Terms that can differ from zero, by feature; all others contribute exactly nothing.
ACTIVE = {"exp_gap": "t_gap", "cert_overlap_ratio": "t_cert", "missing_critical_cert": "t_critical", "shift_match": "t_shift"}
MEANS_SQL = "means AS MATERIALIZED (SELECT avg(t_cert) AS m_cert, avg(t_gap) AS m_gap, avg(t_shift) AS m_shift, avg(t_critical) AS m_critical FROM scored)"
CONTRIBUTION_SQL = f"""{FEATURES_SQL}, {MEANS_SQL},
explained AS (SELECT s.*, t_gap - (SELECT m_gap FROM means) AS c_exp_gap, t_cert - (SELECT m_cert FROM means) AS c_cert_overlap_ratio,
  t_shift - (SELECT m_shift FROM means) AS c_shift_match, t_critical - (SELECT m_critical FROM means) AS c_missing_critical_cert,
  (SELECT m_cert + m_gap + m_shift + m_critical FROM means) AS base_value FROM scored s)"""
LONG_SQL = CONTRIBUTION_SQL + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT job_id, candidate_id, score, '{n}' AS feature, {i} AS position, {n} AS value, "
    + (f"c_{n}" if n in ACTIVE else "CAST(0.0 AS DOUBLE)") + " AS contribution FROM explained"
    for i, n in enumerate(NAMES)
) + """),
placed AS (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY abs(contribution) DESC, position) AS place,
  sum(abs(contribution)) OVER (PARTITION BY job_id, candidate_id) AS total FROM long)"""  # fmt: skip


def explained(spark, sf_dir, keep=()):
    """Contributions of every scored pair.

    The scored features are written once: the expected terms and the explanation
    both read them, and neither repeats the joins behind them.
    """
    rows = materialise(scored(spark, sf_dir, [*KEYS, *keep]), "scored")
    return ex.attribute_additive(rows, ex.expected_terms(rows), [*KEYS, *keep, "score"])


def _by_effect(rows):
    return rows.withColumn("ranked", ex.ranked_contributions()).withColumn("total", ex.total_effect())


def _ordered(spark, sf_dir, keep=()):
    return _by_effect(explained(spark, sf_dir, keep))


@query(
    "attribute_additive",
    f"""WITH {FEATURES_SQL} SELECT job_id, candidate_id,
    round(avg(t_cert) OVER () + avg(t_gap) OVER () + avg(t_shift) OVER () + avg(t_critical) OVER (), 6) AS base_value,
    round(t_gap - avg(t_gap) OVER (), 6) AS exp_gap, round(t_cert - avg(t_cert) OVER (), 6) AS cert_overlap_ratio,
    round(t_critical - avg(t_critical) OVER (), 6) AS missing_critical_cert, round(t_shift - avg(t_shift) OVER (), 6) AS shift_match,
    CAST(0 AS DOUBLE) AS all_others FROM scored""",
)
def attribute_additive(spark, sf_dir):
    rows = explained(spark, sf_dir)
    at = {name: F.col("contributions")[i]["contribution"] for i, name in enumerate(NAMES)}
    others = F.lit(0.0)
    for name in NAMES:
        if name not in ACTIVE:
            others = others + F.abs(at[name])
    return rows.select(
        *KEYS, round6("base_value").alias("base_value"), *[round6(at[n]).alias(n) for n in ACTIVE], round6(others).alias("all_others")
    )


@query(
    "explain_batch",
    f"""WITH {CONTRIBUTION_SQL} SELECT job_id, count(*) AS n_candidates, round(sum(abs(c_exp_gap)), 4) AS exp_gap_effect,
    round(sum(abs(c_cert_overlap_ratio)), 4) AS coverage_effect FROM explained GROUP BY job_id""",
)
def explain_batch(spark, sf_dir):
    """All candidates of each posting explained from the already scored features."""
    rows = explained(spark, sf_dir)
    effect = lambda name: F.round(F.sum(F.abs(F.col("contributions")[NAMES.index(name)]["contribution"])), 4)
    return rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), effect("exp_gap").alias("exp_gap_effect"),
        effect("cert_overlap_ratio").alias("coverage_effect"),
    )


@query(
    "ranked_contributions",
    f"""WITH {LONG_SQL} SELECT job_id, candidate_id, string_agg(feature, '|' ORDER BY place) AS features,
    string_agg(CAST(CAST(round(contribution * 1000) AS BIGINT) AS VARCHAR), '|' ORDER BY place) AS thousandths FROM placed GROUP BY job_id, candidate_id""",
)
def ranked_contributions(spark, sf_dir):
    rows = _ordered(spark, sf_dir)
    return rows.select(
        *KEYS, F.array_join(F.transform("ranked", lambda c: c["feature"]), "|").alias("features"),
        F.array_join(F.transform("ranked", lambda c: F.round(c["contribution"] * 1000).cast("bigint").cast("string")), "|").alias("thousandths"),
    )


@query(
    "additivity_check",
    f"""WITH {FEATURES_SQL} SELECT job_id, candidate_id, round(score, 6) AS score,
    round(t_gap + t_cert + t_shift + t_critical, 6) AS sum, true AS holds FROM scored""",
)
def additivity_check(spark, sf_dir):
    checked = ex.additivity_check(explained(spark, sf_dir), "score")
    return checked.select(*KEYS, round6("score").alias("score"), round6("sum").alias("sum"), "holds")


_SENTENCES = """CASE feature
  WHEN 'exp_gap' THEN CASE WHEN value IS NULL THEN 'Years of experience could not be determined from the CV'
    WHEN value >= 0 THEN format('{:.1f}', value) || ' years above the minimum experience requirement'
    ELSE format('{:.1f}', abs(value)) || ' years below the minimum experience requirement' END
  WHEN 'exp_ratio' THEN CASE WHEN value IS NULL THEN 'Years of experience could not be determined from the CV'
    ELSE 'Experience is ' || format('{:.1f}', value) || ' times the stated minimum' END
  WHEN 'licence_match' THEN CASE WHEN value >= 1 THEN 'Holds the required security licence' ELSE 'Does not hold the required security licence' END
  WHEN 'cert_overlap_ratio' THEN 'Holds ' || format('{:.0f}', value * 100) || '% of the certifications this role requires'
  WHEN 'cert_overlap_count' THEN 'Holds ' || format('{:.0f}', value) || ' of the required certifications'
  WHEN 'missing_critical_cert' THEN CASE WHEN value >= 1 THEN 'Missing a certification this role treats as mandatory' ELSE 'Holds every mandatory certification' END
  WHEN 'shift_match' THEN CASE WHEN value IS NULL THEN 'Shift availability was not stated in the CV'
    WHEN value >= 1 THEN 'Available for the shift pattern this role needs' ELSE 'Not available for the shift pattern this role needs' END
  WHEN 'site_type_match' THEN CASE WHEN value IS NULL THEN 'No employment history was found in the CV'
    WHEN value >= 1 THEN 'Has prior experience at this type of site' ELSE 'No prior experience at this type of site' END
  WHEN 'driving_required_match' THEN CASE WHEN value IS NULL THEN 'Driving licence status was not stated in the CV'
    WHEN value >= 1 THEN 'Meets the driving requirement for this role' ELSE 'Does not hold a driving licence, which this role requires' END
  WHEN 'extra_cert_count' THEN CASE WHEN value > 0 THEN 'Holds ' || format('{:.0f}', value) || ' relevant certifications beyond those required'
    ELSE 'No relevant certifications beyond those required' END
  WHEN 'role_count' THEN CASE WHEN value IS NULL THEN 'No employment history was found in the CV' WHEN value = 0 THEN 'No previous security roles'
    ELSE format('{:.0f}', value) || ' previous security roles' END
  WHEN 'recency_months' THEN CASE WHEN value IS NULL THEN 'Date of the most recent role could not be determined'
    WHEN value <= 0 THEN 'Currently or very recently employed' ELSE 'Most recent role ended around ' || format('{:.0f}', value) || ' months ago' END
  END"""
_EFFECT = """'counted ' || CASE WHEN abs(contribution) / total >= 0.25 THEN 'strong' WHEN abs(contribution) / total >= 0.10 THEN 'moderate'
  ELSE 'slight' END || 'ly ' || CASE WHEN contribution >= 0 THEN 'in favour' ELSE 'against' END"""


@query(
    "describe_value",
    f"""WITH {LONG_SQL}, told AS (SELECT feature, {_SENTENCES} AS sentence FROM long)
    SELECT feature, sentence, count(*) AS n FROM told GROUP BY feature, sentence""",
)
def describe_value(spark, sf_dir):
    rows = explained(spark, sf_dir).select(F.inline(F.transform("contributions", lambda c: F.struct(c["feature"].alias("feature"), c["value"].alias("value")))))
    told = rows.select("feature", ex.describe_value(F.col("feature"), F.col("value")).alias("sentence"))
    return told.groupBy("feature", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "effect_phrase",
    f"""WITH {LONG_SQL} SELECT feature, {_EFFECT} AS phrase, count(*) AS n FROM placed GROUP BY 1, 2""",
)
def effect_phrase(spark, sf_dir):
    rows = _ordered(spark, sf_dir).select("total", F.inline("contributions"))
    phrase = ex.effect_phrase(F.col("contribution"), F.abs("contribution") / F.nullif("total", F.lit(0.0)))
    return rows.groupBy("feature", phrase.alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


REASONS_SQL = f"""{LONG_SQL},
reasons AS (SELECT job_id, candidate_id, coalesce(string_agg({_SENTENCES} || ' — ' || {_EFFECT}, ' | ' ORDER BY place)
  FILTER (place <= 5 AND abs(contribution) / total >= 0.02), '') AS reasons FROM placed GROUP BY job_id, candidate_id)"""


@query("build_reasons", f"WITH {REASONS_SQL} SELECT * FROM reasons")
def build_reasons(spark, sf_dir):
    rows = _ordered(spark, sf_dir)
    return rows.select(*KEYS, F.array_join(ex.build_reasons(F.col("ranked"), F.col("total")), " | ").alias("reasons"))


@query(
    "global_importance",
    f"""WITH {LONG_SQL}, per AS (SELECT feature, avg(abs(contribution)) AS importance FROM long GROUP BY feature)
    SELECT feature, round(importance, 6) AS importance, round(importance / sum(importance) OVER (), 6) AS share FROM per""",
)
def global_importance(spark, sf_dir):
    found = ex.global_importance(explained(spark, sf_dir))
    return found.select("feature", round6("importance").alias("importance"), round6("share").alias("share"))


_WATCHED = " ".join(f"WHEN '{f}' THEN '{a.replace(chr(39), chr(39) * 2)}'" for f, (a, _) in gd.PROXY_REGISTER.items())


@query(
    "proxy_report",
    f"""WITH {LONG_SQL}, per AS (SELECT feature, avg(abs(contribution)) AS importance FROM long GROUP BY feature),
    told AS (SELECT *, CASE feature {_WATCHED} END AS leaks FROM per)
    SELECT feature, round(importance, 6) AS importance, leaks IS NOT NULL AS watched, leaks FROM told""",
)
def proxy_report(spark, sf_dir):
    importance = ex.global_importance(explained(spark, sf_dir)).select("feature", "importance")
    report = ft.proxy_report(importance, gd.PROXY_REGISTER)
    return report.select("feature", round6("importance").alias("importance"), "watched", "leaks")


@query(
    "contribution_tally",
    f"""WITH {LONG_SQL} SELECT job_id, candidate_id, count(*) FILTER (contribution > 0) AS in_favour, count(*) FILTER (contribution < 0) AS against,
    count(*) FILTER (contribution = 0) AS no_effect, round(max(abs(contribution)), 6) AS widest FROM long GROUP BY job_id, candidate_id""",
)
def contribution_tally(spark, sf_dir):
    return explained(spark, sf_dir).select(*KEYS, *ex.contribution_tally()).withColumn("widest", round6("widest"))


REQUIREMENTS_SQL = f"""{FEATURES_SQL},
asked AS (SELECT *, list_contains(required_certifications, 'PROMO') AS gate_asked,
  len(list_filter(required_certifications, lambda c: c <> 'PROMO')) AS others,
  greatest(0.0, cert_overlap_count - CASE WHEN list_contains(required_certifications, 'PROMO') THEN licence_match ELSE 0 END) AS held_others FROM features),
requirements AS (
  SELECT job_id, candidate_id, 1 AS n, 'Minimum experience' AS label, CASE WHEN exp_gap IS NULL THEN 'not-stated' WHEN exp_gap >= 0 THEN 'met' ELSE 'unmet' END AS state
    FROM asked WHERE min_years_experience > 0
  UNION ALL SELECT job_id, candidate_id, 2, 'Security licence', CASE WHEN licence_match >= 1 THEN 'met' ELSE 'unmet' END FROM asked WHERE gate_asked
  UNION ALL SELECT job_id, candidate_id, 3, CASE WHEN others = 1 THEN 'Other required certification' ELSE 'Other required certifications' END,
    CASE WHEN held_others >= others THEN 'met' ELSE 'unmet' END FROM asked WHERE others > 0
  UNION ALL SELECT job_id, candidate_id, 4, 'Shift availability', CASE WHEN shift_match IS NULL THEN 'not-stated' WHEN shift_match >= 1 THEN 'met' ELSE 'unmet' END FROM asked
  UNION ALL SELECT job_id, candidate_id, 5, 'Site experience', CASE WHEN site_type_match IS NULL THEN 'not-stated' WHEN site_type_match >= 1 THEN 'met' ELSE 'unmet' END FROM asked
  UNION ALL SELECT job_id, candidate_id, 6, 'Driving licence', CASE WHEN driving_required_match IS NULL THEN 'not-stated' WHEN driving_required_match >= 1 THEN 'met' ELSE 'unmet' END
    FROM asked WHERE driving_required),
summary AS (SELECT job_id, candidate_id, count(*) AS asked, count(*) FILTER (state = 'met') AS met, count(*) FILTER (state = 'unmet') AS unmet,
  count(*) FILTER (state = 'not-stated') AS not_stated, coalesce(string_agg(label, '|' ORDER BY n) FILTER (state = 'met'), '') AS met_list,
  coalesce(string_agg(label, '|' ORDER BY n) FILTER (state <> 'met'), '') AS outstanding FROM requirements GROUP BY job_id, candidate_id)"""


def _requirements(spark, sf_dir):
    return features(spark, sf_dir, [*KEYS, *ASKED]).select(*KEYS, ex.requirement_states(GATE).alias("requirements"))


@query(
    "requirement_states",
    f"""WITH {REQUIREMENTS_SQL} SELECT job_id, candidate_id, string_agg(label || '=' || state, '|' ORDER BY n) AS states
    FROM requirements GROUP BY job_id, candidate_id""",
)
def requirement_states(spark, sf_dir):
    states = F.transform("requirements", lambda r: F.concat(r["label"], F.lit("="), r["state"]))
    return _requirements(spark, sf_dir).select(*KEYS, F.array_join(states, "|").alias("states"))


@query("requirement_summary", f"WITH {REQUIREMENTS_SQL} SELECT * FROM summary")
def requirement_summary(spark, sf_dir):
    rows = _requirements(spark, sf_dir).select(*KEYS, *ex.requirement_summary())
    return rows.withColumn("met_list", F.array_join("met_list", "|")).withColumn("outstanding", F.array_join("outstanding", "|"))


@query(
    "requirement_badge",
    f"""WITH {REQUIREMENTS_SQL} SELECT job_id, candidate_id, met || ' of ' || asked || ' requirements met'
    || CASE WHEN not_stated > 0 THEN ' · ' || not_stated || ' not stated' ELSE '' END AS badge FROM summary""",
)
def requirement_badge(spark, sf_dir):
    rows = _requirements(spark, sf_dir).select(*KEYS, *ex.requirement_summary())
    return rows.select(*KEYS, ex.requirement_badge(F.col("met"), F.col("asked"), F.col("not_stated")).alias("badge"))


@query(
    "years_from_gap",
    f"WITH {FEATURES_SQL} SELECT job_id, candidate_id, round(floor((exp_gap + min_years_experience) * 10 + 0.5) / 10, 6) AS years FROM features",
)
def years_from_gap(spark, sf_dir):
    rows = features(spark, sf_dir, [*KEYS, "min_years_experience"])
    return rows.select(*KEYS, round6(ex.years_from_gap(F.col("exp_gap"), F.col("min_years_experience"))).alias("years"))


@query(
    "format_feature",
    f"""WITH {FEATURES_SQL}, shown AS (SELECT job_id, candidate_id, exp_ratio AS v, score AS s FROM scored)
    SELECT job_id, candidate_id, CASE WHEN v IS NULL THEN 'not stated' WHEN v = floor(v) THEN format('{{:.0f}}', v) ELSE format('{{:.2f}}', v) END AS value_text,
    CASE WHEN s > 0 THEN '+' WHEN s < 0 THEN '−' ELSE '±' END || format('{{:.4f}}', abs(s)) AS score_text FROM shown""",
)
def format_feature(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.select(*KEYS, ex.format_feature(F.col("exp_ratio")).alias("value_text"), ex.format_contribution(F.col("score")).alias("score_text"))


GAPS_SQL = " + ".join(f"CAST({n} IS NULL AS INTEGER)" for n in NAMES)
SHORTLIST_SQL = f"""{FEATURES_SQL},
shortlist AS (SELECT s.job_id, s.candidate_id, s.score, {GAPS_SQL} AS n_gaps, CASE WHEN c_acctbal >= 0 THEN c_name END AS display_name,
  row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank FROM scored s JOIN customer ON c_custkey = candidate_id)"""


def shortlist(spark, sf_dir, rows=None):
    """Ranked pairs with the count of unstated facts and the private display name."""
    if rows is None:
        gaps = sum((F.col(n).isNull().cast("int") for n in NAMES[1:]), F.col(NAMES[0]).isNull().cast("int"))
        rows = scored(spark, sf_dir, KEYS).select(*KEYS, "score", gaps.alias("n_gaps"))
        sizes = pairs(spark, sf_dir)
    else:
        sizes = rows
    ranked = rk.rank_within(rows, ["job_id"], "score", ["candidate_id"], sizes=sizes)
    drafts = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("candidate_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("").alias("display_name")
    )
    names = sl.display_names(drafts, "candidate_id", "display_name").withColumn("candidate_id", F.col("candidate_id").cast("bigint"))
    return ranked.join(names, "candidate_id", "left")


@query(
    "display_names",
    "SELECT trim('  ' || c_custkey || ' ') AS candidate_id, c_name AS display_name FROM customer WHERE c_acctbal >= 0",
)
def display_names(spark, sf_dir):
    drafts = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("candidate_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise("").alias("display_name"),
    )
    return sl.display_names(drafts, "candidate_id", "display_name")


@query(
    "sort_views",
    f"""WITH {SHORTLIST_SQL} SELECT job_id, candidate_id, rank AS at_rank,
    row_number() OVER (PARTITION BY job_id ORDER BY score, candidate_id) AS at_score_asc,
    row_number() OVER (PARTITION BY job_id ORDER BY n_gaps DESC, rank, candidate_id) AS at_gaps FROM shortlist""",
)
def sort_views(spark, sf_dir):
    """Where each row stands in the different orders of one shortlist."""
    base = materialise(shortlist(spark, sf_dir).select(*KEYS, "rank", "n_gaps", (-F.col("score")).alias("neg_score")), "shortlist")
    by_score = rk.rank_within(base.withColumnRenamed("rank", "at_rank"), ["job_id"], "neg_score", ["candidate_id"], sizes=base)
    by_gaps = by_score.withColumnRenamed("rank", "at_score_asc").withColumn("gap_key", F.col("n_gaps").cast("double"))
    placed = rk.rank_within(by_gaps, ["job_id"], "gap_key", ["at_rank", "candidate_id"], sizes=base)
    return placed.select(*KEYS, "at_rank", "at_score_asc", F.col("rank").alias("at_gaps"))


@query(
    "filter_view",
    f"""WITH {SHORTLIST_SQL} SELECT job_id, candidate_id, rank, n_gaps FROM shortlist WHERE n_gaps > 0
    AND (contains(CAST(candidate_id AS VARCHAR), '42') OR contains(lower(coalesce(display_name, '')), '42'))""",
)
def filter_view(spark, sf_dir):
    view = sl.filter_view(shortlist(spark, sf_dir), query="  42 ", only_with_gaps=True)
    return view.select(*KEYS, "rank", "n_gaps")


@query(
    "shortlist_summary",
    f"""WITH {SHORTLIST_SQL} SELECT job_id, count(*) AS n_candidates, count(*) FILTER (n_gaps > 0) AS n_with_gaps,
    round(max(score), 6) AS top_score, CAST(sum(n_gaps) AS BIGINT) AS total_warnings FROM shortlist GROUP BY job_id""",
)
def shortlist_summary(spark, sf_dir):
    return sl.shortlist_summary(shortlist(spark, sf_dir), "job_id").withColumn("top_score", round6("top_score"))


def _full_shortlist(spark, sf_dir):
    """Scored pairs ranked, named and with reasons: features are computed once, ranked once.

    Ranked and named first: what travels is the numbers, not the contributions and sentences made of them.
    """
    rows = materialise(scored(spark, sf_dir, KEYS), "scored")
    kept = [*KEYS, "score", "rank", "display_name"]
    told = _by_effect(ex.attribute_additive(shortlist(spark, sf_dir, rows), ex.expected_terms(rows), kept))
    unknown = [F.get("contributions", F.lit(at))["value"].isNull().cast("int") for at in range(len(NAMES))]
    gaps = sum(unknown[1:], unknown[0])
    return told.select(
        *kept, gaps.alias("n_gaps"), "contributions", "base_value",
        F.array_join(ex.build_reasons(F.col("ranked"), F.col("total")), " | ").alias("reasons"),
    )


@query(
    "shortlist_csv",
    f"""WITH {REASONS_SQL}, named AS (SELECT s.job_id, s.candidate_id, s.score, {GAPS_SQL} AS n_gaps, reasons,
      CASE WHEN c_acctbal >= 0 THEN c_name ELSE '' END AS display_name,
      row_number() OVER (PARTITION BY s.job_id ORDER BY s.score DESC, s.candidate_id) AS rank
      FROM scored s JOIN reasons r ON s.job_id = r.job_id AND s.candidate_id = r.candidate_id JOIN customer ON c_custkey = s.candidate_id),
    lines AS (SELECT job_id, rank + 4 AS line_no, rank || ',' || candidate_id || ',' || display_name || ',' || format('{{:.4f}}', score) || ',relative_ranking_score,' || n_gaps || ','
      || CASE WHEN contains(reasons, ',') THEN '"' || reasons || '"' ELSE reasons END AS line FROM named
    UNION ALL SELECT DISTINCT job_id, 1, 'DISCLAIMER: {sl.DISCLAIMER}' FROM named
    UNION ALL SELECT DISTINCT job_id, 2, 'Posting ' || job_id || ' · model v1 · request r1. Scores are relative to this posting only and are not comparable with any other.' FROM named
    UNION ALL SELECT DISTINCT job_id, 3, '' FROM named
    UNION ALL SELECT DISTINCT job_id, 4, 'rank,reference,name,score,score_type,cv_gaps,reasons' FROM named)
    SELECT job_id, line_no, line FROM lines""",
)
def shortlist_csv(spark, sf_dir):
    return sl.shortlist_csv(_full_shortlist(spark, sf_dir), "job_id", VERSION, REQUEST)


@query("shortlist_csv_files", ORACLES["shortlist_csv"])
def shortlist_csv_files(spark, sf_dir):
    """Every list exported to numbered files in the shared folder, then read back in order.

    The lines are many times as long as the rows they are made from, so the files are compressed.
    """
    path = scratch_path(spark, "lists")
    sl.write_csv_lines(shortlist_csv(spark, sf_dir), "job_id", path, compression="gzip")
    return sl.read_csv_lines(spark, path, "job_id").withColumn("job_id", F.col("job_id").cast("bigint"))


@query(
    "export_name",
    "SELECT DISTINCT s_suppkey AS job_id, 'shortlist-' || regexp_replace(s_name, '[^a-zA-Z0-9._-]+', '_', 'g') || '-v1.csv' AS file_name FROM supplier",
)
def export_name(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("job_id"), sl.export_name(F.col("s_name"), VERSION).alias("file_name")
    )


@query(
    "rank_response",
    f"""WITH {REASONS_SQL}, named AS (SELECT s.job_id, s.candidate_id, s.score, {GAPS_SQL} AS n_gaps, reasons,
      row_number() OVER (PARTITION BY s.job_id ORDER BY s.score DESC, s.candidate_id) AS rank
      FROM scored s JOIN reasons r ON s.job_id = r.job_id AND s.candidate_id = r.candidate_id)
    SELECT job_id, rank, candidate_id, format('{{:.4f}}', score) AS score, 'relative_ranking_score' AS score_type, n_gaps, 12 AS n_contributions, reasons,
    '{sl.DISCLAIMER}' AS disclaimer, 'v1' AS model_version FROM named""",
)
def rank_response(spark, sf_dir):
    """The final shortlist rows: one plan from pairs to explained, ranked answers."""
    return _full_shortlist(spark, sf_dir).select(
        "job_id", "rank", "candidate_id", fixed(F.col("score"), 4).alias("score"), F.lit(sl.SCORE_TYPE).alias("score_type"), "n_gaps",
        F.size("contributions").alias("n_contributions"), "reasons", F.lit(sl.DISCLAIMER).alias("disclaimer"), F.lit(VERSION).alias("model_version"),
    )
