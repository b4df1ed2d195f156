"""Pair construction, features, scoring and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairrank.functions.stats import round6
from pairrank.operators import boosting as bo
from pairrank.operators import features as ft
from pairrank.operators import fairness as fr
from pairrank.operators import guards as gd
from pairrank.operators import monitor as mo
from pairrank.operators import ranking as rk
from pairrank.operators import training as tr
from pairrank.plans.entities import (
    APPEARANCES_SQL,
    CRITICAL,
    CRITICAL_SITES,
    FEATURES_SQL,
    GATE,
    PAIRED_SQL,
    PAIRS_SQL,
    POSTINGS_SQL,
    PROFILES_SQL,
    RANK_IDS,
    appearances,
    pairs,
    postings,
    profiles,
    table,
)
from pairrank.plans.registry import query
from pairrank.session import materialise
from pairrank.sources import models as md
from pairrank.sources import tables as tb

KEYS = ["job_id", "candidate_id"]


def paired(spark, sf_dir):
    return ft.pair_join(pairs(spark, sf_dir), profiles(spark, sf_dir), postings(spark, sf_dir))


def features(spark, sf_dir, keep=("job_id", "candidate_id", "grade")):
    return ft.build_features(paired(spark, sf_dir), GATE, CRITICAL, list(keep))


def _feature_sql(name):
    return f"WITH {FEATURES_SQL} SELECT job_id, candidate_id, round({name}, 6) AS {name} FROM features"


def _one_feature(key, name):
    @query(key, _feature_sql(name))
    def build(spark, sf_dir):
        return features(spark, sf_dir).select(*KEYS, round6(name).alias(name))

    return build


@query(
    "pair_join",
    f"""WITH {PAIRED_SQL} SELECT job_id, candidate_id, grade, years_experience, min_years_experience,
    array_to_string(certifications, '|') AS certifications, array_to_string(required_certifications, '|') AS required,
    array_to_string(shift_availability, '|') AS shifts, shift_pattern FROM paired""",
)
def pair_join(spark, sf_dir):
    return paired(spark, sf_dir).select(
        *KEYS, "grade", "years_experience", "min_years_experience",
        F.array_join("certifications", "|").alias("certifications"),
        F.array_join("required_certifications", "|").alias("required"),
        F.array_join("shift_availability", "|").alias("shifts"), "shift_pattern",
    )


REQUESTS_SQL = """requests AS (SELECT s_nationkey AS nation, s_suppkey AS job_id FROM (SELECT *, row_number() OVER
  (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) WHERE place = 1)"""


@query(
    "pair_cross",
    f"""WITH {REQUESTS_SQL}, {POSTINGS_SQL} SELECT p.job_id, c_custkey AS candidate_id, shift_pattern
    FROM customer JOIN requests ON c_nationkey = nation JOIN postings p ON p.job_id = requests.job_id""",
)
def pair_cross(spark, sf_dir):
    """One request per nation: its customers against its one posting, by the request key."""
    suppliers = table(spark, sf_dir, "supplier")
    best = suppliers.groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.min_by("s_suppkey", F.struct((-F.col("s_acctbal")).alias("b"), "s_suppkey")).alias("job_id")
    )
    requests = best.join(postings(spark, sf_dir), "job_id")
    candidates = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("candidate_id"), F.col("c_nationkey").alias("nation")
    )
    return ft.pair_request(candidates, requests, "nation").select(*KEYS, "shift_pattern")


for _key in ("exp_gap", "exp_ratio", "licence_match", "cert_overlap_ratio", "cert_overlap_count", "missing_critical_cert",
             "shift_match", "site_type_match", "driving_required_match", "extra_cert_count"):
    _one_feature(_key, _key)
_one_feature("role_count_capped", "role_count")
_one_feature("recency_capped", "recency_months")

_ALL = ", ".join(f"round({n}, 6) AS {n}" for n in ft.FEATURE_NAMES)


@query("build_features", f"WITH {FEATURES_SQL} SELECT job_id, candidate_id, grade, {_ALL} FROM features")
def build_features(spark, sf_dir):
    return features(spark, sf_dir).select(*KEYS, "grade", *[round6(n).alias(n) for n in ft.FEATURE_NAMES])


_VECTOR = " || '|' || ".join(f"coalesce(CAST(CAST(floor({n} * 1000 + 0.5) AS BIGINT) AS VARCHAR), 'null')" for n in ft.FEATURE_NAMES)


@query("to_vector", f"WITH {FEATURES_SQL} SELECT job_id, candidate_id, {_VECTOR} AS vector FROM features")
def to_vector(spark, sf_dir):
    vectors = ft.to_vector(features(spark, sf_dir, KEYS), KEYS)
    thousandths = F.transform("vector", lambda v: F.coalesce(F.floor(v * 1000 + 0.5).cast("string"), F.lit("null")))
    return vectors.select(*KEYS, F.array_join(thousandths, "|").alias("vector"))


@query(
    "contract_diff",
    """WITH stored AS (SELECT p_type AS name, row_number() OVER (ORDER BY p_type) AS position FROM (SELECT DISTINCT p_type FROM part)),
    seen AS (SELECT p_type AS name, row_number() OVER (ORDER BY min(p_partkey)) AS position FROM part GROUP BY p_type),
    brands AS (SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) AS position FROM (SELECT DISTINCT p_brand FROM part)),
    sold AS (SELECT name, row_number() OVER (ORDER BY name) AS position FROM (SELECT DISTINCT p_brand AS name FROM part WHERE p_retailprice < 1000
      UNION SELECT DISTINCT p_type FROM part)),
    diffs AS (SELECT 'same' AS pair, s.name AS a, c.name AS b, s.position AS p, c.position AS q FROM stored s FULL JOIN stored c ON s.name = c.name
      UNION ALL SELECT 'by first use', s.name, c.name, s.position, c.position FROM stored s FULL JOIN seen c ON s.name = c.name
      UNION ALL SELECT 'other set', s.name, c.name, s.position, c.position FROM brands s FULL JOIN sold c ON s.name = c.name)
    SELECT pair, CASE WHEN count(*) FILTER (p IS NULL OR q IS NULL) > 0 THEN 'set differs'
      WHEN count(*) FILTER (p <> q) > 0 THEN 'order differs' ELSE 'identical' END AS status,
      coalesce(string_agg(a, '|' ORDER BY a) FILTER (b IS NULL), '') AS only_stored,
      coalesce(string_agg(b, '|' ORDER BY b) FILTER (a IS NULL), '') AS only_current FROM diffs GROUP BY pair""",
)
def contract_diff(spark, sf_dir):
    """Feature lists derived from the part table, as stored and as found now."""
    part = table(spark, sf_dir, "part")

    def positioned(names, order):
        # A list of column names: as short as the set of types or brands.
        listed = names.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "name"))).alias("list"))
        return listed.select(F.posexplode("list").alias("position", "item")).select(F.col("item.name").alias("name"), "position")

    types = part.groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("first"))
    stored, seen = positioned(types, "name"), positioned(types, "first")
    brands = positioned(part.select(F.col("p_brand").alias("name")).distinct(), "name")
    cheap = part.where("p_retailprice < 1000").select(F.col("p_brand").alias("name"))
    sold = positioned(cheap.union(part.select("p_type")).distinct(), "name")
    cases = {"same": (stored, stored), "by first use": (stored, seen), "other set": (brands, sold)}
    result = None
    for pair, (a, b) in cases.items():
        diff = ft.contract_diff(a, b).select(
            F.lit(pair).alias("pair"), "status", F.array_join("only_stored", "|").alias("only_stored"),
            F.array_join("only_current", "|").alias("only_current"),
        )
        result = diff if result is None else result.unionByName(diff)
    return result


_NAMES = ", ".join(f"'{n}'" for n in gd.BLOCKED_NAMES)
_TOKENS = ", ".join(f"'{n}'" for n in gd.BLOCKED_TOKENS)
_FRAGMENTS = " OR ".join(f"contains(k, '{n}')" for n in gd.BLOCKED_FRAGMENTS)


@query(
    "blocked_columns",
    f"""WITH words AS (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents
      UNION ALL SELECT unnest(string_split_regex(html, '[^A-Za-z_-]+')) FROM pages
      UNION ALL SELECT p_name || '_' || lower(p_brand) FROM part UNION ALL SELECT 'candidate_' || event_type || '-age' FROM events),
    names AS (SELECT DISTINCT w AS name, lower(trim(w)) AS k FROM words WHERE w <> '')
    SELECT name FROM names WHERE k IN ({_NAMES}) OR {_FRAGMENTS}
      OR len(list_intersect(string_split_regex(k, '[_-]'), [{_TOKENS}])) > 0""",
)
def blocked_columns(spark, sf_dir):
    """Every word of the corpus tried as a column name."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("name"))
    tags = table(spark, sf_dir, "pages").select(F.explode(F.split("html", "[^A-Za-z_-]+")).alias("name"))
    parts = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("_"), F.lower("p_brand")).alias("name"))
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("candidate_"), "event_type", F.lit("-age")).alias("name"))
    names = words.union(tags).union(parts).union(events).where("name <> ''").distinct()
    return gd.blocked_columns(names)


@query("assert_clean", f"WITH {PAIRED_SQL} SELECT job_id, count(*) AS n_pairs FROM paired GROUP BY job_id")
def assert_clean(spark, sf_dir):
    """The guard passes over the real feature frame and then lets it through unchanged."""
    frame = features(spark, sf_dir)
    gd.assert_clean(frame)
    return frame.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_pairs"))


BASELINE_COLUMNS = "job_id, candidate_id, round(score, 6) AS score"


def scored(spark, sf_dir, keep=("job_id", "candidate_id", "grade")):
    return features(spark, sf_dir, keep).withColumn("score", ft.baseline_score())


@query("baseline_score", f"WITH {FEATURES_SQL} SELECT {BASELINE_COLUMNS} FROM scored")
def baseline_score(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, round6("score").alias("score"))


@query("score_single", f"WITH {FEATURES_SQL} SELECT {BASELINE_COLUMNS}, 'relative_ranking_score' AS score_type FROM scored")
def score_single(spark, sf_dir):
    """Pairs scored one by one: no window, no rank column."""
    return scored(spark, sf_dir).select(*KEYS, round6("score").alias("score"), F.lit("relative_ranking_score").alias("score_type"))


FIT_SQL = f"""{PAIRED_SQL},
latent AS (SELECT *, (candidate_id * 7 % 100) / 100.0 AS latent_a, (candidate_id * 13 % 100) / 100.0 AS latent_b,
  len(list_intersect(required_certifications, certifications)) AS overlap, coalesce(years_experience, 0.0) AS yrs,
  list_contains(certifications, 'PROMO') AS has_gate, list_contains(required_certifications, 'PROMO') AS needs_gate,
  list_contains(shift_availability, shift_pattern) AS shift_ok, list_contains(site_experience, site_type) AS site_ok FROM paired),
summed AS (SELECT *, 0.30 * (CASE WHEN len(required_certifications) = 0 THEN 1.0 ELSE overlap / CAST(len(required_certifications) AS DOUBLE) END)
  + 0.20 * (least(yrs / greatest(min_years_experience, 1.0), 1.5) / 1.5) + 0.15 * CAST(shift_ok AS INTEGER) + 0.08 * CAST(site_ok AS INTEGER)
  + 0.07 * CAST((NOT driving_required OR coalesce(driving_licence, false)) AS INTEGER) + 0.12 * latent_a + 0.08 * latent_b AS total FROM latent),
fit AS (SELECT job_id, candidate_id, greatest(0.0, least(1.0,
  (CASE WHEN needs_gate AND NOT has_gate THEN total * 0.25 ELSE total END)
  + (CASE WHEN has_gate AND yrs >= min_years_experience THEN 0.10 ELSE 0.0 END)
  - (CASE WHEN shift_ok THEN 0.0 WHEN site_type IN ('anvil', 'bolt') THEN 0.12 ELSE 0.04 END))) AS fit FROM summed)"""


def _fit(spark, sf_dir):
    latent = paired(spark, sf_dir).select(
        "*", (F.col("candidate_id") * 7 % 100 / 100.0).alias("latent_a"), (F.col("candidate_id") * 13 % 100 / 100.0).alias("latent_b")
    )
    return latent.select(*KEYS, ft.fit_score(GATE, CRITICAL_SITES, "latent_a", "latent_b").alias("fit"))


@query("fit_score", f"WITH {FIT_SQL} SELECT job_id, candidate_id, round(fit, 6) AS fit FROM fit")
def fit_score(spark, sf_dir):
    return _fit(spark, sf_dir).withColumn("fit", round6("fit"))


@query(
    "to_grade",
    f"""WITH {FIT_SQL}, rounded AS (SELECT job_id, candidate_id, round(fit, 9) AS f FROM fit)
    SELECT job_id, candidate_id, CASE WHEN f >= 0.82 THEN 3 WHEN f >= 0.68 THEN 2 WHEN f >= 0.50 THEN 1 ELSE 0 END AS grade FROM rounded""",
)
def to_grade(spark, sf_dir):
    return _fit(spark, sf_dir).select(*KEYS, ft.to_grade(F.round("fit", 9)).alias("grade"))


_UNIT = "CAST(('0x' || substr(md5('{seed}|{tag}|' || job_id || '|' || candidate_id), 1, 12)) AS BIGINT) / 281474976710656.0"


@query(
    "label_noise",
    f"""WITH {PAIRS_SQL}, drawn AS (SELECT *, {_UNIT.format(seed=42, tag="hit")} AS hit, {_UNIT.format(seed=42, tag="sign")} AS sign FROM pairs)
    SELECT job_id, candidate_id, grade, CASE WHEN hit < 0.12 THEN greatest(0, least(3, grade + CASE WHEN sign < 0.5 THEN -1 ELSE 1 END))
      ELSE grade END AS noisy_grade FROM drawn""",
)
def label_noise(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return rows.withColumn("noisy_grade", ft.noisy_grade(F.col("grade"), 42, KEYS))


@query(
    "sample_group",
    f"""WITH {PAIRS_SQL}, drawn AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY md5('7|' || job_id || '|' || candidate_id), candidate_id) AS place,
      40 + CAST(floor(CAST(('0x' || substr(md5('7|size|' || job_id), 1, 12)) AS BIGINT) / 281474976710656.0 * 41) AS INTEGER) AS size FROM pairs)
    SELECT job_id, candidate_id, grade FROM drawn WHERE place <= size""",
)
def sample_group(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    drawn = rows.select("job_id", "candidate_id", "grade", F.col("job_id").alias("again"))
    return ft.sample_group(drawn, "job_id", ["candidate_id"], seed=7).select(*KEYS, "grade")


@query(
    "group_split",
    """WITH drawn AS (SELECT l_suppkey AS job_id, md5('42|' || l_suppkey) AS draw FROM (SELECT DISTINCT l_suppkey FROM lineitem))
    SELECT job_id, CASE WHEN row_number() OVER (ORDER BY draw, job_id) <= floor((SELECT count(*) FROM drawn) * 0.75)
      THEN 'train' ELSE 'valid' END AS split FROM drawn""",
)
def group_split(spark, sf_dir):
    return ft.group_split(appearances(spark, sf_dir), "job_id", seed=42)


@query("group_sizes", f"WITH {PAIRS_SQL} SELECT job_id, count(*) AS group_size FROM pairs GROUP BY job_id")
def group_sizes(spark, sf_dir):
    return ft.group_sizes(pairs(spark, sf_dir), "job_id")


LAMBDA_SQL = f"""WITH {APPEARANCES_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey) AS rank,
  row_number() OVER (PARTITION BY job_id ORDER BY grade DESC, l_orderkey, l_linenumber, l_partkey, score) AS best FROM appearances),
ideal AS (SELECT job_id, sum((2 ** grade - 1) / log2(best + 1)) AS idcg FROM ranked WHERE best <= 10 GROUP BY job_id),
pairs AS (SELECT a.job_id, a.l_orderkey, a.l_linenumber, a.l_partkey, a.score,
  CASE WHEN a.grade > b.grade THEN 1 ELSE -1 END * abs((2 ** a.grade - 2 ** b.grade) * (1 / log2(a.rank + 1) - 1 / log2(b.rank + 1))) / idcg AS delta,
  1 / (1 + exp(CASE WHEN a.grade > b.grade THEN 1 ELSE -1 END * (a.score - b.score) / 100000.0)) AS rho
  FROM ranked a JOIN ranked b ON a.job_id = b.job_id AND a.grade <> b.grade AND least(a.rank, b.rank) <= 10 JOIN ideal i ON a.job_id = i.job_id WHERE idcg > 0),
summed AS (SELECT job_id, l_orderkey, l_linenumber, l_partkey, score, sum(delta * rho) AS gradient, sum(abs(delta) * rho * (1 - rho)) AS hessian
  FROM pairs GROUP BY ALL)
SELECT r.job_id, r.l_orderkey, r.l_linenumber, r.l_partkey, r.score, round(coalesce(gradient, 0), 6) AS gradient, round(coalesce(hessian, 0), 6) AS hessian
FROM ranked r LEFT JOIN summed s USING (job_id, l_orderkey, l_linenumber, l_partkey, score)"""


@query("lambda_gradients", LAMBDA_SQL)
def lambda_gradients(spark, sf_dir):
    rows = appearances(spark, sf_dir).select("job_id", *RANK_IDS, "score", "grade")
    found = tr.lambda_gradients(rows, "job_id", "score", RANK_IDS, scale=100000.0)
    return found.select("job_id", *RANK_IDS, "score", round6("gradient").alias("gradient"), round6("hessian").alias("hessian"))


def _split(rows):
    return tr.train_valid(rows, "job_id", seed=42)


def _fitted(spark, sf_dir):
    """The features, written once, and the model of the default settings on them, fitted by whoever asks first."""
    rows = materialise(features(spark, sf_dir), "features")
    return rows, md.fitted_on(rows, _split, "job_id", ["candidate_id"])


@query("rank_boost_fit")
def rank_boost_fit(spark, sf_dir):
    """A fit on the pair features with the default rounds and early stopping; its validation quality per round."""
    return _fitted(spark, sf_dir)[1]["history"].select("round", round6("ndcg_at_10").alias("ndcg_at_10"))


@query("grid_select")
def grid_select(spark, sf_dir):
    """Every setting of the default grid with the default rounds and early stopping, side by side."""
    train, valid = _split(materialise(features(spark, sf_dir), "features"))
    return bo.grid_select(train, valid, "job_id", ["candidate_id"]).trials


@query("predict_scores")
def predict_scores(spark, sf_dir):
    """Every pair scored by the stored ensemble."""
    rows, stored = _fitted(spark, sf_dir)
    return bo.predict_scores(md.ensemble(stored), rows).select(*KEYS, round6("score").alias("score"))


@query("attribute_trees")
def attribute_trees(spark, sf_dir):
    """Shapley contributions of the stored ensemble for every held-out pair, with the additivity gap."""
    rows, stored = _fitted(spark, sf_dir)
    model = md.ensemble(stored)
    _, valid = _split(rows)
    explained = bo.attribute_trees(model, bo.predict_scores(model, valid))
    total = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    return explained.select(
        *KEYS, round6("score").alias("score"), round6("base_value").alias("base_value"),
        F.array_join(F.transform("contributions", lambda c: F.round(c, 6).cast("string")), "|").alias("contributions"),
        (F.abs(total - F.col("score")) <= 1e-6).alias("holds"),
    )


@query(
    "grade_distribution",
    f"""WITH {PAIRS_SQL}, counts AS (SELECT grade, count(*) AS n FROM pairs GROUP BY grade)
    SELECT CAST(g AS INTEGER) AS grade, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST((SELECT count(*) FROM pairs) AS DOUBLE), 6) AS share
    FROM range(4) t(g) LEFT JOIN counts ON g = grade""",
)
def grade_distribution(spark, sf_dir):
    return tb.grade_distribution(pairs(spark, sf_dir)).withColumn("share", round6("share"))


@query(
    "pairwise_check",
    f"""WITH {PAIRS_SQL}, per AS (SELECT candidate_id, count(*) AS n, count(DISTINCT grade) > 1 AS varies FROM pairs GROUP BY candidate_id)
    SELECT count(*) AS n_items, count(*) FILTER (varies) AS n_varying, round(count(*) FILTER (varies) / CAST(count(*) AS DOUBLE), 6) AS share_varying
    FROM per WHERE n >= 3""",
)
def pairwise_check(spark, sf_dir):
    return mo.pairwise_check(pairs(spark, sf_dir), "candidate_id").withColumn("share_varying", round6("share_varying"))


@query(
    "group_depth",
    f"""WITH {PAIRS_SQL}, per AS (SELECT job_id, count(*) AS n, count(*) FILTER (grade = 3) AS top FROM pairs GROUP BY job_id)
    SELECT count(*) AS n_groups, min(n) AS smallest, max(n) AS largest, round(quantile_cont(top, 0.5), 6) AS median_top_grade FROM per""",
)
def group_depth(spark, sf_dir):
    return mo.group_depth(pairs(spark, sf_dir), "job_id").withColumn("median_top_grade", round6("median_top_grade"))


@query(
    "feature_drift_snapshot",
    "WITH " + FEATURES_SQL + " " + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, count({n}) AS n, round(avg({n}), 6) AS mean, round(coalesce(stddev_samp({n}), 0), 6) AS stdev FROM features HAVING count({n}) > 0"
        for n in ft.FEATURE_NAMES
    ),
)
def feature_drift_snapshot(spark, sf_dir):
    snap = mo.feature_drift_snapshot(features(spark, sf_dir), ft.FEATURE_NAMES)
    return snap.select("feature", "n", round6("mean").alias("mean"), round6("stdev").alias("stdev"))


def _histogram_sql(cte, value, bounds, relation, by=""):
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    labels = [str(b) for b in bounds] + ["+Inf"]
    parts = [f"count(*) FILTER ({value} <= {b})" for b in bounds] + [f"count({value})"]
    return f"{cte} " + " UNION ALL ".join(
        f"SELECT {lead}count({value}) AS n, round(sum({value}), 4) AS total, '{le}' AS le, {p} AS cumulative FROM {relation} {group}"
        for le, p in zip(labels, parts, strict=True)
    )


@query("score_histogram", _histogram_sql(f"WITH {FEATURES_SQL}", "score", mo.SCORE_BUCKETS, "scored"))
def score_histogram(spark, sf_dir):
    return mo.histogram(scored(spark, sf_dir), "score", mo.SCORE_BUCKETS).withColumn("total", F.round("total", 4))


@query(
    "batch_size_histogram",
    _histogram_sql(
        f"WITH {PAIRS_SQL}, sizes AS (SELECT CAST(count(*) AS DOUBLE) AS batch_size FROM pairs GROUP BY job_id)",
        "batch_size", mo.BATCH_BUCKETS, "sizes",
    ),
)
def batch_size_histogram(spark, sf_dir):
    return mo.batch_size_histogram(pairs(spark, sf_dir), "job_id").withColumn("total", F.round("total", 4))


@query(
    "batch_constraints",
    """WITH per AS (SELECT l_suppkey AS job_id, count(*) AS n, count(DISTINCT o_custkey) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT job_id, n AS n_rows, d AS n_items, n < 1 AS is_empty, n > 500 AS over_limit, n <> d AS has_duplicates, greatest(0, 500 - n) AS remaining_capacity FROM per""",
)
def batch_constraints(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("job_id"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return gd.batch_constraints(rows, "job_id", "o_custkey")


@query(
    "canonical_set",
    f"WITH {PROFILES_SQL} SELECT candidate_id, array_to_string(list_sort(list_distinct(list_concat(shift_availability, certifications))), '|') AS codes FROM profiles",
)
def canonical_set(spark, sf_dir):
    people = profiles(spark, sf_dir)
    return people.select(
        "candidate_id", F.array_join(tb.canonical_set(F.concat("shift_availability", "certifications")), "|").alias("codes")
    )


@query(
    "critical_codes",
    f"""WITH {PAIRED_SQL} SELECT job_id, candidate_id, list_contains(certifications, 'PROMO') AS has_code,
    array_to_string(list_intersect(required_certifications, ['PROMO']), '|') AS critical_codes FROM paired""",
)
def critical_codes(spark, sf_dir):
    return paired(spark, sf_dir).select(
        *KEYS, F.array_contains("certifications", GATE).alias("has_code"),
        F.array_join(ft.required_critical(CRITICAL), "|").alias("critical_codes"),
    )


@query(
    "has_code",
    f"WITH {PROFILES_SQL} SELECT candidate_id, list_contains(certifications, 'PROMO') AS has_code FROM profiles",
)
def has_code(spark, sf_dir):
    return profiles(spark, sf_dir).select("candidate_id", F.array_contains("certifications", GATE).alias("has_code"))


BASELINE_SQL = f"""WITH {FEATURES_SQL},
ordered AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, candidate_id) AS rank,
  row_number() OVER (PARTITION BY job_id ORDER BY grade DESC, candidate_id) AS best FROM scored),
hit AS (SELECT *, sum(CASE WHEN grade >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY rank) AS hits FROM ordered),
per AS (SELECT job_id, coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 5), 0) AS d5, coalesce(sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= 10), 0) AS d10,
  coalesce(sum((2 ** grade - 1) / log2(best + 1)) FILTER (best <= 5), 0) AS i5, coalesce(sum((2 ** grade - 1) / log2(best + 1)) FILTER (best <= 10), 0) AS i10,
  coalesce(sum(hits / CAST(rank AS DOUBLE)) FILTER (grade >= 2), 0) AS p, count(*) FILTER (grade >= 2) AS nr, min(rank) FILTER (grade >= 2) AS f FROM hit GROUP BY job_id)
SELECT round(avg(CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0 END), 6) AS ndcg_at_5, round(avg(CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END), 6) AS ndcg_at_10,
  round(avg(CASE WHEN nr > 0 THEN p / nr ELSE 0 END), 6) AS mean_average_precision, round(avg(coalesce(1.0 / f, 0)), 6) AS mean_reciprocal_rank, count(*) AS n_groups,
  avg(CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0 END) > 0.95 AS circularity_suspected FROM per"""


@query("evaluate_baseline", BASELINE_SQL)
def evaluate_baseline(spark, sf_dir):
    """The rule scorer measured on the labelled pairs."""
    metrics = rk.posting_metrics(scored(spark, sf_dir), ["job_id"], "score", ["candidate_id"], sizes=pairs(spark, sf_dir))
    summary = rk.evaluate_ranking(metrics)
    return summary.select(*[round6(c).alias(c) if t == "double" else F.col(c) for c, t in summary.dtypes])


@query(
    "night_rate_by_segment",
    """WITH n AS (SELECT o_custkey, bool_or(o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS nights FROM orders GROUP BY o_custkey),
    r AS (SELECT c_mktsegment AS segment, count(*) AS n, avg(CASE WHEN nights THEN 1.0 ELSE 0.0 END) AS rate
      FROM customer LEFT JOIN n ON c_custkey = o_custkey WHERE c_acctbal >= 0 GROUP BY c_mktsegment)
    SELECT round(max(rate) - min(rate), 6) AS gap, CASE WHEN max(rate) - min(rate) > 0.10 THEN 'unexpected gap' END AS warning FROM r""",
)
def night_rate_by_segment(spark, sf_dir):
    people = profiles(spark, sf_dir).join(
        table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("segment")),
        "candidate_id",
    )
    domain = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    rates = fr.conditional_rate_by_group(people, "segment", F.array_contains("shift_availability", "night"), domain)
    return fr.rate_gap(rates, expected_biased=False).withColumn("gap", round6("gap"))
