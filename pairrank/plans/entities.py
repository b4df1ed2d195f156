"""The test tables seen as postings, pairs, profiles and documents.

Each view exists twice: as a DataFrame for the engine and as a common table
expression for the SQL twin of a query. The document view renders text from
columns, so its SQL twin states the facts from the columns and never parses text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.functions.vocab import NUMBER_WORDS
from pairrank.session import spread_rows

GATE = "PROMO"
CRITICAL = ("PROMO",)
CRITICAL_SITES = ("anvil", "bolt")
SHIFT_OF_REGION = ("day", "night", "weekend", "rotating", "night")
SITES = ("widget", "anvil", "gear", "gizmo", "ring", "bolt", "plate", "rod")
RANK_IDS = ["l_orderkey", "l_linenumber", "l_partkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grade_of_quantity(quantity: Column) -> Column:
    return F.when(quantity >= 44, 3).when(quantity >= 36, 2).when(quantity >= 21, 1).otherwise(0)


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per appearance of an item in a posting, with score and grade."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("job_id"),
        *RANK_IDS,
        F.col("l_extendedprice").alias("score"),
        grade_of_quantity(F.col("l_quantity")).alias("grade"),
        F.col("l_discount").alias("other_score"),
    )


GRADE_SQL = "CASE WHEN l_quantity >= 44 THEN 3 WHEN l_quantity >= 36 THEN 2 WHEN l_quantity >= 21 THEN 1 ELSE 0 END"
APPEARANCES_SQL = f"""appearances AS (
  SELECT l_suppkey AS job_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS score,
         {GRADE_SQL} AS grade, l_discount AS other_score
  FROM lineitem)"""
RANKED_SQL = (
    APPEARANCES_SQL
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, l_orderkey, l_linenumber, l_partkey) AS rank
  FROM appearances)"""
)


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group values per order, kept apart from the ranking columns.

    Customers with a negative balance have no record, so their rows are unmapped.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
    )


DEMOGRAPHICS_SQL = """demographics AS (
  SELECT o_orderkey AS l_orderkey, c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per customer; set columns sorted and distinct, unknowns null."""
    orders = table(spark, sf_dir, "orders")
    shift = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "night")
        .when(F.col("o_orderpriority") == "2-HIGH", "day")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "weekend")
        .when(F.col("o_orderpriority") == "5-LOW", "rotating")
    )
    history = orders.groupBy("o_custkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "P", shift))).alias("shift_availability"),
        F.when(F.count_if(F.col("o_orderstatus") == "O") > 0, F.count_if(F.col("o_orderstatus") == "F"))
        .cast("int")
        .alias("previous_role_count"),
        ((F.lit(2003) - F.max(F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate")))) * 12).alias(
            "months_since_last_role"
        ),
    )
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 44").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"))
    held = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_custkey")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("l_quantity") >= 47, F.col("p_type")))).alias("certifications"),
            F.array_sort(F.collect_set("noun")).alias("site_experience"),
        )
    )
    nothing = F.array().cast("array<string>")
    segment = F.col("c_mktsegment")
    return (
        table(spark, sf_dir, "customer")
        .join(history.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
        .join(held, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("candidate_id"),
            F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 50) / 10.0).alias("years_experience"),
            F.coalesce("certifications", nothing).alias("certifications"),
            F.when(segment.isin("BUILDING", "MACHINERY"), True)
            .when(segment.isin("FURNITURE", "AUTOMOBILE"), False)
            .alias("driving_licence"),
            F.coalesce("shift_availability", nothing).alias("shift_availability"),
            F.coalesce("site_experience", nothing).alias("site_experience"),
            "previous_role_count",
            "months_since_last_role",
        )
    )


PROFILES_SQL = """history AS (
  SELECT o_custkey,
    list_sort(coalesce(list(DISTINCT CASE o_orderpriority WHEN '1-URGENT' THEN 'night' WHEN '2-HIGH' THEN 'day'
      WHEN '3-MEDIUM' THEN 'weekend' WHEN '5-LOW' THEN 'rotating' END)
      FILTER (o_orderstatus = 'P' AND o_orderpriority <> '4-NOT SPECIFIED'), [])) AS shift_availability,
    CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN CAST(count(*) FILTER (o_orderstatus = 'F') AS INTEGER) END
      AS previous_role_count,
    CAST((2003 - max(year(o_orderdate)) FILTER (o_orderstatus = 'F')) * 12 AS INTEGER) AS months_since_last_role
  FROM orders GROUP BY o_custkey),
held AS (
  SELECT o_custkey,
    list_sort(coalesce(list(DISTINCT p_type) FILTER (l_quantity >= 47), [])) AS certifications,
    list_sort(list(DISTINCT split_part(p_name, ' ', 2))) AS site_experience
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE l_quantity >= 44 GROUP BY o_custkey),
profiles AS (
  SELECT c_custkey AS candidate_id,
    CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 50) / 10.0 END AS years_experience,
    coalesce(certifications, []) AS certifications,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN true
         WHEN c_mktsegment IN ('FURNITURE', 'AUTOMOBILE') THEN false END AS driving_licence,
    coalesce(shift_availability, []) AS shift_availability,
    coalesce(site_experience, []) AS site_experience,
    previous_role_count, months_since_last_role
  FROM customer LEFT JOIN history h ON c_custkey = h.o_custkey LEFT JOIN held d ON c_custkey = d.o_custkey)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per supplier: the three part types it sells most of are required."""
    sold = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("l_suppkey", "p_type")
        .agg(F.sum("l_quantity").alias("quantity"))
    )
    # One entry per (supplier, type) is left, so the list per supplier is as short
    # as the list of types.
    types = sold.groupBy("l_suppkey").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("quantity")).alias("q"), "p_type"))).alias("types")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    top = F.transform(F.slice("types", 1, 3), lambda t: t["p_type"])
    balance = F.col("s_acctbal")
    return (
        table(spark, sf_dir, "supplier")
        .join(types, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("job_id"),
            F.when((balance >= 0) & F.col("types").isNotNull(), F.array_sort(top))
            .otherwise(F.array().cast("array<string>"))
            .alias("required_certifications"),
            F.floor(F.greatest(balance, F.lit(0.0)) / 1000).cast("double").alias("min_years_experience"),
            F.get(F.array(*[F.lit(s) for s in SHIFT_OF_REGION]), F.col("n_regionkey")).alias("shift_pattern"),
            F.get(F.array(*[F.lit(s) for s in SITES]), F.col("s_nationkey") % len(SITES)).alias("site_type"),
            (balance > 4000).alias("driving_required"),
        )
    )


POSTINGS_SQL = """sold AS (
  SELECT l_suppkey, p_type, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, p_type) AS place
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_type),
required AS (SELECT l_suppkey, list_sort(list(p_type)) AS types FROM sold WHERE place <= 3 GROUP BY l_suppkey),
postings AS (
  SELECT s_suppkey AS job_id,
    CASE WHEN s_acctbal >= 0 AND types IS NOT NULL THEN types ELSE [] END AS required_certifications,
    CAST(floor(greatest(s_acctbal, 0.0) / 1000) AS DOUBLE) AS min_years_experience,
    ['day', 'night', 'weekend', 'rotating', 'night'][n_regionkey + 1] AS shift_pattern,
    ['widget', 'anvil', 'gear', 'gizmo', 'ring', 'bolt', 'plate', 'rod'][s_nationkey % 8 + 1] AS site_type,
    s_acctbal > 4000 AS driving_required
  FROM supplier LEFT JOIN required ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (posting, candidate) with the best grade reached between them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey", "l_quantity")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("l_suppkey").alias("job_id"), F.col("o_custkey").alias("candidate_id"))
        .agg(F.max(grade_of_quantity(F.col("l_quantity"))).alias("grade"))
    )


PAIRS_SQL = f"""pairs AS (
  SELECT l_suppkey AS job_id, o_custkey AS candidate_id, max({GRADE_SQL}) AS grade
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey)"""

PAIRED_SQL = f"""{PROFILES_SQL}, {POSTINGS_SQL}, {PAIRS_SQL},
paired AS (SELECT * FROM pairs JOIN profiles USING (candidate_id) JOIN postings USING (job_id))"""

FEATURES_SQL = f"""{PAIRED_SQL},
overlapped AS (
  SELECT *, len(list_intersect(required_certifications, certifications)) AS overlap,
    len(required_certifications) AS n_required FROM paired),
features AS (
  SELECT job_id, candidate_id, grade,
    years_experience - min_years_experience AS exp_gap,
    CASE WHEN years_experience IS NOT NULL
      THEN least(years_experience / greatest(min_years_experience, 1.0), 5.0) END AS exp_ratio,
    CASE WHEN NOT list_contains(required_certifications, 'PROMO') THEN 1.0
      WHEN list_contains(certifications, 'PROMO') THEN 1.0 ELSE 0.0 END AS licence_match,
    CASE WHEN n_required = 0 THEN 1.0 ELSE overlap / CAST(n_required AS DOUBLE) END AS cert_overlap_ratio,
    CAST(overlap AS DOUBLE) AS cert_overlap_count,
    CASE WHEN list_contains(required_certifications, 'PROMO') AND NOT list_contains(certifications, 'PROMO')
      THEN 1.0 ELSE 0.0 END AS missing_critical_cert,
    CASE WHEN len(shift_availability) = 0 THEN NULL
      WHEN list_contains(shift_availability, shift_pattern) THEN 1.0 ELSE 0.0 END AS shift_match,
    CASE WHEN previous_role_count IS NULL THEN NULL
      WHEN list_contains(site_experience, site_type) THEN 1.0 ELSE 0.0 END AS site_type_match,
    CASE WHEN NOT driving_required THEN 1.0 WHEN driving_licence IS NULL THEN NULL
      WHEN driving_licence THEN 1.0 ELSE 0.0 END AS driving_required_match,
    CAST(len(certifications) - overlap AS DOUBLE) AS extra_cert_count,
    CASE WHEN previous_role_count > 6 THEN 6.0 ELSE CAST(previous_role_count AS DOUBLE) END AS role_count,
    CASE WHEN months_since_last_role > 240 THEN 240.0 ELSE CAST(months_since_last_role AS DOUBLE) END AS recency_months,
    required_certifications, min_years_experience, shift_pattern, site_type, driving_required
  FROM overlapped),
terms AS (
  SELECT *, 2.0 * coalesce(cert_overlap_ratio, 0.0) AS t_cert, CASE WHEN exp_gap >= 0 THEN 1.0 ELSE 0.0 END AS t_gap,
    0.5 * coalesce(shift_match, 0.0) AS t_shift, -1.5 * coalesce(missing_critical_cert, 0.0) AS t_critical
  FROM features),
scored AS (SELECT *, t_cert + t_gap + t_shift + t_critical AS score FROM terms)"""


# --- documents -----------------------------------------------------------------

WORD_OF_NUMBER = {n: w for w, n in NUMBER_WORDS.items()}


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one section-structured document per order.

    The narrow rows are dealt out before the text is made, so that what a task renders and parses doesn't grow with the table.
    """
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    stated = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus", "c_nationkey", "c_acctbal", "c_mktsegment")
    d = spread_rows(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(*stated), orders.count())
    y = F.floor(F.col("o_totalprice") / 25000).cast("int")
    ys = y.cast("string")
    year = F.year("o_orderdate")
    segment, priority, status = F.col("c_mktsegment"), F.col("o_orderpriority"), F.col("o_orderstatus")
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    word = F.try_element_at(
        F.create_map(*[c for n, w in WORD_OF_NUMBER.items() for c in (F.lit(n), F.lit(w))]), y
    )

    def s(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    summary = (
        F.when(segment == "AUTOMOBILE", s("Reliable guard with ", ys, " years of experience."))
        .when(segment == "BUILDING", s("Experienced officer. over ", ys, "+ years in the security industry"))
        .when(segment == "FURNITURE", s("Dedicated guard, ", F.coalesce(word, ys), " years of experience."))
        .when(segment == "MACHINERY", s("Officer, ", ys, ".5 years’ experience in security. Before that 3 years of experience."))
        .otherwise(s((F.lit(2026) - y).cast("string"), "-2026 (", ys, " years)"))
    )
    site = (
        F.when(priority == "1-URGENT", "stadium")
        .when(priority == "2-HIGH", "warehouse")
        .when(priority == "3-MEDIUM", "gated community")
        .otherwise("head office tower")
    )
    first = s("Retail Security Officer, Acme Ltd (", (year - 2).cast("string"), " - ", year.cast("string"), ") - ", site)
    second = s("Static Guard, Beta Ltd (", year.cast("string"), " – ", (year + 1).cast("string"), ") – shopping centre")
    current = s("Control Room Operator, Gamma Ltd (", year.cast("string"), " - present) - ", site)
    work = (
        F.when(status == "F", F.array(F.lit("WORK HISTORY"), first, second))
        .when(status == "O", F.array(F.lit("EMPLOYMENT"), F.lit("No previous security roles")))
        .when(priority == "1-URGENT", F.array(F.lit("EXPERIENCE"), current))
        .when(priority == "2-HIGH", F.array(F.lit("CAREER HISTORY"), F.lit("Various roles, dates on request")))
        .otherwise(F.array().cast("array<string>"))
    )
    bullets = F.array_compact(
        F.array(
            F.when(nation < 8, "- S.I.A. licensed"),
            F.when(nation.between(5, 14), "• Emergency first aid at work"),
            F.when(nation >= 20, "* frist aid"),
            F.when(balance > 5000, "- C.C.T.V. operator"),
            F.when(balance < 1000, "- Health & Safety"),
            F.when(status == "P", s("- juggling diploma no ", F.col("o_custkey").cast("string"))),
        )
    )
    shift = (
        F.when(priority == "1-URGENT", "Available for night shifts")
        .when(priority == "2-HIGH", "Saturdays and Sundays")
        .when(priority == "3-MEDIUM", "Happy with day shifts and NIGHTS")
        .when(priority == "5-LOW", "4 on 4 off preferred")
        .otherwise("Ask me")
    )
    driving = (
        F.when(balance < 0, "No driving licence")
        .when(balance < 3000, "Full clean driving licence")
        .when(balance < 4500, "Driving licence: none")
        .when(balance < 6000, "Driving licence: full, clean")
    )
    lines = F.concat(
        F.array(s("Application ", F.col("o_orderkey").cast("string")), F.lit(""), F.lit("PROFILE"), summary),
        work,
        F.array(F.lit("LICENCES & TRAINING")),
        bullets,
        F.array(F.lit("AVAILABILITY"), shift),
        F.array_compact(F.array(driving)),
    )
    breaks = F.when(nation < 12, "\n").otherwise("\r\n")
    return d.select(F.col("o_orderkey").alias("doc_id"), _join(lines, breaks).alias("text"))


def _join(lines: Column, separator: Column) -> Column:
    """array_join takes a literal separator; this takes a column."""
    return F.replace(F.array_join(lines, "\n"), F.lit("\n"), separator)


TRUTH_SQL = """stated AS (
  SELECT o_orderkey AS doc_id, o_custkey, CAST(floor(o_totalprice / 25000) AS INTEGER) AS y, year(o_orderdate) AS yr,
    c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status, c_nationkey AS nation,
    c_acctbal AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey),
truth AS (
  SELECT doc_id, o_custkey, status, priority, segment, nation, balance, y, yr,
    CASE segment WHEN 'HOUSEHOLD' THEN NULL WHEN 'MACHINERY' THEN greatest(y + 0.5, 3.0) ELSE CAST(y AS DOUBLE) END
      AS true_years,
    list_sort(list_filter([CASE WHEN nation < 8 THEN 'security_licence' END,
      CASE WHEN nation BETWEEN 5 AND 14 OR nation >= 20 THEN 'first_aid' END,
      CASE WHEN balance > 5000 THEN 'cctv_operation' END,
      CASE WHEN balance < 1000 THEN 'health_and_safety' END], lambda c: c IS NOT NULL)) AS true_certifications,
    CASE WHEN balance < 0 THEN false WHEN balance < 3000 THEN true WHEN balance < 4500 THEN false
      WHEN balance < 6000 THEN true END AS true_driving,
    CASE priority WHEN '1-URGENT' THEN ['night'] WHEN '2-HIGH' THEN ['weekend'] WHEN '3-MEDIUM' THEN ['day', 'night']
      WHEN '5-LOW' THEN ['rotating'] ELSE [] END AS true_shifts,
    CASE WHEN status = 'F' THEN list_sort(list_filter(['retail', CASE priority WHEN '1-URGENT' THEN 'event'
        WHEN '2-HIGH' THEN 'industrial' WHEN '3-MEDIUM' THEN 'residential' END], lambda c: c IS NOT NULL))
      WHEN status = 'P' AND priority = '1-URGENT' THEN ['event'] ELSE [] END AS true_sites,
    CASE WHEN status = 'F' THEN 2 WHEN status = 'O' THEN 0 WHEN priority = '1-URGENT' THEN 1 END AS true_roles,
    CAST(CASE WHEN status = 'F' THEN greatest(0, (2026 - (yr + 1)) * 12)
      WHEN status = 'P' AND priority = '1-URGENT' THEN 0 END AS INTEGER) AS true_months
  FROM stated)"""

WARNINGS_SQL = """list_filter([
    CASE WHEN true_years IS NULL THEN 'years_experience: not stated' END,
    CASE WHEN status = 'P' THEN 'certification: unrecognised entry ''juggling diploma no ' || o_custkey || '''' END,
    CASE WHEN status = 'P' AND priority = '2-HIGH' THEN 'employment: section present but no dated roles found'
      WHEN status = 'P' AND priority <> '1-URGENT' THEN 'employment: no employment section found' END,
    CASE WHEN len(true_shifts) = 0 THEN 'shift_availability: not stated' END,
    CASE WHEN true_driving IS NULL THEN 'driving_licence: not stated' END], lambda w: w IS NOT NULL)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth of :func:`rendered`, read from the columns."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    d = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    y = F.floor(F.col("o_totalprice") / 25000)
    nation, balance = F.col("c_nationkey"), F.col("c_acctbal")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")

    def present(*options) -> Column:
        return F.array_sort(F.array_compact(F.array(*options)))

    site = (
        F.when(priority == "1-URGENT", "event").when(priority == "2-HIGH", "industrial").when(priority == "3-MEDIUM", "residential")
    )
    nothing = F.array().cast("array<string>")
    working = (status == "P") & (priority == "1-URGENT")
    return d.select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", None)
        .when(F.col("c_mktsegment") == "MACHINERY", F.greatest(y + 0.5, F.lit(3.0)))
        .otherwise(y.cast("double"))
        .alias("true_years"),
        present(
            F.when(nation < 8, "security_licence"),
            F.when(nation.between(5, 14) | (nation >= 20), "first_aid"),
            F.when(balance > 5000, "cctv_operation"),
            F.when(balance < 1000, "health_and_safety"),
        ).alias("true_certifications"),
        F.when(balance < 0, False).when(balance < 3000, True).when(balance < 4500, False).when(balance < 6000, True).alias("true_driving"),
        F.when(priority == "1-URGENT", F.array(F.lit("night")))
        .when(priority == "2-HIGH", F.array(F.lit("weekend")))
        .when(priority == "3-MEDIUM", F.array(F.lit("day"), F.lit("night")))
        .when(priority == "5-LOW", F.array(F.lit("rotating")))
        .otherwise(nothing)
        .alias("true_shifts"),
        F.when(status == "F", present(F.lit("retail"), site)).when(working, F.array(F.lit("event"))).otherwise(nothing).alias("true_sites"),
        F.when(status == "F", 2).when(status == "O", 0).when(working, 1).alias("true_roles"),
        F.when(status == "F", F.greatest(F.lit(0), (F.lit(2025) - F.year("o_orderdate")) * 12)).when(working, 0).alias("true_months"),
    )
