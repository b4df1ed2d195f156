"""Text extraction: whole corpora in, structured facts out.

Documents rendered from columns have a SQL twin that states the facts from those
columns; free prose (documents, conversations, pages) is checked by an independent
regular-expression formulation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairrank.functions import text as tx
from pairrank.functions import vocab as V
from pairrank.functions.stats import round6
from pairrank.operators import extract as xt
from pairrank.operators import monitor as mo
from pairrank.plans.entities import TRUTH_SQL, WARNINGS_SQL, rendered, table, truth
from pairrank.plans.registry import query
from pairrank.session import spread

CANON_SQL = "trim(regexp_replace({low}, '[^a-z0-9]+', ' ', 'g'))"


def canon_sql(column):
    low = f"lower({column})"
    for variant, canonical in tx.SPELLING:
        low = f"replace({low}, '{variant}', '{canonical}')"
    return CANON_SQL.format(low=low)


@query("canonical_text", f"SELECT doc_id, md5({canon_sql('text')}) AS canonical_md5, length({canon_sql('text')}) AS n FROM documents")
def canonical_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.canonical_text(F.col("text")).alias("c"))
    return docs.select("doc_id", F.md5("c").alias("canonical_md5"), F.length("c").cast("bigint").alias("n"))


@query(
    "vocab_index",
    f"""SELECT {canon_sql("p_name || ' ' || p_brand")} AS phrase, max_by(p_type, p_partkey) AS code FROM part GROUP BY 1""",
)
def vocab_index(spark, sf_dir):
    return part_index(spark, sf_dir)


def part_index(spark, sf_dir):
    """Canonical phrase to code from a vocabulary table of any size; the later entry wins."""
    entries = table(spark, sf_dir, "part").select(
        tx.canonical_text(F.concat("p_name", F.lit(" "), "p_brand")).alias("phrase"), "p_type", "p_partkey"
    )
    return entries.groupBy("phrase").agg(F.max_by("p_type", "p_partkey").alias("code"))


@query(
    "match_exact",
    f"""WITH vocab AS (SELECT {canon_sql("p_name || ' ' || p_brand")} AS phrase, max_by(p_type, p_partkey) AS code FROM part GROUP BY 1),
    asked AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      {canon_sql("p_name || CASE WHEN l_returnflag = 'R' THEN ', ' ELSE ' the ' END || p_brand")} AS phrase FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, code FROM asked LEFT JOIN vocab ON asked.phrase = vocab.phrase""",
)
def match_exact(spark, sf_dir):
    """Phrases against a vocabulary table: an equi-join on the canonical form."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    said = F.concat("p_name", F.when(F.col("l_returnflag") == "R", ", ").otherwise(" the "), "p_brand")
    asked = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("phrase", tx.canonical_text(said))
    found = asked.join(part_index(spark, sf_dir), "phrase", "left")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "code")


# Entry wording by nation; the SQL twin names the code and the step that should answer.
ENTRIES = (
    ("SIA badge", "security_licence", "exact"),
    ("valid SIA licence (front line), expires 20{n}", "security_licence", "contained"),
    ("frist aid", "first_aid", "fuzzy"),
    ("CCTV oepration", "cctv_operation", "contained"),
    ("conflict managment", "conflict_management", "fuzzy"),
    ("forklift licence", None, None),
    ("   ", None, None),
    ("First Aid at Work no {n}", "first_aid", "contained"),
    ("S.I.A. licensed", "security_licence", "exact"),
    ("Customer service award {n}", None, None),
    ("Dog  Handling", "dog_handling", "exact"),
    ("fire safety awareness", "fire_safety", "exact"),
    ("SIA licance", "security_licence", "fuzzy"),
    ("degree in computer science", None, None),
    ("close protection officer, team {n}", "close_protection", "contained"),
    ("Health & Safety", "health_and_safety", "exact"),
)


def _entries(spark, sf_dir):
    nation, n = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    entry = F.lit("unlisted entry")
    for i, (wording, _, _) in enumerate(ENTRIES):
        entry = F.when(nation == i, F.replace(F.lit(wording), F.lit("{n}"), n)).otherwise(entry)
    return table(spark, sf_dir, "customer").select("c_custkey", entry.alias("entry"))


def _entries_sql(steps):
    whens = " ".join(f"WHEN {i} THEN '{code}'" for i, (_, code, step) in enumerate(ENTRIES) if step in steps)
    return f"SELECT c_custkey, CASE c_nationkey {whens} END AS code FROM customer"


@query("match_contained", _entries_sql({"contained"}))
def match_contained(spark, sf_dir):
    canon = _entries(spark, sf_dir).select("c_custkey", tx.canonical_text(F.col("entry")).alias("c"))
    exact = tx.match_exact(F.col("c"), V.CERTIFICATIONS)
    return canon.select("c_custkey", F.when(exact.isNull(), tx.match_contained(F.col("c"), V.CERTIFICATIONS)).alias("code"))


@query("match_fuzzy", _entries_sql({"fuzzy"}))
def match_fuzzy(spark, sf_dir):
    """Only the distinct entries no cheaper step answered are compared by similarity."""
    canon = _entries(spark, sf_dir).select("c_custkey", tx.canonical_text(F.col("entry")).alias("c"))
    open_entries = canon.where(
        tx.match_exact(F.col("c"), V.CERTIFICATIONS).isNull() & tx.match_contained(F.col("c"), V.CERTIFICATIONS).isNull()
    ).select("c").distinct()
    answers = open_entries.select("c", tx.match_fuzzy(F.col("c"), V.CERTIFICATIONS).alias("code")).where("code IS NOT NULL")
    return canon.join(answers, "c", "left").select("c_custkey", "code")


@query("match_cascade", _entries_sql({"exact", "contained", "fuzzy"}))
def match_cascade(spark, sf_dir):
    canon = _entries(spark, sf_dir).select("c_custkey", tx.canonical_text(F.col("entry")).alias("c"))
    return canon.select("c_custkey", tx.match_cascade(F.col("c"), V.CERTIFICATIONS).alias("code"))


PROSE = {"greeting": ("the", "and the"), "negation": ("nicht", "non"), "link": ("http", "www"), "motion": ("to be", "und der")}
_PROSE_FLAGS = ", ".join(
    "CASE WHEN " + " OR ".join(f"regexp_matches({canon_sql('text')}, '\\b{p}\\b')" for p in phrases) + f" THEN '{code}' END"
    for code, phrases in sorted(PROSE.items())
)


@query(
    "tag_phrases",
    f"""SELECT doc_id, array_to_string(list_filter([{_PROSE_FLAGS}], lambda c: c IS NOT NULL), '|') AS codes FROM documents""",
)
def tag_phrases(spark, sf_dir):
    canon = table(spark, sf_dir, "documents").select("doc_id", tx.canonical_text(F.col("text")).alias("canonical"))
    return canon.select("doc_id", F.array_join(tx.tag_phrases(F.col("canonical"), PROSE), "|").alias("codes"))


@query(
    "tag_entities",
    f"""WITH {TRUTH_SQL} SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN nation < 8 THEN 'security_licence' END,
      CASE WHEN nation BETWEEN 5 AND 14 THEN 'first_aid' END, CASE WHEN balance > 5000 THEN 'cctv_operation' END,
      CASE WHEN balance < 1000 THEN 'health_and_safety' END], lambda c: c IS NOT NULL)), '|') AS codes FROM truth""",
)
def tag_entities(spark, sf_dir):
    docs = rendered(spark, sf_dir).select("doc_id", tx.entity_spans(F.col("text"), V.CERTIFICATIONS).alias("spans"))
    return docs.select("doc_id", F.array_join(F.array_sort(tx.codes_of_spans(F.col("spans"), V.CERTIFICATIONS)), "|").alias("codes"))


@query(
    "split_sections",
    f"""WITH {TRUTH_SQL}, sections AS (
      SELECT doc_id, 0 AS section, '' AS heading, 1 AS n_lines FROM truth
      UNION ALL SELECT doc_id, 1, 'PROFILE', 1 FROM truth
      UNION ALL SELECT doc_id, 2, CASE WHEN status = 'F' THEN 'WORK HISTORY' WHEN status = 'O' THEN 'EMPLOYMENT' WHEN priority = '1-URGENT' THEN 'EXPERIENCE' ELSE 'CAREER HISTORY' END,
        CASE WHEN status = 'F' THEN 2 ELSE 1 END FROM truth WHERE status <> 'P' OR priority IN ('1-URGENT', '2-HIGH')
      UNION ALL SELECT doc_id, 3, 'LICENCES & TRAINING', CAST(nation < 8 AS INTEGER) + CAST(nation BETWEEN 5 AND 14 AS INTEGER) + CAST(nation >= 20 AS INTEGER)
        + CAST(balance > 5000 AS INTEGER) + CAST(balance < 1000 AS INTEGER) + CAST(status = 'P' AS INTEGER) FROM truth
      UNION ALL SELECT doc_id, 4, 'AVAILABILITY', 1 + CAST(balance < 6000 AS INTEGER) FROM truth)
    SELECT doc_id, heading, n_lines FROM sections""",
)
def split_sections(spark, sf_dir):
    docs = rendered(spark, sf_dir).select("doc_id", tx.lines_of(F.col("text")).alias("lines"))
    sections = docs.select("doc_id", F.inline(tx.sections_of(F.col("lines"))))
    return sections.select("doc_id", "heading", F.size("lines").alias("n_lines"))


@query(
    "split_turns",
    r"""SELECT conv_id, turn, upper(role) AS heading, len(list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda l: trim(l, E' \t\n\r') <> '')) AS n_lines
    FROM conversations""",
)
def split_turns(spark, sf_dir):
    """Conversation turns read as one-section documents."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.lines_of(F.concat(F.upper("role"), F.lit("\n"), "text")).alias("lines")
    )
    sections = turns.select("conv_id", "turn", F.inline(tx.sections_of(F.col("lines"))))
    return sections.where("heading <> ''").select("conv_id", "turn", "heading", F.size("lines").alias("n_lines"))


@query(
    "bullet_items",
    f"""WITH {TRUTH_SQL}, items AS (SELECT doc_id, unnest(list_filter([CASE WHEN nation < 8 THEN 'S.I.A. licensed' END,
      CASE WHEN nation BETWEEN 5 AND 14 THEN 'Emergency first aid at work' END, CASE WHEN nation >= 20 THEN 'frist aid' END,
      CASE WHEN balance > 5000 THEN 'C.C.T.V. operator' END, CASE WHEN balance < 1000 THEN 'Health & Safety' END,
      CASE WHEN status = 'P' THEN 'juggling diploma no ' || o_custkey END], lambda c: c IS NOT NULL)) AS item FROM truth)
    SELECT doc_id, item FROM items""",
)
def bullet_items(spark, sf_dir):
    docs = rendered(spark, sf_dir)
    return docs.select("doc_id", F.explode(tx.bullets_of(tx.lines_of(F.col("text")))).alias("item"))


def parsed(spark, sf_dir):
    return xt.parse_profiles(rendered(spark, sf_dir), "doc_id")


def corpus(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


@query(
    "extract_certs",
    f"""WITH {TRUTH_SQL} SELECT doc_id, array_to_string(true_certifications, '|') AS certifications,
    CASE WHEN status = 'P' THEN 1 ELSE 0 END AS n_unrecognised FROM truth""",
)
def extract_certs(spark, sf_dir):
    loose = F.size(F.filter("parse_warnings", lambda w: w.startswith("certification:")))
    return parsed(spark, sf_dir).select("doc_id", F.array_join("certifications", "|").alias("certifications"), loose.alias("n_unrecognised"))


@query("extract_quantity", f"WITH {TRUTH_SQL} SELECT doc_id, true_years AS years_experience FROM truth")
def extract_quantity(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", xt.stated_years(F.col("text")).alias("years_experience"))


@query(
    "stated_years_in_prose",
    r"""SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '(?i)(\d{1,2}(?:\.\d)?)\s*\+?\s*years?[''’]?\s*(?:of\s+)?(?:security\s+)?(?:experience|in\s+the\s+security|in\s+security)', 1),
      lambda n: CAST(n AS DOUBLE))) AS years FROM documents""",
)
def stated_years_in_prose(spark, sf_dir):
    """The same extractor over free prose, which states almost nothing: null, never zero."""
    return table(spark, sf_dir, "documents").select("doc_id", xt.stated_years(F.col("text")).alias("years"))


@query(
    "extract_periods",
    f"WITH {TRUTH_SQL} SELECT doc_id, true_roles AS previous_role_count, true_months AS months_since_last_role FROM truth",
)
def extract_periods(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", "previous_role_count", "months_since_last_role")


@query("tri_state_flag", f"WITH {TRUTH_SQL} SELECT doc_id, true_driving AS driving_licence FROM truth")
def tri_state_flag(spark, sf_dir):
    return rendered(spark, sf_dir).select("doc_id", xt.driving_flag(F.col("text")).alias("driving_licence"))


@query("scoped_tags", f"WITH {TRUTH_SQL} SELECT doc_id, array_to_string(true_sites, '|') AS site_experience FROM truth")
def scoped_tags(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", F.array_join("site_experience", "|").alias("site_experience"))


@query("parse_warnings", f"WITH {TRUTH_SQL} SELECT doc_id, array_to_string({WARNINGS_SQL}, '; ') AS warnings FROM truth")
def parse_warnings(spark, sf_dir):
    return parsed(spark, sf_dir).select("doc_id", F.array_join("parse_warnings", "; ").alias("warnings"))


@query(
    "parse_profiles",
    f"""WITH {TRUTH_SQL} SELECT doc_id, true_years AS years_experience, array_to_string(true_certifications, '|') AS certifications, true_driving AS driving_licence,
    array_to_string(true_shifts, '|') AS shift_availability, array_to_string(true_sites, '|') AS site_experience, true_roles AS previous_role_count,
    true_months AS months_since_last_role, len({WARNINGS_SQL}) AS n_warnings FROM truth""",
)
def parse_profiles(spark, sf_dir):
    sets = ("certifications", "shift_availability", "site_experience")
    return parsed(spark, sf_dir).select(
        "doc_id", "years_experience", *[F.array_join(s, "|").alias(s) for s in sets], "driving_licence", "previous_role_count",
        "months_since_last_role", F.size("parse_warnings").alias("n_warnings"),
    )


@query(
    "parse_corpus",
    f"""SELECT doc_id, len(list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda l: regexp_matches(trim(l), '^[-•*]\\s*.+'))) AS n_bullets,
    regexp_matches({canon_sql("text")}, '\\b(days|nights|weekends)\\b') AS has_shift FROM documents""",
)
def parse_corpus(spark, sf_dir):
    """The full extractor over free prose, long documents included."""
    docs = corpus(spark, sf_dir)
    profile = xt.parse_profiles(
        docs.withColumn("n_bullets", F.size(tx.bullets_of(tx.lines_of(F.col("text"))))), "doc_id", keep=["n_bullets"]
    )
    return profile.select("doc_id", "n_bullets", (F.size("shift_availability") > 0).alias("has_shift"))


@query(
    "warning_counts",
    f"""WITH {TRUTH_SQL}, w AS (SELECT unnest({WARNINGS_SQL}) AS warning FROM truth)
    SELECT split_part(warning, ':', 1) AS field, count(*) AS n FROM w GROUP BY 1""",
)
def warning_counts(spark, sf_dir):
    return xt.warning_counts(parsed(spark, sf_dir))


@query(
    "failure_counts",
    """WITH r AS (SELECT CASE WHEN length(trim(text, E' \\t\\n\\r')) = 0 THEN 'empty' WHEN length(trim(text, E' \\t\\n\\r')) > 20000 THEN 'too_long' END AS reason
      FROM (SELECT text FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT CASE WHEN turn = 0 THEN '  ' ELSE text END FROM conversations))
    SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason""",
)
def failure_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.when(F.col("turn") == 0, "  ").otherwise(F.col("text")).alias("text"))
    return xt.failure_counts(xt.text_quarantine(docs.union(pages).union(turns)))


@query(
    "text_quarantine",
    """SELECT doc_id, CASE WHEN length(trim(text, E' \\t\\n\\r')) = 0 THEN 'empty' WHEN length(trim(text, E' \\t\\n\\r')) > 20000 THEN 'too_long' END AS reason FROM documents""",
)
def text_quarantine(spark, sf_dir):
    return xt.text_quarantine(table(spark, sf_dir, "documents")).select("doc_id", "reason")


_FRIENDLY = " ".join(f"WHEN starts_with(warning, '{p}') THEN '{label}'" for p, label in xt.FRIENDLY)


@query(
    "friendly_warning",
    f"""WITH {TRUTH_SQL}, w AS (SELECT unnest({WARNINGS_SQL}) AS warning FROM truth UNION ALL SELECT event_type || ': other' FROM events)
    SELECT CASE {_FRIENDLY} ELSE warning END AS message, count(*) AS n FROM w GROUP BY 1""",
)
def friendly_warning(spark, sf_dir):
    warnings = xt.warnings_of(parsed(spark, sf_dir))
    other = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(": other")).alias("warning"))
    told = warnings.union(other).select(xt.friendly_warning(F.col("warning")).alias("message"))
    return told.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "recovery_audit",
    """SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS n_documents, field, CAST(0 AS BIGINT) AS n_mismatches
    FROM (SELECT unnest(['years_experience', 'certifications', 'driving_licence', 'shift_availability', 'site_experience', 'previous_role_count',
      'months_since_last_role', 'invented_codes']) AS field)""",
)
def recovery_audit(spark, sf_dir):
    return xt.recovery_audit(parsed(spark, sf_dir), truth(spark, sf_dir), "doc_id")


@query(
    "text_preview",
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\n\\r')),
      lambda x: x <> '' AND NOT regexp_full_match(x, '[A-Z][A-Z &]{2,}'))[1] AS line FROM documents)
    SELECT doc_id, CASE WHEN line IS NULL THEN 'Empty' WHEN length(line) > 64 THEN substr(line, 1, 64) || '…' ELSE line END AS preview FROM l""",
)
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", xt.text_preview(F.col("text")).alias("preview"))


COVERAGE = ("the", "and the", "to be", "nicht", "from", "le", "una", "quality", "first aid", "years of experience")
_PADDED = f"' ' || {canon_sql('text')} || ' '"


@query(
    "phrase_coverage",
    " UNION ALL ".join(
        f"SELECT '{p}' AS phrase, count(*) FILTER (contains({_PADDED}, ' {p} ')) AS n_documents FROM documents" for p in COVERAGE
    ),
)
def phrase_coverage(spark, sf_dir):
    return xt.phrase_coverage(table(spark, sf_dir, "documents"), "text", COVERAGE)


@query(
    "text_profile",
    f"""WITH {TRUTH_SQL} SELECT count(*) AS n_documents, round(avg(CASE WHEN true_years IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS states_years,
    round(avg(CASE WHEN true_driving IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS states_driving, round(avg(CASE WHEN len(true_shifts) > 0 THEN 1.0 ELSE 0 END), 6) AS states_shifts,
    (SELECT min(length(text)) FROM documents) AS shortest, (SELECT max(length(text)) FROM documents) AS longest,
    (SELECT round(quantile_cont(length(text), 0.5), 6) FROM documents) AS median_length FROM truth""",
)
def text_profile(spark, sf_dir):
    """Lengths of the free corpus beside the share of rendered documents stating each fact."""
    lengths = mo.text_profile(table(spark, sf_dir, "documents"), "text", {})
    facts = mo.text_profile(
        rendered(spark, sf_dir)
        .withColumn("canonical", tx.canonical_text(F.col("text")))
        .select("text", xt.stated_years(F.col("text")).alias("y"), xt.driving_flag(F.col("text")).alias("d"),
                tx.tag_phrases(F.col("canonical"), V.SHIFTS).alias("s")),
        "text",
        {"states_years": F.col("y").isNotNull(), "states_driving": F.col("d").isNotNull(), "states_shifts": F.size("s") > 0},
    )
    scalar = lambda c: lengths.select(c).scalar().alias(c)
    return facts.select(
        "n_documents", *[round6(c).alias(c) for c in ("states_years", "states_driving", "states_shifts")],
        scalar("shortest"), scalar("longest"), scalar("median_length"),
    )


@query("lf_normalise", "SELECT page_id, md5(replace(replace(html, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS digest FROM pages")
def lf_normalise(spark, sf_dir):
    from pairrank.sources.files import lf_normalise as lf

    crlf = F.replace("html", F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(lf(crlf)).alias("digest"))
