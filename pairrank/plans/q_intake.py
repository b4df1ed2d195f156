"""Intake, constraints, redaction, files, versions and monitoring counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairrank.functions.stats import round6
from pairrank.operators import extract as xt
from pairrank.operators import guards as gd
from pairrank.operators import intake as it
from pairrank.operators import monitor as mo
from pairrank.operators import shortlist as sl
from pairrank.plans.entities import PAIRS_SQL, POSTINGS_SQL, PROFILES_SQL, pairs, postings, profiles, table
from pairrank.plans.q_pairs import _histogram_sql
from pairrank.plans.registry import query
from pairrank.session import materialise, scratch_path
from pairrank.sources import files as fl
from pairrank.sources import tables as tb
from pairrank.sources import versions as vs
from pairrank.streaming import monitor as sm

POSTING_OUT = ("job_id", "min_years_experience", "shift_pattern", "site_type", "driving_required")


@query(
    "load_tables",
    f"""WITH {POSTINGS_SQL}, {PAIRS_SQL}, n AS (SELECT job_id, count(*) AS n_labels FROM pairs JOIN customer ON c_custkey = candidate_id GROUP BY job_id)
    SELECT p.job_id, min_years_experience, shift_pattern, site_type, driving_required, array_to_string(required_certifications, '|') AS required, n_labels
    FROM postings p JOIN n ON p.job_id = n.job_id""",
)
def load_tables(spark, sf_dir):
    """Three entity tables written to the shared folder and read back through their declared schemas."""
    root = scratch_path(spark, "tables")
    jobs = postings(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("job_id"), "required_certifications", *POSTING_OUT[1:], F.lit("").alias("description")
    )
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("candidate_id"), F.col("c_name").alias("cv_text"))
    labels = pairs(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("job_id"), F.col("candidate_id").cast("string").alias("candidate_id"), "grade"
    )
    tb.write_dataset({"candidates": people, "jobs": jobs, "labels": labels}, root)
    back = tb.load_tables(spark, root)
    posted = gd.schema_guard(back["jobs"], jobs.schema)
    counted = back["labels"].join(back["candidates"].select("candidate_id"), "candidate_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_labels"))
    return posted.join(counted, "job_id").select(
        F.col("job_id").cast("bigint").alias("job_id"), *POSTING_OUT[1:], F.array_join("required_certifications", "|").alias("required"), "n_labels"
    )


@query(
    "write_dataset",
    f"WITH {PAIRS_SQL} SELECT 'labels' AS \"table\", count(*) AS n FROM pairs UNION ALL SELECT 'protected', count(*) FROM customer WHERE c_acctbal >= 0",
)
def write_dataset(spark, sf_dir):
    """Pairs and the separate group records, each in its own folder; counted after reading back."""
    root = scratch_path(spark, "dataset")
    labels = pairs(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("job_id"), F.col("candidate_id").cast("string").alias("candidate_id"), "grade"
    )
    protected = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(
        F.col("c_custkey").cast("string").alias("candidate_id"), F.col("c_mktsegment").alias("gender"),
        F.lit(None).cast("string").alias("age_band"), F.col("c_nationkey").cast("string").alias("nationality"),
    )
    tb.write_dataset({"labels": labels}, root, fmt="json")
    tb.write_dataset({"protected": protected}, root)
    read_labels = tb.read_table(spark, f"{root}/labels", tb.PAIR, "json")
    read_protected = tb.load_protected(spark, root)
    count = lambda name, df: df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
    return count("labels", read_labels).unionByName(count("protected", read_protected))


@query(
    "dataset_manifest",
    f"""WITH {PAIRS_SQL} SELECT 'v1' AS generator_version, 42 AS seed, (SELECT count(*) FROM customer) AS n_candidates, (SELECT count(*) FROM supplier) AS n_jobs,
    (SELECT count(*) FROM pairs) AS n_pairs, (SELECT string_agg(g || ':' || n, '|' ORDER BY g) FROM
      (SELECT g, (SELECT count(*) FROM pairs WHERE grade = g) AS n FROM range(4) t(g))) AS grade_counts""",
)
def dataset_manifest(spark, sf_dir):
    labelled = pairs(spark, sf_dir)
    manifest = tb.dataset_manifest(
        {"candidates": table(spark, sf_dir, "customer"), "jobs": table(spark, sf_dir, "supplier"), "labels": labelled},
        tb.grade_distribution(labelled), "v1", 42,
    )
    entry = F.transform(F.array_sort(F.map_entries("grade_counts")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return manifest.select(
        "generator_version", "seed", F.col("table_counts")["candidates"].alias("n_candidates"), F.col("table_counts")["jobs"].alias("n_jobs"),
        F.col("table_counts")["labels"].alias("n_pairs"), F.array_join(entry, "|").alias("grade_counts"),
    )


@query(
    "schema_guard",
    """SELECT event_id, k AS key, 'unknown' AS problem FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) WHERE k <> 'kind'
    UNION ALL SELECT event_id, 'kind', 'missing' FROM events WHERE NOT list_contains(json_keys(props), 'kind')""",
)
def schema_guard(spark, sf_dir):
    """Unknown and missing keys of every event record."""
    return gd.record_key_violations(table(spark, sf_dir, "events"), "props", ["kind"], ["event_id"])


@query(
    "row_constraints",
    f"""WITH {PROFILES_SQL}, rows AS (SELECT candidate_id, years_experience * 4 AS years, previous_role_count - 3 AS roles, months_since_last_role AS months, shift_availability FROM profiles)
    SELECT candidate_id, unnest(list_filter([CASE WHEN years < 0 OR years > 60 THEN 'years_out_of_range' END, CASE WHEN roles < 0 THEN 'negative_role_count' END,
      CASE WHEN months < 0 THEN 'negative_months' END, CASE WHEN len(list_filter(shift_availability, lambda s: s NOT IN ('day', 'night', 'weekend'))) > 0 THEN 'unknown_shift' END],
      lambda v: v IS NOT NULL)) AS violation FROM rows""",
)
def row_constraints(spark, sf_dir):
    rows = profiles(spark, sf_dir).select(
        "candidate_id", (F.col("years_experience") * 4).alias("years"), (F.col("previous_role_count") - 3).alias("roles"),
        F.col("months_since_last_role").alias("months"), "shift_availability",
    )
    allowed = F.array(*[F.lit(s) for s in ("day", "night", "weekend")])
    rules = {
        "years_out_of_range": ~F.col("years").between(0, 60),
        "negative_role_count": F.col("roles") < 0,
        "negative_months": F.col("months") < 0,
        "unknown_shift": F.size(F.array_except("shift_availability", allowed)) > 0,
    }
    return gd.quarantine(rows, rules, ["candidate_id"])


DRAFTS_SQL = """drafts AS (SELECT doc_id AS idx, CASE WHEN lang = 'de' THEN '  ' ELSE ' ' || source || '-' || lang || '-' || (n_chars % 50) || ' ' END AS ref,
  CASE WHEN source = 'src3' THEN '' ELSE text END AS text FROM documents)"""


def _drafts(spark, sf_dir):
    """Drafts with blank, repeated and unique references, and blank and over-long texts."""
    ref = F.concat(F.lit(" "), "source", F.lit("-"), "lang", F.lit("-"), (F.col("n_chars") % 50).cast("string"), F.lit(" "))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.when(F.col("lang") == "de", "  ").otherwise(ref).alias("ref"),
        F.when(F.col("source") == "src3", "").otherwise(F.col("text")).alias("text"),
    )


@query(
    "draft_issues",
    f"""WITH {DRAFTS_SQL}, seen AS (SELECT *, trim(ref) AS r, row_number() OVER (PARTITION BY trim(ref) ORDER BY idx) AS use FROM drafts),
    issues AS (SELECT idx, list_filter([CASE WHEN r = '' THEN 'Needs a reference.' WHEN use > 1 THEN 'Reference "' || r || '" is already used above.' END,
      CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN 'Paste the application text, or drop a file.'
        WHEN length(text) > 20000 THEN format('{{:,}}', length(text) - 20000) || ' characters over the 20,000 limit.' END], lambda m: m IS NOT NULL) AS l FROM seen)
    SELECT idx, CAST(unnest(range(len(l))) AS INTEGER) AS issue_no, unnest(l) AS message FROM issues""",
)
def draft_issues(spark, sf_dir):
    return it.draft_issues(_drafts(spark, sf_dir), "idx", "ref", "text")


@query(
    "reference_slug",
    r"""WITH named AS (SELECT page_id AS idx, string_split(url, '/')[3] || '.txt' AS file FROM pages),
    slugs AS (SELECT idx, file, CASE WHEN s = '' THEN 'cv' ELSE s END AS base FROM
      (SELECT *, substr(regexp_replace(regexp_replace(lower(regexp_replace(file, '\.[^.]*$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS s FROM named))
    SELECT idx, file, base || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS reference FROM
      (SELECT *, row_number() OVER (PARTITION BY base ORDER BY idx) AS n FROM slugs)""",
)
def reference_slug(spark, sf_dir):
    """Files named after the host of each page: many share a name."""
    files = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("idx"), F.concat(F.get(F.split("url", "/"), F.lit(2)), F.lit(".txt")).alias("file")
    )
    return it.reference_slug(files, "idx", "file")


@query("public_projection", f"WITH {DRAFTS_SQL} SELECT trim(ref) AS candidate_id, text AS cv_text FROM drafts")
def public_projection(spark, sf_dir):
    return sl.public_projection(_drafts(spark, sf_dir), "ref", "text")


@query(
    "merge_results",
    """WITH a AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)
    SELECT id, CASE WHEN length(t) > 20000 THEN 'too_long' END AS reason FROM a""",
)
def merge_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.length("text").alias("n"))
    pages = table(spark, sf_dir, "pages").select(F.length("html").alias("n"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.length("text").alias("n")
    )
    return it.merge_results(docs, pages, turns).select("id", F.when(F.col("n") > 20000, "too_long").alias("reason"))


@query(
    "remaining_capacity",
    f"WITH {PAIRS_SQL} SELECT job_id, greatest(0, 500 - count(*)) AS remaining FROM pairs GROUP BY job_id",
)
def remaining_capacity(spark, sf_dir):
    sizes = pairs(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("job_id", it.remaining_capacity(F.col("n")).alias("remaining"))


@query(
    "intake_search",
    "SELECT conv_id, turn FROM conversations WHERE contains(lower(role), 'the') OR contains(lower(text), 'the') OR contains(CAST(conv_id AS VARCHAR), 'the')",
)
def intake_search(spark, sf_dir):
    return sl.intake_search(table(spark, sf_dir, "conversations"), " The ", ["role", "text", "conv_id"]).select("conv_id", "turn")


TABLES = "*.parquet"


@query("intake_triage")
def intake_triage(spark, sf_dir):
    """The data files themselves, under names that make each rule fire."""
    names = ("cv.txt", "cv.pdf", "cv.docx", "old.doc", ".txt", "notes.md", "sheet.xlsx")
    heads = fl.read_files(spark, sf_dir, TABLES, fl.MAX_UPLOAD_BYTES).select("filename", F.substring("content", 1, 5).alias("content"))
    files = fl.list_files(spark, sf_dir, TABLES).join(heads, "filename", "left")
    tried = files.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("filename"), F.col("filename").alias("origin"), "length", "content")
    return fl.intake_triage(tried).select("origin", "filename", "extension", "kind", "reason")


# Names and first bytes that, put on the documents in turn, make every rule fire.
UPLOAD_NAMES = ("cv.txt", "CV.PDF", "cv.docx", "old.doc", ".txt", "notes.md", "sheet.xlsx", "two.dots.text", "plain")
UPLOAD_HEADS = ("%PDF-", "PK\x03\x04", "")
_MB = "CAST(floor(length / 1048576.0 * 10 + 0.5) / 10 AS DECIMAL(18,1))"
_UPLOADS_SQL = f"""uploads AS (SELECT doc_id, text, [{", ".join(f"'{n}'" for n in UPLOAD_NAMES)}][CAST(doc_id % {len(UPLOAD_NAMES)} AS INT) + 1] AS filename,
      CAST(doc_id // {len(UPLOAD_NAMES)} AS BIGINT) AS turn FROM documents),
    sized AS (SELECT doc_id, filename, ['%PDF-', 'PK' || chr(3) || chr(4), ''][CAST(turn % 3 AS INT) + 1] AS head,
      CASE WHEN turn % 5 = 0 THEN 0 WHEN turn % 5 = 1 THEN 5242881 + 104857 * (turn % 1000) ELSE strlen(text) END AS length,
      CASE WHEN filename = 'plain' OR filename = '.txt' THEN '' ELSE lower(regexp_extract(filename, '[.][^.]*$')) END AS extension FROM uploads)"""


@query(
    "intake_triage_documents",
    f"""WITH {_UPLOADS_SQL}, judged AS (SELECT doc_id, extension, CASE
      WHEN extension IN ('.doc', '.rtf', '.odt', '.pages') THEN extension || ' is an older format this cannot read. Save it as .docx or .txt and upload again.'
      WHEN extension NOT IN ('.txt', '.text', '.md', '.pdf', '.docx') THEN CASE WHEN extension = '' THEN 'this file' ELSE extension END || ' is not supported. Accepted: .docx, .md, .pdf, .text, .txt.'
      WHEN length = 0 THEN 'this file is empty'
      WHEN length > 5242880 THEN {_MB} || ' MB is too large for a CV — the limit is 5 MB.'
      WHEN extension = '.pdf' AND head <> '%PDF-' THEN 'this file is named .pdf but its contents are not a PDF'
      WHEN extension = '.docx' AND head <> 'PK' || chr(3) || chr(4) THEN 'this file is named .docx but its contents are not a Word document' END AS reason FROM sized)
    SELECT doc_id, extension, CASE WHEN reason IS NOT NULL THEN NULL WHEN extension = '.pdf' THEN 'pdf' WHEN extension = '.docx' THEN 'docx' ELSE 'text' END AS kind, reason FROM judged""",
)
def intake_triage_documents(spark, sf_dir):
    """Every document as an upload whose name, length and first bytes go by its id."""
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    turn = F.floor(F.col("doc_id") / len(UPLOAD_NAMES)).cast("bigint")
    uploads = table(spark, sf_dir, "documents").select(
        "doc_id", pick(UPLOAD_NAMES, F.col("doc_id") % len(UPLOAD_NAMES)).alias("filename"),
        F.when(turn % 5 == 0, F.lit(0)).when(turn % 5 == 1, 5242881 + 104857 * (turn % 1000)).otherwise(F.octet_length("text")).alias("length"),
        F.encode(pick(UPLOAD_HEADS, turn % len(UPLOAD_HEADS)), "UTF-8").alias("content"),
    )
    return fl.intake_triage(uploads).select("doc_id", "extension", "kind", "reason")


@query(
    "decode_plain",
    "SELECT doc_id, md5(text) AS as_utf8, true AS same_text FROM documents",
)
def decode_plain(spark, sf_dir):
    """Every document encoded with a byte-order mark, then decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.encode("text", "UTF-8").alias("bytes"))
    marked = docs.withColumn("content", F.concat(F.lit(b"\xef\xbb\xbf"), "bytes"))
    decoded = fl.decode_files(marked.select("doc_id", "content", F.col("text").alias("original")))
    return decoded.select("doc_id", F.md5("text").alias("as_utf8"), (F.col("text") == F.col("original")).alias("same_text"))


FILE_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_FILES_SQL = ", ".join(f"('{n}')" for n in FILE_NAMES)


@query(
    "integrity_check",
    f"""SELECT n || '.parquet' AS filename, CASE n WHEN 'region' THEN 'mismatch' WHEN 'part' THEN 'not recorded' WHEN 'nation' THEN 'record missing'
    WHEN 'gone' THEN 'file missing' ELSE 'ok' END AS status FROM (VALUES {_FILES_SQL}, ('gone')) t(n)""",
)
def integrity_check(spark, sf_dir):
    """Files against a manifest that has lost one record, gained one and altered one."""
    hashes = materialise(fl.hash_folder(spark, sf_dir, TABLES).drop("length"), "hashes")  # every file is read once
    altered = hashes.where("filename <> 'nation.parquet'").select(
        "filename",
        F.when(F.col("filename") == "region.parquet", F.lit("0" * 64)).when(F.col("filename") == "part.parquet", None).otherwise(F.col("sha256")).alias("sha256"),
    )
    gone = hashes.where("filename = 'nation.parquet'").select(F.lit("gone.parquet").alias("filename"), "sha256")
    return fl.integrity_check(hashes, altered.unionByName(gone))


@query(
    "immutable_version",
    "SELECT DISTINCT 'v' || year(l_shipdate) AS version FROM lineitem WHERE year(l_shipdate) NOT IN (SELECT DISTINCT year(o_orderdate) FROM orders WHERE year(o_orderdate) < 1998)",
)
def immutable_version(spark, sf_dir):
    """Runs named after years: those already recorded are refused, the rest appended and listed."""
    path = scratch_path(spark, "runs")
    stamp = lambda df, c: df.select(F.concat(F.lit("v"), F.year(c).cast("string")).alias("version")).distinct()
    existing = stamp(table(spark, sf_dir, "orders").where("year(o_orderdate) < 1998"), "o_orderdate")
    new = stamp(table(spark, sf_dir, "lineitem"), "l_shipdate").withColumn("n", F.lit(1))
    tb.refuse_existing(new, existing).write.mode("errorifexists").partitionBy("version").parquet(path)
    return tb.list_versions(spark, path)


@query(
    "run_log",
    """SELECT 'v1' AS version, 42 AS seed, '{''learning_rate'': 0.05}' AS params, '{"ndcg_at_10":0.9}' AS metrics, count(*) AS n_rows FROM lineitem""",
)
def run_log(spark, sf_dir):
    """Provenance of a run, carrying counts derived from the tables."""
    counts = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("l_quantity") >= 44).alias("n_top"))
    entry = {"version": "v1", "seed": 42, "params": {"learning_rate": 0.05}, "metrics": {"ndcg_at_10": 0.9, "passed": True, "note": "x"}}
    logged = tb.run_log(spark, entry)
    return logged.select("version", "seed", "params", F.to_json("metrics").alias("metrics"), counts.select("n_rows").scalar().alias("n_rows"))


@query(
    "run_commits",
    """WITH r AS (SELECT 'v1' AS version, 1 AS seed, count(*) AS n_rows, 'open' AS metric, CAST(count(*) FILTER (o_orderstatus = 'O') AS DOUBLE) AS value FROM orders
    UNION ALL SELECT 'v2', 2, count(*), 'most', max(l_quantity) FROM lineitem UNION ALL SELECT 'v2', 2, count(*), 'parts', count(DISTINCT l_partkey) FROM lineitem)
    SELECT version, seed, 't' || seed AS made_from, n_rows, n_rows AS n_kept, metric, value FROM r""",
)
def run_commits(spark, sf_dir):
    """Two runs published with counts of their tables; a repeat of the first is refused and changes nothing."""
    root = scratch_path(spark, "store")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    tries = [
        vs.commit_version(orders, root, "v1", 1, {"from": "t1"}, {"open": F.count_if(F.col("o_orderstatus") == "O")}),
        vs.commit_version(lines, root, "v2", 2, {"from": "t2"}, {"most": F.max("l_quantity"), "parts": F.count_distinct("l_partkey")}),
        vs.commit_version(lines, root, "v1", 3, {"from": "t3"}, {"most": F.max("l_quantity")}),
    ]
    kept = [vs.read_version(spark, root, t.version).agg(F.lit(t.version).alias("version"), F.count(F.lit(1)).alias("n_kept")) for t in tries if t.published]
    runs = vs.read_runs(spark, root).join(kept[0].unionByName(kept[1]), "version")
    return runs.select("version", "seed", F.col("params")["from"].alias("made_from"), "n_rows", "n_kept", F.explode("metrics").alias("metric", "value"))


@query(
    "redact",
    """SELECT event_id, '{"k":"[redacted]"}' AS props FROM events""",
)
def redact(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", gd.redact_json(F.col("props"), ["K"]).alias("props"))


@query(
    "redact_nested",
    """SELECT conv_id, turn, role, '[redacted]' AS inner_text, '[redacted]' AS listed_email, CAST(length(text) AS BIGINT) AS kept FROM conversations""",
)
def redact_nested(spark, sf_dir):
    """Structs and lists of structs, several levels down."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.struct("role", F.struct(F.col("text").alias("Text"), F.length("text").cast("bigint").alias("n")).alias("body")).alias("message"),
        F.array(F.struct(F.col("text").alias("email"), F.lit(1).alias("at"))).alias("contacts"),
    )
    clean = gd.redact(turns)
    return clean.select(
        "conv_id", "turn", "message.role", F.col("message.body.Text").alias("inner_text"),
        F.col("contacts")[0]["email"].alias("listed_email"), F.col("message.body.n").alias("kept"),
    )


@query(
    "redact_json",
    """SELECT conv_id, turn, '{"message":{"role":"' || role || '","body":{"Text":"[redacted]","n":' || CAST(length(text) AS BIGINT)
      || '}},"contacts":[[{"EMAIL":"[redacted]","at":1,"share":0.5}]]}' AS body FROM conversations""",
)
def redact_json(spark, sf_dir):
    """JSON text with objects and lists nested three levels deep; numbers stay numbers."""
    turns = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(
        F.struct("role", F.struct(F.col("text").alias("Text"), F.length("text").cast("bigint").alias("n")).alias("body")).alias("message"),
        F.array(F.array(F.struct(F.col("text").alias("EMAIL"), F.lit(1).alias("at"), F.lit(0.5).alias("share")))).alias("contacts"),
    ))
    return turns.select("conv_id", "turn", gd.redact_json(body).alias("body"))


@query("event_counters", "SELECT event_type, CAST(floor(user_id / 50) AS BIGINT) AS tier, count(*) AS n FROM events GROUP BY 1, 2")
def event_counters(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("tier", F.floor(F.col("user_id") / 50))
    return mo.event_counters(events, ["event_type", "tier"])


@query("event_counters_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_counters_stream(spark, sf_dir):
    """The same counters from a file stream run to its end."""
    schema = table(spark, sf_dir, "events").schema
    return sm.stream_counters(sm.read_stream(spark, sf_dir, "events.parquet", schema), ["event_type"])


_FEEDS_SQL = """e AS (SELECT *, coalesce(event_id % 4, 0) >= 2 AS second, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end FROM events),
    m AS (SELECT max(ts) FILTER (NOT second) - INTERVAL 10 DAY AS first_mark, max(ts) - INTERVAL 10 DAY AS last_mark FROM e),
    judged AS (SELECT e.*, ts IS NULL OR (second AND coalesce(window_end <= first_mark, false)) AS late, last_mark FROM e, m)"""


def _windowed_events(spark, sf_dir):
    """Events arriving in two feeds, the second read by a new run that goes on from the checkpoint."""
    events, path = table(spark, sf_dir, "events"), scratch_path(spark, "feeds")
    second = F.coalesce(F.col("event_id") % 4, F.lit(0)) >= 2
    for feed in (events.where(~second), events.where(second)):
        feed.write.mode("append").parquet(f"{path}/feed")
        stream = sm.read_stream(spark, f"{path}/feed", "*.parquet", events.schema, None)
        found = sm.windowed_with_late(stream, "ts", ["event_type"], "1 day", "10 days", f"{path}/windows")
    return found


@query(
    "event_windows",
    f"""WITH {_FEEDS_SQL} SELECT strftime(window_end - INTERVAL 1 DAY, '%Y-%m-%d') AS day, event_type, count(*) AS n, coalesce(window_end <= last_mark, false) AS closed
    FROM judged WHERE NOT late GROUP BY window_end, event_type, last_mark""",
)
def event_windows(spark, sf_dir):
    counts, _ = _windowed_events(spark, sf_dir)
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "closed")


@query("event_windows_late", f"WITH {_FEEDS_SQL} SELECT event_id, event_type, user_id, value FROM judged WHERE late")
def event_windows_late(spark, sf_dir):
    _, late = _windowed_events(spark, sf_dir)
    return late.select("event_id", "event_type", "user_id", "value")


@query(
    "drift_snapshot_stream",
    "SELECT 'value' AS feature, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev FROM events",
)
def drift_snapshot_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    found = sm.stream_feature_moments(sm.read_stream(spark, sf_dir, "events.parquet", schema), ["value"])
    return found.select("feature", "n", round6("mean").alias("mean"), round6("stdev").alias("stdev"))


@query("latency_histogram", _histogram_sql("WITH timed AS (SELECT event_type, value / 100.0 AS seconds FROM events)", "seconds", mo.LATENCY_BUCKETS, "timed", "event_type"))
def latency_histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100.0).alias("seconds"))
    return mo.histogram(events, "seconds", mo.LATENCY_BUCKETS, ["event_type"]).withColumn("total", F.round("total", 4))


@query(
    "embedding_vectors",
    "SELECT 'e' || i AS feature, count(*) AS n, round(avg(embedding[i]), 5) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i",
)
def embedding_vectors(spark, sf_dir):
    """Drift snapshot over nested vectors: all 64 positions read as features."""
    names = [f"e{i}" for i in range(1, 65)]
    rows = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i + 1}") for i in range(64)])
    return mo.feature_drift_snapshot(rows, names).select("feature", "n", F.round("mean", 5).alias("mean"))


@query(
    "previews_of_turns",
    r"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\n\r')), lambda x: x <> '' AND NOT regexp_full_match(x, '[A-Z][A-Z &]{2,}'))[1] AS line FROM conversations)
    SELECT conv_id, turn, CASE WHEN line IS NULL THEN 'Empty' WHEN length(line) > 64 THEN substr(line, 1, 64) || '…' ELSE line END AS preview FROM l""",
)
def previews_of_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", xt.text_preview(F.col("text")).alias("preview"))
