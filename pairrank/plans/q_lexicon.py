"""Text against vocabularies that are tables: part descriptions and the openings of the benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairrank.functions import text as tx
from pairrank.operators import lexicon as lx
from pairrank.plans.entities import table
from pairrank.plans.q_text import canon_sql
from pairrank.plans.registry import query

# Every part with its brand, and the first one to four words of every item.
SAID_SQL = f"""vocab AS (SELECT phrase AS v_phrase, max(code) AS v_code FROM (
    SELECT {canon_sql("p_name || ' ' || p_brand")} AS phrase, p_type AS code FROM part
    UNION ALL SELECT array_to_string(list_slice(string_split({canon_sql('text')}, ' '), 1, 1 + item_id % 4), ' '), 'item ' || item_id FROM benchmark)
  WHERE phrase <> '' GROUP BY phrase),
docs AS (SELECT doc_id, ' ' || {canon_sql('text')} || ' ' AS padded FROM documents),
hits AS (SELECT DISTINCT doc_id, v_phrase, v_code FROM docs JOIN vocab ON contains(padded, ' ' || v_phrase || ' '))"""


def _said_vocabulary(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(tx.canonical_text(F.concat("p_name", F.lit(" "), "p_brand")).alias("phrase"), F.col("p_type").alias("code"))
    opening = F.slice(F.split(tx.canonical_text(F.col("text")), " "), F.lit(1), (1 + F.col("item_id") % 4).cast("int"))
    items = table(spark, sf_dir, "benchmark").select(F.array_join(opening, " ").alias("phrase"), F.concat(F.lit("item "), "item_id").alias("code"))
    return lx.entries(parts.unionByName(items))


@query(
    "tag_phrases_table",
    f"""WITH {SAID_SQL} SELECT d.doc_id, coalesce(codes, '') AS codes FROM docs d
    LEFT JOIN (SELECT doc_id, string_agg(v_code, '|' ORDER BY v_code) AS codes FROM (SELECT DISTINCT doc_id, v_code FROM hits) GROUP BY doc_id) h ON d.doc_id = h.doc_id""",
)
def tag_phrases_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tagged = lx.tag_phrases(docs, "doc_id", tx.canonical_text(F.col("text")), _said_vocabulary(spark, sf_dir))
    return tagged.select("doc_id", F.array_join("codes", "|").alias("codes"))


@query(
    "phrase_coverage_table",
    f"""WITH {SAID_SQL} SELECT v.v_phrase AS phrase, count(h.doc_id) AS n_documents FROM vocab v LEFT JOIN hits h ON h.v_phrase = v.v_phrase GROUP BY v.v_phrase""",
)
def phrase_coverage_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lx.phrase_coverage(docs, "doc_id", tx.canonical_text(F.col("text")), _said_vocabulary(spark, sf_dir))


@query("tag_entities_table")
def tag_entities_table(spark, sf_dir):
    """Longest dictionary matches of part names and item openings in the raw text, with their places."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("phrase"), F.col("p_type").alias("code"))
    opening = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(lx.TOKEN), F.lit(0)), 1, 5), "")
    items = table(spark, sf_dir, "benchmark").select(opening.alias("phrase"), F.concat(F.lit("item "), "item_id").alias("code"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lx.entity_spans(docs, "doc_id", F.col("text"), lx.entries(names.unionByName(items)))
    said = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["code"]))
    return found.select("doc_id", F.size("spans").alias("n_spans"), F.array_join(said, "|").alias("spans"))


# Pieces of the descriptions as keys; what is asked wraps the whole description.
PIECE_SQL = f"""pieces AS (SELECT substr(d, 1 + CAST(p_partkey % 5 AS INTEGER), 3 + CAST(p_partkey % 9 AS INTEGER)) AS phrase, p_type AS code, p_partkey
    FROM (SELECT *, {canon_sql("p_name || ' ' || p_brand")} AS d FROM part)),
keys AS (SELECT phrase, max(struct_pack(place := p_partkey, code := code)) AS last FROM pieces WHERE phrase <> '' GROUP BY phrase),
asked AS (SELECT p_partkey, {canon_sql("'new ' || p_name || ' ' || p_brand || ' size ' || p_size")} AS said FROM part)"""


@query(
    "match_contained_table",
    f"""WITH {PIECE_SQL}, found AS (SELECT said, last.code AS code, row_number() OVER (PARTITION BY said ORDER BY length(phrase) DESC, last.place DESC, phrase) AS k
      FROM (SELECT DISTINCT said FROM asked) a JOIN keys ON contains(said, phrase))
    SELECT p_partkey, code FROM asked LEFT JOIN found ON found.said = asked.said AND k = 1""",
)
def match_contained_table(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    described = tx.canonical_text(F.concat("p_name", F.lit(" "), "p_brand"))
    piece = F.substring(described, (1 + F.col("p_partkey") % 5).cast("int"), (3 + F.col("p_partkey") % 9).cast("int"))
    keys = lx.entries(parts.select(piece.alias("phrase"), F.col("p_type").alias("code"), "p_partkey"), place="p_partkey")
    said = tx.canonical_text(F.concat(F.lit("new "), "p_name", F.lit(" "), "p_brand", F.lit(" size "), "p_size"))
    asked = parts.select("p_partkey", said.alias("said"))
    found = lx.match_contained(asked, "said", keys)
    return asked.join(found, F.col("said") == F.col("a_phrase"), "left").select("p_partkey", "code")


# Descriptions with a character lost, and in every other row one too many; similarity by a bit-parallel fold over all pairs.
LOST = "substr(d, 1, CAST(p_partkey % length(d) AS INTEGER)) || substr(d, 2 + CAST(p_partkey % length(d) AS INTEGER))"
DAMAGED_SQL = f"""described AS (SELECT p_partkey, p_brand, {canon_sql("p_name || ' ' || p_type")} AS d FROM part),
damaged AS (SELECT *, CASE WHEN p_partkey % 2 = 1 THEN substr(e, 1, CAST(p_partkey // 7 % length(e) AS INTEGER)) || 'x' || substr(e, 1 + CAST(p_partkey // 7 % length(e) AS INTEGER)) ELSE e END AS said
    FROM (SELECT *, {LOST} AS e FROM described)),
keys AS (SELECT d AS phrase, max(struct_pack(place := p_partkey, code := p_brand)) AS last, CAST(length(d) AS BIGINT) AS n,
    CAST(power(2, length(d)) AS BIGINT) - 1 AS whole,
    list_transform(range(32, 123), lambda a: CAST(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN ascii(substr(d, CAST(i AS INTEGER), 1)) = a THEN CAST(power(2, i - 1) AS BIGINT) ELSE 0 END)) AS BIGINT)) AS masks
    FROM described GROUP BY d)"""
SIMILAR_SQL = """alike AS (SELECT said, last.code AS code, row_number() OVER (PARTITION BY said ORDER BY s DESC, last.place DESC, phrase) AS k FROM (
    SELECT said, phrase, last, 200.0::DOUBLE * (n - bit_count(list_reduce(list_transform(string_split(said, ''), lambda c: masks[ascii(c) - 31]),
      lambda v, m: ((v + (v & m)) | (v - (v & m))) & whole, whole))) / (length(said) + n) AS s
    FROM (SELECT DISTINCT said FROM {asked}) a JOIN keys ON length(said) > 0) WHERE s >= 88)"""


def _described(spark, sf_dir):
    """(p_partkey, d, said): descriptions as they are and damaged; and the vocabulary of the descriptions."""
    key = F.col("p_partkey")
    cut = lambda x, at, skip, new: F.concat(F.substring(x, F.lit(1), at.cast("int")), F.lit(new), F.substring(x, at.cast("int") + skip, F.length(x)))
    lost = lambda d: cut(d, key % F.length(d), 2, "")
    more = lambda e: F.when(key % 2 == 1, cut(e, F.floor(key / 7) % F.length(e), 1, "x")).otherwise(e)
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  a long expression that is used more than once
    d = tx.canonical_text(F.concat("p_name", F.lit(" "), "p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", once(d, lambda d: F.struct(d.alias("d"), once(lost(d), more).alias("said"))).alias("s"))
    rows = rows.select("p_partkey", "p_brand", "s.d", "s.said")
    vocab = lx.entries(rows.select(F.col("d").alias("phrase"), F.col("p_brand").alias("code"), "p_partkey"), place="p_partkey")
    return rows.select("p_partkey", "d", "said"), vocab


@query(
    "match_fuzzy_table",
    f"""WITH {DAMAGED_SQL}, {SIMILAR_SQL.format(asked='damaged')}
    SELECT p_partkey, code FROM damaged LEFT JOIN alike ON alike.said = damaged.said AND k = 1""",
)
def match_fuzzy_table(spark, sf_dir):
    asked, vocab = _described(spark, sf_dir)
    found = lx.match_fuzzy(asked, "said", vocab)
    return asked.join(found, F.col("said") == F.col("a_phrase"), "left").select("p_partkey", "code")


@query(
    "match_cascade_table",
    f"""WITH {DAMAGED_SQL}, mixed AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN d WHEN 1 THEN 'one ' || d || ' boxed' ELSE said END AS said FROM damaged),
    exact AS (SELECT DISTINCT said, last.code AS code FROM mixed JOIN keys ON said = phrase),
    held AS (SELECT said, last.code AS code, row_number() OVER (PARTITION BY said ORDER BY n DESC, last.place DESC, phrase) AS k FROM (SELECT DISTINCT said FROM mixed) m JOIN keys ON contains(said, phrase)),
    {SIMILAR_SQL.format(asked='mixed')}
    SELECT p_partkey, coalesce(e.code, h.code, s.code) AS code,
      CASE WHEN e.code IS NOT NULL THEN 'exact' WHEN h.code IS NOT NULL THEN 'contained' WHEN s.code IS NOT NULL THEN 'fuzzy' END AS step
    FROM mixed m LEFT JOIN exact e ON e.said = m.said LEFT JOIN held h ON h.said = m.said AND h.k = 1 LEFT JOIN alike s ON s.said = m.said AND s.k = 1""",
)
def match_cascade_table(spark, sf_dir):
    rows, vocab = _described(spark, sf_dir)
    said = F.when(F.col("p_partkey") % 3 == 0, F.col("d")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("one "), "d", F.lit(" boxed"))).otherwise(F.col("said"))
    asked = rows.select("p_partkey", said.alias("said"))
    found = lx.match_cascade(asked, "said", vocab)
    return asked.join(found, F.col("said") == F.col("a_phrase"), "left").select("p_partkey", "code", "step")
