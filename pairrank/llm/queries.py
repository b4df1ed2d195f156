"""The queries of this package over the given tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.llm import (
    bpe, collocations, conversations, decontaminate, langid, licences, quality, shards, simhash, topk, toxicity, warc, webpages,
)
from pairrank.llm.common import held_out, load, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, "text", grammar).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_matches"
    )


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_decode(docs, "text", public_tokenizers.path("word_bpe_49k.json"), keep=())
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, "text", model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, "doc_id", "text").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS k, least(len(w), 10) AS l
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, l, array_to_string(list_slice(w, s, s + l - 1), ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, greatest(len(w) - l + 2, 1))) AS s FROM d, (SELECT DISTINCT l FROM iw))
), m AS (
  SELECT doc_id, s, dw.l, item_id FROM dw JOIN iw ON dw.k = iw.k
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT doc_id, s, l FROM m)) GROUP BY doc_id
), x AS (
  SELECT doc_id, count(*) AS n, string_agg(v, ',' ORDER BY v) AS v
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(x.n, 0) AS BIGINT) AS n_items, sha256(coalesce(x.v, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)
"""


@query("op8_decontamination", OP8_SQL)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op5_licences")
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan_licences(docs, "text", keep_spans=False).drop("text")


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


@query("op6_topk", OP6_SQL)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(load(spark, sf_dir, "documents"), "doc_id", "text").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha1(body) || '0' AS h FROM p
), k AS (
  SELECT page_id, n, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      ((strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 1 AS INTEGER), 1)) - 1) * 16
       + strpos('0123456789abcdef', substr(h, CAST(5 * i // 4 + 2 AS INTEGER), 1)) - 1)
      // CAST(power(2, 3 - (5 * i) % 4) AS BIGINT) % 32 AS INTEGER), 1)), '') AS digest
  FROM d
), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query("op4_warc", OP4_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"), "page_id", "url", "html")


@query("op1_html")
def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webpages.extract(load(spark, sf_dir, "pages"), "page_id", "url", "html")


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), t AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda s: array_to_string(list_slice(w, s, s + k - 1), ' '))) AS phrase
        FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY lang, k, phrase HAVING count(*) >= 30
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS x, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), s AS (
  SELECT c.lang, c.k, c.phrase, a, cut, l.f AS l, r.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.k = cut AND l.phrase = array_to_string(list_slice(x, 1, cut), ' ')
         JOIN f r ON r.lang = c.lang AND r.k = c.k - cut AND r.phrase = array_to_string(list_slice(x, cut + 1, c.k), ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), i AS (
  SELECT lang, phrase, max(f) AS around
  FROM (SELECT lang, f, unnest(list_transform(range(1, k - z + 2), lambda s: array_to_string(list_slice(string_split(phrase, ' '), s, s + z - 1), ' '))) AS phrase
        FROM f, (SELECT unnest([2, 3]) AS z) WHERE k > z)
  GROUP BY lang, phrase
), o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS place
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE around IS NULL OR 100 * CAST(around AS HUGEINT) < 80 * CAST(a AS HUGEINT)
)
SELECT o.lang, CAST(place AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, t.n, score
FROM o JOIN t ON t.lang = o.lang WHERE place <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"), "text", "lang")


@query("op13_langid")
def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = langid.fit(docs, "text", "lang", ~held)
    return langid.classify(docs.select("doc_id", "text", held.alias("held_out")), "text", model).drop("text")


OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS tab
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'),
               lambda h: CAST('0x' || h AS BIGINT)),
             lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS fate
  FROM conversations, crc
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM src, (SELECT unnest([1, 2]) AS copy) WHERE fate <> 0 AND (copy = 1 OR fate = 3)
), tidy AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM hurt
), rows AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN right(body, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault
  FROM tidy
), total AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate,
         count_if(fault = 't') AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS size
  FROM rows GROUP BY conv_id
), step AS (
  SELECT * FROM (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')) v(q, initial, z)
), pad AS (
  SELECT * FROM (VALUES ('0', '0', '', 0, []), ('0', 'u', 'I', 5, ['user:']), ('0', 'a', 'II', 10, ['user:', 'assistant:']),
    ('s', 's', '', 0, []), ('s', 'u', 'I', 5, ['user:']), ('s', 'a', 'II', 10, ['user:', 'assistant:']),
    ('u', 'u', '', 0, []), ('u', 'a', 'I', 5, ['assistant:']), ('u', 'u', 'II', 10, ['assistant:', 'user:']),
    ('a', 'a', '', 0, []), ('a', 'u', 'I', 5, ['user:']), ('a', 'a', 'II', 10, ['user:', 'assistant:'])) v(q, z, edits, cost, lines)
), way AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '0' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM total
  UNION ALL
  SELECT conv_id, i, z, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, z ORDER BY cost, audit) AS best FROM (
      SELECT w.conv_id, r.i, e.z, CAST(w.cost + p.cost + e.cost AS BIGINT) AS cost, w.audit || p.edits || e.edit AS audit,
             list_concat(list_concat(w.lines, CAST(p.lines AS VARCHAR[])), e.line) AS lines
      FROM way w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN pad p ON p.q = w.state,
      LATERAL (
        SELECT p.z AS z, 2 AS cost, 'D' AS edit, CAST([] AS VARCHAR[]) AS line
        UNION ALL SELECT step.z, CASE WHEN r.fault = 't' THEN 5 ELSE 0 END, 'K', [r.role || ':' || r.text]
          FROM step WHERE step.q = p.z AND step.initial = r.initial AND r.fault IN ('-', 't')
        UNION ALL SELECT step.z, CASE WHEN r.fault = 't' THEN 6 ELSE 1 END, 'R', [CASE step.z WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text]
          FROM step WHERE step.q = p.z AND step.initial <> 's' AND r.fault IN ('-', 't')
      ) e
    )
  ) WHERE best = 1
), ended AS (
  SELECT w.conv_id, w.cost + p.cost AS cost, w.audit || p.edits AS audit, list_concat(w.lines, CAST(p.lines AS VARCHAR[])) AS lines,
         row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + p.cost, w.audit || p.edits) AS best
  FROM way w JOIN total t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = t.size JOIN pad p ON p.q = w.state AND p.z IN ('0', 'a')
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN total t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.best = 1
"""


@query("op11_conversations", OP11_SQL)
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
