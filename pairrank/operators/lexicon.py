"""Matching text against a vocabulary that is a table of any size: ``phrase``, ``code`` (and ``place``, the order of entries).

Nothing is a literal of the plan and nothing is broadcast by force: each operator turns text and vocabulary into keys that both
sides share, joins on them and verifies. Catalyst broadcasts a small vocabulary by its measured size and otherwise shuffles,
with adaptive skew handling and run-time Bloom filters.

* **Token windows.** A phrase of n words can only stand where a window of n words has its hash; windows are formed for the
  lengths the vocabulary has.
* **Rarest character n-gram.** A key that is contained in a text shares all its n-grams with it, so it is enough to file each key under
  the one that the fewest texts hold.
* **Prefix-filtered similarity join.** A least similarity is a least number of shared bigrams; two strings that share so many
  share one among the rarest few of each.

Null and empty texts match nothing. Repeated rows of the text side get equal answers each; a phrase that is entered twice counts with
its largest ``place``. Vocabulary columns are renamed before any join, so extra columns of the text side may have their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.functions import text as tx

#: A word, or any single character between words.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
WORD = r"^[\p{L}\p{N}_]"
GRAM = 3
#: At every word the window that begins with it and has so many more words. Words are what stands between single blanks.
WINDOW = r"(?<![^ ])(?=([^ ]*+(?: [^ ]*+){%d}+))[^ ]*+"


def entries(vocabulary: DataFrame, phrase: str = "phrase", code: str = "code", place: str | None = None) -> DataFrame:
    """The vocabulary as ``v_phrase``, ``v_code``, ``v_place``: one row a phrase, the entry with the largest place (then code) wins."""
    rows = vocabulary.select(
        F.col(phrase).alias("v_phrase"), F.col(code).alias("v_code"), (F.col(place) if place else F.lit(0)).cast("long").alias("v_place")
    ).where(F.col("v_phrase").isNotNull() & (F.col("v_phrase") != ""))
    return rows.groupBy("v_phrase").agg(F.max(F.struct("v_place", "v_code")).alias("last")).select(
        "v_phrase", "last.v_code", "last.v_place"
    )


#: Tokens between two known places of a text.
STRIDE = 32


def _places(tokens: Column) -> Column:
    """Characters before every ``STRIDE``-th token."""
    return F.aggregate(
        F.sequence(F.lit(0), (F.size(tokens) / STRIDE).cast("int")),
        F.array(F.lit(0)),
        lambda seen, k: F.array_append(
            seen, F.element_at(seen, -1) + F.length(F.array_join(F.slice(tokens, k * STRIDE + 1, F.lit(STRIDE)), ""))
        ),
    )


def _windows(cut: DataFrame, row: str) -> DataFrame:
    """(``row``, window, at, n, start) of all windows of ``sizes`` tokens between which and their neighbours no word is cut.

    Places come out of plain generators and windows are plain columns: in a function with a lambda Spark would interpret them.
    What stands before a window is counted from the last known place, not from the start of the text.
    """
    word = lambda c: F.coalesce(F.rlike(c, F.lit(WORD)), F.lit(False))
    known = cut.withColumn("solid", F.transform("tokens", word)).withColumn("places", _places(F.col("tokens")))
    sized = known.select(row, "tokens", "solid", "places", F.explode("sizes").alias("n")).where(F.size("tokens") >= F.col("n"))
    placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("n"))).alias("at"))
    solid = lambda at: F.coalesce(F.get("solid", at), F.lit(False))
    at, n = F.col("at"), F.col("n")
    last = (at / STRIDE).cast("int")
    rest = F.slice("tokens", last * STRIDE + 1, at - last * STRIDE)
    return placed.where(~solid(at - 1) & ~solid(at + n)).select(
        row, F.array_join(F.slice("tokens", at + 1, n), "").alias("window"), "at", "n",
        (F.get("places", last) + F.length(F.array_join(rest, ""))).alias("start"),
    )


def phrase_hits(docs: DataFrame, row: str, canonical: Column, vocab: DataFrame) -> DataFrame:
    """Distinct (``row``, ``v_phrase``, ``v_code``): phrases on word boundaries of canonical text. ``row`` identifies a text."""
    listed = vocab.withColumn("v_words", F.split("v_phrase", " "))
    sizes = listed.agg(F.collect_set(F.size("v_words")).alias("sizes")).scalar()
    # A text that repeats a phrase sends it once.
    sized = docs.select(F.col(row), canonical.alias("whole"), sizes.alias("sizes")).select(row, "whole", F.explode("sizes").alias("n"))
    windows = F.regexp_extract_all("whole", F.format_string(WINDOW, F.col("n") - 1), F.lit(1))
    found = sized.select(row, F.explode(F.array_distinct(windows)).alias("window"))
    return found.join(vocab, F.col("window") == F.col("v_phrase")).select(row, "v_phrase", "v_code").distinct()


def tag_phrases(docs: DataFrame, row: str, canonical: Column, vocab: DataFrame) -> DataFrame:
    """Every ``row`` with ``codes``: the sorted codes whose phrase stands in the text on word boundaries."""
    hits = phrase_hits(docs, row, canonical, vocab).groupBy(row).agg(F.array_sort(F.collect_set("v_code")).alias("codes"))
    return _completed(docs, row, hits, "codes")


def _completed(docs: DataFrame, row: str, found: DataFrame, column: str) -> DataFrame:
    named = found.withColumnRenamed(row, "r_row")
    joined = docs.select(row).join(named, F.col(row).eqNullSafe(F.col("r_row")), "left")
    return joined.select(row, F.coalesce(column, F.array().cast(found.schema[column].dataType)).alias(column))


def entity_spans(docs: DataFrame, row: str, text: Column, vocab: DataFrame) -> DataFrame:
    """Every ``row`` with ``spans``: (``start`` in characters from 0, ``span``, ``code``) of the dictionary matches in lower-cased text.

    Matches begin and end at token boundaries; from left to right the longest one at a place is taken and the
    search goes on behind it. Phrases keep their punctuation and spaces.
    """
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    listed = vocab.select(F.lower("v_phrase").alias("v_span"), "v_code", "v_place").groupBy("v_span").agg(
        F.max(F.struct("v_place", "v_code")).alias("last")
    ).select("v_span", F.col("last.v_code").alias("v_code"), tokens(F.col("v_span")).alias("v_tokens"))
    sizes = listed.agg(F.collect_set(F.size("v_tokens")).alias("sizes")).scalar()
    cut = docs.select(F.col(row), tokens(text).alias("tokens")).withColumn("sizes", sizes)
    hits = _windows(cut, row).join(listed, F.col("window") == F.col("v_span"))
    # One longest match for a place, then those that don't begin inside the one before.
    longest = hits.groupBy(row, "at").agg(F.max(F.struct("n", "start", "v_span", "v_code")).alias("m"))
    ordered = longest.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("all"))
    taken = F.aggregate(
        "all",
        F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start: int, span: string, code: string>>").alias("spans")),
        lambda acc, x: F.when(
            x["at"] >= acc["free"],
            F.struct(
                (x["at"] + x["m"]["n"]).alias("free"),
                F.array_append(
                    acc["spans"],
                    F.struct(x["m"]["start"].alias("start"), x["m"]["v_span"].alias("span"), x["m"]["v_code"].cast("string").alias("code")),
                ).alias("spans"),
            ),
        ).otherwise(acc),
        lambda acc: acc["spans"],
    )
    return _completed(docs, row, ordered.select(row, taken.alias("spans")), "spans")


def phrase_coverage(docs: DataFrame, row: str, canonical: Column, vocab: DataFrame) -> DataFrame:
    """``phrase`` and ``n_documents``: how many texts hold each phrase of the vocabulary, none included."""
    counts = phrase_hits(docs, row, canonical, vocab).groupBy("v_phrase").agg(F.count(F.lit(1)).alias("n"))
    return vocab.select("v_phrase").join(counts, "v_phrase", "left").select(
        F.col("v_phrase").alias("phrase"), F.coalesce("n", F.lit(0)).cast("long").alias("n_documents")
    )


def _grams(text: Column, n: Column | int) -> Column:
    size = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at, size))


def match_exact(asked: DataFrame, phrase: str, vocab: DataFrame) -> DataFrame:
    """Distinct (``a_phrase``, ``code``) of the asked phrases that are entries."""
    return _distinct(asked, phrase).join(vocab, F.col("a_phrase") == F.col("v_phrase")).select("a_phrase", F.col("v_code").alias("code"))


def _distinct(asked: DataFrame, phrase: str) -> DataFrame:
    return asked.select(F.col(phrase).alias("a_phrase")).where(F.col("a_phrase").isNotNull() & (F.col("a_phrase") != "")).distinct()


def match_contained(asked: DataFrame, phrase: str, vocab: DataFrame) -> DataFrame:
    """Distinct (``a_phrase``, ``code``): the longest entry that is a raw substring of the phrase, the largest place and then the least entry first.

    An entry shorter than ``GRAM`` is filed under itself.
    """
    texts = _distinct(asked, phrase)
    filed = vocab.withColumn("size", F.least(F.length("v_phrase"), F.lit(GRAM)))
    sizes = filed.agg(F.collect_set("size").alias("sizes")).scalar()
    grams = texts.withColumn("sizes", sizes).select(
        "a_phrase", F.explode(F.array_distinct(F.flatten(F.transform("sizes", lambda n: _grams(F.col("a_phrase"), n))))).alias("gram")
    )
    held = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    # A gram that no text holds drops its entry here: it can't be contained in any.
    own = filed.select("v_phrase", "v_code", "v_place", "size", F.explode(F.array_distinct(_grams(F.col("v_phrase"), F.col("size")))).alias("gram"))
    all_grams = own.groupBy("v_phrase").agg(F.count(F.lit(1)).alias("needed"))
    known = own.join(held, "gram").groupBy("v_phrase", "v_code", "v_place").agg(
        F.min(F.struct("texts", "gram")).alias("rarest"), F.count(F.lit(1)).alias("there")
    )
    index = known.join(all_grams, "v_phrase").where("there = needed").select("v_phrase", "v_code", "v_place", F.col("rarest.gram").alias("gram"))
    found = grams.join(index, "gram").where(F.contains("a_phrase", F.col("v_phrase")))
    best = F.min_by("v_code", F.struct(-F.length("v_phrase"), -F.col("v_place"), F.col("v_phrase")))
    return found.groupBy("a_phrase").agg(best.alias("code"))


def similarity(a: str, b: str) -> float:
    """``200 LCS / (len a + len b)``, bit-parallel (Crochemore et al. 2001) on whole numbers of any width."""
    if not a and not b:
        return 0.0
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return 200.0 * (len(a) - state.bit_count()) / (len(a) + len(b))


def _similar(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def _numbered_bigrams(phrase: Column) -> Column:
    """Bigrams of the padded string, repeated ones told apart by their number: n + 1 different items for n characters."""
    pairs = _grams(F.concat(F.lit("\u0002"), phrase, F.lit("\u0003")), 2)
    numbered = F.transform(pairs, lambda g, k: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), k + 1), lambda h: h == g)).cast("string")))
    return numbered


def match_fuzzy(asked: DataFrame, phrase: str, vocab: DataFrame, threshold: float = tx.FUZZY_THRESHOLD) -> DataFrame:
    """Distinct (``a_phrase``, ``code``): the most similar entry at or above ``threshold``, the largest place and then the least entry first.

    From similarity s = threshold / 200 follow, for lengths n and m and d = n + m - 2 LCS insertions and deletions: d <= (1 - 2 s)(n + m);
    the shorter length is at least s (n + m); and as an insertion or deletion touches two bigrams at most, max(n, m) + 1 - 2 d
    of them are shared. For a string of n that is never below n + 1 - 4 (1 - 2 s) n, so one of its rarest
    4 (1 - 2 s) n + 1 bigrams is shared. Below a threshold of 75 the bound says nothing, which is an error.
    """
    if not 75 < threshold <= 100:
        raise ValueError("the bigram bound needs a threshold above 75 and at most 100")
    s, loss = threshold / 200.0, 1 - threshold / 100.0
    texts = _distinct(asked, phrase)
    sides = texts.select(F.lit(0).alias("side"), F.col("a_phrase").alias("p"), F.lit(None).cast(vocab.schema["v_code"].dataType).alias("v_code"), F.lit(0).cast("long").alias("v_place")).unionByName(
        vocab.select(F.lit(1).alias("side"), F.col("v_phrase").alias("p"), "v_code", "v_place")
    )
    items = sides.select("*", F.explode(_numbered_bigrams(F.col("p"))).alias("item"))
    common = items.groupBy("item").agg(F.count(F.lit(1)).alias("strings"))
    ranked = items.join(common, "item").groupBy("side", "p", "v_code", "v_place").agg(
        F.array_sort(F.collect_list(F.struct("strings", "item"))).alias("items")
    )
    # 1e-9 keeps rounding from ever taking a bigram too few.
    prefix = F.floor(F.length("p") * (4 * loss) + 1e-9).cast("int") + 1
    heads = ranked.select("side", "p", "v_code", "v_place", F.length("p").alias("n"), F.explode(F.slice("items", F.lit(1), prefix)["item"]).alias("item"))
    left = heads.where("side = 0").select(F.col("p").alias("a_phrase"), F.col("n").alias("a_n"), "item")
    right = heads.where("side = 1").select(F.col("p").alias("v_phrase"), F.col("n").alias("v_n"), "v_code", "v_place", "item")
    close = F.least("a_n", "v_n") + 1e-9 >= (F.col("a_n") + F.col("v_n")) * s
    pairs = left.join(right, "item").where(close).select("a_phrase", "v_phrase", "v_code", "v_place").distinct()
    scored = pairs.withColumn("similarity", F.arrow_udf(_similar, "double")("a_phrase", "v_phrase")).where(F.col("similarity") >= threshold)
    best = F.min_by("v_code", F.struct(-F.col("similarity"), -F.col("v_place"), F.col("v_phrase")))
    return scored.groupBy("a_phrase").agg(best.alias("code"))


def match_cascade(asked: DataFrame, phrase: str, vocab: DataFrame, threshold: float = tx.FUZZY_THRESHOLD) -> DataFrame:
    """Distinct (``a_phrase``, ``code``, ``step``): exact, else contained, else fuzzy; phrases without an answer are absent."""
    texts = _distinct(asked, phrase)
    exact = match_exact(texts, "a_phrase", vocab).withColumn("step", F.lit("exact"))
    rest = texts.join(exact.select("a_phrase"), "a_phrase", "left_anti")
    contained = match_contained(rest, "a_phrase", vocab).withColumn("step", F.lit("contained"))
    rest = rest.join(contained.select("a_phrase"), "a_phrase", "left_anti")
    fuzzy = match_fuzzy(rest, "a_phrase", vocab, threshold).withColumn("step", F.lit("fuzzy"))
    return exact.unionByName(contained).unionByName(fuzzy)


def canonical_vocabulary(vocabulary: DataFrame, phrase: str, code: str, place: str | None = None) -> DataFrame:
    """:func:`entries` by canonical form."""
    return entries(vocabulary.withColumn(phrase, tx.canonical_text(F.col(phrase))), phrase, code, place)
