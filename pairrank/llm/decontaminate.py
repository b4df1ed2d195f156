"""Benchmark passages in training text, by a stored positional inverted index and native functions only.

Every text is split once. The places of the words that benchmark items hold are written as
postings (code of the term, document, place), ordered by term within a range of documents: a
frequent term has a list in every range, never one for all of them. A window of an item (ten
consecutive words) begins at ``place - offset`` of each of its words, so its occurrences are
what the lists of its words have in common after that shift. The list of the rarest word is
taken first, that of the next rarest is intersected with it, then those of all other words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import words
from pairrank.session import materialise

#: No word holds the character zero: as a first word it gives every text one posting, which holds its length.
MARK, MARK_CODE = "\0", -1


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item, window) of all windows; a shorter item is one window, one without words none."""
    split = items.select(F.col(f"`{item_id}`").alias("item"), words(F.col(f"`{text}`")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return split.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window")).distinct()


def _same_term(a: str, b: str) -> Column:
    """Equality of two words by way of a hash: an integer key joins several times faster than a string."""
    return (F.xxhash64(a) == F.xxhash64(b)) & (F.col(a) == F.col(b))


def vocabulary(windows: DataFrame) -> DataFrame:
    """(known, code): the distinct words of ``windows`` with a number each, and the mark. A written table."""
    terms = windows.select(F.explode("window").alias("known")).distinct().withColumn("code", F.monotonically_increasing_id())
    mark = windows.sparkSession.range(1).select(F.lit(MARK).alias("known"), F.lit(MARK_CODE).cast("bigint").alias("code"))
    return materialise(terms.unionByName(mark), "vocabulary")


def store_postings(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(code, doc_id, digest, place), written: where the words of ``known`` stand in ``docs`` (doc_id, text).

    The mark of a text has its number of words as ``place``. ``digest`` is a hash of the
    text. The vocabulary is broadcast when its file is below Spark's threshold in bytes;
    otherwise words are shuffled to it, and adaptive execution splits frequent ones.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words"))
    terms = texts.select("doc_id", "digest", F.size("words").alias("n_words"), F.concat(F.array(F.lit(MARK)), "words").alias("words")).select(
        "doc_id", "digest", "n_words", F.posexplode("words").alias("place", "term")
    )
    place = F.when(F.col("code") == MARK_CODE, F.col("n_words")).otherwise(F.col("place") - 1).alias("place")
    postings = terms.join(known, _same_term("term", "known")).select("code", "doc_id", "digest", place)
    return materialise(postings.sortWithinPartitions("code"), "postings")


def by_rarity(numbered: DataFrame, known: DataFrame, postings: DataFrame) -> DataFrame:
    """(id, length, terms): the (n, at, code) of each window's words, rarest first, by the lengths of their lists. Written.

    Windows with a word that no document has cannot occur and are left out.
    """
    counts = materialise(postings.where(F.col("code") != MARK_CODE).groupBy("code").agg(F.count("*").alias("n")), "counts")
    rated = materialise(known.join(counts, "code"), "rated")
    places = numbered.select("id", F.size("window").alias("length"), F.posexplode("window").alias("at", "term"))
    terms = places.join(rated, _same_term("term", "known")).groupBy("id", "length").agg(F.sort_array(F.collect_list(F.struct("n", "at", "code"))).alias("terms"))
    return materialise(terms.where(F.size("terms") == F.col("length")), "terms")


def _lists(postings: DataFrame, codes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The lists of ``codes`` over all documents, or those whose digests are in ``texts``, under names of their own."""
    lists = postings.join(materialise(codes.select("code").distinct(), "codes"), "code", "left_semi")
    if texts is not None:
        lists = lists.join(materialise(texts.select("digest").distinct(), "digests"), "digest", "left_semi")
    return lists.select(*[F.col(c).alias(f"list_{c}") for c in ("doc_id", "digest", "code", "place")])


def _meets(wanted: DataFrame, lists: DataFrame) -> Column:
    """Same document and term."""
    return (
        wanted["doc_id"].eqNullSafe(lists["list_doc_id"])
        & (wanted["digest"] == lists["list_digest"])
        & (wanted["code"] == lists["list_code"])
    )


def phrases(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, digest, id, start, length): where whole windows stand, in order and side by side."""
    term = lambda k: F.get("terms", F.lit(k))
    lead = terms.select("id", "length", term(0)["code"].alias("code"), term(0)["at"].alias("offset"), term(1)["code"].alias("next"), term(1)["at"].alias("next_at"))
    # A narrow table of its own: Spark judges by the bytes of its file whether to send it to the lists.
    lead = materialise(lead, "lead")
    key = ["doc_id", "digest", "id", "start"]
    first = postings.join(lead, "code").withColumn("start", F.col("place") - F.col("offset")).where(F.col("start") >= 0)
    first = materialise(first.select(*key, "length", F.col("next").alias("code"), "next_at").distinct(), "first-lists")
    # Repeated rows have equal postings; distinct keeps one of each meeting. What was found so far
    # grows with the documents, so it is merged with the lists at every size and never broadcast.
    wanted = first.where("length > 1").withColumn("place", F.col("start") + F.col("next_at"))
    lists = _lists(postings, lead.select(F.col("next").alias("code")).where("code is not null"))
    second = materialise(wanted.hint("merge").join(lists, _meets(wanted, lists) & (wanted["place"] == lists["list_place"])).select(*key, "length").distinct(), "second-lists")
    others = terms.where("length > 2").select("id", F.explode(F.slice("terms", 3, F.greatest(F.size("terms") - 2, F.lit(1)))).alias("term"))
    others = others.select("id", F.col("term.code").alias("code"), F.col("term.at").alias("at"))
    wanted = materialise(second.where("length > 2").join(others, "id").withColumn("place", F.col("start") + F.col("at")), "other-places")
    lists = _lists(postings, others, second)
    rest = wanted.hint("merge").join(lists, _meets(wanted, lists) & (wanted["place"] == lists["list_place"])).groupBy(*key, "length")
    rest = rest.agg(F.size(F.collect_set("at")).alias("met")).where(F.col("met") == F.col("length") - 2)
    columns = [*key, "length"]
    return first.where("length = 1").select(columns).unionByName(second.where("length = 2").select(columns)).unionByName(rest.select(columns))


def near(postings: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """(doc_id, digest, id, start, length): places of a window's rarest word with its other words in reach.

    All distinct words stand within the window's length and ``slop`` more words, around ``start``.
    Lists meet by stretches of that length, so a word that fills a text is compared in three of them only.
    """
    reach, key = F.col("length") + slop, ["doc_id", "digest", "id", "start", "length"]
    rarest = terms.select("id", "length", F.get("terms", F.lit(0))["code"].alias("code"))
    first = materialise(postings.join(rarest, "code").select("doc_id", "digest", "id", "length", F.col("place").alias("start"), "code").distinct(), "first-lists")
    codes = terms.select("id", F.explode(F.array_distinct(F.transform("terms", lambda t: t["code"]))).alias("code"))
    stretch = F.floor(F.col("start") / reach)
    wanted = first.drop("code").join(codes, "id").withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    wanted = materialise(wanted.withColumn("reach", reach), "near-places")
    widths = wanted.select("code", "reach").distinct()
    lists = postings.join(widths, "code").select(
        *[F.col(c).alias(f"list_{c}") for c in ("doc_id", "digest", "code", "place", "reach")], F.floor(F.col("place") / F.col("reach")).alias("list_stretch")
    )
    same = _meets(wanted, lists) & (wanted["reach"] == lists["list_reach"]) & (wanted["stretch"] == lists["list_stretch"])
    close = F.abs(F.col("list_place") - F.col("start")) < F.col("reach")
    met = wanted.hint("merge").join(lists, same & close).groupBy(*key, "reach").agg(F.collect_set(F.struct(F.col("list_place").alias("place"), "code")).alias("hits"))
    sizes = terms.select("id", F.size(F.array_distinct(F.transform("terms", lambda t: t["code"]))).alias("distinct"))

    def whole(begin: Column) -> Column:
        inside = F.filter("hits", lambda h: (h["place"] >= begin) & (h["place"] < begin + F.col("reach")))
        return F.size(F.array_distinct(F.transform(inside, lambda h: h["code"]))) == F.col("distinct")

    return met.join(sizes, "id").where(F.exists(F.sequence(F.col("start") - F.col("reach") + 1, F.col("start")), whole)).select(key)


def matches(docs: DataFrame, windows: DataFrame, slop: int | None = None) -> DataFrame:
    """Occurrences of windows in ``docs`` (doc_id, text): (doc_id, digest, n_words, window, start, length).

    Besides, there is one row without a window for every row of ``docs``; only these have
    ``n_words``. Without ``slop`` the words stand in order and side by side. With it a match
    is one of proximity (``near``), and ``start`` is the place of the rarest word.
    """
    numbered = materialise(windows.select("window").distinct().withColumn("id", F.monotonically_increasing_id()), "numbered")
    known = vocabulary(numbered)
    postings = store_postings(docs, known)
    terms = by_rarity(numbered, known, postings)
    found = phrases(postings, terms) if slop is None else near(postings, terms, slop)
    found = found.join(numbered, "id").select("doc_id", "digest", F.lit(None).cast("bigint").alias("n_words"), "window", "start", "length")
    every = postings.where(F.col("code") == MARK_CODE)
    none = {"window": "array<string>", "start": "int", "length": "int"}
    return found.unionByName(
        every.select("doc_id", "digest", F.col("place").cast("bigint").alias("n_words"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    )


def covered(spans: Column) -> Column:
    """Number of places in at least one of the (start, length) spans, given sorted."""
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))

    def step(acc, span):
        end = span["start"] + span["length"]
        return F.struct(
            F.greatest(acc["upto"], end).alias("upto"),
            (acc["n"] + F.greatest(end - F.greatest(acc["upto"], span["start"]), F.lit(0))).alias("n"),
        )

    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, n_items, items_sha256, contaminated, items), one row per row of ``docs``.

    Null and empty texts have no words and are clean. Repeated rows, and rows that agree
    in id and text, get the same result each. ``digest`` is a hash of the text that tells
    rows with one id (or none) apart. Other columns play no part, whatever their names.
    Without items nothing is contaminated.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    of_items = materialise(item_windows(items, item_id, item_text, width), "windows")
    every = materialise(matches(plain, of_items.select("window").distinct()), "matches")
    found = every.where(F.col("window").isNotNull())
    hits = found.groupBy("doc_id", "digest").agg(
        covered(F.sort_array(F.collect_set(F.struct("start", "length")))).cast("bigint").alias("n_hit")
    )
    named = (
        found.select("doc_id", "digest", "window").distinct().join(of_items, "window")
        .groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
    hits = hits.join(named, same(hits, named)).select(hits["doc_id"], hits["digest"], "n_hit", "items")
    rows = every.where(F.col("window").isNull()).select("doc_id", "digest", "n_words")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(hits, same(rows, hits), "left").select(
        rows["doc_id"],
        rows["digest"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        items_of.alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their columns."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    windows = materialise(item_windows(items, "item_id", "text", width), "windows")
    bad = materialise(
        matches(plain, windows.select("window").distinct())
        .where(F.col("window").isNotNull())
        .select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest"))
        .distinct(),
        "contaminated",
    )
    # The row travels as one value, so no column of it can clash with those made here.
    whole = docs.select(
        F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("digest")
    )
    same = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.col("digest") == F.col("bad_digest"))
    return whole.join(bad, same, "left_anti").select("row.*")
