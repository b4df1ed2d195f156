"""Checks and identifiers for a batch of drafts before they are ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.functions.text import strip
from pairrank.operators.ranking import rank_within

MAX_TEXT_LENGTH = 20_000
SLUG_LENGTH = 40


def draft_issues(drafts: DataFrame, index: str, item: str, text: str, limit: int = MAX_TEXT_LENGTH) -> DataFrame:
    """(index, issue_no, message), in the order a reviewer sees them.

    The first use of an id is found with a min per id (merged map-side) joined
    back, instead of a window that would put one crowded id into one task. Blank
    ids are outside that comparison.
    """
    trimmed = drafts.withColumn("ref", strip(F.coalesce(F.col(item).cast("string"), F.lit(""))))
    first = (
        trimmed.where(F.col("ref") != "").groupBy("ref").agg(F.min(index).alias("first_index"), F.count(F.lit(1)).alias("uses"))
    )
    repeated = first.where(F.col("uses") > 1).select("ref", "first_index")
    checked = trimmed.join(repeated, "ref", "left")
    length = F.length(F.col(text))
    id_issue = F.when(F.col("ref") == "", "Needs a reference.").when(
        F.col(index) > F.col("first_index"),
        F.concat(F.lit('Reference "'), "ref", F.lit('" is already used above.')),
    )
    text_issue = F.when(
        strip(F.coalesce(F.col(text), F.lit(""))) == "", "Paste the application text, or drop a file."
    ).when(
        length > limit,
        F.concat(F.format_number(length - limit, 0), F.lit(f" characters over the {limit:,} limit.")),
    )
    issues = F.array_compact(F.array(id_issue, text_issue))
    return checked.select(index, F.posexplode(issues).alias("issue_no", "message"))


def base_slug(filename: Column) -> Column:
    stem = F.coalesce(F.nullif(F.regexp_extract(filename, r"^(.+)\.[^.]*$", 1), F.lit("")), filename)
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    cut = F.substring(slug, 1, SLUG_LENGTH)
    return F.when(cut == "", "cv").otherwise(cut)


def reference_slug(files: DataFrame, index: str, filename: str, **rank_options) -> DataFrame:
    """A unique reference per file: base, base_2, base_3 … by input index.

    Numbers within a base come from the split-safe rank. A suffixed name that
    another file already owns as its base (``base_2.txt`` beside two ``base.txt``)
    is moved past every number in use for that base.
    """
    named = files.withColumn("base", base_slug(F.col(filename))).withColumn("order_key", -F.col(index))
    numbered = rank_within(named, ["base"], "order_key", [index], **rank_options).drop("order_key")
    plain = numbered.withColumn(
        "wanted", F.when(F.col("rank") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("rank").cast("string")))
    )
    owned = named.select(F.col("base").alias("wanted")).distinct().withColumn("owned", F.lit(True))
    checked = plain.join(owned, "wanted", "left").withColumn("clash", F.col("owned").isNotNull() & (F.col("rank") > 1))
    # Highest number already meaningful for a base: its own uses and the numbers
    # that other files own as "<base>_<n>".
    uses = named.groupBy("base").agg(F.count(F.lit(1)).alias("top"))
    suffixed = named.select(
        F.regexp_extract("base", r"^(.+)_([0-9]{1,18})$", 1).alias("stem"),
        F.regexp_extract("base", r"^(.+)_([0-9]{1,18})$", 2).try_cast("bigint").alias("top"),
    ).where(F.col("top").isNotNull())
    tops = uses.unionByName(suffixed.withColumnRenamed("stem", "base")).groupBy("base").agg(F.max("top").alias("top"))
    moved = rank_within(
        checked.where("clash").select(index, "base", (-F.col("rank")).alias("order_key")),
        ["base"], "order_key", [index], **rank_options,
    ).join(tops, "base").select(index, (F.col("top") + F.col("rank")).alias("moved_to"))
    return (
        checked.join(moved, index, "left")
        .withColumn(
            "reference",
            F.when(F.col("clash"), F.concat_ws("_", "base", F.col("moved_to").cast("string"))).otherwise(F.col("wanted")),
        )
        .select(*files.columns, "reference")
    )


def merge_results(*readers: DataFrame) -> DataFrame:
    """One list from several readers, columns matched by name."""
    merged = readers[0]
    for reader in readers[1:]:
        merged = merged.unionByName(reader, allowMissingColumns=True)
    return merged


def remaining_capacity(n: Column, limit: int = 500) -> Column:
    return F.greatest(F.lit(0), F.lit(limit) - n)
