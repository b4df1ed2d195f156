"""Structured profiles from a corpus of section-structured documents.

Everything is a column expression over the row's own text: one scan, no shuffle,
no Python. Each stage is its own projection so that a derived column (body, work,
spans) is computed once and read many times. Lines stay in one string, where compiled
patterns find them; arrays of lines would be walked by interpreted functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.functions import text as tx
from pairrank.functions import vocab as V


@dataclass(frozen=True)
class Vocabulary:
    """What the extractor can recognise; the defaults are the stock lists."""

    certifications: Mapping[str, Sequence[str]] = field(default_factory=lambda: V.CERTIFICATIONS)
    shifts: Mapping[str, Sequence[str]] = field(default_factory=lambda: V.SHIFTS)
    sites: Mapping[str, Sequence[str]] = field(default_factory=lambda: V.SITES)
    experience_sections: Sequence[str] = V.EXPERIENCE_SECTIONS
    reference_year: int = V.REFERENCE_YEAR


def text_quarantine(docs: DataFrame, text: str = "text", limit: int = V.MAX_TEXT_LENGTH) -> DataFrame:
    """Add ``reason``: empty (a null text too), too_long, or null for documents that pass."""
    stripped = tx.strip(F.coalesce(F.col(text), F.lit("")))
    return docs.withColumn(
        "reason", F.when(F.length(stripped) == 0, "empty").when(F.length(stripped) > limit, "too_long")
    )


def stated_years(text: Column) -> Column:
    """Largest quantity stated in digits or words; null when none is."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(V.YEARS_DIGITS), F.lit(1)), lambda n: n.try_cast("double"))
    numbers = tx._literal_map({word: float(n) for word, n in V.NUMBER_WORDS.items()})
    words = F.transform(
        F.regexp_extract_all(text, F.lit(V.YEARS_WORDS), F.lit(1)), lambda w: F.try_element_at(numbers, F.lower(w))
    )
    return F.array_max(F.concat(digits, words))


def driving_flag(text: Column) -> Column:
    """Negative statements first: they contain the positive ones."""
    return F.when(text.rlike(V.NO_DRIVING), False).when(text.rlike(V.HAS_DRIVING), True)


def experience_lines(sections: Column, headings: Sequence[str]) -> Column:
    return F.flatten(
        F.transform(F.filter(sections, lambda s: s["heading"].isin(*headings)), lambda s: s["lines"])
    )


def experience_text(text: Column, blocks: Column, headings: Sequence[str]) -> Column:
    """``experience_lines`` as a body (see ``text.body_of``).

    Up to two blocks stand in the order of the text, whatever their headings. Of more, one may go on with
    a section that began earlier, so they are put together by section.
    """
    merged = experience_lines(tx.sections_of(tx.lines_of(text)), headings)
    return F.when(F.size(blocks) <= 2, F.array_join(blocks, "")).otherwise(
        F.array_join(F.transform(merged, lambda line: F.concat(F.lit("\n"), line)), "")
    )


def periods_of(work: Column) -> Column:
    """End of every dated role: a year as text, or ``present``."""
    return F.regexp_extract_all(F.lower(work), F.lit(V.PERIOD), F.lit(2))


def site_fragments(work: Column) -> Column:
    return F.array_join(F.regexp_extract_all(work, F.lit(tx.by_line(V.SITE_TAIL)), F.lit(1)), "\n")


def parse_profiles(docs: DataFrame, item: str, text: str = "text", vocabulary: Vocabulary | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Profile of each document. Persist or write the result: pairs reuse it.

    A null text is an empty one: nothing stated, empty arrays and the warnings that say so.
    """
    v = vocabulary or Vocabulary()
    staged = (
        docs.select(item, *keep, tx.strip(F.coalesce(F.col(text), F.lit(""))).alias("text"))
        .withColumn("body", tx.body_of(F.col("text")))
        .withColumn("blocks", tx.section_blocks(F.col("body"), v.experience_sections))
        .withColumn("spans", tx.entity_spans(F.col("text"), v.certifications))
        .withColumn("canonical", tx.canonical_text(F.col("text")))
        .withColumn("work", experience_text(F.col("text"), F.col("blocks"), v.experience_sections))
        .withColumn("ends", periods_of(F.col("work")))
        .withColumn("site_text", tx.canonical_text(site_fragments(F.col("work"))))
    )
    # Bullets that hold no dictionary match go through the cascade; the lookup is
    # skipped altogether for documents that have none.
    loose = F.filter(
        tx.bullets_in(F.col("body")),
        lambda b: ~tx._let(F.lower(b), lambda low: F.exists(F.col("spans"), lambda s: F.contains(low, s))),
    )
    staged = staged.withColumn("loose", loose).withColumn(
        "matched",
        F.when(
            F.size("loose") > 0,
            F.transform(
                F.transform("loose", lambda b: F.struct(b.alias("entry"), tx.canonical_text(b).alias("canonical"))),
                lambda e: F.struct(
                    e["entry"].alias("entry"), tx.match_cascade(e["canonical"], v.certifications).alias("code")
                ),
            ),
        ),
    )
    no_roles = F.col("work").rlike(tx.by_line(V.NO_ROLES))
    has_work, has_ends = F.col("work") != "", F.size("ends") > 0
    latest = F.array_max(F.transform("ends", lambda e: e.try_cast("int")))
    profile = staged.select(
        item,
        *keep,
        stated_years(F.col("text")).alias("years_experience"),
        F.array_sort(
            F.array_distinct(
                F.array_compact(
                    F.concat(
                        tx.codes_of_spans(F.col("spans"), v.certifications),
                        F.coalesce(F.transform("matched", lambda m: m["code"]), F.array().cast("array<string>")),
                    )
                )
            )
        ).alias("certifications"),
        driving_flag(F.col("text")).alias("driving_licence"),
        tx.tag_phrases(F.col("canonical"), v.shifts).alias("shift_availability"),
        tx.tag_phrases(F.col("site_text"), v.sites).alias("site_experience"),
        F.when(no_roles, 0).when(has_ends, F.size("ends")).alias("previous_role_count"),
        F.when(no_roles, F.lit(None))
        .when(F.array_contains("ends", "present"), 0)
        .when(has_ends, F.greatest(F.lit(0), (F.lit(v.reference_year) - latest) * 12))
        .cast("int")
        .alias("months_since_last_role"),
        F.transform(
            F.filter(F.coalesce("matched", F.array().cast("array<struct<entry:string,code:string>>")), lambda m: m["code"].isNull()),
            lambda m: F.concat(F.lit("certification: unrecognised entry "), tx.repr_quoted(m["entry"])),
        ).alias("certification_warnings"),
        F.when(no_roles, None)
        .when(~has_work, "employment: no employment section found")
        .when(~has_ends, "employment: section present but no dated roles found")
        .alias("employment_warning"),
    )
    warnings = F.concat(
        F.array_compact(F.array(F.when(F.col("years_experience").isNull(), "years_experience: not stated"))),
        F.col("certification_warnings"),
        F.array_compact(
            F.array(
                F.col("employment_warning"),
                F.when(F.size("shift_availability") == 0, "shift_availability: not stated"),
                F.when(F.col("driving_licence").isNull(), "driving_licence: not stated"),
            )
        ),
    )
    return profile.withColumn("parse_warnings", warnings).drop("certification_warnings", "employment_warning")


def warnings_of(profiles: DataFrame, column: str = "parse_warnings") -> DataFrame:
    """(warning): one row for each.

    A plain ``explode`` brings a filter on the array with it, which the optimiser pushes to the
    documents: every stage of the parser would be written out, again and again, inside that filter.
    The outer form brings none; the row it makes of an empty array is dropped behind it.
    """
    return profiles.select(F.explode_outer(column).alias("warning")).where(F.col("warning").isNotNull())


def warning_counts(profiles: DataFrame, column: str = "parse_warnings") -> DataFrame:
    field_name = F.substring_index(F.col("warning"), ":", 1)
    return (
        warnings_of(profiles, column)
        .groupBy(field_name.alias("field"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def failure_counts(quarantined: DataFrame) -> DataFrame:
    return quarantined.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# Reviewer wording of the warnings, tested in this order.
FRIENDLY = (
    ("years_experience: not stated", "Did not state years of experience"),
    ("employment: no employment section found", "No employment history section"),
    ("employment: section present but no dated roles found", "Employment section present, but no dated roles in it"),
    ("driving_licence: not stated", "Did not say whether a driving licence is held"),
    ("shift_availability: not stated", "Did not state shift availability"),
    ("certification:", "An entry in the certifications list was not recognised"),
)


def friendly_warning(warning: Column) -> Column:
    phrased = F.lit(None).cast("string")
    for prefix, label in reversed(FRIENDLY):
        phrased = F.when(warning.startswith(prefix), label).otherwise(phrased)
    return F.coalesce(phrased, warning)


def recovery_audit(profiles: DataFrame, truth: DataFrame, item: str, tolerance: float = 0.55) -> DataFrame:
    """Mismatches per field against ground truth, and codes that nobody wrote.

    Facts the document left unstated are excluded. One join by id, one partial
    aggregation, then rows per field.
    """
    joined = profiles.join(truth, item)
    stated = lambda c: F.col(c).isNotNull()
    differ = {
        "years_experience": stated("years_experience") & (F.abs(F.col("years_experience") - F.col("true_years")) >= tolerance),
        "certifications": F.col("certifications") != F.col("true_certifications"),
        "driving_licence": stated("driving_licence") & (F.col("driving_licence") != F.col("true_driving")),
        "shift_availability": (F.size("shift_availability") > 0) & (F.col("shift_availability") != F.col("true_shifts")),
        "site_experience": (F.size("site_experience") > 0) & (F.col("site_experience") != F.col("true_sites")),
        "previous_role_count": stated("previous_role_count") & (F.col("previous_role_count") != F.col("true_roles")),
        "months_since_last_role": stated("months_since_last_role")
        & (F.col("months_since_last_role") != F.col("true_months")),
    }
    sums = joined.agg(
        F.count(F.lit(1)).alias("n_documents"),
        *[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in differ.items()],
        F.coalesce(F.sum(F.size(F.array_except("certifications", "true_certifications"))), F.lit(0)).alias("invented_codes"),
    )
    fields = [*differ, "invented_codes"]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_mismatches")) for f in fields])
    return sums.select("n_documents", F.inline(rows))


def text_preview(text: Column, width: int = 64) -> Column:
    """First non-blank line that is not a heading, cut with an ellipsis."""
    lines = F.filter(F.transform(F.split(text, "\n"), tx.strip), lambda line: (line != "") & ~tx.is_heading(line))
    first = F.get(lines, F.lit(0))
    cut = F.when(F.length(first) > width, F.concat(F.substring(first, 1, width), F.lit("…"))).otherwise(first)
    return F.coalesce(cut, F.lit("Empty"))


def phrase_coverage(docs: DataFrame, text: str, phrases: Sequence[str]) -> DataFrame:
    """Documents containing each phrase (canonical, word-bounded), zero included.

    One scan and one partial aggregation whatever the number of phrases.
    """
    if len(phrases) > tx.MAX_LITERAL_PHRASES:
        raise ValueError("too many phrases for one pass")
    canon = docs.select(F.concat(F.lit(" "), tx.canonical_text(F.col(text)), F.lit(" ")).alias("padded"))
    keys = list(dict.fromkeys(phrases))
    counts = canon.agg(
        F.array(*[F.count_if(F.contains("padded", F.lit(f" {key} "))) for key in keys]).alias("counts")
    )
    rows = F.arrays_zip(F.array(*[F.lit(k) for k in keys]).alias("phrase"), F.col("counts").alias("n_documents"))
    return counts.select(F.inline(rows)).toDF("phrase", "n_documents")
