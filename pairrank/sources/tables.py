"""Declared schemas, readers and writers of the entity tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANDIDATE = "candidate_id STRING, cv_text STRING"
POSTING = (
    "job_id STRING, required_certifications ARRAY<STRING>, min_years_experience DOUBLE, shift_pattern STRING, "
    "site_type STRING, driving_required BOOLEAN, description STRING"
)
PAIR = "job_id STRING, candidate_id STRING, grade INT"
PROTECTED = "candidate_id STRING, gender STRING, age_band STRING, nationality STRING"

SCHEMAS = {"candidates": CANDIDATE, "jobs": POSTING, "labels": PAIR}


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet") -> DataFrame:
    """Read with a declared schema; nothing is inferred, so no extra pass over the files."""
    return spark.read.schema(schema).format(fmt).load(path)


def load_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Candidates, postings and pairs. Protected data is never among them."""
    return {name: read_table(spark, f"{root}/{name}", schema, fmt) for name, schema in SCHEMAS.items()}


def load_protected(spark: SparkSession, root: str, fmt: str = "parquet") -> DataFrame:
    """Demographics, only for a caller that asks for them by name."""
    return read_table(spark, f"{root}/protected", PROTECTED, fmt)


def write_dataset(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Each table in its own folder; an existing folder is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").format(fmt).save(f"{root}/{name}")


def canonical_set(column: Column) -> Column:
    """Sorted and distinct, so that what is written or hashed is stable."""
    return F.array_sort(F.array_distinct(column))


def grade_distribution(pairs: DataFrame, grade: str = "grade", top: int = 3) -> DataFrame:
    """Count and share of every grade of the closed domain, zero-filled.

    Conditional counts in one aggregation, then one row per grade.
    """
    totals = pairs.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(grade) == g).alias(f"n_{g}") for g in range(top + 1)]
    )
    rows = [F.struct(F.lit(g).alias("grade"), F.col(f"n_{g}").alias("n")) for g in range(top + 1)]
    return totals.select(F.inline(F.transform(F.array(*rows), lambda r: F.struct(
        r["grade"].alias("grade"), r["n"].alias("n"), (r["n"] / F.greatest(F.col("total"), F.lit(1))).alias("share")
    ))))


def dataset_manifest(tables: Mapping[str, DataFrame], grades: DataFrame, version: str, seed: int) -> DataFrame:
    """One row: rows per table, grade counts, version and seed."""
    counted = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"))
        counted = one if counted is None else counted.unionByName(one)
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "n"))))
    by_grade = grades.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("grade").cast("string").alias("g"), "n")))).alias("m")
    )
    return counted.agg(counts.alias("table_counts")).select(
        F.lit(version).alias("generator_version"),
        F.lit(seed).alias("seed"),
        "table_counts",
        by_grade.scalar().alias("grade_counts"),
    )


def list_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("version").distinct().orderBy("version")


def append_version(run: DataFrame, path: str, version: str) -> None:
    """Write a new version; writing one that exists is refused."""
    run.drop("version").write.mode("errorifexists").parquet(f"{path}/version={version}")


def refuse_existing(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``new`` whose version is not recorded yet."""
    return new.join(existing.select("version").distinct(), "version", "left_anti")


def rewrite_audit(audit: DataFrame, path: str, version: str) -> None:
    """The one permitted change to a written version: its audit folder."""
    audit.write.mode("overwrite").parquet(f"{path}/audit/version={version}")


def run_log(spark: SparkSession, entry: Mapping[str, object]) -> DataFrame:
    """One provenance row; ``metrics`` keeps only numeric, non-boolean entries."""
    metrics = {
        k: float(v) for k, v in dict(entry.get("metrics", {})).items() if isinstance(v, int | float) and not isinstance(v, bool)
    }
    row = {k: v for k, v in entry.items() if k != "metrics"}
    literals = [F.lit(str(v) if isinstance(v, (list, tuple, dict)) else v).alias(k) for k, v in row.items()]
    pairs = [c for k, v in metrics.items() for c in (F.lit(k), F.lit(v))]
    return spark.range(1).select(*literals, F.create_map(*pairs).cast("map<string,double>").alias("metrics"))
