"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else.
FOLD = {code: code + 32 for code in range(65, 91)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII characters that no word holds.
OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
#: A run of ASCII digits, small ASCII letters and everything above ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster the package is shipped with ``--py-files`` or installed; the entry is harmless there.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def add_fields(df: DataFrame, struct: Column, fields: list[str]) -> DataFrame:
    """``df`` with the fields of ``struct`` as columns, after its own.

    A column of ``df`` that bears the name of a field (in any case) gives way to it.
    """
    made, taken = "__made", {f.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in taken]
    return df.withColumn(made, struct).select(
        *[F.col(f"`{c}`") for c in kept], *[F.col(f"{made}.{f}").alias(f) for f in fields]
    )


def words(text: Column) -> Column:
    """The words of a text (``WORD``) after A-Z are lower-cased; null has none.

    One ``translate`` folds the letters and blanks out the other ASCII characters; cutting
    at single blanks is several times faster than a regular expression.
    """
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + OTHER, LOWER + " " * len(OTHER)), " ")
    return F.array_remove(parts, "")


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the id as text, divisible by 5. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
