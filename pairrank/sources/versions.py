"""Versions of a run: written apart, published in one exclusive step, never changed.

A run's rows go to a folder of their own that nobody reads yet. Its entry in the run
table, one JSON file per version, is then put in place by a step that fails when the
name is taken: a hard link on a local disk, a rename elsewhere (atomic on HDFS; an object
store needs a committer that renames atomically). Of two writers one wins, the
other removes what it wrote and is told who won. Readers see whole entries or none.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = (
    "version STRING, seed BIGINT, params MAP<STRING, STRING>, n_rows BIGINT, metrics MAP<STRING, DOUBLE>, folder STRING"
)
VERSION_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class Commit(NamedTuple):
    """``folder`` is the one that readers of ``version`` get, whoever wrote it."""

    version: str
    published: bool
    folder: str


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write ``text`` as ``path`` unless it is there already; whether this call wrote it."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"  # Spark's readers pass over a leading dot
    fs, place = _filesystem(spark, path)
    _, drafted = _filesystem(spark, draft)
    fs.mkdirs(place.getParent())
    if fs.getUri().getScheme() == "file":
        local, target = drafted.toUri().getPath(), place.toUri().getPath()
        with open(local, "x", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(local, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(local)
        return True
    out = fs.create(drafted, False)
    out.write(bytearray(text, "utf-8"))
    out.close()
    # Looked at first, because some file systems rename onto a file that exists.
    if not fs.exists(place) and fs.rename(drafted, place):
        return True
    fs.delete(drafted, False)
    return False


def commit_version(
    rows: DataFrame,
    root: str,
    version: str,
    seed: int = 0,
    params: Mapping[str, object] | None = None,
    metrics: Mapping[str, Column] | None = None,
) -> Commit:
    """Write ``rows`` as ``version`` and append its entry to the run table, or be refused.

    ``metrics`` are aggregates over the rows as written; a null one is left out. A version
    that is recorded already is refused before anything is written, and one that another
    writer records meanwhile is refused after; what this call wrote is then removed.
    """
    if not VERSION_NAME.fullmatch(version):
        raise ValueError(f"not a version name: {version!r}")
    spark = rows.sparkSession
    taken = run_folder(spark, root, version)
    if taken is not None:
        return Commit(version, False, taken)
    folder = f"{root}/data/{version}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    wanted = {name: value.cast("double") for name, value in dict(metrics or {}).items()}
    written = spark.read.schema(rows.schema).parquet(folder)
    found = written.agg(F.count(F.lit(1)), *wanted.values()).first()
    entry = {
        "version": version,
        "seed": seed,
        "params": {k: str(v) for k, v in dict(params or {}).items()},
        "n_rows": found[0],
        "metrics": {name: value for name, value in zip(wanted, found[1:]) if value is not None},
        "folder": folder,
    }
    if _put_once(spark, f"{root}/runs/{version}.json", json.dumps(entry, ensure_ascii=False)):
        return Commit(version, True, folder)
    fs, place = _filesystem(spark, folder)
    fs.delete(place, True)
    return Commit(version, False, run_folder(spark, root, version))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run table: one row per published version; none yet is an empty table."""
    fs, place = _filesystem(spark, f"{root}/runs")
    if not fs.exists(place):
        return spark.createDataFrame([], RUN)
    return spark.read.schema(RUN).json(f"{root}/runs")


def run_folder(spark: SparkSession, root: str, version: str) -> str | None:
    """Where the rows of a published version lie; null for one that is not published."""
    fs, place = _filesystem(spark, f"{root}/runs/{version}.json")
    return spark.read.schema(RUN).json(f"{root}/runs/{version}.json").first()["folder"] if fs.exists(place) else None


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    folder = run_folder(spark, root, version)
    if folder is None:
        raise ValueError(f"version {version!r} is not published under {root}")
    return spark.read.parquet(folder)
