"""Labelled rows for a fit: a bounded, repeatable sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most ``per_class`` ids of either class, and the class sizes.

    Held-out ids and ids without a document or a label take no part. The ids with the
    smallest hashes are taken, so the sample is the same on any partitioning. An id
    that comes with several texts or labels counts once, with the largest of each.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi")
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"))
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # Twice per_class rows of twelve bytes at most: the bound that allows the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text")), sizes
