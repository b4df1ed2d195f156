"""Near-duplicate groups from 64-bit fingerprints that differ in few bits.

Two halves of 32 bits: of fingerprints within three bits, one half differs in at most
one. Each half is indexed under its 32 variants with one bit deleted; equal variants
meet in an equality join and are verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import add_fields
from pairrank.session import cut_lineage, materialise

#: Shingles hashed at once: bounds the memory of a task whatever the text's length.
PIECE = 1 << 16


def fingerprint_of(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles as a signed 64-bit integer.

    Bytes: ``lower`` touches A-Z only and ``split`` the blanks 09-0D and 20, as wanted.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined = b" ".join(words)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(first[at : at + PIECE], last[at : at + PIECE])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str) -> DataFrame:
    """Add ``fingerprint``: a signed 64-bit integer; zero for null and blank texts."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t) for t in batch.to_pylist()], pa.int64())

    return add_fields(docs, F.struct(run(F.col(f"`{text}`")).alias("fingerprint")), ["fingerprint"])


def _variants(node: Column) -> Column:
    """The 64 deletion variants: half, deleted bit and what is left of the half, in one integer."""
    halves = (F.shiftrightunsigned(node, 32), node.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array(
        *[half.bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << bit)) + F.lit((32 * k + bit) << 32) for k, half in enumerate(halves) for bit in range(32)]
    )


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``fingerprint`` values that differ in at most ``distance`` bits.

    Each pair comes out once: at the first half with at most one differing bit, under the
    variant without that bit, or without bit 0 if the half is equal. A fingerprint has at
    most 43,744 others within three bits, so the links of a group of copies stay bounded
    however many copies there are.

    The variants are merged at every size: Spark judges a side by the bytes of ``nodes``,
    not by the 64 rows that each of them becomes, and would send it to all executors.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two halves with one deletion find distances up to 3")
    made = nodes.select(F.col("fingerprint").alias("node"), F.explode(_variants(F.col("fingerprint"))).alias("variant"))
    a, b = made.alias("a"), made.alias("b")
    x = F.col("a.node").bitwiseXOR(F.col("b.node"))
    high, low = F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF))
    place = F.shiftright(F.col("a.variant"), 32)
    at = place.bitwiseAND(F.lit(31))
    half = F.when(place < 32, high).otherwise(low)
    first = (half == 0) & (at == 0) | (half == F.pow(F.lit(2), at).cast("bigint"))
    return (
        a.join(
            b.hint("merge"),
            (F.col("a.variant") == F.col("b.variant"))
            & (F.col("a.node") < F.col("b.node"))
            & (F.bit_count(x) <= distance)
            & first
            & ((place < 32) | (F.bit_count(high) > 1)),
        )
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the ``edges`` (a, b); the root is the least node of its component.

    Alternating large and small stars. Every round is a checkpoint in the shared folder,
    so a lost executor costs one round at most. Minima merge map-side; the joins that bring
    them back are ordinary equality joins, which adaptive execution splits for hot nodes.
    """
    stars = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        stars = cut_lineage(small.where("a <> b").distinct())
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def groups(marked: DataFrame, doc_id: str, distance: int = 3) -> DataFrame:
    """(fingerprint, root, component_id) of every distinct fingerprint of ``marked``.

    ``component_id`` is the smallest id among all documents of the component, null if
    none has an id; ``root`` names the component then too.
    """
    nodes = materialise(
        marked.groupBy("fingerprint").agg(F.min(F.col(f"`{doc_id}`")).alias("least_id")), "fingerprints"
    )
    moved = components(links(nodes, distance))
    rooted = nodes.join(moved.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    whole = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rooted.join(whole, "root").select("fingerprint", "root", "component_id", "least_id")


def near_duplicates(docs: DataFrame, doc_id: str, text: str, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Null and blank texts have fingerprint zero and are linked like any other. Equal texts
    share a fingerprint and meet there, never in pairs. Repeated rows come out repeated;
    a null id is never a component's id unless the component has no other. Other columns
    of ``docs`` play no part, whatever their names.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = materialise(fingerprints(plain, "text").select("doc_id", "fingerprint"), "simhash")
    return marked.join(groups(marked, "doc_id", distance).select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str, text: str, distance: int = 3) -> DataFrame:
    """The columns of ``docs``, one row for each component: that with the smallest id.

    Rows that repeat the kept id and fingerprint count as one; which of them stays does not
    matter where they are equal.
    """
    # The row travels as one value, so no column of it can clash with those made here.
    whole = docs.select(
        F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    marked = materialise(fingerprints(whole, "text").drop("text"), "simhash-rows")
    thin = marked.select("doc_id", "fingerprint")
    kept = (
        groups(thin, "doc_id", distance)
        .groupBy("root")
        .agg(F.min(F.struct(F.col("least_id").isNull(), "least_id", "fingerprint")).alias("k"))
        .select(F.col("k.least_id").alias("kept_id"), F.col("k.fingerprint").alias("kept_mark"))
    )
    kept = materialise(kept, "kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("fingerprint") == F.col("kept_mark"))
    repeated = thin.groupBy("doc_id", "fingerprint").count().where("count > 1")
    out = marked.join(kept, same, "left_semi")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", "fingerprint"])
    return out.select("row.*")
