"""Exact top-k inner products, a term at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores held at once by a task: bounds its memory whatever the blocks' sizes.
TILE = 1 << 20


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; one beyond 64 bits is an error, for a cast would make it another number."""
    limit = F.lit(2.0**63)
    large = F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("bigint")

    def floored(x: Column) -> Column:
        scaled = F.lit(scale) * x.cast("double")
        return F.when((scaled >= -limit) & (scaled < limit), F.floor(scaled).cast("bigint")).otherwise(large)

    return F.transform(vector, floored)


def _largest(values: np.ndarray) -> int:
    """The largest absolute value, as a Python integer: that of the lowest 64-bit integer fits no other."""
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def _matrix(values: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width; a shorter vector ends in zeros, which add nothing."""
    lists = values.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def best_of_block(candidates: pa.Table, queries: pa.Table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best candidates of each query, ties to the smaller id.

    Every component is a term: its postings are the candidates with a weight other than
    zero. The query rows scatter weighted postings into dense arrays of scores.
    """
    ids = candidates["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, weights = ids[order], _matrix(candidates["v"])[order]
    asked, rows = queries["id"].to_numpy(), _matrix(queries["v"])
    terms = min(weights.shape[1], rows.shape[1])
    postings = [(np.flatnonzero(weights[:, t]), weights[:, t]) for t in range(terms)]
    # Where a sum might pass 64 bits, Python's integers are added instead.
    wide = _largest(weights) * _largest(rows) * terms >= 1 << 63
    if wide:
        rows, postings = rows.astype(object), [(places, column.astype(object)) for places, column in postings]
    step = max(1, TILE // max(1, len(ids)))
    for at in range(0, len(asked), step):
        tile = rows[at : at + step]
        scores = np.zeros((len(tile), len(ids)), object if wide else np.int64)
        for t, (places, column) in enumerate(postings):
            active = np.flatnonzero(tile[:, t])
            if not len(active) or not len(places):
                continue
            if len(places) == len(ids):
                scores[active] += tile[active, t, None] * column
            else:
                scores[active[:, None], places] += tile[active, t, None] * column[places]
        for query, found in zip(asked[at : at + step].tolist(), scores):
            others = ids != query
            own, mine = (ids, found) if others.all() else (ids[others], found[others])
            if wide:
                if not np.all((mine >= -(1 << 63)) & (mine < 1 << 63)):
                    raise OverflowError("a score does not fit 64 bits")
                mine = mine.astype(np.int64)
            if len(mine) > k:
                least = np.partition(mine, len(mine) - k)[len(mine) - k]
                some = np.flatnonzero(mine >= least)
                own, mine = own[some], mine[some]
            top = np.argsort(~mine, kind="stable")[:k]
            yield query, own[top], mine[top]


def top_k(vectors: DataFrame, vec_id: str, embedding: str, is_query: Column, k: int = 5, block_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of every query with all other rows.

    Candidates and queries are dealt into blocks of bounded size; each block of candidates
    meets each block of queries, and at most k rows per query leave a pair of blocks. Ties
    go to the smaller id. Rows that share the query's id are not its candidates; other
    repeated rows count each. Equal query rows ask once; query rows of one id with different
    vectors are ranked each for itself under that id. Rows without id, and vectors that are not ``usable``, take no
    part. Scores are exact; one that does not fit 64 bits, or such a component, is an error. No queries, or no candidates: no rows.
    """
    whole = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("e"), is_query.alias("asks"))
    rows = whole.where(F.col("id").isNotNull() & usable(F.col("e"))).select("id", "asks", quantised(F.col("e")).alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, asks = max(1, math.ceil(size["n"] / block_rows)), max(1, math.ceil(size["q"] / query_rows))
    spot = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "v", spot(1, blocks).alias("block")).select("id", "v", "block", every(asks).alias("part"))
    asking = rows.where("asks").select("id", "v").distinct()
    queries = asking.select("id", "v", F.xxhash64("id", "v").alias("query"), spot(2, asks).alias("part")).select("id", "v", "query", "part", every(blocks).alias("block"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(best_of_block(left, right, k)) if left.num_rows and right.num_rows else []
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pa.table({
            "query": pa.array(np.repeat(right["query"].to_numpy()[: len(out)], [len(i) for _, i, _ in out]), pa.int64()),
            "query_id": pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64), pa.int64()),
            "vec_id": pa.array(cat([i for _, i, _ in out]), pa.int64()),
            "score": pa.array(cat([s for _, _, s in out]), pa.int64()),
        })

    found = (
        candidates.groupBy("block", "part")
        .cogroup(queries.groupBy("block", "part"))
        .applyInArrow(meet, "query bigint, query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
