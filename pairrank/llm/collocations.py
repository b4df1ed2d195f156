"""Phrases whose words keep company, counted on a prefix-free parse of the corpus.

**Parse.** A piece of text (words between punctuation) is cut where its content says so: at every
place where the hash of the next ``max_words - 1`` words is divisible by ``PERIOD``. Neighbouring
chunks overlap by exactly those words, so every phrase of up to ``max_words`` words that starts before
the overlap lies whole in its chunk, and one that starts in the overlap belongs to the next. Equal
passages are cut alike wherever they stand. The *dictionary* holds each distinct chunk of a language
once, with the number of times it occurs in the parse (Boucher et al., prefix-free parsing).

**Counts.** All counting is done inside the distinct chunks, weighted by their frequency. A chunk counts
the phrases that start in its own ``core`` words, so what lies in an overlap is counted once.
Phrases grow as in frequent item sets: one can be frequent only if its parts are. Words are counted by their
text, longer phrases first by 64-bit hash; the hashes with enough occurrences set bits of a bitmap of fixed size
(``BITS``), which is broadcast to the next level. Hash counts and bits can only be too large, so no phrase is
lost; at the end the phrases that are left are counted by their text, exactly.

Rows repeat freely, null and empty texts have no words, a null language is ``und``. Only the two named
columns are read, so names of others can't clash. An empty table has no phrase.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.session import materialise

#: A chunk of running text has some so many words.
PERIOD = 16
#: Bits of the bitmap of frequent hashes: 8 MB, whatever the input.
BITS = 26
#: Distinct chunks a task holds before it sends them on, and bytes of chunks counted at once.
HELD, COUNTED = 200_000, 8_000_000
#: Lower case, punctuation to line feeds, tabs to spaces: byte for byte, which leaves other UTF-8 alone.
FOLD = bytes(
    10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece that has any."""
    for piece in text.translate(FOLD).split(b"\n"):
        words = [w for w in piece.split(b" ") if w]
        if words:
            yield words


def chunks(words: list[bytes], overlap: int, period: int = PERIOD) -> Iterator[tuple[bytes, int]]:
    """(words of the chunk, how many of them count) from front to back."""
    start = 0
    for at in range(1, len(words) - overlap + 1):
        if crc32(b" ".join(words[at : at + overlap])) % period == 0:
            yield b" ".join(words[start : at + overlap]), at - start
            start = at
    yield b" ".join(words[start:]), len(words) - start


def parse(docs: DataFrame, text: str, lang: str, max_words: int) -> DataFrame:
    """The dictionary: ``lang``, ``chunk``, ``core`` (words that count) and ``n`` (occurrences)."""
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text")
    ).where(F.col("text").isNotNull())

    def batch_of(held: dict[tuple[str, bytes, int], int]) -> pa.RecordBatch:
        columns = [
            pa.array([k[0] for k in held], pa.string()),
            pa.array([k[1] for k in held], pa.binary()).cast(pa.string()),
            pa.array([k[2] for k in held], pa.int32()),
            pa.array(held.values(), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "core", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes, int], int] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            for name, body in zip(names, batch.column("text")):
                for words in pieces(body.as_py()):
                    for chunk, core in chunks(words, max_words - 1):
                        key = (name, chunk, core)
                        held[key] = held.get(key, 0) + 1
                if len(held) > HELD:
                    yield batch_of(held)
                    held = {}
        if held:
            yield batch_of(held)

    found = rows.mapInArrow(cut, "lang string, chunk string, core int, n long")
    return found.groupBy("lang", "chunk", "core").agg(F.sum("n").alias("n"))


class Block:
    """Chunks with their words as numbers: what one counting step works on."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        split = pc.split_pattern(table.column("chunk"), " ").combine_chunks()
        sizes = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs, chunk_lang = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        self.lang = np.repeat(chunk_lang, sizes)
        self.n = np.repeat(table.column("n").to_numpy(), sizes)
        self.end = np.repeat(ends, sizes)
        self.core = np.repeat(ends - sizes + table.column("core").to_numpy(), sizes)
        seed = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs.to_pylist()], np.uint64)
        single = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.words.to_pylist()], np.uint64)
        self.seed, self.single = seed[self.lang], single[self.code]

    def hashes(self, k: int) -> np.ndarray:
        """A hash of (language, k words) for every place with k words in its chunk, in order of place."""
        n = len(self.code) - k + 1
        key = self.seed[:n].copy()
        for j in range(k):
            key = (key ^ self.single[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)

    def places(self, k: int) -> np.ndarray:
        """The starts of phrases of k words that this chunk counts."""
        at = np.arange(max(0, len(self.code) - k + 1))
        return at[(at < self.core[: len(at)]) & (at + k <= self.end[: len(at)])]


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & ((1 << BITS) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _narrowed(block: Block, k: int, below: int, bits: np.ndarray) -> np.ndarray:
    """Places of phrases of k words all of whose parts of ``below`` words are marked."""
    at = block.places(k)
    if len(at):
        marked = _marked(bits, block.hashes(below))
        for j in range(k - below + 1):
            at = at[marked[at + j]]
    return at


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their weights, and where each key stands first."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.add.reduceat(weights[order], starts), order[starts]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= COUNTED:
            yield Block(held)
            held = []
    if held:
        yield Block(held)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """One bit for each hash ``h``, 2^BITS in all, however many rows were counted."""
    slot = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        at = (row["bucket"] - 1) * 4096
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def _counted(dictionary: DataFrame, sizes: list[int], below: int, bits, least: int) -> DataFrame:
    """The hashes of phrases of ``sizes`` words with ``least`` occurrences or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for k in sizes:
                at = _narrowed(block, k, below, bits.value)
                if len(at):
                    keys, sums, _ = _summed(block.hashes(k)[at], block.n[at])
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["h", "n"])

    return dictionary.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _spelled(block: Block, k: int, at: np.ndarray) -> pa.RecordBatch:
    """The distinct phrases of k words at these places: language, text, hash and occurrences."""
    # Numbers of the phrases within this block, a word at a time: exact, and never above 2^63.
    number = block.lang[at]
    for j in range(k):
        number = number * len(block.words) + block.code[at + j]
        if j < k - 1:
            number = np.unique(number, return_inverse=True)[1]
    _, sums, first = _summed(number, block.n[at])
    first = at[first]
    words = [block.words.take(pa.array(block.code[first + j])) for j in range(k)]
    columns = [
        block.langs.take(pa.array(block.lang[first])),
        pa.array(np.full(len(first), k, np.int32)),
        pc.binary_join_element_wise(*words, " ") if k > 1 else words[0],
        pa.array(block.hashes(k)[first]),
        pa.array(sums),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "words", "phrase", "h", "f"])


def _exact(dictionary: DataFrame, sizes: list[int], keep: Callable[[Block, int], np.ndarray], least: int) -> DataFrame:
    """Phrases of ``sizes`` words at the places that ``keep`` names, with ``least`` occurrences or more, by their text."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for k in sizes:
                at = keep(block, k)
                if len(at):
                    yield _spelled(block, k, at)

    found = dictionary.mapInArrow(spell, "lang string, words int, phrase string, h long, f long")
    return found.groupBy("lang", "words", "phrase", "h").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def frequent_phrases(dictionary: DataFrame, max_words: int, least: int) -> DataFrame:
    """``lang``, ``words``, ``phrase``, ``h`` and ``f`` of every phrase of 1 to ``max_words`` words that occurs ``least`` times."""
    context = dictionary.sparkSession.sparkContext
    single = materialise(_exact(dictionary, [1], Block.places, least), "frequent-words")
    marks = {1: context.broadcast(_bitmap(single))}
    marks[2] = context.broadcast(_bitmap(_counted(dictionary, [2], 1, marks[1], least)))
    if max_words > 2:
        longer = context.broadcast(_bitmap(_counted(dictionary, list(range(3, max_words + 1)), 2, marks[2], least)))
        marks |= {k: longer for k in range(3, max_words + 1)}

    def marked(block: Block, k: int) -> np.ndarray:
        at = _narrowed(block, k, 2, marks[2].value)
        return at[_marked(marks[k].value, block.hashes(k)[at])] if k > 2 and len(at) else at

    return single.unionByName(_exact(dictionary, list(range(2, max_words + 1)), marked, least))


def _wide(column: str) -> Column:
    """A count as a decimal: products of counts and constants stay exact beyond 64 bits."""
    return F.col(column).cast("decimal(20,0)")


def rank_phrases(frequent: DataFrame, totals: DataFrame, top: int, covered: int = 80) -> DataFrame:
    """Score the frequent phrases by their weakest cut, drop those that live inside longer ones, keep the first ``top``.

    The score of a cut is floor(2000000 a / (l + r)); ties of the floored scores go to the shortest first
    part. A phrase goes if a longer one that contains it has 100 f >= ``covered`` a. ``totals`` has ``n`` by ``lang``.
    """
    cuts = (
        frequent.where("words > 1")
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .selectExpr(
            "lang", "words", "phrase", "f AS a", "cut",
            "substring_index(phrase, ' ', cut) AS left_part", "substring_index(phrase, ' ', cut - words) AS right_part",
        )
    )
    parts = frequent.select("lang", "phrase", "f")
    left = parts.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r"))
    quotient = F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000BD) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = (
        cuts.join(left, ["lang", "left_part"])
        .join(right, ["lang", "right_part"])
        .withColumn("score", quotient)
        .groupBy("lang", "words", "phrase", "a")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
    )
    # Every shorter phrase inside a longer one, with the most frequent of those around it.
    inside = (
        frequent.where("words > 2")
        .selectExpr("lang", "split(phrase, ' ') AS w", "words", "f")
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
        .selectExpr("lang", "array_join(slice(w, at, size), ' ') AS phrase", "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("around"))
    )
    whole = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (_wide("around") * 100 < _wide("a") * covered)
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (
        whole.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
        .withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= top)
    )
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def collocations(docs: DataFrame, text: str, lang: str, max_words: int = 4, least: int = 30, top: int = 2_000) -> DataFrame:
    """The ``top`` collocations of 2 to ``max_words`` words of every language; see the module and ``rank_phrases``."""
    if max_words < 2:
        raise ValueError("a collocation has two words or more")
    dictionary = materialise(parse(docs, text, lang, max_words), "phrase-dictionary")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("core") * F.col("n")).alias("n"))
    frequent = materialise(frequent_phrases(dictionary, max_words, least), "frequent-phrases")
    return rank_phrases(frequent, totals, top)
