"""Language of a text by compression: the language whose sample text shortens it most.

A language is known by a *raw-content dictionary*: some 64 KB of passages of its training
texts, which zstandard may point back into as if they stood before the text. Each text is
compressed once with the dictionary of each language, and the smallest result names it.

* **Text** is reduced to its letters: lower case, words of letters, one space between them.
  Digits, punctuation and capitals say little about the language and much about the source.
* **Blocks.** A text is compressed in blocks of ``BLOCK`` bytes, each afresh, and sizes add up.
  Without that a long text would soon be its own best dictionary and its margin would not grow.
* **Ties** (a word or two leave whole bytes equal) go to the language with more training
  passages, then to the lesser name.
* **Rejection.** A margin is narrow if the second best needs less than ``MARGIN`` more than the
  best, or less than ``BYTES`` more in all. Such rows are marked ``narrow``; with ``reject=True``
  they are ``und`` as well.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if
nothing was learned. Repeated rows get equal answers on any partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest
from itertools import islice

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.llm.common import add_fields

UNKNOWN = "und"
PASSAGE, BLOCK = 512, 2048
MARGIN, BYTES = 0.01, 2
#: Single letters of any script, without digits and the underscore.
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> bytes:
    """The words of letters of a text in lower case, a space between them, as UTF-8."""
    # A lone surrogate has no UTF-8 form; none is a letter either.
    return " ".join(LETTERS.findall((text or "").lower())).encode()


@dataclass(frozen=True)
class Model:
    """A dictionary per language, and how many training passages each language had."""

    dictionaries: dict[str, bytes]
    passages: dict[str, int]


class Judge:
    """The compressors of a model, built once in a worker."""

    def __init__(self, model: Model) -> None:
        # Greedy search for matches of four bytes on: as exact as slower levels here, at half their cost.
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=3, hash_log=16, chain_log=16, write_content_size=False
        )
        self.order = sorted(model.dictionaries, key=lambda lang: (-model.passages[lang], lang))
        self.coders = []
        for lang in self.order:
            content = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=params))

    def sizes(self, text: bytes) -> list[int]:
        blocks = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
        return [sum(len(coder.compress(block)) for block in blocks) for coder in self.coders]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, narrow). The score is the best one's share where every byte saved counts two to one."""
        reduced = letters(text)
        if not reduced or not self.order:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(reduced)
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
        share = 1 / sum(2.0 ** -min(size - sizes[best], 1000) for size in sizes)
        if len(sizes) == 1:
            return self.order[0], share, False
        second = min(size for k, size in enumerate(sizes) if k != best)
        gap = second - sizes[best]
        return self.order[best], share, gap < BYTES or gap < MARGIN * sizes[best]


def fit(docs: DataFrame, text: str, lang: str, learn: Column, passages: int = 128) -> Model:
    """Dictionaries of at most ``passages`` x 512 bytes for every language of the rows where ``learn`` holds.

    Every training text is cut into passages; of the different ones of a language those with
    the smallest hashes are taken, whatever document they stand in. So copies count once, long
    texts may not crowd out others, and the sample is the same on any partitioning. Tasks send
    on only their own smallest ones. The driver receives 64 KB a language.
    """
    rows = docs.where(learn & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, bytes]] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                reduced, mine = letters(body), kept.setdefault(name, {})
                for at in range(0, len(reduced), PASSAGE):
                    part = reduced[at : at + PASSAGE]
                    mine[xxhash.xxh64_intdigest(part) - 2**63] = part
                seen[name] = seen.get(name, 0) + -(-len(reduced) // PASSAGE)
                if len(mine) > 8 * passages:
                    kept[name] = {k: mine[k] for k in nsmallest(passages, mine)}
        found = [(name, k, mine[k]) for name, mine in kept.items() for k in nsmallest(passages, mine)]
        # A row without a passage carries the number of passages the task has seen.
        found += [(name, None, str(n).encode()) for name, n in seen.items()]
        while part := list(islice(found, 1000)):
            del found[: len(part)]
            yield pa.RecordBatch.from_pydict(
                {"lang": [x[0] for x in part], "at": [x[1] for x in part], "part": [x[2] for x in part]},
                schema=pa.schema([("lang", pa.string()), ("at", pa.int64()), ("part", pa.binary())]),
            )

    found = rows.mapInArrow(smallest, "lang string, at long, part binary")
    first = Window.partitionBy("lang").orderBy("at")
    counted = F.sum(F.when(F.col("at").isNull(), F.col("part").cast("string").cast("long")))
    grouped = found.groupBy("lang", "at").agg(F.min("part").alias("part"), counted.alias("seen"))
    # Nulls come first: one row more than there are passages.
    taken = grouped.withColumn("k", F.row_number().over(first)).where(F.col("k") <= passages + 1).collect()
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for row in taken:
        if row["at"] is not None:
            parts.setdefault(row["lang"], []).append((row["at"], bytes(row["part"])))
    seen = {row["lang"]: row["seen"] for row in taken if row["at"] is None}
    return Model({name: b" ".join(part for _, part in sorted(found)) for name, found in parts.items()}, {name: seen[name] for name in parts})


def classify(docs: DataFrame, text: str, model: Model, reject: bool = False) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``narrow``. Columns named like a result give way to it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, narrow: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Judge(shared.value)
        for batch in batches:
            rows = [judge.judge(body) for body in batch.to_pylist()]
            names = [UNKNOWN if reject and narrow else name for name, _, narrow in rows]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())],
                names=["lang_pred", "score", "narrow"],
            )

    return add_fields(docs, run(F.col(f"`{text}`")), ["lang_pred", "score", "narrow"])
