"""Quality of a text from learned subword vectors.

Every word, pair of neighbouring words and character n-gram of a text is hashed to one
of ``BUCKETS`` learned vectors; their mean goes through a linear layer and a softmax.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import add_fields
from pairrank.llm.fit import labelled_sample

BUCKETS = 1 << 16
NGRAMS = (2, 4)
#: Characters hashed at once: bounds the memory of a task whatever the text's length.
PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(48)).astype(np.uint16)


def grams(text: str) -> Iterator[np.ndarray]:
    """Bucket of every feature of a text, in arrays; repeats included.

    Words are runs of non-blanks. A word that follows its equal gives one bucket common
    to all such pairs. N-grams run over the text with blanks; line ends count as blanks.
    """
    last = np.zeros(0, np.uint64)  # hash of the word before the piece
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and end > at + 1 and not text[end - 1].isspace():
            end -= 1  # pieces end with a blank, so that no word is cut
        if end <= at + 1:
            end = min(len(text), at + PIECE)
        code = np.frombuffer(text[at : min(len(text), end + max(NGRAMS) - 1)].encode("utf-32-le"), np.uint32).astype(np.uint64)
        own = end - at
        blank = (code <= 32) | (code == 160)
        code = np.where(blank, np.uint64(32), code)
        for n in NGRAMS:
            count = min(own, len(code) - n + 1)
            if count <= 0:
                continue
            h = code[:count].copy()
            for k in range(1, n):
                h = h * _BASE + code[k : k + count]
            yield _bucket(h, n)
        code, blank = code[:own], blank[:own]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        if len(edge):
            start, stop = edge[::2], edge[1::2]
            # A polynomial of the letters; the inverse power takes the word's place out of its hash.
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * _powers(_BASE, own), dtype=np.uint64)))
            word = (total[stop] - total[start]) * _powers(_INVERSE, own)[start]
            yield _bucket(word, 11)
            both = np.concatenate((last, word))
            pair = both[:-1] * np.uint64(31) + both[1:]
            yield _bucket(np.where(both[:-1] == both[1:], np.uint64(1), pair), 13)
            last = word[-1:]
        at = end


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    counts = np.zeros(BUCKETS, np.int64)
    for part in grams(text):
        counts += np.bincount(part, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    """Per bucket, the difference of the two logits; the mean over a text plus ``bias`` is its logit."""

    slope: np.ndarray
    bias: float

    def logit(self, text: str) -> float:
        total, n = 0.0, 0
        for part in grams(text):
            total += float(self.slope[part].sum(dtype=np.float64))
            n += len(part)
        return self.bias + (total / n if n else 0.0)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -60, 60))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, sizes: dict[int, int], dim: int = 8, epochs: int = 5, rate: float = 2.0, seed: int = 7) -> Model:
    """Stochastic gradient descent, a document a step, on cross entropy.

    Classes are weighted so that the sample stands for ``sizes``. With one class only, the
    score is the smoothed share of that class for every text.
    """
    share = {c: (sizes.get(c, 0) + 1) / (sum(sizes.values()) + 2) for c in (0, 1)}
    seen = {c: int((labels == c).sum()) for c in (0, 1)}
    prior = float(np.log(share[1] / share[0]))
    if not seen[0] or not seen[1]:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    weight = {c: share[c] * len(labels) / seen[c] for c in (0, 1)}
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    out = rng.normal(0, 1, (2, dim))
    bias = np.array([0.0, prior])
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            at, part = bags[k]
            lr = rate * (1 - step / steps)
            step += 1
            if not len(at):
                continue
            mean = part @ vectors[at]
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[int(labels[k])]
            back = p @ out
            out -= lr * np.outer(p, mean)
            bias -= 0.05 * lr * p
            # A share is small where a text is long: scaled by the root of the number of buckets.
            vectors[at] -= lr * np.sqrt(len(at)) * part[:, None] * back
    slope = vectors @ (out[1] - out[0])
    return Model(slope.astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1_500) -> Model:
    """Train on at most ``per_class`` labelled documents of either class (``labelled_sample``).

    Executors hash the texts; the driver receives one sparse row per sampled document,
    of ``BUCKETS`` entries at most and some 1,500 as a rule.
    """
    sample, sizes = labelled_sample(docs, labels, label, per_class)

    @F.arrow_udf("struct<at: binary, part: binary>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [bag(text or "") for text in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array([a.tobytes() for a, _ in rows], pa.binary()), pa.array([p.tobytes() for _, p in rows], pa.binary())],
                names=["at", "part"],
            )

    rows = sample.select("doc_id", "label", hashed("text").alias("h")).select("doc_id", "label", "h.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    bags = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["part"], np.float32)) for r in rows]
    return train(bags, np.array([r["label"] for r in rows], np.int64), sizes)


def score(docs: DataFrame, text: str, model: Model, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``.

    Whole texts count. A null or empty text has no features and gets the score of the
    bias alone. Equal texts get equal scores, in any order and any partitioning. Columns
    named like a result give way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, predicted: int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores = [shared.value.score(t or "") for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["score", "predicted"],
            )

    return add_fields(docs, run(F.col(f"`{text}`")), ["score", "predicted"])
