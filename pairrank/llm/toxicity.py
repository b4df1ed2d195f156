"""Toxicity from a weighted finite-state grammar over clauses.

A text is cut into clauses. Its words become symbols: an insult or threat of the
lexicon, a target, a negation, a verb of reported speech, or nothing of these. Four
transducers read the symbols in lock step; each marks the insults in its scope. The
marked insults and the threats with a target are what a clause is scored by. The
lexicon (words and word beginnings, for languages that inflect) and the weights of the
marks are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import add_fields
from pairrank.llm.fit import labelled_sample

LETTERS = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:\n]+")
#: Lengths of the word beginnings that may stand for an inflected word.
STEMS = (4, 5, 6, 7, 8)
#: Closed classes of the grammar (English, German, French, Spanish).
CLASSES = {
    "target": "you your yours yourself he she him her they them these those this is are du dich ihr euch sie tu te toi vous il elle ils usted tú eres".split(),
    "negation": "not no never nobody isn aren don nicht kein keine nie pas jamais ne nunca ni".split(),
    "report": "said says say wrote writes called calls quoted quotes reported claims claimed according sagte schrieb dit écrit dijo escribió".split(),
    "threat": "kill kills hurt destroy burn beat shoot stab hang töten umbringen tuer frapper matar golpear".split(),
}
MARKS = ("plain", "targeted", "negated", "reported", "threat")


@dataclass
class Scope:
    """A transducer with a counter for its state: it marks what follows its trigger within ``reach`` words."""

    trigger: str
    reach: int
    since: int = 1 << 30

    def step(self, symbol: str | None) -> bool:
        marked = self.since < self.reach
        self.since = 0 if symbol == self.trigger else self.since + 1
        return marked


def read_clause(symbols: list[tuple[str | None, float]]) -> list[tuple[str, float]]:
    """Compose the transducers over the symbols of a clause: (mark, weight) for every insult and threat."""
    target, negation, report, threat = Scope("target", 4), Scope("negation", 3), Scope("report", 1 << 29), Scope("threat", 4)
    out = []
    for symbol, weight in symbols:
        aimed, denied, quoted, menaced = (s.step(symbol) for s in (target, negation, report, threat))
        if symbol == "insult":
            out.append(("reported" if quoted else "negated" if denied else "targeted" if aimed else "plain", weight))
        elif symbol == "target" and menaced and not denied:
            out.append(("threat", 1.0))
    return out


def units(text: str) -> set[str]:
    """The words of a text and their beginnings, the latter with a hyphen at the end."""
    words = set(LETTERS.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


@dataclass
class Grammar:
    """``insults``: weight by word or beginning; ``weights`` and ``bias``: of a text's features."""

    insults: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [1.0] * (len(MARKS) + 2))
    bias: float = -3.0

    def __post_init__(self):
        self._finder = None

    def __getstate__(self):
        return {"insults": self.insults, "weights": self.weights, "bias": self.bias, "_finder": None}

    def finder(self):
        """Automaton of the words and beginnings with which a clause can matter, and of threats."""
        if self._finder is None:
            made = ahocorasick.Automaton()
            keys: dict[str, list[tuple[bool, int]]] = {}
            for unit in [*self.insults, *CLASSES["threat"]]:
                stem = unit.endswith("-")
                word = unit.removesuffix("-")
                keys.setdefault(word, []).append((stem, len(word)))
            for word, kinds in keys.items():
                made.add_word(word, (any(stem for stem, _ in kinds), len(word)))
            if keys:
                made.make_automaton()
            self._finder = (made, {w: kind for kind, words in CLASSES.items() for w in words}, bool(keys))
        return self._finder

    def symbol(self, word: str, classes: dict[str, str]) -> tuple[str | None, float]:
        best = self.insults.get(word, 0.0)
        for n in STEMS:
            if len(word) > n:
                best = max(best, self.insults.get(word[:n] + "-", 0.0))
        return ("insult", best) if best > 0 else (classes.get(word), 0.0)

    def matches(self, text: str) -> list[tuple[str, float, str]]:
        """(mark, weight, clause) of every insult and threat; clauses without any are never read."""
        made, classes, usable = self.finder()
        low = text.lower()
        if not usable:
            return []
        found = []
        for end, (stem, size) in made.iter(low):
            start = end - size + 1
            if start and low[start - 1].isalpha():
                continue
            if not stem and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            found.append(start)
        out, upto = [], -1
        for at in sorted(found):
            if at < upto:
                continue
            begin = max(low.rfind(c, 0, at) for c in ".!?;:\n") + 1
            clause = CLAUSE.match(low, begin)
            if clause is None:
                continue
            upto = clause.end()
            symbols = [self.symbol(w, classes) for w in LETTERS.findall(clause.group())]
            out += [(mark, weight, clause.group()) for mark, weight in read_clause(symbols)]
        return out

    def features(self, text: str) -> list[float]:
        totals, top = dict.fromkeys(MARKS, 0.0), 0.0
        for mark, weight, _ in self.matches(text):
            totals[mark] += weight
            if mark != "threat":
                top = max(top, weight)
        dense = (sum(totals.values()) - totals["threat"]) / math.log2(2 + len(text))
        return [math.log1p(totals[m]) for m in MARKS] + [top, dense]

    def score(self, text: str) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def strength(p: int, n: int, toxic: int, clean: int) -> tuple[float, float]:
    """Log-likelihood ratio of a unit in ``p`` toxic and ``n`` clean texts, and its log odds."""
    seen, total = p + n, toxic + clean
    expected = (seen * toxic / total, seen * clean / total)
    ratio = 2 * sum(o * math.log(o / e) for o, e in zip((p, n), expected) if o)
    return ratio, math.log((p + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (clean + 1))


def select(candidates: list[tuple[str, float]], held: list[list[int]], least: int = 3, sure: float = 100.0) -> list[str]:
    """The candidates (unit, likelihood ratio), strongest first, that explain ``least`` texts
    which no stronger one does; one such text is enough from a ratio of ``sure``.

    ``held`` has the candidates' indexes of every toxic text. Words that only keep company
    with an insult, as in a group of near copies, explain nothing and fall away.
    """
    texts: dict[int, list[int]] = {}
    for k, found in enumerate(held):
        for i in found:
            texts.setdefault(i, []).append(k)
    explained, out = set(), []
    for i, (unit, ratio) in enumerate(candidates):
        fresh = [k for k in texts.get(i, []) if k not in explained]
        if len(fresh) >= (1 if ratio >= sure else least):
            out.append(unit)
            explained.update(fresh)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression, by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-6)) @ a + keep, a.T @ (p - y) + keep @ w)
        w -= step / max(1.0, np.abs(step).max() / 2)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 8_000, entries: int = 4_000, evidence: float = 18.0, odds: float = 2.0) -> Grammar:
    """Learn the grammar from at most ``per_class`` labelled documents of either class.

    Every word and word beginning is counted by the number of sampled documents that hold
    it; tasks sum up before the shuffle. Those with a likelihood ratio of ``evidence`` and
    log odds of ``odds`` at least are the lexicon: the strongest ``entries`` of them come
    to the driver, which keeps those that explain texts (``select``). Then the marks' weights
    are fitted to the features of the same sample.
    Without documents of both classes there is no lexicon and all scores are the base rate.
    """
    sample, sizes = labelled_sample(docs, labels, label, per_class)
    base = math.log((sizes.get(1, 0) + 1) / (sizes.get(0, 0) + 1))
    taken = {c: min(per_class, sizes.get(c, 0)) for c in (0, 1)}
    if not taken[0] or not taken[1]:
        return Grammar({}, bias=base)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            names = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(names, pa.string()), *(pa.array([seen[c][u] for u in names], pa.int64()) for c in (1, 0))]
            for c in (0, 1):
                seen[c].clear()
            return pa.RecordBatch.from_arrays(columns, names=["unit", "p", "n"])

        for batch in batches:
            for text, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[value].update(units(text or ""))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield flush()
        yield flush()

    counted = (
        sample.select("text", "label")
        .mapInArrow(count, "unit string, p bigint, n bigint")
        .groupBy("unit")
        .agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    )
    p, n = F.col("p"), F.col("n")
    toxic, clean = F.lit(float(taken[1])), F.lit(float(taken[0]))
    half = lambda o, total: F.when(o > 0, o * F.log(o * (toxic + clean) / ((p + n) * total))).otherwise(0.0)
    ratio = 2 * (half(p, toxic) + half(n, clean))
    logs = F.log((p + 0.5) / (toxic + 1)) - F.log((n + 0.5) / (clean + 1))
    lexicon = (
        counted.select("unit", ratio.alias("ratio"), logs.alias("odds"))
        .where((F.col("ratio") >= evidence) & (F.col("odds") >= odds))
        .orderBy(F.desc("ratio"), "unit")
        .limit(entries)
        .collect()
    )
    candidates = docs.sparkSession.sparkContext.broadcast({r["unit"]: k for k, r in enumerate(lexicon)})

    @F.arrow_udf("array<int>")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = candidates.value
        for batch in batches:
            yield pa.array([[index[u] for u in units(t or "") if u in index] for t in batch.to_pylist()], pa.list_(pa.int32()))

    toxic_rows = sample.where(F.col("label") == 1).select("doc_id", held("text").alias("held")).collect()
    chosen = set(select([(r["unit"], r["ratio"]) for r in lexicon], [r["held"] for r in toxic_rows]))
    grammar = Grammar({r["unit"]: min(6.0, r["odds"]) for r in lexicon if r["unit"] in chosen}, bias=base)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shared.value.features(t or "") for t in batch.to_pylist()], pa.list_(pa.float64()))

    rows = sample.select("label", measured("text").alias("x")).collect()
    if not rows:
        return grammar
    *weights, bias = logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)).tolist()
    # The sample holds the classes in other shares than the rows it stands for.
    bias += base - math.log((taken[1] + 1) / (taken[0] + 1))
    return Grammar(grammar.insults, weights, bias)


def score(docs: DataFrame, text: str, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` and ``n_matches`` (marked insults and threats).

    Whole texts count. Null and empty texts match nothing and get the base score. Equal
    texts get equal scores. Columns named like a result give way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.arrow_udf("struct<score: double, predicted: int, n_matches: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = shared.value
            texts = batch.to_pylist()
            scores = [made.score(t or "") for t in texts]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array([len(made.matches(t or "")) for t in texts], pa.int64()),
                ],
                names=["score", "predicted", "n_matches"],
            )

    return add_fields(docs, run(F.col(f"`{text}`")), ["score", "predicted", "n_matches"])
