"""Licence statements in running text, by a generalised suffix automaton.

The automaton is built over the words of all templates. A text streams through it once:
at every word it holds the longest match that ends there. Matches that cannot be
extended are chained, template by template, into covered spans.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairrank.llm.common import FOLD, WORD, add_fields

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Customary statements of public licences, in the words of ``WORD``.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
)
#: Words of a match worth chaining, words that may lie between two of a chain, share of a template that makes a label.
LONG, GAP, SHARE = 3, 8, 0.75
_WORD = re.compile(WORD)


class Automaton:
    """Suffix automaton of several word sequences; knows the ends of every match in them."""

    def __init__(self, sequences: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].add((number, at + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(e) for e in ends]

    def _extend(self, last: int, word: str, ends: list) -> int:
        def state(length: int, link: int, nxt: dict[str, int]) -> int:
            self.length.append(length)
            self.link.append(link)
            self.next.append(nxt)
            ends.append(set())
            return len(self.length) - 1

        def split(p: int, q: int) -> int:
            copy = state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = copy
                p = self.link[p]
            self.link[q] = copy
            return copy

        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        new, p = state(self.length[last] + 1, -1, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return new

    def stream(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest match that ends at each word with one."""
        state = length = 0
        nxt, link, lengths = self.next, self.link, self.length
        for at, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                length = lengths[state]
            if word in nxt[state]:
                state = nxt[state][word]
                length += 1
                yield at, state, length


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [*phrases.values(), *(label for label, _ in templates)]
        sequences = [t.split() for t in [*phrases, *(t for _, t in templates)]]
        self.sizes, self.n_phrases = [len(s) for s in sequences], len(phrases)
        self.automaton = Automaton(sequences)
        # Phrases that end where a match of this state ends: whole in the state or in one of its suffixes.
        made = self.automaton
        self.whole: list[list[int]] = [[] for _ in made.length]
        for state in sorted(range(1, len(made.length)), key=made.length.__getitem__):
            own = {n for n, end in made.ends[state] if n < self.n_phrases and end == self.sizes[n] <= made.length[state]}
            self.whole[state] = sorted(own.union(self.whole[made.link[state]]))

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, float]]]:
        """Phrase places (start, phrase) and covered spans (template, first word, end, share)."""
        places, matches = [], []
        held = None
        for at, state, length in self.automaton.stream(words):
            for n in self.whole[state]:
                if self.sizes[n] <= length:
                    places.append((at - self.sizes[n] + 1, n))
            if held is not None and (at != held[0] + 1 or length != held[2] + 1) and held[2] >= LONG:
                matches.append(held)
            held = (at, state, length)
        if held is not None and held[2] >= LONG:
            matches.append(held)
        chains: dict[int, list[list[int]]] = defaultdict(list)
        for at, state, length in matches:
            for n, end in self.automaton.ends[state]:
                if n < self.n_phrases:
                    continue
                begin, start = end - length, at - length + 1
                last = chains[n][-1] if chains[n] else None
                if last and start - last[1] <= GAP and end > last[2]:
                    last[3] += end - max(begin, last[2])
                    last[1], last[2] = at + 1, end
                else:
                    chains[n].append([start, at + 1, end, length])
        spans = [(n, c[0], c[1], c[3] / self.sizes[n]) for n, found in chains.items() for c in found]
        return places, spans


def scan_licences(docs: DataFrame, text: str, keep_spans: bool = True) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and, if wanted, spans.

    Base: every place of a phrase, overlapping ones too. ``labels`` adds the templates of
    which a span covers ``SHARE`` at least. ``score`` is the largest share of a template
    covered by one span, 1 where a phrase stands. Null and empty texts have no words, no
    labels and score 0. Repeated rows are scanned each for itself; columns named like a
    result give way to it.
    """
    kinds = {
        "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
        "base_labels": "string", "labels": "string", "score": "double",
    }
    if keep_spans:
        kinds["spans"] = "array<struct<label: string, first: bigint, end: bigint, share: double>>"

    @F.arrow_udf("struct<" + ", ".join(f"{k}: {v}" for k, v in kinds.items()) + ">")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for value in batch.to_pylist():
                words = _WORD.findall((value or "").translate(FOLD) if value and not value.isascii() else (value or "").lower())
                places, spans = scanner.scan(words)
                starts = [p for p, _ in places]
                base = {scanner.names[n] for _, n in places}
                more = {scanner.names[n] for n, _, _, share in spans if share >= SHARE}
                rows.append({
                    "n_words": len(words), "n_base": len(places),
                    "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)),
                    "score": 1.0 if places else min(1.0, max((s for *_, s in spans), default=0.0)),
                    "spans": [{"label": scanner.names[n], "first": a, "end": b, "share": s} for n, a, b, s in spans],
                })
            fields = {
                "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
                "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
                "spans": pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])),
            }
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], fields[k]) for k in kinds], names=list(kinds))

    return add_fields(docs, run(F.col(f"`{text}`")), list(kinds))
