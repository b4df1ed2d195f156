"""Byte-pair encoding and decoding over a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairrank.llm.common import add_fields

#: White space as the vocabulary's normaliser sees it (fixed values).
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Distinct pieces remembered by a task, and characters whose new pieces are merged together.
REMEMBERED, TOGETHER = 100_000, 2_000_000
#: Texts of a batch that are Python strings at a time.
AT_ONCE = 1_000
#: Positions from which a rank is applied to all of them at once.
MANY = 8


class Codec:
    """A lower-casing word vocabulary with word ends, read from the text of its JSON file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64).reshape(-1, 2)
        self.left, self.right = pairs[:, 0], pairs[:, 1]
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.order = np.argsort(self.left << 20 | self.right)
        self.sorted_pairs = (self.left << 20 | self.right)[self.order]
        self.rank = {pair: r for r, pair in enumerate(zip(self.left.tolist(), self.right.tolist()))}
        # A rank is plain if its token has one pair, of two different symbols, and enters later ranks only.
        first_use = np.full(max(self.token) + 1, len(merges), np.int64)
        np.minimum.at(first_use, self.left, np.arange(len(merges)))
        np.minimum.at(first_use, self.right, np.arange(len(merges)))
        uses = np.bincount(self.made, minlength=len(first_use))
        self.plain = (uses[self.made] == 1) & (self.left != self.right) & (first_use[self.made] > np.arange(len(merges)))
        self.text = [self.token.get(i, "").encode() for i in range(max(self.token) + 1)]
        self.coded: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.forget()
        self.spec, self.library = spec, None
        self.old: set[str] = set()

    def forget(self) -> None:
        """Empty what the task remembers, but for the special tokens."""
        self.coded = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.decoded = {t: t.encode() for t in self.special}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, -1 where it is none; negative symbols pair with nothing."""
        if not len(self.sorted_pairs):
            return np.full(len(left), -1, np.int64)
        key = np.where((left >= 0) & (right >= 0), left << 20 | right, -1)
        at = np.searchsorted(self.sorted_pairs, key)
        at[at == len(self.sorted_pairs)] = 0
        return np.where(self.sorted_pairs[at] == key, self.order[at], -1)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word's ids end.

        All words stand in one row of symbols, each with a wall behind it. ``places``, the
        index, lists the positions of each pair by its rank. The smallest active rank is
        applied next, at all its positions, and only the lists of the pairs beside them
        change. A plain rank with many positions is applied to them at once; any other one
        goes from left to right and gives way as soon as a smaller rank becomes active.
        """
        joined = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        letters = self.inner[joined]
        letters[ends - 1] = self.final[joined[ends - 1]]
        symbol = np.insert(letters, ends, -1)
        symbol = np.append(symbol, -1)
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[0] = n - 1  # the last wall
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            some = rank >= 0
            at, rank = at[some], rank[some]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            edges = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
            for q, a, b in zip(rank[edges].tolist(), edges, [*edges[1:], len(at)]):
                if q in places:
                    places[q].append(at[a:b])
                else:
                    places[q] = [at[a:b]]
                    heapq.heappush(active, q)

        enter(np.arange(n - 1), self.ranks(symbol[:-1], symbol[1:]))
        while active:
            r = heapq.heappop(active)
            lists = places.pop(r, None)
            if lists is None:
                continue
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if len(at) < MANY or not self.plain[r]:
                self._one_by_one(r, sorted(set(at.tolist())), symbol, after, before, places, active)
                continue
            new = self.made[r]
            at = at[(symbol[at] == self.left[r]) & (symbol[after[at]] == self.right[r])]
            if len(lists) > 1:
                at = np.unique(at)
            gone = after[at]
            symbol[at], symbol[gone] = new, -2
            beyond = after[gone]
            after[at], before[beyond] = beyond, at
            prev = before[at]
            edge = np.concatenate((prev, at))
            enter(edge, self.ranks(symbol[edge], symbol[np.concatenate((at, beyond))]))
        alive = symbol >= 0
        walls = np.flatnonzero(symbol == -1)[: len(words)]
        return symbol[alive], np.cumsum(alive)[walls]

    def _one_by_one(self, r, todo, symbol, after, before, places, active) -> None:
        rank, made = self.rank, self.made
        new = int(made[r])
        for k, at in enumerate(todo):
            left, right = int(symbol[at]), int(after[at])
            now = rank.get((left, int(symbol[right])))
            if now is None or made[now] != new:
                continue
            symbol[at], symbol[right] = new, -2
            nxt = int(after[right])
            after[at], before[nxt] = nxt, at
            prev = int(before[at])
            lower = False
            for first, pair in ((prev, (int(symbol[prev]), new)), (at, (new, int(symbol[nxt])))):
                q = rank.get(pair)
                if q is not None:
                    if q in places:
                        places[q].append(np.array([first]))
                    else:
                        places[q] = [np.array([first])]
                        heapq.heappush(active, q)
                    lower = lower or q <= r
            if lower and todo[k + 1 :]:
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(np.array(todo[k + 1 :]))
                return

    def learn(self, words: list[str]) -> None:
        """Encode pieces that are not yet known."""
        if not words:
            return
        ids, ends = self.merge_all([w.encode() for w in words])
        coded, listed, start, text = ids.astype("<u4").tobytes(), ids.tolist(), 0, self.text
        for word, end in zip(words, ends.tolist()):
            self.coded[word] = coded[4 * start : 4 * end]
            self.decoded[word] = b" ".join([text[i] for i in listed[start:end]])
            start = end

    def _split_young(self, text: str) -> list[str]:
        """Pieces of a text with characters unknown to this Python: the library knows their classes and cases."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.spec)
        normal = self.library.normalizer.normalize_str(text)
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        return [bytes(byte[x] for x in piece).decode() for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def split(self, text: str) -> list[str]:
        """The pieces of a text, special tokens written out in it among them."""
        out: list[str] = []
        parts = self.split_special.split(text) if self.split_special and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(part)
                continue
            if not part.isascii():
                fresh = set(part) - self.old
                if any(unicodedata.category(c) == "Cn" for c in fresh):
                    out += self._split_young(part)
                    continue
                self.old |= fresh
                part = SPACES.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ")
            out += self.pieces.findall(part.lower())
        return out

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids (unsigned 32-bit, little-endian) and the decoded text in UTF-8."""
        at = 0
        while at < len(texts):
            group, size, fresh = [], 0, set()
            if len(self.coded) > REMEMBERED:
                self.forget()
            while at < len(texts) and (not group or size < TOGETHER):
                text = texts[at] or ""
                pieces = self.split(text)
                fresh.update(set(pieces).difference(self.coded))
                group.append(pieces)
                size += len(text)
                at += 1
            self.learn(sorted(fresh))
            coded, decoded = self.coded.__getitem__, self.decoded.__getitem__
            for pieces in group:
                yield b"".join(map(coded, pieces)), b" ".join(map(decoded, pieces))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(moved.get(b, b)) for b in range(256)]


_CODECS: dict[str, Codec] = {}


def codec_of(spec: str) -> Codec:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def encode_decode(df: DataFrame, text: str, tokenizer_path: str, keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and those of ``ids`` / ``decoded`` in ``keep``.

    The vocabulary file (a few MB) is read once by the driver and broadcast, so executors
    need not see its folder. Null and empty texts have no tokens and decode to the empty
    text. Special tokens written out in a text become their ids. Tokens of the decoded text
    are joined by one blank, word ends kept, since this vocabulary names no decoder.
    Repeated rows are encoded each for itself; columns named like a result give way to it.
    A vocabulary must hold all 256 byte letters, with and without the word end.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    kinds |= {k: v for k, v in {"ids": "array<int>", "decoded": "string"}.items() if k in keep}

    @F.arrow_udf(", ".join(f"{k}: {v}" for k, v in kinds.items()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(spec.value)
        for batch in batches:
            counts, ids_sha, text_sha, ids, texts = [], [], [], [], []
            parts = (batch.slice(at, AT_ONCE).to_pylist() for at in range(0, len(batch), AT_ONCE))
            for coded, decoded in chain.from_iterable(map(codec.encode, parts)):
                counts.append(len(coded) // 4)
                ids_sha.append(hashlib.sha256(coded).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if "ids" in keep:
                    ids.append(memoryview(coded).cast("I").tolist())
                if "decoded" in keep:
                    texts.append(decoded.decode())
            columns = [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if "ids" in keep else []
            columns += [pa.array(texts, pa.string())] if "decoded" in keep else []
            yield pa.StructArray.from_arrays(columns, names=list(kinds))

    return add_fields(df, run(F.col(f"`{text}`")), list(kinds))
