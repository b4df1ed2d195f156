"""Toxicity grammar, quality vectors, encoder and licence automaton against plain versions."""

import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairrank.llm import bpe, licences, quality, toxicity
from pairrank.llm.common import FOLD, WORD, held_out, prepare, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, encoding="utf-8") as file:
        return bpe.Codec(file.read()), Tokenizer.from_file(VOCABULARY)


def same_as_library(codec, texts):
    own, library = codec
    for text, (ids, decoded) in zip(texts, own.encode(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == struct.pack(f"<{len(want)}I", *want), text
        assert decoded.decode() == library.decode(want, skip_special_tokens=False), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_encoder_is_the_library(codec, texts):
    same_as_library(codec, texts)


def test_encoder_edges(codec):
    same_as_library(codec, [None, "", " \n", "a" * 5000, "ab" * 900, "ΑΣ ΣΑΣ İ ﬁ", "x<|endoftext|>y <|startoftext|>", "it's I'LL", "ha" * 40, ":\U0003d000a", "\u1c89\ua7cb x"] * 2)


def test_encoder_many_words_at_once(codec):
    rng = random.Random(5)
    parts = ["th", "in", "er", "an", "ou", "ä", "ción", "re", "!", "7"]
    same_as_library(codec, [" ".join("".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(3000))])


def test_encoder_on_rows(spark):
    prepare(spark)
    df = spark.createDataFrame([(1, "Hello, world", 5), (1, "Hello, world", 5), (2, None, None)], "doc_id int, text string, N_tokens int")
    rows = bpe.encode_decode(df, "text", VOCABULARY).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in rows] == [3, 3, 0] and rows[2]["decoded"] == "" and rows[2]["ids"] == []
    assert rows[0]["decoded"] == "hello</w> ,</w> world</w>" and rows[0].asDict().keys() >= {"doc_id", "text", "ids"}
    assert bpe.encode_decode(df.limit(0), "text", VOCABULARY).count() == 0


def test_a_codec_remembers_a_bounded_number_of_pieces():
    with open(VOCABULARY, encoding="utf-8") as file:
        codec = bpe.Codec(file.read())
    most = 0
    for part in range(5):
        words = ["".join(chr(97 + int(c, 16)) for c in f"{k:x}") for k in range(part * 50_000, part * 50_000 + 50_000)]
        assert sum(1 for _ in codec.encode([" ".join(words)])) == 1
        most = max(most, len(codec.coded))
    assert most < bpe.REMEMBERED + 60_000 < 200_000


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_native_words(text):
    # The two ways of cutting words: the pattern, and blanks after a translation.
    other = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
    cut = [w for w in text.translate(FOLD).translate({ord(c): " " for c in other}).split(" ") if w]
    assert re.findall(WORD, text.translate(FOLD)) == cut


def test_words_in_spark(spark):
    rows = spark.createDataFrame([("A-b  Ç\x00É9_x",), ("",), (None,)], "t string").select(words(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in rows] == [["a", "b", "Ç", "É9", "x"], [], []]


def test_clause_marks():
    read = toxicity.read_clause
    insult, you, no, said, kill = ("insult", 2.0), ("target", 0.0), ("negation", 0.0), ("report", 0.0), ("threat", 0.0)
    other = (None, 0.0)
    assert read([other, insult]) == [("plain", 2.0)]
    assert read([you, other, insult]) == [("targeted", 2.0)]
    assert read([you, no, insult]) == [("negated", 2.0)]
    assert read([said, other, you, insult]) == [("reported", 2.0)]
    assert read([kill, you]) == [("threat", 1.0)] and read([you, kill]) == []


def test_matches_are_whole_words_or_beginnings():
    g = toxicity.Grammar({"scum": 4.0, "lowe-": 3.0})
    assert [(m, w) for m, w, _ in g.matches("Scum! scummy. xscum; loweisch lowe, flowers")] == [("plain", 4.0), ("plain", 3.0)]
    assert g.matches("") == [] and toxicity.Grammar({}).matches("kill you") != []


def labelled(spark, n=400):
    rng = random.Random(3)
    base = ["the", "and", "of", "thing", "reader", "water", "stone", "other"]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(base) + rng.choice(["", "s", "ing"]) for _ in range(40)]
        toxic, good = int(i % 5 == 0), int(i % 3 != 0)
        if toxic:
            text[rng.randrange(40)] = rng.choice(["zorgo", "zorgen", "zorgisch", "blarg"])
        line = " ".join(text) if good else " ".join(t.upper() + "!!" for t in text)
        docs.append((i, line, "x"))
        labels.append((i, good, toxic))
    docs += [(None, None, "x"), (n + 1, "", "x"), (n + 2, "blarg " * 20_000, "x"), (3, docs[3][1], "x")]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, score string"),
        spark.createDataFrame(labels + [(None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int"),
    )


@pytest.mark.parametrize("module, label, threshold", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_fitted_models_on_held_out_rows(spark, module, label, threshold):
    prepare(spark)
    docs, labels = labelled(spark)
    model = module.fit(docs, labels)
    rows = module.score(docs, "text", model).join(labels, "doc_id").where(held_out(docs["doc_id"])).collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r[label] for r in rows) >= 0.95 * len(rows)
    assert all((r["score"] >= threshold) == bool(r["predicted"]) for r in rows)
    everything = module.score(docs, "text", model)
    assert everything.count() == docs.count() and dict(everything.dtypes)["score"] == "double"
    # Labels of held-out rows are never seen: turning them over changes nothing.
    from pyspark.sql import functions as F

    flipped = labels.withColumn(label, F.when(held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    again = module.score(docs, "text", module.fit(docs, flipped))
    key = lambda df: sorted((str(r["doc_id"]), r["score"]) for r in df.collect())
    assert key(again) == key(everything)


def test_models_without_labels(spark):
    prepare(spark)
    docs, labels = labelled(spark, 20)
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(docs, labels.limit(0))
        assert {round(r["score"], 6) for r in module.score(docs, "text", model).collect()} == {0.5}
        assert module.score(docs.limit(0), "text", model).count() == 0


def test_held_out_rule(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_features_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(9)
    text = " ".join("".join(rng.choices("abçd!", k=rng.randint(1, 9))) for _ in range(4000))
    whole = quality.bag(text)
    monkeypatch.setattr(quality, "PIECE", 997)
    cut = quality.bag(text)
    assert np.array_equal(whole[0], cut[0]) and np.allclose(whole[1], cut[1])
    assert len(quality.bag("")[0]) == 0


def plain_licences(text):
    found = re.findall(WORD, (text or "").translate(FOLD))
    places = [
        (i, label)
        for phrase, label in licences.PHRASES.items()
        for i in range(len(found))
        if found[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(found), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licence_places(spark):
    prepare(spark)
    rng = random.Random(2)
    pool = "the mit license apache License, general public LICENSE. gnu version 2 0 licensed under cc by nc 4 é".split()
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "Licensed under CC BY-NC 4.0.", "word " * 50_000 + "MIT License", "Released under the MIT License." * 2]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, labels int")
    rows = licences.scan_licences(df, "text").orderBy("doc_id").collect()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licences(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert rows[302]["labels"] == "cc-by-nc" and rows[302]["spans"][0]["share"] == 1.0 and rows[300]["score"] == 0
    assert licences.scan_licences(df.limit(0), "text").count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(4)
    for _ in range(60):
        sequences = [[rng.choice("abc") for _ in range(rng.randint(1, 9))] for _ in range(3)]
        made = licences.Automaton(sequences)
        text = [rng.choice("abcd") for _ in range(40)]
        got = {at: (state, length) for at, state, length in made.stream(text)}
        for at in range(len(text)):
            ends = lambda n: {(k, e) for k, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == text[at + 1 - n : at + 1]}
            best = max((n for n in range(1, at + 2) if n < 10 and ends(n)), default=0)
            assert got.get(at, (0, 0))[1] == best
            if best:
                assert set(made.ends[got[at][0]]) == ends(best)
