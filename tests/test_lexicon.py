"""Vocabulary tables against plain Python: windows, containment, similarity."""

import random
import re

import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairrank.operators import lexicon as lx

WORDS = ["a", "b", "cctv", "fire", "first", "aid", "at", "work", "sia", "x1"]


def vocab_of(spark, rows):
    return lx.entries(spark.createDataFrame(rows, "phrase STRING, code STRING, place INT"), place="place")


def last_entries(rows):
    out = {}
    for phrase, code, place in sorted(rows, key=lambda r: (r[2], r[1])):
        if phrase:
            out[phrase] = (code, place)
    return out


def random_phrases(n, seed, low=1, high=4):
    rng = random.Random(seed)
    return [(" ".join(rng.choices(WORDS, k=rng.randint(low, high))), f"c{rng.randint(0, 9)}", rng.randint(0, 3)) for _ in range(n)]


def test_phrases_on_word_boundaries(spark):
    rng = random.Random(1)
    rows = [*random_phrases(40, 1), ("", "none", 0), (None, "none", 0), ("fire fire fire fire fire fire", "long", 0)]
    texts = [" ".join(rng.choices(WORDS + ["firex", "aida"], k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "fire " * 5_000 + "fire"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "id INT, t STRING, v_code INT")
    vocab = vocab_of(spark, rows)
    entries = last_entries(rows)
    present = {k: {p for p in entries if t and f" {p} " in f" {t} "} for k, t in enumerate(texts)}
    got = {r["id"]: r["codes"] for r in lx.tag_phrases(docs, "id", F.col("t"), vocab).collect()}
    assert got == {k: sorted({entries[p][0] for p in found}) for k, found in present.items()}
    counts = {r["phrase"]: r["n_documents"] for r in lx.phrase_coverage(docs, "id", F.col("t"), vocab).collect()}
    assert counts == {p: sum(p in found for found in present.values()) for p in entries}
    assert lx.phrase_coverage(docs.limit(0), "id", F.col("t"), vocab).agg(F.sum("n_documents")).first()[0] == 0
    assert {tuple(r["codes"]) for r in lx.tag_phrases(docs, "id", F.col("t"), vocab.limit(0)).collect()} == {()}


def test_windows_are_compiled(spark):
    """No function with a lambda, which Spark interprets, makes the windows; blanks and lengths are as in a split text."""
    long = " ".join(["w"] * 20_000)
    texts = [long, "a  b", " a b ", "a", "", None, "a\nb c", "é b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    vocab = vocab_of(spark, [(p, p[:9], 0) for p in (long, "a  b", "a", " ", "b ", "a b", "a\nb", "\nb", "é", "w w")])
    hits = lx.phrase_hits(docs, "id", F.col("t"), vocab)
    assert "lambda" not in hits._jdf.queryExecution().optimizedPlan().toString()
    phrases = [r["v_phrase"] for r in vocab.collect()]
    want = {(k, p) for k, t in enumerate(texts) if t is not None for p in phrases if f" {p} " in f" {t} "}
    assert {(r["id"], r["v_phrase"]) for r in hits.collect()} == want


def test_more_phrases_than_a_plan_could_hold(spark):
    vocab = lx.entries(spark.range(5_000).select(F.concat(F.lit("w"), "id").alias("phrase"), F.col("id").cast("string").alias("code")))
    docs = spark.createDataFrame([(1, "w7 w4999 w5000 ww8")], "id INT, t STRING")
    assert lx.tag_phrases(docs, "id", F.col("t"), vocab).first()["codes"] == ["4999", "7"]


def test_entities_are_the_longest_from_left_to_right(spark):
    rows = [("First Aid", "fa", 0), ("first aid at work", "faw", 0), ("C++", "cpp", 0), ("fire-safety", "fs", 0), ("aid at", "aa", 0), (".net", "net", 0), ("é", "e", 0)]
    texts = ["FIRST AID at work, first aid.", "xfirst aid", "c++ c+++ C++x", "fire-safety fire safety é éa", "asp.net .net first  aid at", None, "", "first aid at workers aid at"]
    rng = random.Random(4)
    texts += ["".join(rng.choices([*WORDS, " ", ".", "-", "+", "first aid", "c++"], k=25)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    entries = {p.lower(): c for p, c, _ in rows}
    body = "|".join(re.escape(p) for p in sorted(entries, key=len, reverse=True))
    pattern = regex.compile(rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])")
    for r in lx.entity_spans(docs, "id", F.col("t"), vocab_of(spark, rows)).collect():
        found = pattern.finditer((texts[r["id"]] or "").lower())
        assert [tuple(s) for s in r["spans"]] == [(m.start(), m[0], entries[m[0]]) for m in found], texts[r["id"]]


def test_places_in_long_texts(spark):
    """Windows come out of plain generators, and a place is counted from the last known one."""
    rng = random.Random(6)
    texts = ["".join(rng.choices(["first aid", "firsts", "c++", " ", " ", "\n", "é"], k=n)) for n in (30, 31, 32, 33, 64, 65, 400, 3_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    found = lx.entity_spans(docs, "id", F.col("t"), vocab_of(spark, [("first aid", "fa", 0), ("c++", "cpp", 0)]))
    assert "explode(transform" not in found._jdf.queryExecution().optimizedPlan().toString()
    pattern = regex.compile(r"(?<![\p{L}\p{N}_])(?:first aid|c\+\+)(?![\p{L}\p{N}_])")
    for r in found.collect():
        want = [(m.start(), m[0]) for m in pattern.finditer(texts[r["id"]])]
        assert [(s["start"], s["span"]) for s in r["spans"]] == want
        assert want or len(texts[r["id"]]) < 200


def test_the_longest_contained_entry_wins(spark):
    rng = random.Random(2)
    letters = "abc "
    word = lambda low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
    rows = [(word(1, 7), f"c{k}", rng.randint(0, 2)) for k in range(60)] + [("a" * 90, "wide", 0), ("zz", "absent", 0)]
    asked = [word(0, 25) for _ in range(120)] + [None, "b" + "a" * 95]
    entries = last_entries(rows)
    want = {}
    for text in filter(None, asked):
        found = [(-len(p), -place, p, code) for p, (code, place) in entries.items() if p in text]
        if found:
            want[text] = min(found)[3]
    got = lx.match_contained(spark.createDataFrame([(t,) for t in asked], "said STRING"), "said", vocab_of(spark, rows)).collect()
    assert {r["a_phrase"]: r["code"] for r in got} == want and len(got) == len(want)


def plain_similarity(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next_row(row, x, b)
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 0.0


def _next_row(row, x, b):
    out = [0]
    for k, y in enumerate(b):
        out.append(row[k] + 1 if x == y else max(row[k + 1], out[k]))
    return out


@given(st.text("abcd", max_size=90), st.text("abcd", max_size=90))
def test_similarity_is_the_textbook_recurrence(a, b):
    assert lx.similarity(a, b) == pytest.approx(plain_similarity(a, b))


@pytest.mark.parametrize("threshold", [76.0, 88.0, 100.0])
def test_similar_entries_equal_all_pairs(spark, threshold):
    rng = random.Random(3)
    rows = [*random_phrases(120, 5, 1, 6), ("ab", "ab", 0), ("a", "a", 0), ("the quick brown fox " * 5, "wide", 0), ("aaaa", "as", 0)]

    def damage(text):
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", "x", "a", " "]) + text[at + rng.randint(0, 1) :]
        return text

    asked = [damage(r[0]) for r in rows for _ in range(2)] + ["", None, "aaaaa"]
    entries = last_entries(rows)
    want = {}
    for text in filter(None, asked):
        found = [(-s, -place, p, code) for p, (code, place) in entries.items() if (s := plain_similarity(text, p)) >= threshold]
        if found:
            want[text] = min(found)[3]
    df = spark.createDataFrame([(t,) for t in asked], "said STRING")
    got = lx.match_fuzzy(df, "said", vocab_of(spark, rows), threshold).collect()
    assert {r["a_phrase"]: r["code"] for r in got} == want and len(got) == len(want)


def test_cascade_takes_the_first_step_that_answers(spark):
    rows = [("first aid", "fa", 0), ("sia", "sia", 0), ("conflict management", "cm", 0)]
    asked = spark.createDataFrame([("first aid",), ("my sia badge",), ("conflict managment",), ("first aid",), ("chess",), (None,)], "said STRING")
    got = lx.match_cascade(asked, "said", vocab_of(spark, rows)).collect()
    assert {tuple(r) for r in got} == {("first aid", "fa", "exact"), ("my sia badge", "sia", "contained"), ("conflict managment", "cm", "fuzzy")}
    with pytest.raises(ValueError, match="above 75"):
        lx.match_fuzzy(asked, "said", vocab_of(spark, rows), 70)
