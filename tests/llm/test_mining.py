"""Conversation repair, collocations and language identification against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairrank.llm import collocations, conversations, langid
from pairrank.llm.common import load, prepare
from pairrank.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
KINDS = st.lists(st.tuples(st.sampled_from("-bdt"), st.sampled_from("suax")).map("".join), max_size=9)


def cheapest(kinds):
    """(cost, audit) by carrying the whole audit of every state forward."""
    after = lambda q: "a" if q == "u" else "u"
    follows = {"0s": "s", "0u": "u", "su": "u", "au": "u", "ua": "a"}
    best = {"0": (0, "")}

    def padded(found):
        out = dict(found)
        for _ in range(4):
            for q, (cost, audit) in list(out.items()):
                offer = (cost + 5, audit + "I")
                out[after(q)] = min(out.get(after(q), (10**9, "")), offer)
        return out

    for fault, initial in kinds:
        reached = {}
        for q, (cost, audit) in padded(best).items():
            ways = [(q, cost + 2, "D")]
            if fault in "-t":
                extra = 5 if fault == "t" else 0
                ways.append((after(q), cost + 1 + extra, "R"))
                if q + initial in follows:
                    ways.append((follows[q + initial], cost + extra, "K"))
            for z, c, letter in ways:
                reached[z] = min(reached.get(z, (10**9, "")), (c, audit + letter))
        best = reached
    return min(way for q, way in padded(best).items() if q in "0a")


def solved(kinds):
    rows = [conversations.row_summary(k) for k in kinds]
    end, tail = conversations.last_state(rows)
    return "".join(conversations.script(kinds, conversations.NOTHING, end)) + "I" * tail


@settings(max_examples=400, deadline=None)
@given(KINDS)
def test_script_is_the_least_of_the_cheapest(kinds):
    cost, audit = cheapest(kinds)
    assert solved(kinds) == audit
    rows = [conversations.row_summary(k) for k in kinds]
    end, tail = conversations.last_state(rows)
    assert conversations.forward(conversations.NOTHING, rows)[end][0] + 5 * tail == cost


@settings(max_examples=200, deadline=None)
@given(KINDS, st.integers(1, 4))
def test_summaries_of_blocks_join(kinds, size):
    blocks = [kinds[at : at + size] for at in range(0, len(kinds), size)]
    made = [
        {"block": k, "summary": conversations._coded(conversations.summarise([conversations.row_summary(x) for x in b]))}
        for k, b in enumerate(blocks)
    ]
    if made:
        ends = conversations._block_ends(made[::-1])
        got = "".join("".join(conversations.script(b, e["start"], e["end"])) + "I" * e["tail"] for b, e in zip(blocks, ends))
        assert got == cheapest(kinds)[1]


def test_a_long_stretch_is_solved_in_linear_space():
    rng = random.Random(3)
    kinds = [rng.choice("---bdt") + rng.choice("suuaax") for _ in range(5_000)]
    assert solved(kinds) == cheapest(kinds)[1]


def plain_report(rows):
    """The contract, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        now = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fate = zlib.crc32(key.encode()) % 20
            if fate:
                text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
                now += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        now.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, kinds = set(), []
        for _, role, text in now:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t"
            seen.add((role, text))
            kinds.append(fault + (role[:1] if role[:1] in tuple("sua") else "x"))
        cost, audit = cheapest(kinds)
        lines, state, left = [], "0", list(now)
        for letter in audit:
            row = left.pop(0) if letter != "I" else None
            if letter != "D":
                state = row[1][:1] if letter == "K" else "a" if state == "u" else "u"
                name = row[1] if letter == "K" else {"u": "user", "a": "assistant"}[state]
                lines.append(f"{name}:{row[2] if row else ''}")
        turns = [r[0] for r in now if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(now, now[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(k[0] == f for k in kinds) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


SCHEMA = "conv_id long, turn long, role string, text string, Audit int, block string"


@pytest.mark.parametrize("bits", [1, 12])
def test_repair_of_rows(spark, monkeypatch, bits):
    prepare(spark)
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rng = random.Random(11)
    texts = ["Yes.", "No", "", " \n", None, "What? ", "é!", "Yes.", "a.b"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(9), 2**40]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    rows += [(conv, turn, "user", "Hi.") for conv in range(10, 60) for turn in range(3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = conversations.repair(df, "conv_id", "turn", "role", "text").collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain_report(rows)
    assert len(got) == len({r[0] for r in rows})


def test_repair_of_nothing(spark):
    prepare(spark)
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(empty, "conv_id", "turn", "role", "text").collect() == []
    # Conversation 0, turn 17 is dropped by its checksum: nothing is left of it.
    gone = next(t for t in range(100) if zlib.crc32(f"0:{t}".encode()) % 20 == 0)
    row = conversations.repair(spark.createDataFrame([(0, gone, "user", "x", 1, "")], SCHEMA), "conv_id", "turn", "role", "text").first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def plain_collocations(rows, least, top=2_000, max_words=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    frequent = {k: a for k, a in f.items() if a >= least and len(k) > 2}
    found = []
    for (lang, *w), a in frequent.items():
        cuts = [(2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        around = [
            b for (other, *x), b in frequent.items()
            if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))
        ]
        if not any(100 * b >= 80 * a for b in around):
            found.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"cc", "é".encode()]), min_size=1, max_size=60), st.integers(1, 3), st.integers(1, 6))
def test_chunks_count_every_place_once(words, overlap, period):
    parts = [(chunk.split(b" "), core) for chunk, core in collocations.chunks(words, overlap, period)]
    assert sum(core for _, core in parts) == len(words)
    at, counted = 0, Counter()
    for part, core in parts:
        assert words[at : at + len(part)] == part
        at += core
        counted.update(tuple(part[i : i + k]) for k in range(1, overlap + 2) for i in range(core) if i + k <= len(part))
    assert counted == Counter(tuple(words[i : i + k]) for k in range(1, overlap + 2) for i in range(len(words) - k + 1))


@pytest.mark.parametrize("bits", [6, 26])
def test_collocations_of_rows(spark, monkeypatch, bits):
    # A bitmap of 64 bits lets nearly everything pass: the counts stay exact.
    prepare(spark)
    rng = random.Random(7)
    words = ["the", "of", "New", "york", "Été", "x\tY", "a b", "x|y", "$1"] + [f"w{k}" for k in range(12)]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice([".", "", "!\n"])) for _ in range(200)]
    rows += [("en", "in the city of new york, in the city of new york")] * 9 + [("en", None), (None, ""), ("fr", "a " * 3_000)]
    df = spark.createDataFrame([(1, *r, 0) for r in rows], "N int, lang string, text string, phrase int").repartition(4)
    if bits == 6:
        monkeypatch.setattr(collocations, "_marked", lambda marks, hashes: hashes >= -(2**63))
    got = [tuple(r) for r in collocations.collocations(df, "text", "lang", least=5).orderBy("lang", "rank").collect()]
    assert got == plain_collocations(rows, 5) and {r[0] for r in got} == {"en", "de", "und", "fr"}
    assert collocations.collocations(df.limit(0), "text", "lang").collect() == []
    first = collocations.collocations(df, "text", "lang", least=5, top=2).collect()
    assert sorted(tuple(r) for r in first) == sorted(r for r in plain_collocations(rows, 5) if r[1] <= 2)


def test_language_of_held_out_documents(spark):
    found = QUERIES["op13_langid"](spark, SF).join(load(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_is_learned_from_text_alone(spark):
    prepare(spark)
    en, de = "the thing that was here and there ", "ich habe nicht gewusst dass das so ist "
    docs = spark.createDataFrame(
        [(1, en * 30, "en", 0.0), (2, de * 30, "de", 0.0), (2, de * 30, "de", 0.0), (3, de, None, 0.0), (4, None, "en", 0.0), (5, "42 !? 7", "de", 0.0),
         (6, en.upper() * 4_000, "de", 0.0), (7, "", None, 0.0)],
        "doc_id int, text string, lang string, Score double",
    )
    model = langid.fit(docs.where("doc_id < 6"), "text", "lang", F.lit(True))
    assert set(model.dictionaries) == {"en", "de"}
    rows = {r["doc_id"]: r for r in langid.classify(docs, "text", model).collect()}
    assert [rows[k]["lang_pred"] for k in range(1, 8)] == ["en", "de", "de", "und", "und", "en", "und"]
    assert rows[4]["score"] == 0 and rows[6]["score"] > 0.99 and not rows[6]["narrow"]
    again = langid.fit(docs.where("doc_id < 6").repartition(7), "text", "lang", F.lit(True))
    assert again == model
    # Nothing in common with either language: the margin is narrow.
    odd = spark.createDataFrame([("ψωφ",)], "text string")
    assert langid.classify(odd, "text", model, reject=True).first()["lang_pred"] == "und"
    nothing = langid.fit(docs.limit(0), "text", "lang", F.lit(True))
    assert {r["lang_pred"] for r in langid.classify(docs, "text", nothing).collect()} == {"und"}
    assert langid.classify(docs.limit(0), "text", model).collect() == []
