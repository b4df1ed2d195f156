import re

import pytest
from pyspark.sql import functions as F

from pairrank.functions import text as tx
from pairrank.functions import vocab as V
from pairrank.operators import extract as xt


def apply(spark, values, make, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, t {kind}")
    return [r["o"] for r in df.select("i", make(F.col("t")).alias("o")).orderBy("i").collect()]


def match(spark, phrases):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "i INT, t STRING").withColumn("c", tx.canonical_text(F.col("t")))
    return [r["o"] for r in df.select("i", tx.match_cascade(F.col("c"), V.CERTIFICATIONS).alias("o")).orderBy("i").collect()]


def profile(spark, text):
    df = spark.createDataFrame([("c", text)], "id STRING, text STRING")
    return xt.parse_profiles(df, "id").first()


def test_canonical_forms(spark):
    cases = {
        "S.I.A. licensed": "sia licenced",
        "SIA Licence": "sia licence",
        "security license": "security licence",
        "Fire  Marshall": "fire marshal",
        "  CCTV Operation  ": "cctv operation",
        "health & safety": "health safety",
        "": "",
        "   ...   ": "",
        "a.b": "a b",
    }
    assert apply(spark, list(cases), tx.canonical_text) == list(cases.values())


def test_literal_keys_equal_the_column_expression(spark):
    for group in (V.CERTIFICATIONS, V.SHIFTS, V.SITES):
        listed = [p for ps in group.values() for p in ps]
        assert set(apply(spark, listed, tx.canonical_text)) == set(tx.canonical_keys(group))


def test_every_phrase_resolves(spark):
    pairs = [(code, p) for code, ps in V.CERTIFICATIONS.items() for p in ps]
    assert match(spark, [p for _, p in pairs]) == [code for code, _ in pairs]


def test_typos_are_recovered_and_unrelated_text_is_not(spark):
    assert match(spark, ["SIA licance", "frist aid", "CCTV oepration", "conflict managment"]) == [
        "security_licence", "first_aid", "cctv_operation", "conflict_management",
    ]
    assert match(spark, ["forklift licence", "degree in computer science", "customer service award", "", "   "]) == [None] * 5
    assert match(spark, ["valid SIA licence (front line), expires 2027"]) == ["security_licence"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity_equals_brute_force(spark):
    words = ["frist aid", "first aid", "sia licance", "abc", "zzz zz", "health safety", "conflict managment 9"]
    keys = {"first aid": "a", "sia licence": "b", "conflict management": "c", "health safety": "d"}
    df = spark.createDataFrame([(w,) for w in words], "w STRING")
    table = tx._mask_table(keys)
    got = df.select("w", F.transform(table, lambda k: tx.lcs_similarity(tx.char_codes(F.col("w")), k)).alias("s")).collect()
    for row in got:
        for value, key in zip(row["s"], keys, strict=True):
            assert value == pytest.approx(200 * lcs(row["w"], key) / (len(row["w"]) + len(key)))


def test_fuzzy_equals_brute_force_best(spark):
    keys = tx.canonical_keys(V.CERTIFICATIONS)
    words = ["fire warde", "canine handlin", "closed circit television operation", "first aids", "cpr qualifed", "k9 handlng", "job", "x" * 80]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i INT, w STRING")
    got = [r["o"] for r in df.select("i", tx.match_fuzzy(F.col("w"), V.CERTIFICATIONS).alias("o")).orderBy("i").collect()]
    want = []
    for w in words:
        best = max(((200 * lcs(w, k) / (len(w) + len(k)), -i, c) for i, (k, c) in enumerate(keys.items())))
        want.append(best[2] if best[0] >= 88 else None)
    assert got == want


def test_shift_words_respect_boundaries(spark):
    find = lambda c: tx.tag_phrases(tx.canonical_text(c), V.SHIFTS)
    assert apply(spark, ["Available for Saturdays and Sundays.", "Available for day duty, nightshift and weekend cover."], find) == [
        ["weekend"], ["day", "night", "weekend"],
    ]


@pytest.mark.parametrize(
    ("text", "years"),
    [
        ("Guard with 5 years of experience", 5.0),
        ("5+ years of experience", 5.0),
        ("over 12 years in the security industry", 12.0),
        ("3.5 years’ experience in security", 3.5),
        ("five years of experience", 5.0),
        ("no years of experience", 0.0),
        ("2015 years of experience", 15.0),
        ("2018-2024 (6 years)", None),
        ("9 years of experience\nEXPERIENCE\nGuard, 2 years of security experience", 9.0),
        ("nothing here", None),
    ],
)
def test_stated_years(spark, text, years):
    row = profile(spark, text)
    assert row["years_experience"] == years
    assert ("years_experience: not stated" in row["parse_warnings"]) == (years is None)


def test_driving_has_three_outcomes(spark):
    texts = ["No driving licence", "Does not drive", "Driving licence: none", "Full clean driving licence", "Driving licence: full", "Holds a full UK driving licence", "hello"]
    assert apply(spark, texts, xt.driving_flag) == [False, False, False, True, True, True, None]


def test_site_comes_from_the_end_of_the_line(spark):
    row = profile(spark, "EXPERIENCE\nRetail Security Officer, Acme Ltd (2022 - 2024) - stadium")
    assert row["site_experience"] == ["event"]
    assert (row["previous_role_count"], row["months_since_last_role"]) == (1, 24)


@pytest.mark.parametrize(
    ("text", "roles", "months", "warning"),
    [
        ("EMPLOYMENT\nNo previous security roles", 0, None, None),
        ("Just a line", None, None, "employment: no employment section found"),
        ("WORK HISTORY\nsome guard work", None, None, "employment: section present but no dated roles found"),
        ("EXPERIENCE\nA (2019 – 2020) - retail\nB (2021 - Present)", 2, 0, None),
        ("EXPERIENCE\nA (2019 - 2030)", 1, 0, None),
        ("EXPERIENCE\nA (2019 - 2020)\nSKILLS\nx\nEXPERIENCE\nB (2020 - 2021)", 2, 60, None),
    ],
)
def test_employment(spark, text, roles, months, warning):
    row = profile(spark, text)
    assert (row["previous_role_count"], row["months_since_last_role"]) == (roles, months)
    found = [w for w in row["parse_warnings"] if w.startswith("employment")]
    assert found == ([warning] if warning else [])


def test_unknown_bullet_is_reported_with_its_text(spark):
    row = profile(spark, "CERTIFICATES\n- frist aid\n- it's chess\n- SIA badge holder")
    assert row["certifications"] == ["first_aid", "security_licence"]
    assert 'certification: unrecognised entry "it\'s chess"' in row["parse_warnings"]


def test_warning_order(spark):
    row = profile(spark, "- chess club")
    assert [w.split(":")[0] for w in row["parse_warnings"]] == [
        "years_experience", "certification", "employment", "shift_availability", "driving_licence",
    ]


def test_sections_keep_order_and_opening_block(spark):
    df = spark.createDataFrame([("hello\r\nPROFILE\r\n  a\r\n\r\nb\u2028c\nCCTV\nx",)], "t STRING")
    found = df.select(F.inline(tx.sections_of(tx.lines_of(F.col("t"))))).collect()
    assert [(r["heading"], r["lines"]) for r in found] == [("", ["hello"]), ("PROFILE", ["a", "b", "c"]), ("CCTV", ["x"])]


def test_quarantine_counts_code_points(spark):
    df = spark.createDataFrame([("  \n",), ("x" * 20000,), ("é" * 20001,)], "text STRING")
    assert [r["reason"] for r in xt.text_quarantine(df).collect()] == ["empty", None, "too_long"]


def test_long_documents_are_parsed_whole(spark):
    text = "filler words here\n" * 900 + "EXPERIENCE\nA (2019 - 2020) - warehouse\nfive years of experience"
    row = profile(spark, text)
    assert (row["years_experience"], row["site_experience"], row["previous_role_count"]) == (5.0, ["industrial"], 1)


def test_preview(spark):
    texts = ["PROFILE\n\n  First line \nsecond", "x" * 70, "  \n", "SUMMARY"]
    assert apply(spark, texts, xt.text_preview) == ["First line", "x" * 64 + "…", "Empty", "Empty"]


def test_friendly_warning_falls_back_to_the_raw_text(spark):
    got = apply(spark, ["years_experience: not stated", "certification: unrecognised entry 'x'", "other: y"], xt.friendly_warning)
    assert got == ["Did not state years of experience", "An entry in the certifications list was not recognised", "other: y"]


def test_repeated_headings_are_one_section(spark):
    text = "intro\nPROFILE\na\u0001b\u0002c\nWORK HISTORY\nx\ny\nPROFILE\nd"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    rows = df.select("id", tx.sections_of(tx.lines_of(F.col("text"))).alias("s")).collect()
    got = {r["id"]: r["s"] and [(s["heading"], s["lines"]) for s in r["s"]] for r in rows}
    assert got == {1: [("", ["intro"]), ("PROFILE", ["a\u0001b\u0002c", "d"]), ("WORK HISTORY", ["x", "y"])], 2: None, 3: [("", [])]}


def test_profile_of_a_null_text(spark):
    row = xt.parse_profiles(spark.createDataFrame([(1, None)], "id int, text string"), "id").first()
    assert row["certifications"] == row["shift_availability"] == row["site_experience"] == []
    assert "employment: no employment section found" in row["parse_warnings"]


def test_the_parser_runs_once_where_warnings_are_counted(spark):
    docs = spark.createDataFrame([(1, "PROFILE\n3 years of experience"), (2, None), (3, "AVAILABILITY\nweekends")], "id INT, text STRING")
    counts = xt.warning_counts(xt.parse_profiles(docs, "id"))
    assert {r["field"]: r["n"] for r in counts.collect()} == {"years_experience": 2, "employment": 3, "shift_availability": 2, "driving_licence": 3}
    assert counts._jdf.queryExecution().optimizedPlan().toString().count(V.PERIOD) == 1
    none = spark.createDataFrame([([],), (None,), (["a: b"],)], "parse_warnings ARRAY<STRING>")
    assert [tuple(r) for r in xt.warning_counts(none).collect()] == [("a", 1)]


ODD_TEXTS = [
    "", "x", "EXPERIENCE", "EXPERIENCE\n\n  \t\nA (2001 - 2003) - stadium\r\n- SIA badge \u2003\n-\n- \u00a0 frist aid",
    "a\u2028EXPERIENCE\u0085one (1999 – present) – shop \x1c\x1f two\nSKILLS\nthree\x0bEMPLOYMENT\ffour) - x) - y\nEXPERIENCE\nfive (\n2001 - 2002)",
    "EMPLOYMENT\nb\nEXPERIENCE\na) -\nEMPLOYMENT\nno previous\nsecurity roles\n• C.C.T.V. operator\n*\u2028* x",
    "EXPERIENCE\nEXPERIENCE\n \u3000EXPERIENCE \nlast  line\t\n", "WORK HISTORY &\nx\nWORK HISTORY\ny\n" + "z (2001 - 2002)\n" * 5000,
]


def test_bodies_give_what_lines_give(spark):
    """Patterns over the whole text find what functions over the array of its lines find."""
    headings = ["EXPERIENCE", "WORK HISTORY", "EMPLOYMENT", "", "Not one"]
    texts = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id INT, raw STRING").select("id", tx.strip(F.col("raw")).alias("text"))
    rows = texts.select("text", tx.lines_of(F.col("text")).alias("lines"), tx.body_of(F.col("text")).alias("body"))
    for wanted in (headings, headings[:3], headings[3:]):
        work = xt.experience_lines(tx.sections_of(F.col("lines")), wanted)
        told = rows.select(
            "lines", "body", tx.bullets_of(F.col("lines")).alias("bullets"), tx.bullets_in(F.col("body")).alias("bullets_in"), work.alias("work"),
            xt.experience_text(F.col("text"), tx.section_blocks(F.col("body"), wanted), wanted).alias("work_text"),
        )
        each = lambda pattern, group: F.flatten(F.transform("work", lambda line: F.regexp_extract_all(line, F.lit(pattern), F.lit(group))))
        told = told.select(
            "*", each(V.PERIOD, 2).alias("ends"), xt.periods_of(F.col("work_text")).alias("periods"),
            each(V.SITE_TAIL, 1).alias("tails"), xt.site_fragments(F.col("work_text")).alias("fragments"),
            F.exists("work", lambda line: line.rlike(V.NO_ROLES)).alias("none"), F.col("work_text").rlike(tx.by_line(V.NO_ROLES)).alias("none_in"),
        )
        for r in told.collect():
            assert r["body"] == "".join("\n" + line for line in r["lines"])
            assert r["bullets_in"] == r["bullets"]
            assert r["work_text"] == "".join("\n" + line for line in r["work"])
            assert (r["periods"], r["fragments"], r["none_in"]) == (r["ends"], "\n".join(r["tails"]), r["none"])


def test_phrase_tree_prefers_the_longer(spark):
    vocabulary = {"a": ["aid", "aid at work", "aid (x)"], "b": ["ai", "c.p", "c.p. certified", "é"]}
    texts = ["aid at work aid at ai", "aid (x) aids c.p. certifiedx c.p", "xaid é aid_ _ai ai-c.p. certified", ""]
    plain = "|".join(re.escape(p) for p in sorted((p for ps in vocabulary.values() for p in ps), key=lambda p: -len(p)))
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", tx.entity_spans(F.col("t"), vocabulary).alias("s"))
    for r in rows.collect():
        assert r["s"] == list(dict.fromkeys(re.findall(rf"(?<!\w)(?:{plain})(?!\w)", r["t"])))


def test_tasks_of_the_parser_do_not_grow(spark, monkeypatch, tmp_path):
    """More orders make more tasks of the same length, where the number of cores was the limit before."""
    from pairrank import session
    from pairrank.plans import entities

    spark.range(4000).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "1000.0 * id AS o_totalprice", "DATE'1995-01-01' AS o_orderdate",
        "'1-URGENT' AS o_orderpriority", "'F' AS o_orderstatus",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(7).selectExpr(
        "id AS c_custkey", "CAST(id AS INT) AS c_nationkey", "100.0 * id AS c_acctbal", "'BUILDING' AS c_mktsegment"
    ).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(session, "ROWS_A_TASK", 50)
    docs = entities.rendered(spark, str(tmp_path))
    sizes = docs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in sizes) == 4000
    assert max(r["count"] for r in sizes) <= 100
