import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairrank.functions.text import strip
from pairrank.operators import features as ft
from pairrank.operators import guards as gd
from pairrank.operators import intake as it
from pairrank.operators import monitor as mo
from pairrank.operators import ranking as rk
from pairrank.operators import shortlist as sl


def blocked(spark, names):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, n STRING")
    return [r["b"] for r in df.select("i", gd.blocked(F.col("n")).alias("b")).orderBy("i").collect()]


def test_protected_names_and_disguises(spark):
    bad = [*gd.BLOCKED_NAMES, "candidate_gender_encoded", "age_bucket", "is-race-known", " Postcode_area ", "SEX", "user_name"]
    good = ["average_score", "trace_id", "exp_gap", "site_type_match", "package", "imagery", "phones"]
    assert blocked(spark, bad) == [True] * len(bad)
    assert blocked(spark, good) == [False] * len(good)
    for name in bad:
        with pytest.raises(ValueError):
            gd.assert_clean([name])
    gd.assert_clean(good)


def test_nested_names_are_seen(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("gender")).alias("person"), F.array(F.struct(F.lit(1).alias("dob"))).alias("items"))
    with pytest.raises(ValueError, match="items.dob.*person.gender"):
        gd.assert_clean(df)


def test_schema_guard(spark):
    expected = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([("x", 1)], "b STRING, a INT")
    assert gd.schema_guard(df, expected).columns == ["a", "b"]
    with pytest.raises(ValueError, match="unknown=\\['c'\\]"):
        gd.schema_guard(df.withColumn("c", F.lit(1)), expected)
    with pytest.raises(ValueError, match="retyped=\\['a'\\]"):
        gd.schema_guard(df.withColumn("a", F.lit("1")), expected)


def test_redaction_is_recursive_and_case_blind(spark):
    row = spark.range(1).select(
        F.lit("x").alias("EMAIL"),
        F.struct(F.lit("n").alias("Name"), F.lit(3).alias("rank"), F.array(F.struct(F.lit("t").alias("cv_text"), F.lit(1).alias("n"))).alias("docs")).alias("body"),
        F.array(F.lit("plain")).alias("tags"),
    )
    got = gd.redact(row).first().asDict(recursive=True)
    assert got == {"EMAIL": gd.REDACTED, "body": {"Name": gd.REDACTED, "rank": 3, "docs": [{"cv_text": gd.REDACTED, "n": 1}]}, "tags": ["plain"]}


def test_redaction_in_maps_and_nested_lists(spark):
    row = spark.range(1).select(
        F.create_map(F.lit("Email"), F.lit("a@b.c"), F.lit("team"), F.lit("t")).alias("contact"),
        F.create_map(F.lit("age"), F.lit(41), F.lit("n"), F.lit(2)).alias("numbers"),
        F.array(F.array(F.struct(F.lit("x").alias("DOB"), F.lit(1).alias("n")))).alias("grid"),
        F.create_map(F.lit("k"), F.array(F.struct(F.lit("x").alias("phone")))).alias("deep"),
        F.lit(None).cast("map<string,struct<name:string>>").alias("nothing"),
    )
    got = gd.redact(row, [*gd.SENSITIVE_KEYS, "K2"]).first().asDict(recursive=True)
    assert got == {
        "contact": {"Email": gd.REDACTED, "team": "t"}, "numbers": {"age": None, "n": 2}, "grid": [[{"DOB": gd.REDACTED, "n": 1}]],
        "deep": {"k": [{"phone": gd.REDACTED}]}, "nothing": None,
    }
    assert "grid.DOB" in gd.field_paths(row.schema) and "deep.phone" in gd.field_paths(row.schema)
    with pytest.raises(ValueError, match="deep.phone"):
        gd.assert_clean(row.select("deep"))


def test_redaction_of_json_text(spark):
    cases = {
        '{"k":1,"n":2,"person":{"email":"a@b.c"}}': '{"k":1,"n":2,"person":{"email":"[redacted]"}}',
        '[{"NAME": {"first": "x"}}, [{"age": 3}], 1.5, "é"]': '[{"NAME":"[redacted]"},[{"age":"[redacted]"}],1.5,"é"]',
        '{"name": "x"': None, "": None, "{}": "{}", '{"n": NaN, "name": "x"}': None,
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "j string")
    got = df.select("j", gd.redact_json(F.col("j")).alias("clean")).collect()
    assert {r["j"]: r["clean"] for r in got} == {**cases, None: None}


def test_draft_issues_in_order(spark):
    rows = [(0, " a ", "x"), (1, "a", " "), (2, "", "x" * 20001), (3, "  ", "y"), (4, "b", "z"), (5, "a", "z")]
    df = spark.createDataFrame(rows, "i INT, ref STRING, text STRING")
    got = [(r["i"], r["message"]) for r in it.draft_issues(df, "i", "ref", "text").orderBy("i", "issue_no").collect()]
    assert got == [
        (1, 'Reference "a" is already used above.'),
        (1, "Paste the application text, or drop a file."),
        (2, "Needs a reference."),
        (2, "1 characters over the 20,000 limit."),
        (3, "Needs a reference."),
        (5, 'Reference "a" is already used above.'),
    ]


def slugs(spark, names, **options):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, f STRING")
    return [r["reference"] for r in it.reference_slug(df, "i", "f", **options).orderBy("i").collect()]


def test_slugs(spark):
    names = ["Jane Doe (CV).PDF", "jane-doe cv.txt", "***.txt", "a.b.docx", "x" * 60 + ".txt", "Jane_Doe_CV.md"]
    assert slugs(spark, names) == ["jane_doe_cv", "jane_doe_cv_2", "cv", "a_b", "x" * 40, "jane_doe_cv_3"]


def test_slug_clashes_stay_unique(spark):
    names = ["cv.txt", "cv.txt", "cv_2.txt", "cv.txt", "cv_2.txt", "cv_9.txt"]
    for options in ({}, {"max_group_rows": 2}):
        got = slugs(spark, names, **options)
        assert len(set(got)) == len(got)
        assert (got[0], got[2], got[5]) == ("cv", "cv_2", "cv_9")


def test_batch_limits(spark):
    rows = [("a", 1), ("a", 1), ("b", 1)]
    got = {r["j"]: r for r in gd.batch_constraints(spark.createDataFrame(rows, "j STRING, c INT"), "j", "c", limit=1).collect()}
    assert got["a"]["over_limit"] and got["a"]["has_duplicates"]
    assert not got["b"]["over_limit"] and not got["b"]["has_duplicates"]
    assert got["b"]["remaining_capacity"] == 0


SHORTLIST = [("j", 1, "c1", 2.0, 0, "ann.pdf"), ("j", 2, "c2", 1.5, 2, None), ("j", 3, "c3", 1.0, 1, 'B, "x".txt'), ("j", 4, "c4", 0.5, 0, None)]


def shortlist(spark):
    df = spark.createDataFrame(SHORTLIST, "job_id STRING, rank INT, candidate_id STRING, score DOUBLE, n_gaps INT, display_name STRING")
    return df.withColumn("reasons", F.lit("one | two"))


def test_filters_never_renumber(spark):
    ranks = lambda **f: [r["rank"] for r in sl.filter_view(shortlist(spark), **f).orderBy("rank").collect()]
    assert ranks(only_with_gaps=True) == [2, 3]
    assert ranks(only_clean=True) == [1, 4]
    assert ranks(query=" ANN ") == [1]
    assert ranks(query="c") == [1, 2, 3, 4]


def test_four_orders(spark):
    order = lambda k: [r["candidate_id"] for r in shortlist(spark).orderBy(*sl.sort_order(k)).collect()]
    assert order("rank") == order("score-desc") == ["c1", "c2", "c3", "c4"]
    assert order("score-asc") == ["c4", "c3", "c2", "c1"]
    assert order("gaps") == ["c2", "c3", "c1", "c4"]


def test_csv_export(spark, tmp_path):
    lines = sl.shortlist_csv(shortlist(spark), "job_id", "v1", "r7")
    text = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert text[0].startswith("DISCLAIMER: ")
    assert "model v1 · request r7. " in text[1]
    assert text[2:5] == ["", sl.CSV_HEADER, "1,c1,ann.pdf,2.0000,relative_ranking_score,0,one | two"]
    assert text[6] == '3,c3,"B, ""x"".txt",1.0000,relative_ranking_score,1,one | two'
    sl.write_csv_lines(lines, "job_id", str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "posting=pj" / "first_line=1").glob("part-*"))
    written = b"".join(p.read_bytes() for p in parts)
    assert written.decode() == "".join(line + "\r\n" for line in text)


def test_lists_are_worked_out_once(spark, tmp_path):
    spark.range(0, 90).select(
        (F.col("id") % 3).alias("job_id"), F.col("id").alias("candidate_id"), (F.col("id") * 0.5).alias("score"),
        F.lit(0).alias("n_gaps"), F.lit("n").alias("display_name"), F.lit("why").alias("reasons"),
    ).write.parquet(str(tmp_path / "rows"))
    ranked = rk.rank_within(spark.read.parquet(str(tmp_path / "rows")), ["job_id"], "score", ["candidate_id"], crowded=False)
    lines = sl.shortlist_csv(ranked, "job_id", "v1", "r7")
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and plan.count("Relation ") == 1
    numbers = [(r["job_id"], r["line_no"]) for r in lines.orderBy("job_id", "line_no").collect()]
    assert numbers == [(j, n) for j in range(3) for n in range(1, 35)]


def test_explanations_are_made_after_the_exchange(spark, tmp_path, monkeypatch):
    """What is ranked and named are numbers: no sentence or list of contributions travels."""
    from pairrank.plans import q_explain

    rows = [(1, c, 2, *[float(c % 4)] * 12) for c in range(8)]
    names = ", ".join(f"{n} DOUBLE" for n in ft.FEATURE_NAMES)
    made = spark.createDataFrame(rows, f"job_id BIGINT, candidate_id BIGINT, grade INT, {names}").withColumn("score", ft.baseline_score())
    spark.createDataFrame([(c, f"c{c}", 1.0) for c in range(8)], "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(q_explain, "scored", lambda *_: made.drop("grade"))
    seen = []
    ranking = rk.rank_within
    monkeypatch.setattr(q_explain.rk, "rank_within", lambda df, *a, **k: seen.append(set(df.columns)) or ranking(df, *a, **k))
    told = q_explain._full_shortlist(spark, str(tmp_path)).orderBy("rank").collect()
    assert not {"contributions", "reasons"} & seen[0]
    assert [r["rank"] for r in told] == list(range(1, 9)) and all(len(r["contributions"]) == 12 for r in told)


def test_long_lists_are_split_into_numbered_files(spark, tmp_path):
    rows = [(j, n, f"{j} é {n}" if n % 7 else "") for j in ("a", "b/c=d", "", None) for n in range(1, 48)]
    rows[4] = ("a", 5, "one\r\ntwo")
    lines = spark.createDataFrame(rows, "job_id STRING, line_no INT, line STRING").repartition(5)
    path = str(tmp_path / "lists")
    sl.write_csv_lines(lines, "job_id", path, lines_per_file=10)
    assert sorted(p.name for p in (tmp_path / "lists" / "posting=pa").iterdir()) == [f"first_line={n}" for n in (1, 11, 21, 31, 41)]
    assert all(len(list(p.glob("part-*"))) == 1 for p in (tmp_path / "lists" / "posting=pa").iterdir())
    rows[4] = ("a", 5, "one\ntwo")
    back = sl.read_csv_lines(spark, path, "job_id")
    assert {tuple(r) for r in back.collect()} == set(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:  # files read in many small splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert {tuple(r) for r in sl.read_csv_lines(spark, path, "job_id").collect()} == set(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    nothing = str(tmp_path / "none")
    sl.write_csv_lines(lines.limit(0), "job_id", nothing)
    assert sl.read_csv_lines(spark, nothing, "job_id").count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_lines_of_lists_are_numbered_where_they_are_read(spark, tmp_path, compression):
    rows = [("a", n, "" if n in (1, 25) else f"\r{n}\n") for n in range(1, 26)]
    path = str(tmp_path / "lists")
    sl.write_csv_lines(spark.createDataFrame(rows, "job_id STRING, line_no INT, line STRING").repartition(3), "job_id", path, 10, compression)
    back = sl.read_csv_lines(spark, path, "job_id")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert sorted(map(tuple, back.collect())) == rows


def test_drift_skips_nulls_and_single_values(spark):
    df = spark.createDataFrame([(1.0, None, None), (3.0, 5.0, None)], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = {r["feature"]: (r["n"], r["mean"], r["stdev"]) for r in mo.feature_drift_snapshot(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 2.0, pytest.approx(2**0.5)), "b": (1, 5.0, 0.0)}


def test_strip_covers_all_white_space(spark):
    texts = [" \u2003\tx y\u00a0\n", "\x1c\x85é ü\u3000", "\u2028\u2029", "plain", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r["s"] for r in df.select("i", strip(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [t.strip() for t in texts]
