import datetime as dt
import hashlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pairrank.sources import files as fl
from pairrank.sources import tables as tb
from pairrank.sources import versions as vs
from pairrank.streaming import monitor as sm

DOCS = {
    "a.txt": b"hello",
    "bom.txt": b"\xef\xbb\xbfPROFILE\nx",
    "cp.txt": b"caf\xe9 \x93ok\x94 \x80",
    "blank.md": b" \n ",
    "empty.txt": b"",
    "old.doc": b"x",
    "sheet.xlsx": b"PK\x03\x04",
    ".txt": b"x",
    "real.pdf": b"%PDF-1.7 ...",
    "fake.pdf": b"hello",
    "real.docx": b"PK\x03\x04zip",
    "fake.docx": b"%PDF-",
    "big.txt": b"x" * (5 * 1024 * 1024 + 1),
}


def files(spark):
    rows = [(name, len(content), bytearray(content)) for name, content in DOCS.items()]
    return spark.createDataFrame(rows, fl.FILE_SCHEMA)


def test_triage_first_failing_rule_wins(spark):
    got = {r["filename"]: (r["kind"], r["reason"]) for r in fl.intake_triage(files(spark)).collect()}
    assert got["a.txt"] == ("text", None)
    assert got["real.pdf"] == ("pdf", None)
    assert got["real.docx"] == ("docx", None)
    assert got["old.doc"][1].startswith(".doc is an older format")
    assert got["sheet.xlsx"][1] == ".xlsx is not supported. Accepted: .docx, .md, .pdf, .text, .txt."
    assert got[".txt"][1].startswith("this file is not supported")
    assert got["empty.txt"][1] == "this file is empty"
    assert got["big.txt"][1] == "5.0 MB is too large for a CV — the limit is 5 MB."
    assert "not a PDF" in got["fake.pdf"][1]
    assert "not a Word document" in got["fake.docx"][1]


def test_decoding(spark):
    got = {r["filename"]: (r["text"], r["reason"]) for r in fl.decode_files(files(spark)).collect()}
    assert got["a.txt"] == ("hello", None)
    assert got["bom.txt"] == ("PROFILE\nx", None)
    assert got["cp.txt"] == ("café “ok” €", None)
    assert got["blank.md"][1] == "this file is empty"


def test_integrity_statuses(spark, tmp_path):
    for name in ("same", "changed", "unlisted", "hashless"):
        (tmp_path / name).write_bytes(name.encode())
    hashes = fl.file_hashes(fl.read_files(spark, str(tmp_path)))
    known = {r["filename"]: r["sha256"] for r in hashes.collect()}
    manifest = spark.createDataFrame(
        [("same", known["same"]), ("changed", "0"), ("hashless", None), ("gone", "1")], "filename STRING, sha256 STRING"
    )
    got = {r["filename"]: r["status"] for r in fl.integrity_check(hashes, manifest).collect()}
    assert got == {"same": "ok", "changed": "mismatch", "unlisted": "record missing", "hashless": "not recorded", "gone": "file missing"}


def test_round_trip_and_no_overwrite(spark, tmp_path):
    root = str(tmp_path / "data")
    tables = {
        "candidates": spark.createDataFrame([("c", "t")], tb.CANDIDATE),
        "jobs": spark.createDataFrame([("j", ["a"], 1.0, "day", "retail", False, "")], tb.POSTING),
        "labels": spark.createDataFrame([("j", "c", 3)], tb.PAIR),
    }
    for fmt in ("parquet", "json"):
        tb.write_dataset(tables, f"{root}-{fmt}", fmt)
        back = tb.load_tables(spark, f"{root}-{fmt}", fmt)
        assert set(back) == {"candidates", "jobs", "labels"}
        for name, df in tables.items():
            assert back[name].select(df.columns).collect() == df.collect()
        with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
            tb.write_dataset(tables, f"{root}-{fmt}", fmt)


def test_versions_are_immutable(spark, tmp_path):
    path = str(tmp_path / "runs")
    run = spark.createDataFrame([("v2", 1)], "version STRING, n INT")
    tb.append_version(run, path, "v2")
    tb.append_version(run, path, "v1")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        tb.append_version(run, path, "v2")
    assert [r["version"] for r in tb.list_versions(spark, path).collect()] == ["v1", "v2"]


def test_manifest_and_zero_filled_grades(spark):
    pairs = spark.createDataFrame([("j", "c", 3), ("j", "d", 0)], tb.PAIR)
    grades = tb.grade_distribution(pairs)
    assert [tuple(r) for r in grades.orderBy("grade").collect()] == [(0, 1, 0.5), (1, 0, 0.0), (2, 0, 0.0), (3, 1, 0.5)]
    row = tb.dataset_manifest({"labels": pairs}, grades, "v1", 7).first()
    assert row["table_counts"] == {"labels": 2}
    assert row["grade_counts"] == {"0": 1, "1": 0, "2": 0, "3": 1}


def test_run_log_keeps_numbers_only(spark):
    row = tb.run_log(spark, {"version": "v1", "metrics": {"a": 1, "b": 0.5, "c": True, "d": "x"}}).first()
    assert row["metrics"] == {"a": 1.0, "b": 0.5}


def events(spark, path, batches=3):
    start = dt.datetime(2024, 1, 1)
    for b in range(batches):
        rows = [(start + dt.timedelta(minutes=b * 20 + i), "click" if i % 3 else "view", float(b * 10 + i)) for i in range(10)]
        spark.createDataFrame(rows, "ts TIMESTAMP, kind STRING, value DOUBLE").coalesce(1).write.mode("append").parquet(path)


def test_streams_equal_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, path)
    batch = spark.read.parquet(path)
    stream = lambda: sm.read_stream(spark, path, "*.parquet", batch.schema, files_per_batch=1)
    counts = {r["kind"]: r["n"] for r in sm.stream_counters(stream(), ["kind"], str(tmp_path / "c")).collect()}
    assert counts == {r["kind"]: r["count"] for r in batch.groupBy("kind").count().collect()}
    got = sm.stream_feature_moments(stream(), ["value"], str(tmp_path / "m")).first()
    want = batch.agg(F.count("value"), F.avg("value"), F.stddev_samp("value")).first()
    assert (got["n"], got["mean"], got["stdev"]) == (want[0], pytest.approx(want[1]), pytest.approx(want[2]))


def test_windowed_counts_close_with_the_watermark(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, path)
    schema = spark.read.parquet(path).schema
    counted = sm.windowed_counters(sm.read_stream(spark, path, "*.parquet", schema), "ts", ["kind"], "10 minutes", "1 minute")
    query = (
        counted.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out"))
    assert closed.agg(F.sum("n")).first()[0] == 20  # the newest window stays open


def test_triage_of_a_folder_opens_only_what_it_must(spark, tmp_path):
    for name, content in {**DOCS, "LOUD.PDF": b"%PDF-1", "sham.Docx": b"no", "huge.pdf": b"%PDF-" + b"x" * (5 * 1024 * 1024)}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["filename"]: r for r in fl.triage_folder(spark, str(tmp_path)).collect()}
    want = {r["filename"]: (r["kind"], r["reason"]) for r in fl.intake_triage(files(spark)).collect()}
    assert {want.pop(n)[1] is not None for n in ("empty.txt", ".txt")} == {True}  # Spark lists neither
    assert {n: (got[n]["kind"], got[n]["reason"]) for n in want} == want
    assert got["LOUD.PDF"]["kind"] == "pdf"
    assert "not a Word document" in got["sham.Docx"]["reason"]
    assert "too large" in got["huge.pdf"]["reason"]
    assert got["big.txt"]["length"] == len(DOCS["big.txt"])
    plan = fl.triage_folder(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "length,5242880" in plan.replace(" ", "")  # the limit is part of the scan


def test_long_files_are_reported_not_read(spark, tmp_path):
    for name in ("small", "long", "unlisted"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    hashes = fl.hash_folder(spark, str(tmp_path), limit=24)
    assert {r["filename"]: (r["length"], r["sha256"] is None) for r in hashes.collect()} == {
        "small": (15, False), "long": (12, False), "unlisted": (24, False)}
    hashes = fl.hash_folder(spark, str(tmp_path), limit=14)
    manifest = spark.createDataFrame([("small", "0"), ("long", "1"), ("gone", "2")], "filename STRING, sha256 STRING")
    got = {r["filename"]: r["status"] for r in fl.integrity_check(hashes, manifest).collect()}
    assert got == {"small": "not hashed", "long": "mismatch", "unlisted": "record missing", "gone": "file missing"}


def test_files_of_any_length_are_hashed(spark, tmp_path):
    with open(tmp_path / "long 100%25 #1", "wb") as out:
        out.truncate((1 << 30) + 1)
    (tmp_path / "short").write_bytes(b"x")
    got = {r["filename"]: (r["length"], r["sha256"]) for r in fl.hash_folder(spark, str(tmp_path)).collect()}
    with open(tmp_path / "long 100%25 #1", "rb") as source:
        long = hashlib.file_digest(source, "sha256").hexdigest()
    assert got == {"long 100%25 #1": ((1 << 30) + 1, long), "short": (1, hashlib.sha256(b"x").hexdigest())}


def test_long_files_of_another_store_are_hashed(spark, tmp_path, monkeypatch):
    """A mount table stands for a store whose paths are no files to Python; short and long files side by side."""
    monkeypatch.setattr(fl, "WHOLE_BYTES", 64)
    want = {f"f{n}": bytes([n % 251]) * n for n in (1, 63, 64, 65, 5_000)}
    for name, content in want.items():
        (tmp_path / name).write_bytes(content)
    spark.conf.set("fs.viewfs.mounttable.hashed.link./in", f"file://{tmp_path}")
    try:
        found = {f: {r["filename"]: r["sha256"] for r in fl.hash_folder(spark, f, glob="f*").collect()} for f in ("viewfs://hashed/in", str(tmp_path))}
    finally:
        spark.conf.unset("fs.viewfs.mounttable.hashed.link./in")
    digests = {name: hashlib.sha256(content).hexdigest() for name, content in want.items()}
    assert found == {"viewfs://hashed/in": digests, str(tmp_path): digests}


def test_commits_are_whole_and_final(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, 2.0), (2, None)], "id INT, x DOUBLE")
    assert vs.read_runs(spark, root).count() == 0
    won = vs.commit_version(rows, root, "v1", 7, {"rate": 0.05}, {"mean": F.avg("x"), "none": F.max(F.lit(None).cast("double"))})
    assert won.published
    lost = vs.commit_version(rows.limit(0), root, "v1")
    assert (lost.published, lost.folder) == (False, won.folder)
    assert vs.commit_version(rows.limit(0), root, "v2.0", metrics={"mean": F.avg("x")}).published
    runs = {r["version"]: r for r in vs.read_runs(spark, root).collect()}
    assert (runs["v1"]["n_rows"], runs["v1"]["seed"], runs["v1"]["params"], runs["v1"]["metrics"]) == (2, 7, {"rate": "0.05"}, {"mean": 2.0})
    assert (runs["v2.0"]["n_rows"], runs["v2.0"]["metrics"]) == (0, {})
    assert sorted(map(tuple, vs.read_version(spark, root, "v1").collect())) == [(1, 2.0), (2, None)]
    assert vs.read_version(spark, root, "v2.0").count() == 0
    with pytest.raises(ValueError, match="not published"):
        vs.read_version(spark, root, "v3")
    for name in ("", "../v1", "a/b", ".hidden", "_x"):
        with pytest.raises(ValueError, match="version name"):
            vs.commit_version(rows, root, name)


def test_one_of_two_writers_wins(spark, tmp_path):
    root = str(tmp_path / "store")
    with ThreadPoolExecutor(4) as pool:
        tries = list(pool.map(lambda n: vs.commit_version(spark.range(n), root, "v1", n), (1, 2, 3, 4)))
    assert sum(t.published for t in tries) == 1
    assert len({t.folder for t in tries}) == 1
    run = vs.read_runs(spark, root).first()
    assert run["seed"] == run["n_rows"] == vs.read_version(spark, root, "v1").count()
    assert [p.name for p in (tmp_path / "store" / "data").iterdir()] == [run["folder"].rsplit("/", 1)[1]]  # losers left nothing


def test_late_rows_come_out_beside_the_counts(spark, tmp_path):
    path, at = str(tmp_path / "events"), lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "ts TIMESTAMP, kind STRING, in_time STRING"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = sm.read_stream(spark, path, "*.parquet", spark.createDataFrame([], schema).schema, None)
        counts, late = sm.windowed_with_late(stream, "ts", ["kind"], "10 minutes", "5 minutes", str(tmp_path / "w"))
        return ({(r["window_start"], r["kind"], r["n"], r["closed"]) for r in counts.collect()}, {tuple(r) for r in late.collect()})

    # The first batch has no watermark before it: nothing is late.
    assert feed([(at(1), "a", None), (at(2), "a", "x"), (at(26), None, "y")]) == (
        {(at(0), "a", 2, True), (at(20), None, 1, False)}, set())
    # Watermark 21: the window 10 to 20 is over, 20 to 30 is open. A new run goes on from the checkpoint.
    late = {(at(19), "a", None), (None, "b", None)}
    assert feed([*late, (at(20), None, None), (at(50), "a", None)]) == (
        {(at(0), "a", 2, True), (at(20), None, 2, True), (at(50), "a", 1, False)}, late)
    # Nothing new: the same again.
    assert feed([])[1] == late
