"""SimHash groups, decontamination, shards, top-k, archives, pages and the pipeline against brute force."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from pairrank.llm import decontaminate, queries, shards, simhash, topk, warc, webpages
from pairrank.llm.common import FOLD, WORD, prepare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    prepare(spark)


def fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 3]), 42) for i in range(max(1, len(found) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    rng = random.Random(8)
    long = [rng.choice(["river", "stone", "Été", "wind", "tree", "glass", "iron"]) + str(rng.randint(0, 30)) for _ in range(300)]
    texts = [" ".join(long)] * 40
    for _ in range(60):
        changed = list(long)
        changed[rng.randrange(300)] = "other"
        texts.append(" ".join(changed))
    texts += [" ".join(rng.choices(long, k=rng.randint(1, 30))) for _ in range(80)]
    return [*texts, None, "", " \t\n", "one", "one two", "ONE two"]


def test_simhash_groups(spark):
    texts = near_texts()
    docs = [(None if i == 3 else i, t, "c") for i, t in enumerate(texts)] + [(5, texts[5], "c")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, component_id string")
    prints = [fingerprint(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    want = sorted((str(d), f"{prints[i]:016x}", least[find(i)]) for i, (d, _, _) in enumerate(docs))
    got = simhash.near_duplicates(df, "doc_id", "text").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("f"), "component_id")
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == want
    kept = simhash.keep_one(df, "doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(least.values())) and len(kept) == len(set(map(find, range(len(docs)))))
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_links_are_complete(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    nodes = set(base)
    for b in base:
        for _ in range(30):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            nodes.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = sorted(map(signed, nodes))
    want = sorted((a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    df = spark.createDataFrame([(n,) for n in nodes], "fingerprint bigint")
    assert sorted(map(tuple, simhash.links(df).collect())) == want
    with pytest.raises(ValueError):
        simhash.links(df, 4)


def test_links_are_never_broadcast(spark):
    """A side of 64 variants a row is taken for as small as its rows before they are exploded."""
    plan = simhash.links(spark.range(50).select(F.xxhash64("id").alias("fingerprint")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def contaminated(docs, items, width=10):
    cut = lambda t: re.findall(WORD, (t or "").translate(FOLD))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = cut(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def no_broadcast(spark, request):
    """Whether sides are broadcast is Spark's choice by bytes; -1 makes it shuffle all of them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if request.param else before)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("seed", "no_broadcast"), [(1, False), (2, False), (2, True)], indirect=["no_broadcast"])
def test_decontamination(spark, seed, no_broadcast):
    rng = random.Random(seed)
    pool = ["the", "of", "Alpha", "beta", "Çedilla", "delta9", "x", "y"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 3, 12, 14])))) for i in range(12)] + [(3, "the of"), (50, None), (51, "...")]
    items += [(60, items[5][1]), (61, items[5][1])]
    docs = []
    for i in range(60):
        text = rng.choices(pool, k=rng.randint(0, 60))
        if i % 3 == 0:
            text.insert(rng.randint(0, len(text)), rng.choice(items)[1] or "")
        docs.append((i, ", ".join(text)))
    docs += [(None, "the of"), (None, None), (7, docs[7][1]), (8, ""), (900, "the " * 3000 + "of")]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, n_hit string")
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id bigint, text string, window string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.contamination(df, bench).select(*cols)
    assert sorted(map(tuple, got.collect()), key=str) == contaminated(docs, items)
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and left.count() == sum(not r[-1] for r in contaminated(docs, items))
    assert not decontaminate.contamination(df, bench.limit(0)).where("contaminated").count()
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("no_broadcast", [False, True], indirect=True)
def test_proximity(spark, no_broadcast):
    docs = spark.createDataFrame([(1, "c b x a"), (2, "a x x x x b c"), (3, "a b")], "doc_id int, text string")
    windows = spark.createDataFrame([(["a", "b", "c"],)], "window array<string>")
    near = decontaminate.matches(docs, windows, slop=1).where("window is not null")
    assert {r["doc_id"] for r in near.collect()} == {1}


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity_against_every_interval(spark, slop):
    rng = random.Random(slop)
    windows = [["a", "b", "c"], ["a", "a", "d"], ["e"], ["d", "e"], ["a", "q"], ["z", "a", "f", "b"]]
    docs = [(i, rng.choices("aaabbcdef", k=rng.randint(0, 40))) for i in range(40)] + [(None, ["a", "d"]), (3, ["e"]), (3, ["e"])]
    counts = Counter(w for _, text in docs for w in text)
    want = set()
    for d, text in docs:
        for window in windows:
            if not all(counts[w] for w in window):
                continue
            rarest = min((counts[w], at, w) for at, w in enumerate(window))[2]
            reach = len(window) + slop
            for place, word in enumerate(text):
                spans = (text[max(0, b) : b + reach] for b in range(place - reach + 1, place + 1))
                if word == rarest and any(set(window) <= set(s) for s in spans):
                    want.add((d, " ".join(text), " ".join(window), place))
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id int, text string")
    digests = {r["digest"]: r["text"] for r in frame.selectExpr("text", "xxhash64(text) digest").collect()}
    got = decontaminate.matches(frame, spark.createDataFrame([(w,) for w in windows], "window array<string>"), slop=slop).where("window is not null").collect()
    assert len(got) == len(want)
    assert {(r["doc_id"], digests[r["digest"]], " ".join(r["window"]), r["start"]) for r in got} == want


def test_postings_are_stored(spark):
    docs = spark.createDataFrame([(1, "a b, A x"), (2, None), (None, "b")], "doc_id int, text string")
    known = decontaminate.vocabulary(spark.createDataFrame([(["a", "b"],)], "window array<string>"))
    codes = {r["known"]: r["code"] for r in known.collect()}
    got = {(r["code"], r["doc_id"], r["place"]) for r in decontaminate.store_postings(docs, known).collect()}
    assert got == {(-1, 1, 4), (-1, 2, 0), (-1, None, 1), (codes["a"], 1, 0), (codes["a"], 1, 2), (codes["b"], 1, 1), (codes["b"], None, 0)}


def test_decontamination_stays_native(spark, capsys):
    decontaminate.contamination(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")).explain()
    assert "Python" not in capsys.readouterr().out


def test_shards(spark, capsys):
    rows = [(i, "same text" if i % 3 == 0 else "é" * (i % 50), "s") for i in range(3000)] + [(None, None, "s"), (5, "x" * 300_000, "s"), (5, "same", "s"), (5, "same", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot string")
    out = shards.shard(df, "doc_id", "text", bucket_bytes=20_000)
    got = out.collect()
    assert len(got) == len(rows) and sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, ((a, b) for a, b, _ in rows)))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        body = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "rows", None)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 0.6 * len(ids)  # shuffled
    out.explain()
    assert "Python" not in capsys.readouterr().out
    assert shards.shard(df.limit(0), "doc_id", "text").count() == 0


def test_rows_of_one_key_fill_many_buckets(spark, monkeypatch):
    written = {}

    def keep(df, label, write=shards.materialise):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(shards, "materialise", keep)
    rows = [(1, "the same text " * 20)] * 2000 + [(None, "and without id " * 10)] * 1000 + [(i, f"text {i} " * 20) for i in range(2, 3000)]
    out = shards.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", bucket_bytes=50_000)
    got = out.collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, rows))
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows) and max(r["slot"] for r in got) == (len(rows) - 1) // 8
    sizes = written["buckets"].groupBy("bucket").agg(F.sum("record.size")).collect()
    assert max(r[1] for r in sizes) < 4 * 50_000
    assert out.columns == ["doc_id", "text", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_top_k_of_repeated_queries(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(4)]) for i in range(1, 60)]
    first, second = [1.0, 0.25, 0.5, -0.5], [-1.0, 0.5, 0.25, 0.25]
    df = spark.createDataFrame(rows + [(0, first)] * 3 + [(0, second)], "vec_id bigint, embedding array<float>")
    want = []
    for v in (first, second):
        scores = sorted((-sum(int(256 * a // 1) * int(256 * b // 1) for a, b in zip(v, w)), i) for i, w in rows)
        want += [(0, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    got = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") == 0, block_rows=20, query_rows=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_no_name_of_a_column_clashes(spark):
    rng = random.Random(3)
    names = ["doc_id", "row", "text", "id", "digest", "fingerprint", "kept_id", "bad_id", "__id", "__digest", "__fingerprint", "__text", "__turn", "turn", "home", "window", "crc", "k"]
    texts = [" ".join(rng.choices("the of and one two three four five six".split(), k=20)) for _ in range(12)]
    rows = [tuple(i if n == "doc_id" else texts[i % 12] if n == "text" else f"{n}{i}" for n in names) for i in range(30)]
    df = spark.createDataFrame(rows + [rows[3]] * 300, ", ".join(f"{n} {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    kept = simhash.keep_one(df, "doc_id", "text")
    assert kept.columns == names and set(map(tuple, kept.collect())) <= set(rows)
    same = simhash.near_duplicates(df, "doc_id", "text").select("component_id").distinct()
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in same.collect())
    bench = spark.createDataFrame([(1, texts[5], "x")], "item_id bigint, text string, row string")
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == names
    assert sorted(map(tuple, left.collect())) == sorted(r for r in rows + [rows[3]] * 300 if r[2] != texts[5])
    # Small buckets, so that the repeated row is dealt over several.
    out = shards.shard(df, "doc_id", "text", bucket_bytes=2_000)
    assert out.columns == [*names, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted(tuple(r)[: len(names)] for r in out.collect()) == sorted(rows + [rows[3]] * 300)


def test_top_k_of_large_components(spark):
    big = 2.0**54
    rows = [(0, [big, 2.0**-8]), (1, [2.0**-8, 1.0]), (2, [-(2.0**-8), big]), (3, [2.0**-7 - 2.0**-8, -1.0]), (4, [0.0, 0.0])]
    ask = lambda data: topk.top_k(spark.createDataFrame(data, "vec_id bigint, embedding array<double>"), "vec_id", "embedding", F.col("vec_id") == 0)
    whole = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    scores = sorted((-sum(a * b for a, b in zip(whole[0][1], v)), i) for i, v in whole[1:])
    assert sorted(map(tuple, ask(rows).collect())) == [(0, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    with pytest.raises(Exception, match="a score does not fit 64 bits"):
        ask([*rows, (5, [4.0, 1.0])]).collect()
    with pytest.raises(Exception, match="a scaled component does not fit 64 bits"):
        ask([*rows, (5, [1e30, 1.0])]).collect()


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(rng.choice([3, 4]))]) for i in range(160)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf"), 1.0]), (250, []), (None, [1.0, 1.0, 1.0, 1.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int")
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < 1e300 for x in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-sum(int(256 * a // 1) * int(256 * b // 1) for a, b in zip(v, w)), i) for i, w in good if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    got = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, block_rows=40, query_rows=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_arc_versions():
    body = b"1 0 Owner\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://a.arc 0.0.0.0 19990102030405 text/plain %d\n" % len(body) + body + b"\nhttp://a/ 1.2.3.4 19990102030405 text/html 5\nab\ncd\n"
    (record,) = warc.read_arc(one)
    assert record.body == b"ab\ncd" and warc.warc_fields(record)["date"] == "1999-01-02T03:04:05Z"
    two = b"http://a/ 1.2.3.4 20010102030405 text/html 200 - - 0 n 2\nhi\n" * 2
    assert [r.fields["filename"] for r in warc.read_arc(two)] == ["n", "n"]
    with pytest.raises(ValueError):
        list(warc.read_arc(b"http://a/ 1.2.3.4 20010102030405 text/html 9\nhi\n", 1))
    with pytest.raises(ValueError):
        list(warc.read_arc(two, 1))


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    pages = [(4, "http://a/ b", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, "<p>é\r\n\r\nWARC/1.1</p>"), (3, "u", None), (9, "u", ""), (None, "u", "lone"), (30, "v", "abc"), (10, "v", "abc"), (4, "http://a/ b", "<p>é\r\n\r\nWARC/1.1</p>"), (77, "w", "y" * 400_000)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, digest int")
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        equal = [j for j, _, x in pages if (x or "") == (h or "") and j is not None]
        first = min(equal, default=None) if len(body) >= least else i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    got = warc.round_trip(df, "page_id", "url", "html", least)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert warc.round_trip(df.limit(0), "page_id", "url", "html").count() == 0


def test_warc_files_read_as_such(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x")], "page_id bigint, url string, html string")
    warc.write_archives(df, "page_id", "url", "html", str(tmp_path / "w"))
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.read_warc(f.read_bytes())]
    types = {r["warc-type"]: r for r in records}
    assert types["revisit"]["warc-refers-to"] == types["response"]["warc-record-id"] and types["revisit"]["body"] == b""
    assert gzip.decompress(next((tmp_path / "w").glob("*.gz")).read_bytes()).startswith(b"WARC/1.1\r\n")


PAGE = (
    '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="post sidebar-left"><header>Head</header>'
    '<nav><a href="/">Menu</a></nav><div class="cookie-notice">We use cookies</div>%s<aside>Side</aside><form><input>Go</form>'
    '<section id="comments"><article class="comment"><p>Reader words</p></article></section><footer>&copy; Foot</footer></body></html>'
)


def test_pages_by_name(spark):
    article = "<article><header><h1>A &amp; B</h1></header><p>One  <b>two</b>\n three<p>f&#246;ur<!-- no --><div class='ad-box'>Buy</div><ul><li>x<li>y</ul></article>"
    rows = [(1, "http://h/a", PAGE % article, "z"), (2, "http://h/b", None, "z"), (3, None, "", "z"), (4, "http://h/c", PAGE % "", "z"), (1, "http://h/a", PAGE % article, "z"), (None, "x", "<p>bare <i", "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in webpages.extract(df, "page_id", "url", "html").collect()}
    text = "A & B\nOne two three\nföur\nx\ny"
    assert {(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "", 0)} <= got and len(got) == 5
    assert webpages.extract(df.limit(0), "page_id", "url", "html").count() == 0


def test_pages_by_template(spark):
    page = '<html><body><div class="t1">Site name of ours</div><div class="x9"><p>%s</p><p>%s</p></div><div class="zz"><a href="/">link %d</a></div></body></html>'
    rng = random.Random(3)
    line = lambda: " ".join(rng.choices(["river", "stone", "wind", "tree"], k=30))
    want, rows = {}, []
    for i in range(20):
        a, b = line(), line()
        want[i] = f"{a}\n{b}"
        rows.append((i, f"http://host/{i}", page % (a, b, i)))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in webpages.extract(df, "page_id", "url", "html").collect()} == want


def extracted(spark, pages):
    rows = [(i, f"http://host/{i}", html) for i, html in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in webpages.extract(df, "page_id", "url", "html").collect()}


def test_copies_of_a_page_are_no_template(spark):
    page = '<body><div class="t1">%s</div><div class="x9"><p>%s</p></div></body>'
    assert set(extracted(spark, [page % ("Site", "the whole story")] * 4).values()) == {"Site\nthe whole story"}
    told = extracted(spark, [page % ("Site", t) for t in ["one text"] * 5 + ["another text"]])
    assert told == {i: "Site\none text" for i in range(5)} | {5: "Site\nanother text"}
    told = extracted(spark, [page % ("Site", t) for t in ["one text"] * 5 + ["another text", "a third"]])
    assert told == {i: "one text" for i in range(5)} | {5: "another text", 6: "a third"}


def test_two_texts_of_a_place_are_not_one(spark):
    """Every pair of texts in one place of three pages and more; estimates of the distinct count may take two for one."""
    hosts = 400
    rows = [(3 * h + i, f"http://h{h}/{i}", f'<div class="a">{h} {min(i, 1)}</div><div class="b">{h} {i}</div>') for h in range(hosts) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in webpages.extract(df, "page_id", "url", "html").collect()}
    assert got == {3 * h + i: f"{h} {min(i, 1)}\n{h} {i}" for h in range(hosts) for i in range(3)}


def test_short_slots_stay(spark):
    page = '<body><div class="lead">lead %d</div><div class="long">%s</div><div class="menu9"><a href="/">all links %d</a></div></body>'
    told = extracted(spark, [page % (i, f"long text {i} " * 50, i) for i in range(4)])
    assert told == {i: f"lead {i}\n" + (f"long text {i} " * 50).strip() for i in range(4)}


@pytest.mark.parametrize(
    ("name", "text"),
    [("has-sidebar", "before\nstory\nafter"), ("sidebar-wrap", "story"), ("content-sidebar", "story"), ("sidebar", ""), ("sidebar widget", "")],
)
def test_names_that_mention_a_sidebar(spark, name, text):
    inner = "before<article>story</article>after" if name != "has-sidebar" else "before<div>story</div>after"
    assert extracted(spark, [f'<body><div class="{name}">{inner}</div></body>']) == {0: text}


def test_whole_tables(spark):
    for name, table in (("op1_html", "pages"), ("op4_warc", "pages"), ("op5_licences", "documents"), ("op9_sharding", "documents"), ("op10_simhash", "documents"), ("op8_decontamination", "documents")):
        assert queries.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            ids = simhash.near_duplicates(before, "doc_id", "text").select("component_id").distinct()
            assert sorted(r[0] for r in ids.collect()) == sorted(r["doc_id"] for r in docs.collect())
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            clean = [r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in before.collect()], items) if not r[-1]]
            assert sorted(clean) == sorted(r["doc_id"] for r in docs.collect())
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0
    assert pipeline.run(spark, SMALL).count() == docs.count()
