import random

from pyspark.sql import functions as F

from reelrank.llm import warc_revisit as W

SCHEMA = "record_id long, warc_type string, target_uri string, warc_date long, status int, headers map<string,string>, payload string, kept string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "own") for r in rows], SCHEMA).withColumn("warc_date", F.timestamp_seconds("warc_date"))


def test_canonical_url(spark):
    cases = {"HTTP://User@Example.COM:80/A?b#c": "http://example.com/A?b", "https://x.org": "https://x.org/", "https://x.org:443?q=1": "https://x.org/?q=1",
             "http://x.org:8080/": "http://x.org:8080/", " http://x.org/a ": "http://x.org/a"}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "u string").select("u", W.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == {**cases, None: None}


def test_against_brute_force(spark):
    r = random.Random(6)
    urls, rows = [f"http://h.org/{i}" for i in range(6)], []
    for i in range(600):
        url = urls[0] if r.random() < 0.4 else r.choice(urls)  # a hot URL
        t, tag = r.randint(0, 40_000), r.choice([None, '"a"', 'W/"a"', '"b"'])
        h = {k: v for k, v in {"ETag": tag, "Last-Modified": r.choice([None, "m1", "m2"]), "Content-Length": str(i), "X": r.choice([None, "x"])}.items() if v}
        if r.random() < 0.5:
            rows.append((i, "response", url, t, r.choice([200, 200, 200, 404]), h, f"p{i}"))
        else:
            rows.append((i, "revisit", url.upper().replace("HTTP://H.ORG", "HTTP://H.ORG:80"), t, 304, h, None))
    got = {x.record_id: x for x in W.resolve_revisits(records(spark, rows), bucket=500).collect()}
    assert len(got) == sum(x[1] == "revisit" for x in rows)
    for i, kind, url, t, _, h, _ in rows:
        if kind != "revisit":
            continue
        h = {k.lower(): v for k, v in h.items()}
        before = [x for x in rows if x[1] == "response" and x[4] == 200 and x[2].lower() == url.lower().replace(":80", "") and x[3] < t]
        g = got[i]
        if not before:
            assert (g.outcome, g.response_id, g.headers) == ("orphan", None, None)
            continue
        best = max(before, key=lambda x: (x[3], x[0]))
        old = {k.lower(): v for k, v in best[5].items()}
        weak = lambda x: x.removeprefix("W/")
        if "etag" in h and "etag" in old:
            want = "verified" if weak(h["etag"]) == weak(old["etag"]) else "mismatch"
        elif "last-modified" in h and "last-modified" in old:
            want = "verified" if h["last-modified"] == old["last-modified"] else "mismatch"
        else:
            want = "unverified"
        assert (g.outcome, g.response_id) == (want, best[0])
        merged = {**old, **{k: v for k, v in h.items() if k not in W.NOT_MERGED}}
        assert (g.headers, g.payload) == ((None, None) if want == "mismatch" else (merged, best[6]))


def test_edge_rows(spark):
    rows = [(1, "response", "http://a/", 10, 200, None, "p"), (1, "response", "http://a/", 10, 200, None, "p"), (2, "revisit", "http://a/", 11, 304, None, None),
            (2, "revisit", "http://a/", 11, 304, None, None), (3, "revisit", None, 11, 304, {"ETag": "x"}, None), (4, "revisit", "http://a/", None, 304, {}, None),
            (5, None, "http://a/", 9, None, {}, None), (6, "revisit", "http://a/", 10, 304, {"A": "1", "a": "2"}, None), (7, "response", "http://b/", 1, 200, {}, None),
            (8, "revisit", "http://b/", 10**9, 304, {"A": "1", "a": "2"}, None)]
    got = sorted(((r.record_id, r.outcome, r.payload) for r in W.resolve_revisits(records(spark, rows)).collect()))
    assert got == [(2, "unverified", "p"), (2, "unverified", "p"), (3, "orphan", None), (4, "orphan", None), (6, "orphan", None), (8, "unverified", None)]
    assert W.resolve_revisits(records(spark, rows).where("false")).count() == 0


def test_times_to_the_microsecond(spark):
    rows = [(1, "response", "http://a/", 10, 200, {"ETag": "x"}, "early"), (2, "revisit", "http://a/", 10, 304, {"ETag": "x"}, None),
            (3, "response", "http://a/", 3_599, 200, {"ETag": "y"}, "late"), (4, "revisit", "http://a/", 3_600, 304, {"ETag": "y"}, None),
            (5, "response", "http://b/", -5, 200, {}, "old"), (6, "revisit", "http://b/", -4, 304, {}, None)]
    micros = {2: 800_000, 3: 999_999, 4: 0, 6: -999_999}
    df = records(spark, rows).withColumn("warc_date", F.timestamp_micros(F.unix_micros("warc_date") + F.coalesce(*[F.when(F.col("record_id") == i, F.lit(m)) for i, m in micros.items()], F.lit(0))))
    got = {r.record_id: (r.outcome, r.response_id, r.payload) for r in W.resolve_revisits(df).collect()}
    assert got == {2: ("verified", 1, "early"), 4: ("verified", 3, "late"), 6: ("unverified", 5, "old")}
    at = {r.record_id: r.at for r in W.resolve_revisits(df).select("record_id", F.unix_micros("warc_date").alias("at")).collect()}
    assert at == {2: 10_800_000, 4: 3_600_000_000, 6: -4_999_999}


def test_payload_of_a_repeated_record_id(spark):
    """The payload is the found response's: other records with its id, at other URLs and times, do not count; ties by tag,
    then headers, then payload. A null id is found by URL and time."""
    rows = [(1, "response", "http://a/", 10, 200, {"ETag": "x"}, "first"), (1, "response", "http://a/", 20, 200, {"ETag": "x"}, "second"),
            (1, "response", "http://b/", 10, 200, {"ETag": "x"}, "zzz"), (1, "response", "http://a/", 10, 404, {"ETag": "x"}, "gone"),
            (2, "revisit", "http://a/", 15, 304, {"ETag": "x"}, None), (3, "revisit", "http://a/", 25, 304, {"ETag": "x"}, None),
            (4, "response", "http://c/", 1, 200, {"ETag": "m", "X": "1"}, "c1"), (4, "response", "http://c/", 1, 200, {"ETag": "m", "X": "2"}, "c0"),
            (4, "response", "http://c/", 1, 200, {"ETag": "k", "X": "9"}, "c9"), (5, "revisit", "http://c/", 2, 304, {"ETag": "m"}, None),
            (None, "response", "http://d/", 1, 200, {}, "d"), (None, "response", "http://e/", 1, 200, {}, "e"), (6, "revisit", "http://d/", 2, 304, {}, None)]
    got = {r.record_id: (r.outcome, r.payload) for r in W.resolve_revisits(records(spark, rows)).collect()}
    assert got == {2: ("verified", "first"), 3: ("verified", "second"), 5: ("verified", "c0"), 6: ("unverified", "d")}
