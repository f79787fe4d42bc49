"""WARC archives with their index, and URL filters."""

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from common import bag, duck, same_as_sql
from pyspark.sql import functions as F

from tallyloom.llm import urls, warc

PAGES = "page_id long, url string, html string"
ODD = [
    (1, "http://a.com/x", "<p>one</p>"), (2, "http://a.com/x", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "http://b.org/", None), (5, "http://b.org/", ""), (6, "https://www.A.com:80/x?y=1#z", "é漢字😀\r\n\r\n"),
    (None, "http://c.net", "<p>one</p>"), (None, None, None), (7, "http://d.net/a b\nc", "<p>seven</p>"), (7, "http://d.net/a b\nc", "<p>seven</p>"), (7, "http://e.net/", "<p>seven</p>"), (8, "ftp://x", "z" * 200_000), (9, "no scheme", "WARC/1.1\r\nContent-Length: 3\r\n\r\n"),
]


def pages(spark, rows=ODD):
    return spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(f"own {c}") for c in ("id", "key", "file", "offset", "length", "sha", "lead", "refers", "payload", "host", "path", "rule", "salt", "action")})


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute_records(rows, least=0):
    """Of equal payloads the largest id leads; of several rows with it one is the response."""
    by = defaultdict(list)
    for i, _, html in rows:
        by[html or ""].append(i)
    out = []
    for html, ids in by.items():
        n = len(html.encode())
        lead = max((i for i in ids if i is not None), default=None)
        led = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True):
            first = n < least or (i == lead and not led)
            led |= i == lead
            out.append((i, n, b32(html), "response" if first else "revisit", None if first else lead))
    return Counter(out)


COLS = ("id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least", [0, 12])
def test_records_of_odd_pages_round_trip(spark, least):
    _, records = warc.archive(pages(spark), least_bytes=least)
    rows = records.collect()
    want = brute_records(ODD, least)
    # Rows of null ids only have no id to refer to, so the record type is what tells.
    assert Counter((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    html = {b32(h): h or "" for _, _, h in ODD}
    for r in rows:
        assert r["payload"] == (html[r["payload_digest"]] if r["record_type"] == "response" else "")


def test_records_of_the_corpus_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = warc.op5_warc(spark, sf)
    assert bag(got, "page_id", *COLS[1:]) == brute_records(rows)
    same_as_sql(got, duck(sf), warc.OP5_SQL)


def test_no_pages_no_records(spark):
    directory, records = warc.archive(pages(spark, []))
    assert directory.count() == 0 and records.count() == 0


def test_lookup_by_url_and_sparse_directory(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    captures = warc.write_archives(table)
    directory = warc.write_index(captures, block=7)
    blocks = [r.asDict() for r in directory.collect()]
    assert sum(b["n"] for b in blocks) == table.count() and max(b["n"] for b in blocks) <= 7
    spans = sorted((b["first_key"], b["last_key"]) for b in blocks)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    look, by = warc.Lookup(blocks), defaultdict(list)
    for r in table.collect():
        by[warc.url_key(r["url"])].append(r)
    for rows in list(by.values())[:40]:
        got = look.records(rows[0]["url"])
        assert Counter(r["WARC-Record-ID"] for r in got) == Counter(f"<urn:page:{r['page_id']}>" for r in rows)
        assert {r["WARC-Payload-Digest"] for r in got} == {f"sha1:{b32(r['html'])}" for r in rows}
    assert look.captures("http://nowhere.example/none") == []


def test_looking_up_a_table_of_urls(spark):
    """One url has most captures, over many blocks and files; some urls were never captured."""
    rows = [(k, "http://hot.com/x" if k % 3 else f"http://h{k % 50}.org/{k}", f"<p>{k % 40}</p>") for k in range(900)]
    table = spark.createDataFrame(rows, PAGES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several index files of few rows
    try:
        directory = warc.write_index(warc.write_archives(table.repartition(5)), block=10)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert directory.select("file").distinct().count() > 1
    asked = ["http://hot.com/x", "http://HOT.com/x#f", "http://h0.org/0", "http://h1.org/1", "http://h3.org/3", "http://zz.zz/", None, "http://h9.org/9999"]
    keys = warc.keys_of(spark.createDataFrame([(u,) for u in asked], "url string"), "url")
    got = Counter(int(r["id"]) for r in warc.look_up(directory, keys).collect())
    wanted = {warc.url_key(u) for u in asked}
    assert got == Counter(i for i, u, _ in rows if warc.url_key(u) in wanted) and len(got) > 600
    records = warc.read_records(warc.look_up(directory, keys), "bigint")
    assert Counter(r["id"] for r in records.collect()) == got


def test_archives_are_plain_warc_members(spark):
    captures = warc.write_archives(pages(spark)).collect()
    name = captures[0]["file"]
    data = warc.read_range(captures[0]["folder"], name, 0, max(c["offset"] + c["length"] for c in captures if c["file"] == name))
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1\r\nWARC-Type: ") == sum(c["file"] == name for c in captures)


def test_url_keys():
    assert warc.url_key("http://user@www.Example.com:80/a/b?c#d") == "com,example,www:80)/a/b?c"
    assert warc.url_key(None) == ")/" and warc.url_key("http://x.y") == "y,x)/"


# --- url filters ---------------------------------------------------------------------------------------------------

RULES = [(a, h, p) for a, h, p in urls.RULES]


def brute_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(-len(h + p), a != "block", h + p, a) for a, h, p in rules if None not in (a, h, p) and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = min(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    "http://example.com/en/x", "http://www.example.com/en/x", "http://WWW.EXAMPLE.COM/en/x?q", "http://a.b.net/es/", "http://a.b.net/es", "http://net/fr/x#y", "http://notnet/fr/", "http://x.com", "http://x.com?y/", "http://x.com/#", None, "", "://", "nothing",
    "a://b://c.com/d", "http://com/", "http://.com/", "http://x..com/", "http://com./", "http://x.com:80/", "http://exämple.com/en/", "http://x.net/es/\nnext", "http://example.com/en/" + "y" * 9000, "http://" + "a." * 300 + "net/fr/",
]


def asked(spark, rows):
    df = spark.createDataFrame([(k, u, "") for k, u in rows], PAGES)
    return df.withColumns({c: F.lit(f"own {c}") for c in ("host", "path", "rule", "salt", "id", "action", "verdict")})


@pytest.mark.parametrize("few", [True, False])
def test_verdicts_on_odd_urls_equal_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(urls, "BROADCAST_ROWS", 0)
    rows = [*enumerate(URLS), (None, URLS[0]), (1, URLS[1])]
    rules = [*RULES, RULES[0], (None, "com", "/"), ("block", None, "/"), ("allow", "b.net", "/es"), ("block", "A.b.net", "/"), ("block", "x.com", ""), ("allow", "x.com", "")]
    got = urls.filter_urls(asked(spark, rows), spark.createDataFrame(rules, "action string, host string, path string"))
    assert bag(got, "page_id", "host", "path", "rule", "verdict") == Counter((k, *brute_verdict(u, [(a, h and h.lower(), p) for a, h, p in rules])) for k, u in rows)


def test_verdicts_on_the_corpus_equal_sql_and_brute_force(spark, sf):
    got = urls.op7_url_filters(spark, sf)
    same_as_sql(got, duck(sf), urls.OP7_SQL)
    table = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert bag(got, "page_id", "host", "path", "rule", "verdict") == Counter((r["page_id"], *brute_verdict(r["url"], RULES)) for r in table)


def test_a_host_of_a_hundred_thousand_labels(spark):
    rules = [("block", "b.net", "/x"), ("allow", ".".join(["a"] * 60) + ".b.net", "/x"), ("block", ".".join("bcdefgh") + ".com", "/")]
    many = [f"http://{'a.' * n}b.net/x/{'y' * 50_000}" for n in (100_000, 50, 0)] + ["http://" + "a." * 99_999 + "b.c.d.e.f.g.h.com/"]
    rows = spark.createDataFrame(list(enumerate(many)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(rows, spark.createDataFrame(rules, "action string, host string, path string")).collect()}
    assert got == {k: brute_verdict(u, rules)[2:] for k, u in enumerate(many)}


def test_no_urls_or_no_rules(spark):
    none = spark.createDataFrame([], "action string, host string, path string")
    assert urls.filter_urls(asked(spark, []), none).count() == 0
    got = urls.filter_urls(asked(spark, [(1, "http://a.com/")]), none, default="block").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [(None, "block")]


def test_no_python_in_the_plan(spark, sf):
    plan = urls.op7_url_filters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)
