"""Operators on pages and shards, against SQL and on odd rows."""

import base64
import hashlib
import random
import re
import zlib
from pathlib import Path

import pytest
from oracle import compare
from pyspark.sql import functions as F

from reviewlake.llm import queries, sharding, urls, warc

URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.Example.COM/en/7?x#y"), (6, "https://example.com/en/8"), (7, "x://a.net/de/8"), (8, "x://example.net/de/8#"), (9, "a://b.org?/es/"), (10, "a://b.org/es/1"), (11, "://éÉ.org/es/"),
    (12, "http://notexample.com/en/7"), (13, "u://com/en/"), (14, "a://b://c/d"), (14, "a://b://c/d"), (None, "http://x.net/de/"), (15, "http://h/p\nq?r"), (16, "z://" + "a" * 50_000),
]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    assert compare(spark, f"/root/testdata/{sf}", queries.QUERIES[name], queries.ORACLE_SQL[name])


def plain_url(u):
    host, path = "", ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for v, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best


def test_urls_equal_plain_reading(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in URLS], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(i, i % 2 == 0) for i in range(1, 9)] + [(1, None), (2, False)], "page_id long, bad boolean")
    for some in (outcomes, outcomes.limit(0)):
        got = urls.judge(pages, some).collect()
        assert len(got) == len(URLS)
        for r in got:
            host, path, best = plain_url(r.url)
            assert (r.host, r.path, r.rule) == (host, path, best and best[0])
            assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0), outcomes).count() == 0


def test_rules_are_those_of_the_contract(spark):
    """Of pages without labels each verdict is the longest rule's: com/en/, example.net/de/8 and org/es/ block, the others allow."""
    want = {"http://a.com/en/1": "block", "http://www.example.com/en/71": "allow", "http://a.net/de/1": "allow", "http://example.net/de/7": "allow", "http://example.net/de/8": "block", "http://x.example.net/de/80": "block", "http://b.org/es/1": "block"}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()
    assert {r.url: r.verdict for r in got} == want and all(r.rule for r in got)


def test_levels_of_hosts(spark):
    want = {"a.co.uk": ("a.co.uk", "co.uk"), "x.b.co.uk:80": ("b.co.uk", "co.uk"), "www.site.org:8080": ("site.org", "org"), "com": ("com", "com"), "co.uk": ("co.uk", "co.uk"), "": ("", "")}
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", *urls.levels(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    rows = [(i, "http://bad.site.info/x") for i in range(60)] + [(100 + i, f"http://h{i % 40}.fine.info/") for i in range(800)] + [(2000, "http://new.fine.info/"), (2001, "http://one.other.info/")]
    bad = [(i, i < 60 or i % 29 == 0 or i == 2001) for i, _ in rows if i != 2000]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad boolean")).collect()
    assert {r.verdict for r in got if r.host == "bad.site.info"} == {"block"}
    assert {r.verdict for r in got if r.host != "bad.site.info"} == {"allow"}


def sha32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


PAGES = [
    (1, "u1", None), (2, "u2", ""), (3, None, ""), (4, "u\r\n4", "same"), (9, "u", "same"), (5, "u", "same"), (9, "u", "same"), (None, "n", "same"), (None, "n", "lone"), (6, "u", "WARC/1.1\r\nX-Archive: x\r\n\r\n\r\nbody\r\n\r\n"),
    (7, "u", "\0é日本🎉\r\n\r\n"), (8, "u", "x" * 300_000), (10, "u", "\r\n\r\n"), (11, "u", "\n"),
]


def plain_members(data):
    """The gzip members of a file, each by itself."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        assert d.eof
        data = d.unused_data
    return out


WARC_RECORD = re.compile(rb"WARC/1\.1\r\n((?:[A-Za-z-]+: [^\r\n]*\r\n)+)\r\n(.*)\r\n\r\n", re.DOTALL)


def plain_record(member):
    """(fields, block) of a member that is one record by the grammar of WARC/1.1, with all mandatory fields."""
    m = WARC_RECORD.fullmatch(member)
    lines = [x.split(": ", 1) for x in m[1].decode().split("\r\n")[:-1]]
    fields = dict(lines)
    assert len(fields) == len(lines) and fields["WARC-Type"] in ("response", "revisit") and len(m[2]) == int(fields["Content-Length"])
    assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
    return fields, m[2]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int").repartition(3)
    path = str(tmp_path / "archive")
    got = warc.archived(pages, path, least).collect()
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        top = max((j for j, _, g in PAGES if (g or "") == (h or "") and j is not None), default=None)
        again = len(body) >= least and i != top
        want.append((i, len(body), sha32(body), "revisit" if again else "response", top if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    back = {r.page_id: r for r in warc.read(spark, path).collect() if r.type == "response"}
    for i, u, h in PAGES:
        if i in (6, 7, 8, 10, 11):
            assert bytes(back[i].payload) == h.encode() and back[i].url == u
    records = [plain_record(m) for p in Path(path).glob("part-*") for m in plain_members(p.read_bytes())]
    assert len(records) == len(PAGES) and len({f["WARC-Record-ID"] for f, _ in records}) == len(PAGES)
    response_of = {f["WARC-Record-ID"]: (f, b) for f, b in records if f["WARC-Type"] == "response"}
    for f, block in records:
        http, _, body = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f["Content-Type"] == "application/http;msgtype=response"
        if f["WARC-Type"] == "revisit":
            original, kept = response_of[f["WARC-Refers-To"]]
            assert not body and original["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and original["X-Page-Id"] == f["X-Refers-To-Page-Id"]
            assert f["WARC-Profile"] == warc.PROFILE and kept.startswith(block)
        else:
            assert f["WARC-Payload-Digest"] == "sha1:" + sha32(body) and f"Content-Length: {len(body)}".encode() in http
    assert warc.archived(pages.limit(0), str(tmp_path / "none")).count() == 0


def test_archives_have_a_size(spark, tmp_path):
    """Archives roll at their size; one that ends in a record of 16 MiB or more is read like any other."""
    rng = random.Random(1)
    rows = [(i, f"u{i}", "".join(rng.choice("abcdef") for _ in range(400))) for i in range(200)] + [(900, "large", "x" * (1 << 24)), (901, "larger", "y" * (17 << 20))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for size in (1, 5000):
        path = str(tmp_path / f"a{size}")
        warc.write(warc.deduplicated(pages), path, archive_bytes=size)
        assert len(list(Path(path).glob("part-*"))) >= (len(rows) if size == 1 else 10)
        assert {r.page_id: r.payload.decode() for r in warc.read(spark, path).collect()} == {i: h for i, _, h in rows}


@pytest.mark.parametrize("limit", [1, 100, 3000, 20_000, 1 << 30])
def test_shards_split_only_what_is_too_large(spark, sf, limit):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("shard", F.lit("mine"))
    rows = sharding.shards(docs, limit=limit).toPandas()
    assert len(rows) == docs.count() and rows.doc_id.is_unique
    total = rows.groupby("shard").n_bytes.sum()
    assert (total[rows[rows.fits].shard.unique()] <= limit).all()
    assert (rows[~rows.fits].groupby("shard").size() == 1).all()
    h = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in rows.doc_id}
    for r in rows.itertuples():
        assert f"{h[r.doc_id]:060b}".startswith(r.shard) and len(r.shard) == r.depth
        if r.depth:  # the bucket it was split from was too large
            parent = sum(b for i, b in zip(rows.doc_id, rows.n_bytes, strict=True) if f"{h[i]:060b}".startswith(r.shard[:-1]))
            assert parent > limit


def test_shards_of_odd_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 10), (3, "é" * 10), (None, "abc"), (None, "d"), (4, "x" * 100_000)], "doc_id long, text string")
    got = sharding.shards(rows, limit=30).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.fits)) for r in got) == sorted(map(str, [(1, 0, True), (2, 0, True), (3, 20, False), (3, 20, False), (None, 3, True), (None, 1, True), (4, 100_000, False)]))
    assert sharding.shards(rows.limit(0)).count() == 0
    sharding.write_shards(rows, str(tmp_path / "s"), limit=30)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 7
