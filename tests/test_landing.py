"""The landing table: last write wins, buckets are replaced, misses are rows; tickets of two trackers."""

import os

from pyspark.sql import functions as F

from reviewlake.sources import landing, records


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_writes_reads_and_misses(spark, tmp_path):
    path = str(tmp_path / "landing")
    batch = lambda *r: spark.createDataFrame(r, "request string, body string, fetched_at int")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "request string")
    assert rows(landing.replay(asked, path, ["request"], 4), "request", "error") == [("a", "never landed"), ("a", "never landed"), ("b", "never landed"), ("c", "never landed")]
    landing.land(batch(("a", "1", 1), ("b", "1", 5), ("b", "0", 4)), path, ["request"], ["fetched_at"], 4)
    for _ in range(2):  # a write that is done anew changes nothing
        landing.land(batch(("a", "2", 2), ("b", "old", 3), ("d", None, 1)), path, ["request"], ["fetched_at"], 4)
        assert rows(landing.replay(asked, path, ["request"], 4), "request", "body", "error") == [("a", "2", None), ("a", "2", None), ("b", "1", None), ("c", None, "never landed")]
        assert rows(landing.read(spark, path), "request") == [("a",), ("b",), ("d",)]


def test_a_write_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "landing")
    landing.land(spark.range(200).select(F.col("id").cast("string").alias("request"), F.lit("x").alias("body"), F.lit(1).alias("fetched_at")), path, ["request"], ["fetched_at"], 8)
    files = lambda: {(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    assert len(before) == 8
    landing.land(spark.createDataFrame([("7", "y", 2)], "request string, body string, fetched_at int"), path, ["request"], ["fetched_at"], 8)
    assert len(before - files()) == 1 and len(files()) == 8
    got = landing.read(spark, path)
    assert got.count() == 200 and rows(got.filter("body = 'y'"), "request") == [("7",)]


def test_bundles_by_head_and_latest(spark, tmp_path):
    path = str(tmp_path / "bundles")
    bundle = lambda *r: spark.createDataFrame(r, "pr long, head string, fetched_at int, bundle string")
    landing.write_bundles(bundle((1, "h1", 1, "first"), (2, "g", 9, "only")), path, 4)
    landing.write_bundles(bundle((1, "h2", 3, "second"), (1, "h1", 2, "again")), path, 4)
    assert rows(landing.read(spark, f"{path}/heads"), "pr", "head", "bundle") == [(1, "h1", "again"), (1, "h2", "second"), (2, "g", "only")]
    assert rows(landing.read(spark, f"{path}/latest"), "pr", "head", "bundle") == [(1, "h2", "second"), (2, "g", "only")]


def test_fields_of_two_trackers_by_name(spark):
    text = lambda a, b: f'{{"key": "P-1", "fields": {{"{a}": [{{"name": "ann"}}, "x", {{"key": "bob", "displayName": "Bob"}}], "{b}": true, "labels": null, "comment": null}}}}'
    df = spark.createDataFrame([("one", text("c1", "c2")), ("two", text("c2", "c1")), ("three", text("c1", "c2")), ("one", None), ("one", "[]")], "tracker string, value string")
    fields = spark.createDataFrame([("one", "c1", "Reviewers"), ("one", "c2", "Source Control Link"), ("two", "c2", "Reviewers"), ("two", "c1", "Source Control Link")], "tracker string, id string, name string")
    got = records.tickets(df, fields, "http://t").collect()
    assert [(sorted((u.name, u.display) for u in r.reviewers), r.source_control_link, r.error) for r in sorted(got, key=lambda r: (r.error or "", r.source_control_link))] == [
        ([], "", None), ([("ann", None), ("bob", "Bob")], "true", None), ([("ann", None), ("bob", "Bob")], "true", None), ([], "", "unreadable"), ([], "", "unreadable"),
    ]
    assert all(r.comments == [] and r.labels == [] and r.remotelinks == [] for r in got)
