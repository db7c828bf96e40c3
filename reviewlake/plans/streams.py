"""Streams over the events table, run until all of it is through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import new_path
from ..streaming import refresh as S
from .catalog import Tables, query


def events(t: Tables):
    rows = t.spark.readStream.schema(t("events").schema).parquet(f"{t.sf_dir}/events.parque[t]")  # a pattern, so that the table may be a file or a folder
    return rows.select(F.col("user_id").alias("pr"), F.col("event_type").alias("head"), (F.col("event_id") % 4 == 0).alias("draft"), F.col("ts").cast("timestamp").alias("updated_at"), (F.col("value") > 10).alias("has_results"), F.col("event_id").alias("seq"))


PUBLISHED = "SELECT DISTINCT user_id AS pr, CASE user_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' END AS head FROM events WHERE user_id % 3 < 2"


@query(f"SELECT DISTINCT user_id AS pr, event_type AS head FROM events LEFT JOIN ({PUBLISHED}) p ON p.pr = user_id WHERE p.head IS NULL OR p.head <> event_type")
def str1_refresh_stream(t):
    published = t("events").selectExpr("user_id AS pr", "CASE user_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' END AS head").filter("head IS NOT NULL").distinct()
    out = new_path(t.spark, "picked")
    picked = S.to_refresh(events(t), published).select("pr", "head")
    S.append(picked, out, new_path(t.spark, "state")).awaitTermination()
    return t.spark.read.schema("pr long, head string").parquet(out)


@query("SELECT event_id AS seq FROM events WHERE NOT (event_id % 4 = 0 AND ts < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY)")
def str2_without_stale_drafts(t):
    out = new_path(t.spark, "live")
    S.append(S.without_stale_drafts(events(t), "2024-02-15").select("seq"), out, new_path(t.spark, "state")).awaitTermination()
    return t.spark.read.schema("seq long").parquet(out)


@query("""WITH a AS (SELECT user_id AS pr, event_type AS head, value > 10 AS has_results, event_id AS seq FROM events), b AS (SELECT *, lag(head) OVER (PARTITION BY pr ORDER BY seq) IS DISTINCT FROM head AS fresh FROM a), c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY pr ORDER BY seq) AS run FROM b)
SELECT pr, head, has_results, seq FROM c QUALIFY row_number() OVER (PARTITION BY pr ORDER BY run DESC, has_results DESC, seq DESC) = 1""")
def str4_standing_reports(t):
    out = new_path(t.spark, "standing")
    q = events(t).writeStream.foreachBatch(S.upsert(out, t.spark)).option("checkpointLocation", new_path(t.spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return S.standing(t.spark, out).select("pr", "head", "has_results", "seq")


def drained(t, stream, schema: str):
    """All that a stream appends until what has landed is through."""
    out = new_path(t.spark, "stream")
    S.append(stream, out, new_path(t.spark, "state")).awaitTermination()
    return t.spark.read.schema(schema).parquet(out)


@query("""WITH e AS (SELECT user_id AS pr, event_type AS head, event_id % 4 = 0 AS draft, ts, ts + INTERVAL 2 DAY AS due, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
SELECT pr, head, epoch_us(ts) AS touched_at, epoch_us(due) AS expired_at FROM e WHERE draft AND coalesce(later > due, due <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY)""")
def str2_expired_drafts(t):
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKS)
    try:
        gone = drained(t, S.expired_drafts(events(t), 2), S.EXPIRED)
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return gone.select("pr", "head", *[F.unix_micros(c).alias(c) for c in ("touched_at", "expired_at")])


@query("SELECT epoch_us(date_trunc('day', ts)) AS day, event_type AS head, count(*) AS rows FROM events GROUP BY ALL HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def str1_updates_per_day(t):
    days = drained(t, S.per_day(events(t), "updated_at", "head"), "day timestamp, head string, rows long")
    return days.withColumn("day", F.unix_micros("day"))


@query("""WITH e AS (SELECT user_id AS pr, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 8 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY pr ORDER BY ts) AS k FROM e)
SELECT pr, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS last, count(*) AS rows FROM s GROUP BY pr, k HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def str1_sessions(t):
    sat = drained(t, S.sessions(events(t), "pr", "updated_at"), "pr long, began timestamp, last timestamp, rows long")
    return sat.withColumns({c: F.unix_micros(c) for c in ("began", "last")})
