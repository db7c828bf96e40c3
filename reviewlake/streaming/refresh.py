"""The refresh stream: updates of changes in, what to refresh and the standing reports out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.refresh import keep_richer

UPDATE = "pr long, head string, draft boolean, updated_at timestamp, has_results boolean, seq long"


def updates(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Landed Parquet files of updates as a stream."""
    return spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def to_refresh(stream: DataFrame, published: DataFrame, late: str = "30 days") -> DataFrame:
    """Updates whose head isn't the published one, each (change, head) once within the watermark. published is a static table."""
    once = stream.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["pr", "head"])
    j = once.join(published.select("pr", F.col("head").alias("published_head")), "pr", "left")
    return j.filter(F.col("published_head").isNull() | (F.col("published_head") != F.col("head"))).drop("published_head")


def without_stale_drafts(stream: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Updates but for drafts not touched in `days` days before now."""
    stale = F.col("draft") & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    return stream.filter(~F.coalesce(stale, F.lit(False)))


EXPIRED = "pr long, head string, touched_at timestamp, expired_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DraftTimers(StatefulProcessor):
    """Of each change its newest update, and while that is a draft one timer, which expires it after `days` quiet days.

    Updates of a batch are taken by time. An update older than the kept one says nothing new and is passed over. One that comes
    after the draft was due lets it expire first, so that the result doesn't hang on how updates are put into batches.
    """

    def __init__(self, days: float):
        self.quiet = round(days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "head string, draft boolean, at long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted((r.at, r.seq, r.head, bool(r.draft)) for part in rows for r in part.itertuples())
        kept = self.newest.get() if self.newest.exists() else None
        before, gone = kept, []
        for at, seq, head, draft in arrived:
            if kept is not None and (at, seq) < (kept[2], kept[3]):
                continue
            if kept is not None and kept[1] and at > kept[2] + self.quiet:
                gone.append(self.expired(key, kept))
            kept = (head, draft, at, seq)
        if kept != before:
            if before is not None and before[1]:
                self.handle.deleteTimer(self.due(before))
            self.newest.update(kept)
            if kept[1]:
                self.handle.registerTimer(self.due(kept))
        if gone:
            yield pd.concat(gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = self.newest.get() if self.newest.exists() else None
        if kept is not None and kept[1] and self.due(kept) == expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
            yield self.expired(key, kept)

    def due(self, kept: tuple) -> int:
        return (kept[2] + self.quiet) // 1000

    def expired(self, key: tuple, kept: tuple) -> pd.DataFrame:
        when = pd.to_datetime([kept[2], kept[2] + self.quiet], unit="us")
        return pd.DataFrame({"pr": [key[0]], "head": [kept[0]], "touched_at": [when[0]], "expired_at": [when[1]]})

    def close(self) -> None:
        pass


def expired_drafts(stream: DataFrame, days: float = 30, late: str = "1 day") -> DataFrame:
    """pr, head, touched_at, expired_at of drafts that nobody touched for `days` days, once the watermark has passed that time: what a
    refresh may forget. A draft that moves again later is a new one. Its session needs the state store ROCKS."""
    rows = stream.withWatermark("updated_at", late).select("pr", "head", "draft", "updated_at", F.unix_micros("updated_at").alias("at"), "seq")
    return rows.groupBy("pr").transformWithStateInPandas(DraftTimers(days), EXPIRED, "Append", "EventTime")


def quiet_drafts(updates: DataFrame, days: float = 30, late: str = "1 day") -> DataFrame:
    """What expired_drafts gives for all of these updates, as a batch."""
    rows = updates.filter("updated_at IS NOT NULL")
    w = W.partitionBy("pr").orderBy("updated_at", "seq")
    due = F.col("updated_at") + F.make_dt_interval(secs=F.lit(days * 86_400))
    end = rows.agg((F.max("updated_at") - F.expr(f"INTERVAL {late}")).alias("_end"))  # one row
    ends = F.coalesce(F.lead("updated_at").over(w) > F.col("expired_at"), F.col("expired_at") <= F.col("_end"))
    x = rows.withColumn("expired_at", due).crossJoin(F.broadcast(end)).withColumn("_gone", F.col("draft") & ends)
    return x.filter("_gone").select("pr", "head", F.col("updated_at").alias("touched_at"), "expired_at")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's rows to Parquet files until all that has landed is through, each once even over restarts."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STANDING = "pr long, head string, has_results boolean, seq long, updated_at timestamp"


def standing(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The newest version of the standing reports, or the newest before a batch; a version is a partition of one folder."""
    every = spark.read.schema(f"{STANDING}, version int").parquet(target)
    some = every if before is None else every.filter(F.col("version") < before)
    last = some.agg(F.max("version")).first()[0]
    return some.filter(F.col("version").eqNullSafe(last)).drop("version")


def upsert(target: str, spark: SparkSession) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps the standing report of each change under target/version=<batch>: the last state and the batch's
    arrivals, in order. A batch that is written again gives the same version, so a restart does no harm."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("pr", "head", "has_results", "seq", "updated_at")
        if number > 0:
            rows = standing(spark, target, number).unionByName(rows)
        keep_richer(rows).write.mode("overwrite").parquet(f"{target}/version={number}")

    return write


def refresh(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    """Bring the standing reports up to date with all that has landed, then stop."""
    stream = updates(spark, source, files_per_trigger)
    return stream.writeStream.foreachBatch(upsert(target, spark)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_day(stream: DataFrame, at: str, *by: str, late: str = "1 day") -> DataFrame:
    """day and the rows of each tumbling day, by more columns if wanted; a stream gives a day once the watermark has passed its end."""
    g = stream.withWatermark(at, late) if stream.isStreaming else stream
    g = g.groupBy(F.window(at, "1 day").alias("_w"), *by).agg(F.count(F.lit(1)).alias("rows"))
    return g.select(F.col("_w.start").alias("day"), *by, "rows")


def sessions(stream: DataFrame, who: str, at: str, gap: str = "8 hours", late: str = "1 day") -> DataFrame:
    """(who, began, last, rows) of sittings: rows of one person with less than `gap` between them. A late row within the watermark joins
    the sittings on both sides of it; a stream gives a sitting once the watermark has passed its end."""
    g = stream.withWatermark(at, late) if stream.isStreaming else stream
    g = g.groupBy(F.session_window(at, gap).alias("_w"), who).agg(F.count(F.lit(1)).alias("rows"), F.max(at).alias("last"))
    return g.select(who, F.col("_w.start").alias("began"), "last", "rows")
