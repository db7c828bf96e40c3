"""What must be refreshed when changes move, and what was true at a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def picks(open_changes: DataFrame, published: DataFrame, now: str, limit: int = 25, stale_days: int = 30) -> DataFrame:
    """open_changes (pr, head, draft, updated_at) with reason and picked: stale drafts and current heads are skipped, the newest
    `limit` of the rest are taken. Only the newest are ranked in one place; the rest are told by their bound."""
    j = open_changes.join(published.select("pr", F.col("head").alias("_head")), "pr", "left")
    stale = F.col("draft") & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {stale_days} DAYS"))
    skip = F.when(F.coalesce(stale, F.lit(False)), "stale draft").when(F.col("_head").eqNullSafe(F.col("head")) & F.col("_head").isNotNull(), "current head")
    j = j.withColumn("_skip", skip)
    first = j.filter("_skip IS NULL").select("pr", "updated_at").orderBy(F.col("updated_at").desc_nulls_last(), F.col("pr").asc()).limit(limit)  # `limit` rows
    out = j.join(F.broadcast(first.select("pr", F.lit(True).alias("picked"))), "pr", "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    reason = F.coalesce("_skip", F.when(~F.col("picked"), "over the cap"), F.when(F.col("_head").isNull(), "no published report").otherwise("new head"))
    return out.withColumn("reason", reason).drop("_head", "_skip")


def keep_richer(arrivals: DataFrame, key: str = "pr", head: str = "head", rich: str = "has_results", seq: str = "seq") -> DataFrame:
    """The report that stands after all arrivals of each key, in order: another head replaces; the same head does when it has
    results or the standing one has none. That is, of the last run of one head, the last with results, else the last."""
    w = W.partitionBy(key).orderBy(seq)
    x = arrivals.withColumn("_new", F.coalesce((~F.col(head).eqNullSafe(F.lag(head).over(w))).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_new").over(w))
    best = F.struct(F.col("_run"), F.col(rich), F.col(seq))
    return x.groupBy(key).agg(F.max_by(F.struct(*arrivals.columns), best).alias("r")).select("r.*")


def as_of(rows: DataFrame, day: Column, cutoff: str) -> DataFrame:
    """Rows dated no later than the day; undated ones go."""
    return rows.filter(day.isNotNull() & (day <= F.lit(cutoff).cast("date")))


def as_of_tickets(tickets: DataFrame, changelog: DataFrame, created: DataFrame, cutoff: str) -> DataFrame:
    """tickets as they could have looked on the day: comments and attachments dated after it, or undated, go, as do remote links and
    the outcome fields; a link stays when the change log first shows it by then or, if it shows nothing, when the linked ticket was
    created by then.

    tickets: key, comments and attachments (arrays of structs with day), links (array of keys), remotelinks, resolution, status,
    fix_versions; changelog: key, linked, day; created: key, day.
    """
    day = F.lit(cutoff).cast("date")
    until = lambda c: F.filter(c, lambda x: x["day"].isNotNull() & (x["day"] <= day))
    added = changelog.groupBy("key", "linked").agg(F.min("day").alias("_added"))
    made = created.groupBy(F.col("key").alias("linked")).agg(F.min("day").alias("_made"))
    links = tickets.select("key", F.explode("links").alias("linked")).join(added, ["key", "linked"], "left").join(made, "linked", "left")
    kept = links.filter(F.coalesce("_added", "_made") <= day).groupBy("key").agg(F.array_sort(F.collect_set("linked")).alias("_links"))
    t = tickets.join(kept, "key", "left")
    gone = lambda c: F.lit(None).cast(tickets.schema[c].dataType).alias(c)
    new = {"comments": until("comments").alias("comments"), "attachments": until("attachments").alias("attachments"), "links": F.coalesce("_links", F.array().cast(tickets.schema["links"].dataType)).alias("links")}
    return t.select(*[new[c] if c in new else gone(c) if c in ("remotelinks", "resolution", "status", "fix_versions") else F.col(c) for c in tickets.columns])


def freshness(fetched: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """name, state of the newest copy of each dimension: ok, stale (older, or the last try failed), unavailable. fetched: name, at, ok."""
    good = fetched.groupBy("name").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("at"), F.max("at").alias("tried"))
    fresh = F.col("at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return good.select("name", F.when(F.col("at").isNull(), "unavailable").when(fresh & (F.col("tried") == F.col("at")), "ok").otherwise("stale").alias("state"))


def baseline_for(wanted: DataFrame, built: DataFrame, days: int = 7) -> DataFrame:
    """wanted (branch, tip, day) with the id of the baseline to use: of those under `days` old, the exact tip's, else the newest."""
    j = wanted.join(built, "branch").filter(F.datediff("day", "built").between(0, days - 1))
    order = F.struct((F.col("tip") == F.col("built_tip")).alias("exact"), F.col("built"), F.col("id"))
    return j.groupBy("branch", "tip", "day").agg(F.max_by("id", order).alias("baseline"))


def run_status(runs: DataFrame) -> DataFrame:
    """runs with status and reason, by precedence: a build that fails with errors has failed, one without is unknown (a missing
    artifact, the harness or the network are named); then failures, timeouts, environment artifacts, flaky tests, a run that failed
    without results or without a failing test, and missing coverage; only what is left passes.

    Columns: build_rc (null: no build), compile_errors, missing_artifact, harness, network, failures, timed_out, timeouts, artifacts,
    flaky, ran_tests, test_rc, run, coverage."""
    c = F.col
    broken, bad_rc = F.coalesce(c("build_rc") != 0, F.lit(False)), c("ran_tests") & F.coalesce(c("test_rc") != 0, F.lit(False))
    cases = [
        (broken & (c("compile_errors") > 0), "build-failed", "compile error"), (broken & c("missing_artifact"), "unknown", "an artifact was not found"), (broken & c("harness"), "unknown", "the harness refused the run"), (broken & c("network"), "unknown", "a resource could not be reached"),
        (broken, "unknown", "the build failed without a compile error"), (c("failures") > 0, "tests-failed", "failing tests"), (c("timed_out"), "timeout", "the run hit its time limit"), (c("timeouts") > 0, "timeout", "test classes timed out"),
        (c("artifacts") > 0, "unknown", "failures of the environment"), (c("flaky") > 0, "unknown", "failed once and passed on retry"), (bad_rc & (c("run") == 0), "unknown", "failed before any result"), (bad_rc, "unknown", "failed without a failing test"),
        (c("ran_tests") & ~c("coverage"), "unknown", "no coverage report"),
    ]
    pick = lambda k: F.coalesce(*[F.when(case[0], case[k]) for case in cases], F.lit("pass") if k == 1 else F.when(c("ran_tests"), "tests passed").otherwise("no tests were selected"))
    return runs.withColumn("status", pick(1)).withColumn("reason", pick(2))


def flaky_split(first: DataFrame, again: DataFrame) -> DataFrame:
    """first failures with kind: persistent where the retry fails too, flaky where it passes; classes missing from the retry stay failures."""
    bad = again.filter("NOT ok").select("cls", "test", F.lit(True).alias("_bad")).distinct()
    seen = again.select("cls", F.lit(True).alias("_seen")).distinct()
    j = first.filter("NOT ok").join(bad, ["cls", "test"], "left").join(seen, "cls", "left")
    return j.withColumn("kind", F.when(F.col("_bad"), "persistent").when(F.col("_seen"), "flaky").otherwise("persistent")).drop("_bad", "_seen")


def edit_decision(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """pr, action: create, unchanged or edit by marker and body with spaces collapsed; blocked where heads disagree."""
    same = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    j = wanted.join(existing.select("pr", F.col("body").alias("_b"), F.col("head").alias("_h")), "pr", "left")
    return j.select("pr", F.when(F.col("_b").isNull(), "create").when(F.col("_h") > F.col("head"), "blocked").when(same("body") == same("_b"), "unchanged").otherwise("edit").alias("action"))
