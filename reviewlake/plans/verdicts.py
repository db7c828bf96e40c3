"""Checks, verdicts, refresh and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import checks as C
from ..operators import refresh as R
from ..operators import report as M
from ..sources import records as S
from .catalog import query
from .changes import TRIAGE_SQL, rated
from .gates import RESULT_SQL, facts, flags, reviewed, reviews_of, statuses
from .scalar import KIND_SQL

WORST_SQL = RESULT_SQL + """, ws AS (SELECT pr, split_part(check_id, '.', 1) AS section, coalesce(first(status ORDER BY CASE status WHEN 'fail' THEN 0 WHEN 'unknown' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END) FILTER (status IN ('fail', 'unknown', 'warn', 'pass')), 'info') AS status, count(*) AS checks, count(*) FILTER (status = 'pass') AS passed FROM rs GROUP BY ALL)"""


@query(WORST_SQL + " SELECT * FROM ws")
def agg23_section_status(t):
    return C.worst(statuses(t))


VERDICT_SQL = RESULT_SQL + """, it AS (SELECT pr, count(*) FILTER (blocking AND status = 'fail' AND owner = 'contributor') AS cf, count(*) FILTER (blocking AND status = 'fail' AND owner <> 'contributor') AS nf, count(*) FILTER (status = 'warn' AND action_required AND owner = 'contributor') AS cw, count(*) FILTER (status = 'warn' AND action_required AND owner <> 'contributor') AS nw, count(*) FILTER (blocking AND status = 'unknown') AS un,
 coalesce(list_sort(list({'check_id': check_id, 'owner': owner}) FILTER (blocking AND status = 'fail' AND owner = 'contributor')), []) AS l1, coalesce(list_sort(list({'check_id': check_id, 'owner': owner}) FILTER (blocking AND status = 'fail' AND owner <> 'contributor')), []) AS l2, coalesce(list_sort(list({'check_id': check_id, 'owner': owner}) FILTER (status = 'warn' AND action_required AND owner = 'contributor')), []) AS l3,
 coalesce(list_sort(list({'check_id': check_id, 'owner': owner}) FILTER (status = 'warn' AND action_required AND owner <> 'contributor')), []) AS l4, coalesce(list_sort(list({'check_id': check_id, 'owner': owner}) FILTER (blocking AND status = 'unknown')), []) AS l5 FROM rs GROUP BY pr),
rv AS (SELECT pr, count(*) FILTER (severity IN ('blocker', 'major')) AS mf, count(DISTINCT lens) >= 3 AS complete, bool_and(idx % 5 <> 4) AS approved FROM {findings} GROUP BY pr),
vd AS (SELECT it.*, draft, coalesce(mf, 0) > 0 AS mf, CASE WHEN draft THEN 'draft' WHEN cf > 0 OR coalesce(mf, 0) > 0 THEN 'needs-contributor-work' WHEN cw > 0 THEN 'needs-work' WHEN un > 0 THEN 'insufficient-evidence' WHEN nf + nw > 0 THEN 'awaiting-review' WHEN NOT coalesce(complete, false) THEN 'requirements-met-unreviewed' WHEN NOT approved THEN 'needs-contributor-work' ELSE 'ready' END AS verdict FROM it JOIN {subjects} USING (pr) LEFT JOIN rv USING (pr)),
wl AS (SELECT pr, verdict, CASE WHEN draft OR cf > 0 OR mf THEN list_concat(l1, l2) WHEN verdict = 'needs-work' THEN list_concat(list_concat(l3, l2), l4) WHEN verdict = 'insufficient-evidence' THEN list_concat(l5, l2) WHEN verdict = 'awaiting-review' THEN list_concat(l2, l4) ELSE [] END AS items FROM vd)"""


@query(VERDICT_SQL + " SELECT pr, verdict, list_transform(items, lambda x: x.check_id) AS reasons, list_sort(list_distinct(list_transform(items, lambda x: x.owner))) AS waiting_on FROM wl")
def agg24_recommend(t):
    return C.recommend(flags(t), reviews_of(t))


GROUP_SQL = "CASE verdict WHEN 'draft' THEN 'draft' WHEN 'insufficient-evidence' THEN 'unknown' WHEN 'ready' THEN 'ready' WHEN 'needs-contributor-work' THEN 'contributor' WHEN 'needs-work' THEN 'contributor' ELSE 'reviewers' END"


@query(VERDICT_SQL + f" SELECT {GROUP_SQL} AS acts, count(*) AS changes, max(pr) AS newest FROM wl GROUP BY 1")
def agg39_out7_index_groups(t):
    r = C.recommend(flags(t), reviews_of(t))
    return r.groupBy(C.next_to_act(F.col("verdict")).alias("acts")).agg(F.count(F.lit(1)).alias("changes"), F.max("pr").alias("newest"))


STEP = "CASE max(CASE status WHEN 'fail' THEN 2 WHEN 'unknown' THEN 1 WHEN 'warn' THEN 1 ELSE 0 END) FILTER (section IN ({0})) WHEN 2 THEN 'bad' WHEN 1 THEN 'unknown' ELSE 'ok' END"


@query(WORST_SQL + f""", st AS (SELECT pr, {STEP.format("'jira', 'branches'")} AS ticket, {STEP.format("'static', 'compat', 'commits', 'commit', 'changelog'")} AS code, {STEP.format("'tests', 'build'")} AS tests, {STEP.format("'ci'")} AS ci0, {STEP.format("'votes'")} AS votes0 FROM ws GROUP BY pr)
SELECT pr, ticket, code, tests, CASE WHEN 'bad' IN (ticket, code, tests) THEN 'later' ELSE ci0 END AS ci, CASE WHEN 'bad' IN (ticket, code, tests) THEN 'later' ELSE votes0 END AS votes FROM st""")
def agg36_progress(t):
    return C.progress(C.worst(statuses(t)))


def report_model(t, words=True):
    """The nested model of each change; the row of a change's facts, with its checks, is where lists of its files, commits and reviews meet. Without
    `words` checks have their flags alone, and facts that only words read aren't made."""
    f = facts(t, None if words else C.asked())
    said = C.in_rows(f, words=words).select("pr", "title", "author", "base", "head", "draft", F.array_sort("checks").alias("checks"))
    verdicts = C.decided(reviewed(said, t))
    changes = verdicts.select(*said.columns, F.struct("verdict", "reasons", "waiting_on").alias("recommendation"))
    files = t("touched").select("pr", "path", "additions", "deletions", P.file_kind(F.col("path")).alias("kind"))
    commits = t("change_commits").select("pr", "idx", F.split_part("message", F.lit("\n"), F.lit(1)).alias("subject"))
    approved = t("approvals").filter("source = 'review'").select("pr", "made", "seq", "who")
    lists = {"files": (files, ["path", "additions", "deletions"]), "commits": (commits, ["idx", "subject"]), "reviews": (approved, ["made", "seq"])}
    return M.model(changes, lists, {"triage": rated(t).select("pr", "rating", "points"), "build": t("builds").select("pr", "status")})


MODEL_SQL = VERDICT_SQL + f""", m1 AS (SELECT pr, array_to_string(list(path || ' ' || kind || ' +' || additions || '-' || deletions ORDER BY path, additions, deletions), '|') AS files FROM (SELECT *, {KIND_SQL} AS kind FROM {{touched}}) GROUP BY pr), m2 AS (SELECT pr, array_to_string(list(idx || ' ' || split_part(message, chr(10), 1) ORDER BY idx, message), '|') AS commits FROM {{change_commits}} GROUP BY pr),
m3 AS (SELECT pr, array_to_string(list(who ORDER BY made, seq), '|') AS reviews FROM {{approvals}} WHERE source = 'review' GROUP BY pr), m4 AS (SELECT pr, array_to_string(list(check_id || '=' || status ORDER BY check_id), '|') AS checks FROM rs GROUP BY pr), m5 AS ({TRIAGE_SQL} SELECT pr, CASE WHEN serial THEN 'hard' WHEN points >= 5 AND lines < 50 THEN 'moderate' WHEN points >= 5 THEN 'hard' WHEN points >= 2 THEN 'moderate' ELSE 'easy' END AS rating FROM pt)"""


@query(MODEL_SQL + " SELECT pr, author, base, head, rating, verdict, coalesce(files, '') AS files, coalesce(commits, '') AS commits, coalesce(reviews, '') AS reviews, checks FROM {subjects} LEFT JOIN m1 USING (pr) LEFT JOIN m2 USING (pr) LEFT JOIN m3 USING (pr) LEFT JOIN m4 USING (pr) LEFT JOIN m5 USING (pr) LEFT JOIN wl USING (pr)")
def out1_report_rows(t):
    m = report_model(t, words=False)
    bars = lambda c, text: F.array_join(F.transform(c, text), "|").alias(c)
    return m.select(
        "pr", "author", "base", "head", "triage.rating", "recommendation.verdict", bars("files", lambda x: F.concat(x["path"], F.lit(" "), x["kind"], F.lit(" +"), x["additions"].cast("string"), F.lit("-"), x["deletions"].cast("string"))), bars("commits", lambda x: F.concat(x["idx"].cast("string"), F.lit(" "), x["subject"])),
        bars("reviews", lambda x: x["who"]), bars("checks", lambda x: F.concat(x["check_id"], F.lit("="), x["status"])),
    )


@query(f"""WITH m5 AS ({TRIAGE_SQL} SELECT pr FROM pt) SELECT pr, CASE WHEN title IS NULL THEN 'invalid: title' WHEN NOT (length(head) IN (32, 40) AND regexp_full_match(head, '[0-9a-f]+')) THEN 'invalid: head' WHEN pr NOT IN (SELECT pr FROM m5) THEN 'invalid: triage.rating' END AS error FROM {{subjects}}""")
def out2_validated(t):
    return M.validated(report_model(t)).select("pr", "error")


@query("SELECT metric, max(v) FILTER (panel = 'src1') AS src1, max(v) FILTER (panel = 'src2') AS src2 FROM (UNPIVOT (SELECT lens AS panel, count(*) AS findings, count(DISTINCT pr) AS changes, count(*) FILTER (severity = 'blocker') AS blockers FROM {findings} WHERE lens IN ('src1', 'src2') GROUP BY lens) ON findings, changes, blockers INTO NAME metric VALUE v) GROUP BY metric")
def out6_comparison(t):
    f = t("findings").filter("lens IN ('src1', 'src2')")
    g = f.groupBy(F.col("lens").alias("panel")).agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("pr").alias("changes"), F.count(F.when(F.col("severity") == "blocker", 1)).alias("blockers"))
    return g.unpivot("panel", ["findings", "changes", "blockers"], "metric", "v").groupBy("metric").pivot("panel", ["src1", "src2"]).agg(F.max("v"))


# -- refresh

PUBLISHED = "SELECT pr, CASE WHEN pr % 3 = 0 THEN head ELSE 'old' END AS head FROM {changes} WHERE pr % 2 = 0"


@query(f"""WITH j AS (SELECT c.pr, c.head, draft, updated_at, p.head AS ph FROM {{changes}} c LEFT JOIN ({PUBLISHED}) p USING (pr)), k AS (SELECT *, CASE WHEN draft AND updated_at < TIMESTAMP '1999-01-01' - INTERVAL 30 DAY THEN 'stale draft' WHEN ph = head THEN 'current head' END AS skip FROM j),
r AS (SELECT *, CASE WHEN skip IS NULL THEN row_number() OVER (PARTITION BY skip IS NULL ORDER BY updated_at DESC NULLS LAST, pr) END AS n FROM k)
SELECT pr, coalesce(n <= 25, false) AS picked, coalesce(skip, CASE WHEN n > 25 THEN 'over the cap' END, CASE WHEN ph IS NULL THEN 'no published report' ELSE 'new head' END) AS reason FROM r""")
def win6_picks(t):
    c = t("changes")
    pub = c.filter("pr % 2 = 0").select("pr", F.when(F.col("pr") % 3 == 0, F.col("head")).otherwise("old").alias("head"))
    return R.picks(c.select("pr", "head", "draft", "updated_at"), pub, "1999-01-01").select("pr", "picked", "reason")


@query(f"""WITH j AS (SELECT c.pr, c.head, draft, updated_at, p.head AS ph FROM {{changes}} c LEFT JOIN ({PUBLISHED}) p USING (pr)), k AS (SELECT *, CASE WHEN draft AND updated_at < TIMESTAMP '1999-01-01' - INTERVAL 30 DAY THEN 'stale draft' WHEN ph = head THEN 'current head' END AS skip FROM j) SELECT skip AS reason, count(*) AS changes FROM k WHERE skip IS NOT NULL GROUP BY skip""")
def agg25_skip_reasons(t):
    return win6_picks(t).filter(F.col("reason").isin("stale draft", "current head")).groupBy("reason").agg(F.count(F.lit(1)).alias("changes"))


ARRIVALS = "SELECT user_id AS pr, concat('h', CAST(CAST(floor(event_id / 900) AS BIGINT) % 3 AS STRING)) AS head, event_type = 'purchase' AS has_results, event_id AS seq FROM {events}"


@query("""WITH a AS (SELECT user_id AS pr, 'h' || (CAST(floor(event_id / 900) AS BIGINT) % 3) AS head, event_type = 'purchase' AS has_results, event_id AS seq FROM events), b AS (SELECT *, lag(head) OVER (PARTITION BY pr ORDER BY seq) IS DISTINCT FROM head AS fresh FROM a), c AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY pr ORDER BY seq) AS run FROM b)
SELECT pr, head, has_results, seq FROM c QUALIFY row_number() OVER (PARTITION BY pr ORDER BY run DESC, has_results DESC, seq DESC) = 1""")
def str3_keep_richer(t):
    a = t("events").selectExpr("user_id AS pr", "concat('h', CAST(floor(event_id / 900) AS BIGINT) % 3) AS head", "event_type = 'purchase' AS has_results", "event_id AS seq")
    return R.keep_richer(a)


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-10'")
def snap1_as_of(t):
    return R.as_of(t("events"), F.to_date("ts"), "2024-01-10").select("event_id", "user_id")


DATED = "SELECT concat('PROJ-', CAST(user_id AS STRING)) AS key, CAST(event_id AS BIGINT) AS n, CASE WHEN event_id % 9 <> 0 THEN CAST(ts AS DATE) END AS day, event_type AS kind, concat('PROJ-', CAST(event_id % 60 AS STRING)) AS linked FROM {events}"


@query(f"""WITH d AS ({DATED.replace('{events}', 'events')}), k AS (SELECT DISTINCT key FROM d), l AS (SELECT DISTINCT key, linked FROM d WHERE n % 2 = 0), g AS (SELECT key, linked, min(day) AS added FROM d WHERE n % 3 = 0 GROUP BY ALL), m AS (SELECT key AS linked, min(day) AS made FROM d GROUP BY key)
SELECT key, coalesce((SELECT list_sort(list(n)) FROM d WHERE d.key = k.key AND kind = 'view' AND day <= DATE '2024-01-10'), [])::VARCHAR AS comments, (SELECT count(*) FROM d WHERE d.key = k.key AND kind = 'click' AND day <= DATE '2024-01-10') AS attachments,
 coalesce((SELECT array_to_string(list_sort(list(linked)), '|') FROM (SELECT l.linked FROM l LEFT JOIN g USING (key, linked) LEFT JOIN m ON m.linked = l.linked WHERE l.key = k.key AND coalesce(added, made) <= DATE '2024-01-10')), '') AS links, NULL::VARCHAR AS status FROM k""")
def snap1_as_of_tickets(t):
    e = t("events")
    d = e.sparkSession.sql(DATED, events=e)
    item = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "day")))
    tickets = d.groupBy("key").agg(item("view").alias("comments"), item("click").alias("attachments"), F.collect_set(F.when(F.col("n") % 2 == 0, F.col("linked"))).alias("links"), F.collect_set("kind").alias("remotelinks"), F.max("kind").alias("resolution"), F.max("kind").alias("status"), F.collect_set("kind").alias("fix_versions"))
    out = R.as_of_tickets(tickets, d.filter("n % 3 = 0").select("key", "linked", "day"), d.select("key", "day"), "2024-01-10")
    shown = F.concat(F.lit("["), F.array_join(F.array_sort(F.transform("comments", lambda c: c["n"])).cast("array<string>"), ", "), F.lit("]"))
    return out.select("key", shown.alias("comments"), F.size("attachments").cast("long").alias("attachments"), F.array_join("links", "|").alias("links"), "status")


@query("""WITH f AS (SELECT 'd' || user_id AS name, ts AS ta, event_type <> 'error' AS ok FROM events), g AS (SELECT name, max(ta) FILTER (ok) AS ta, max(ta) AS tried FROM f GROUP BY name)
SELECT name, CASE WHEN ta IS NULL THEN 'unavailable' WHEN ta >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AND tried = ta THEN 'ok' ELSE 'stale' END AS state FROM g""")
def snap2_freshness(t):
    return R.freshness(t("events").selectExpr("concat('d', user_id) AS name", "ts AS at", "event_type <> 'error' AS ok"), "2024-01-30")


@query("""WITH b AS (SELECT o_orderkey AS id, o_orderpriority AS branch, 't' || (o_custkey % 5) AS built_tip, CAST(o_orderdate AS DATE) AS built FROM orders), w AS (SELECT DISTINCT o_orderpriority AS branch, 't1' AS tip, DATE '1998-03-01' AS day FROM orders)
SELECT w.branch, tip, day, arg_max(id, {'e': tip = built_tip, 'b': built, 'i': id}) AS baseline FROM w JOIN b ON w.branch = b.branch AND day - built BETWEEN 0 AND 6 GROUP BY ALL""")
def win7_baseline(t):
    o = t("orders")
    built = o.selectExpr("o_orderkey AS id", "o_orderpriority AS branch", "concat('t', o_custkey % 5) AS built_tip", "CAST(o_orderdate AS DATE) AS built")
    want = o.selectExpr("o_orderpriority AS branch", "'t1' AS tip", "DATE '1998-03-01' AS day").distinct()
    return R.baseline_for(want, built)


RUNS = """SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 0 END AS build_rc, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS compile_errors, user_id % 3 = 0 AS missing_artifact, user_id % 4 = 0 AS harness, user_id % 5 = 0 AS network, CASE WHEN user_id % 7 = 0 THEN 2 ELSE 0 END AS failures, event_id % 23 = 0 AS timed_out,
 CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS timeouts, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS artifacts, CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS flaky, event_id % 5 <> 0 AS ran_tests, CASE WHEN event_id % 17 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 0 END AS test_rc, user_id % 6 AS run, event_id % 31 <> 0 AS coverage FROM {events}"""


@query(f"""SELECT event_id, CASE WHEN build_rc = 1 THEN CASE WHEN compile_errors = 1 THEN 'build-failed' ELSE 'unknown' END WHEN failures > 0 THEN 'tests-failed' WHEN timed_out OR timeouts > 0 THEN 'timeout' WHEN artifacts > 0 OR flaky > 0 OR (ran_tests AND (coalesce(test_rc, 0) <> 0 OR NOT coverage)) THEN 'unknown' ELSE 'pass' END AS status,
 CASE WHEN build_rc = 1 THEN CASE WHEN compile_errors = 1 THEN 'compile error' WHEN missing_artifact THEN 'an artifact was not found' WHEN harness THEN 'the harness refused the run' WHEN network THEN 'a resource could not be reached' ELSE 'the build failed without a compile error' END WHEN failures > 0 THEN 'failing tests' WHEN timed_out THEN 'the run hit its time limit' WHEN timeouts > 0 THEN 'test classes timed out'
 WHEN artifacts > 0 THEN 'failures of the environment' WHEN flaky > 0 THEN 'failed once and passed on retry' WHEN ran_tests AND test_rc = 1 THEN CASE WHEN run = 0 THEN 'failed before any result' ELSE 'failed without a failing test' END WHEN ran_tests AND NOT coverage THEN 'no coverage report' WHEN ran_tests THEN 'tests passed' ELSE 'no tests were selected' END AS reason FROM ({RUNS.format(events='events')})""")
def agg19_run_status(t):
    e = t("events")
    return R.run_status(e.sparkSession.sql(RUNS, events=e)).select("event_id", "status", "reason")


@query("""WITH f AS (SELECT DISTINCT user_id AS cls, event_id % 40 AS test FROM events WHERE event_type = 'error'), a AS (SELECT user_id AS cls, event_id % 40 AS test, event_type <> 'view' AS ok FROM events WHERE user_id % 2 = 0)
SELECT cls, test, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.cls = f.cls AND a.test = f.test AND NOT ok) THEN 'persistent' WHEN EXISTS (SELECT 1 FROM a WHERE a.cls = f.cls) THEN 'flaky' ELSE 'persistent' END AS kind FROM f""")
def jon25_flaky_split(t):
    e = t("events")
    first = e.filter("event_type = 'error'").selectExpr("user_id AS cls", "event_id % 40 AS test", "false AS ok").distinct()
    again = e.filter("user_id % 2 = 0").selectExpr("user_id AS cls", "event_id % 40 AS test", "event_type <> 'view' AS ok")
    return R.flaky_split(first, again).select("cls", "test", "kind")


@query("SELECT pr, CASE WHEN pr % 4 = 3 THEN 'create' WHEN pr % 8 = 0 THEN 'blocked' WHEN pr % 4 = 1 THEN 'unchanged' ELSE 'edit' END AS action FROM {changes}")
def str6_edit_decision(t):
    c = t("changes")
    want = c.select("pr", F.lit("h1").alias("head"), F.concat(F.lit("a  b "), "author").alias("body"))
    have = c.filter("pr % 4 <> 3").select("pr", F.when(F.col("pr") % 8 == 0, "h2").otherwise("h1").alias("head"), F.when(F.col("pr") % 4 == 1, F.concat(F.lit("a b  "), "author")).otherwise("other").alias("body"))
    return R.edit_decision(want, have)


@query("SELECT pr, base AS missing FROM (SELECT DISTINCT pr, b AS base FROM {changes}, (VALUES ('trunk'), ('project-4.1')) w(b)) EXCEPT SELECT pr, base FROM {changes}")
def set2_missing_branches(t):
    c = t("changes")
    want = c.select("pr", F.explode(F.array(F.lit("trunk"), F.lit("project-4.1"))).alias("missing"))
    return want.subtract(c.select("pr", F.col("base").alias("missing")))


@query("SELECT pr, replace(to_json({'pr': pr, 'title': title}), '<', '\\u003c') AS doc FROM {changes} WHERE title IS NOT NULL")
def snk1_model_json(t):
    return t("changes").filter("title IS NOT NULL").select("pr", S.model_json("pr", "title").alias("doc"))


@query("""WITH s AS (SELECT user_id % 2 AS pair, CASE event_id % 2 WHEN 0 THEN 'base' ELSE 'head' END AS arm, value FROM events), g AS (SELECT pair, round(quantile_cont(value, 0.99) FILTER (arm = 'base'), 6) AS base, round(quantile_cont(value, 0.99) FILTER (arm = 'head'), 6) AS head FROM s GROUP BY pair)
SELECT pair, base, head, head <= base + 2 * 0.5 AS ok, bool_and(head <= base + 2 * 0.5) OVER () AS all_ok FROM g""")
def agg42_ab_decision(t):
    s = t("events").select((F.col("user_id") % 2).alias("pair"), F.when(F.col("event_id") % 2 == 0, "base").otherwise("head").alias("arm"), "value")
    g = s.groupBy("pair").pivot("arm", ["base", "head"]).agg(F.round(F.expr("percentile(value, 0.99)"), 6))
    ok = F.col("head") <= F.col("base") + 2 * 0.5
    total = g.agg(F.bool_and(ok).alias("all_ok"))
    return g.withColumn("ok", ok).join(F.broadcast(total))
