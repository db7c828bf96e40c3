"""Changes: keys, siblings, branches, CI, triage, rankings and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import changes as C
from ..operators import joins as J
from ..operators import ranking as R
from .catalog import query
from .scalar import KIND_SQL, RESOLVED_SQL

HINTS = [(r"3\.0", "project-3.0"), (r"3\.11", "project-3.11"), (r"4\.0", "project-4.0"), (r"4\.1", "project-4.1")]
HINT_SQL = "CASE WHEN contains(ref, '3.0') THEN 'project-3.0' WHEN contains(ref, '3.11') THEN 'project-3.11' WHEN contains(ref, '4.0') THEN 'project-4.0' WHEN contains(ref, '4.1') THEN 'project-4.1' END"
SURFACES_SQL = "list_sort(list_filter([CASE WHEN contains(path, '/net/') THEN 'network' END, CASE WHEN contains(path, '/db/') THEN 'storage' END, CASE WHEN starts_with(path, 'conf/') THEN 'config' END, CASE WHEN starts_with(path, 'pylib/') THEN 'tools' END], lambda x: x IS NOT NULL))"
COUNTED_SQL = r"NOT (regexp_matches(path, '^src/gen-java/|/gen/|\.(db|bin)$') OR regexp_matches(path, '^test/(resources|data|conf)/') OR bin)"
PROD_SQL = "regexp_matches(path, '^(src/java|pylib)/')"


def keyed(t):
    none = F.array().cast("array<string>")
    return t("changes").withColumn("key", X.key_struct(F.col("title"), F.col("branch"), F.col("body"), none)["key"])


@query(RESOLVED_SQL + " SELECT pr, key, count(*) OVER (PARTITION BY key) AS size, min(pr) OVER (PARTITION BY key) AS first FROM k2 WHERE key IS NOT NULL")
def jon4_ticket_groups(t):
    return C.ticket_groups(keyed(t)).select("pr", "key", "size", "first")


@query(RESOLVED_SQL + " SELECT a.pr, a.key, b.pr AS sibling, a.pr = b.pr AS is_self FROM k2 a JOIN k2 b ON a.key = b.key WHERE a.pr % 20 = 0")
def jon4_siblings(t):
    c = keyed(t)
    return C.siblings_of(c.filter("pr % 20 = 0"), c).select("pr", "key", "sibling", "is_self")


@query(RESOLVED_SQL + """, s AS (SELECT a.pr, b.pr AS sibling, c.base, c.state FROM k2 a JOIN k2 b ON a.key = b.key JOIN {changes} c ON c.pr = b.pr WHERE a.pr = b.pr OR c.state = 'O')
SELECT pr, base, first(sibling ORDER BY sibling <> pr, sibling) AS sibling FROM s GROUP BY pr, base""")
def jon7_targeted_branches(t):
    return C.targeted_branches(keyed(t))


@query(f"WITH h AS (SELECT head AS sha, min(base) AS b FROM {{changes}} GROUP BY head) SELECT seq, coalesce(b, {HINT_SQL}) AS target_branch, CASE WHEN b IS NOT NULL THEN 'head' WHEN {HINT_SQL} IS NOT NULL THEN 'name' END AS mapped_by FROM {{ci_runs}} LEFT JOIN h USING (sha)")
def jon5_map_ci(t):
    return C.map_ci(t("ci_runs"), t("changes"), HINTS).select("seq", "target_branch", "mapped_by")


LATEST_SQL = f"""WITH h AS (SELECT head AS sha, min(base) AS b FROM {{changes}} GROUP BY head), m AS (SELECT seq, pr, sha, created, failed, coalesce(b, {HINT_SQL}) AS target_branch FROM {{ci_runs}} LEFT JOIN h USING (sha)),
l AS (SELECT * FROM m WHERE target_branch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pr, target_branch ORDER BY created DESC, seq) = 1)"""


@query(LATEST_SQL + " SELECT pr, target_branch, seq, failed FROM l")
def win2_latest_ci(t):
    return C.latest_ci(C.map_ci(t("ci_runs"), t("changes"), HINTS)).select("pr", "target_branch", "seq", "failed")


@query(LATEST_SQL + """, o(b, ord) AS (VALUES ('project-3.0', 1), ('project-3.11', 2), ('project-4.0', 3), ('project-4.1', 4)), r AS (SELECT c.pr, c.base, l.seq, l.failed, l.sha IS NOT DISTINCT FROM c.head AS sha_matches, coalesce(ord, 99) AS ord FROM {changes} c LEFT JOIN l ON l.pr = c.pr AND l.target_branch = c.base LEFT JOIN o ON o.b = c.base)
SELECT pr, base, seq, failed, CASE WHEN seq IS NOT NULL THEN sha_matches END AS sha_matches, ord FROM r""")
def jon6_win14_branch_matrix(t):
    runs = C.latest_ci(C.map_ci(t("ci_runs"), t("changes"), HINTS)).select("pr", F.col("target_branch").alias("base"), "seq", "failed", "sha")
    order = F.coalesce(*[F.when(F.col("base") == b, k) for k, b in enumerate(("project-3.0", "project-3.11", "project-4.0", "project-4.1"), 1)], F.lit(99))
    out = t("changes").select("pr", "base", "head").join(runs, ["pr", "base"], "left")
    return out.select("pr", "base", "seq", "failed", F.when(F.col("seq").isNotNull(), F.col("sha").eqNullSafe(F.col("head"))).alias("sha_matches"), order.alias("ord"))


TRIAGE_SQL = RESOLVED_SQL + f""", tb AS (SELECT a.pr, count(DISTINCT c.base) AS branches FROM k2 a JOIN k2 b ON a.key = b.key JOIN {{changes}} c ON c.pr = b.pr WHERE a.pr = b.pr OR c.state = 'O' GROUP BY a.pr),
fl AS (SELECT pr, path, additions + deletions AS n, {COUNTED_SQL} AS ok, {PROD_SQL} AS prod, {SURFACES_SQL} AS sf, CASE WHEN contains(path, 'org/project/') THEN CASE WHEN contains(split_part(path, 'org/project/', 2), '/') THEN split_part(split_part(path, 'org/project/', 2), '/', 1) ELSE '(root)' END END AS ss FROM {{changed_files}}),
ag AS (SELECT pr, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS lines, count(*) FILTER (ok) AS files, coalesce(sum(n) FILTER (ok AND prod), 0)::BIGINT AS prod_lines, count(*) FILTER (ok AND prod) AS prod_files, coalesce(list_sort(list(DISTINCT ss) FILTER (ok AND prod AND ss IS NOT NULL)), []) AS subsystems,
 list_sort(list_distinct(flatten(list(sf)))) AS surfaces, bool_or(ok AND starts_with(path, 'src/java/org/project/concurrent/')) AS conc, bool_or(starts_with(path, 'test/')) AS has_tests, bool_or(contains(path, '/db/blue_') AND prod) AS serial FROM fl GROUP BY pr),
pt AS (SELECT ag.*, coalesce(branches, 1) AS br, (CASE WHEN lines > 1000 THEN 4 WHEN lines > 400 THEN 2 WHEN lines > 100 THEN 1 ELSE 0 END + CASE WHEN files > 30 THEN 2 WHEN files > 10 THEN 1 ELSE 0 END + CASE WHEN len(subsystems) > 4 THEN 2 WHEN len(subsystems) > 2 THEN 1 ELSE 0 END
 + len(surfaces) + len(list_intersect(surfaces, ['network', 'storage'])) + CASE WHEN conc THEN 2 ELSE 0 END + CASE WHEN coalesce(branches, 1) > 2 THEN 1 ELSE 0 END + CASE WHEN prod_files > 0 AND NOT has_tests THEN 1 ELSE 0 END)::BIGINT AS points FROM ag LEFT JOIN tb USING (pr))"""


def rated(t):
    target = C.targeted_branches(keyed(t)).groupBy("pr").agg(F.count(F.lit(1)).alias("branches"))
    s = C.triage_signals(t("changed_files")).join(target, "pr", "left").fillna({"branches": 1})
    return C.triage_rating(s)


@query(TRIAGE_SQL + " SELECT pr, lines, files, prod_lines, subsystems, surfaces, has_tests, points, CASE WHEN serial THEN 'hard' WHEN points >= 5 AND lines < 50 THEN 'moderate' WHEN points >= 5 THEN 'hard' WHEN points >= 2 THEN 'moderate' ELSE 'easy' END AS rating, prod_lines > 1000 AS split FROM pt")
def agg1_agg2_triage(t):
    return rated(t).select("pr", "lines", "files", "prod_lines", "subsystems", "surfaces", "has_tests", "points", "rating", "split")


@query(f"""WITH x AS (SELECT pr, path, additions * 20 + deletions AS n, bin FROM {{changed_files}}), f AS (SELECT pr, path, sum(n)::BIGINT AS lines FROM x WHERE {COUNTED_SQL} GROUP BY ALL), b AS (SELECT pr FROM x WHERE {COUNTED_SQL} AND {PROD_SQL} GROUP BY pr HAVING sum(n) > 1000)
SELECT pr, path, lines, row_number() OVER (PARTITION BY pr ORDER BY lines DESC, path) AS rank FROM f JOIN b USING (pr) QUALIFY rank <= 5""")
def agg3_win1_split_advice(t):
    return C.split_advice(t("changed_files").withColumn("additions", F.col("additions") * 20))


@query(r"WITH s AS (SELECT pr, coalesce(sum(additions + deletions) FILTER (regexp_matches(path, '\.(java|py|g|sh|xml|yaml)$') AND NOT starts_with(path, 'test/')), 0)::BIGINT AS lines FROM {changed_files} GROUP BY pr) SELECT pr, lines, CASE WHEN lines = 0 THEN 'none' WHEN lines < 50 THEN 'small' WHEN lines > 1000 THEN 'large' ELSE 'medium' END AS tier FROM s")
def agg4_tier(t):
    return C.review_tier(t("changed_files"))


@query(f"""WITH f AS (SELECT pr, path, sum(additions + deletions)::BIGINT AS lines FROM {{changed_files}} WHERE regexp_matches(path, '\\.(java|py|g|sh|xml|yaml)$') GROUP BY ALL),
r AS (SELECT *, round_even(lines * (1 + CASE WHEN len({SURFACES_SQL}) > 0 THEN 2.0 ELSE 0 END + CASE WHEN starts_with(path, 'src/java/org/project/concurrent/') THEN 1.5 ELSE 0 END + CASE WHEN contains(path, '/db/blue_') THEN 2.0 ELSE 0 END)::DOUBLE, 1) AS risk FROM f)
SELECT pr, path, lines, risk, row_number() OVER (PARTITION BY pr ORDER BY risk DESC, path) AS rank, rank <= 15 AS focus FROM r""")
def agg5_win15_risk_ranking(t):
    return C.risk_ranked(t("changed_files"))


@query(f"""SELECT pr, coalesce(sum(additions + deletions) FILTER ({PROD_SQL}), 0)::BIGINT AS prod, coalesce(sum(additions + deletions) FILTER ({KIND_SQL} = 'test'), 0)::BIGINT AS test,
 count(DISTINCT path) FILTER (starts_with(path, 'test/unit/')) AS unit, count(DISTINCT path) FILTER (starts_with(path, 'test/distributed/')) AS distributed FROM {{changed_files}} GROUP BY pr""")
def agg7_test_ratio(t):
    p, n = F.col("path"), F.col("additions") + F.col("deletions")
    files = t("changed_files")
    return files.groupBy("pr").agg(F.coalesce(F.sum(F.when(P.is_prod(p), n)), F.lit(0)).alias("prod"), F.coalesce(F.sum(F.when(P.file_kind(p) == "test", n)), F.lit(0)).alias("test"), F.count_distinct(F.when(P.test_suite(p) == "unit", p)).alias("unit"), F.count_distinct(F.when(P.test_suite(p) == "distributed", p)).alias("distributed"))


PARTS = "SELECT user_id AS pr, concat(CASE event_type WHEN 'view' THEN 'src/java/' WHEN 'click' THEN 'test/' ELSE 'doc/' END, CAST(event_id % 40 AS STRING)) AS path, CAST(event_id AS BIGINT) AS start, CAST(event_id % 9 AS INT) AS additions, 1 AS deletions FROM {events}"
PART_SQL = f"WITH p AS ({PARTS.replace('{events}', 'events')}), s AS (SELECT pr, path, sum(additions + deletions) AS size FROM p GROUP BY ALL), {{0}} SELECT *, rank <= {{1}} AS taken, greatest(0, count(*) OVER (PARTITION BY pr) - {{1}}) AS skipped FROM r"


def parts(t):
    e = t("events")
    return e.sparkSession.sql(PARTS, events=e)


@query(PART_SQL.format("r AS (SELECT p.pr, p.path, start, row_number() OVER (PARTITION BY p.pr ORDER BY starts_with(p.path, 'src/java/') DESC, size DESC, p.path, start) AS rank FROM p JOIN s ON p.pr = s.pr AND p.path = s.path)", 300))
def win3_hunks(t):
    p = parts(t)
    return C.selected_parts(p.select("pr", "path", "start"), p, 300)


@query(PART_SQL.format("r AS (SELECT pr, path, row_number() OVER (PARTITION BY pr ORDER BY starts_with(path, 'src/java/') DESC, size DESC, path) AS rank FROM s)", 25))
def win3_files(t):
    p = parts(t)
    return C.selected_parts(p.select("pr", "path").distinct(), p, 25)


@query("""WITH c AS (SELECT pr, rule, count(*) AS n FROM {violations} GROUP BY ALL), w AS (SELECT *, coalesce(sum(least(3, n)) OVER (PARTITION BY pr ORDER BY rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT pr, rule, n, greatest(0, least(least(3, n), 5 - before))::BIGINT AS shown FROM w""")
def win4_win5_running_budget(t):
    c = t("violations").groupBy("pr", "rule").agg(F.count(F.lit(1)).alias("n"))
    return R.running_budget(c, ["pr"], [F.col("rule").asc()], F.col("n"), 3, 5)


@query("SELECT kind, login, seq, ts, row_number() OVER (PARTITION BY kind, login ORDER BY ts DESC, seq) AS rank, rank > 5 AS pruned FROM {reviews}")
def win8_keep_newest(t):
    out = R.ranked(t("reviews").select("kind", "login", "seq", "ts"), ["kind", "login"], [F.col("ts").desc(), F.col("seq").asc()])
    return out.withColumn("pruned", F.col("rank") > 5)


@query("WITH s AS (SELECT user_id AS pr, event_id AS test, event_id * 7 % 100 AS score, user_id % 2 = 0 AND event_type = 'view' AS own FROM events), w AS (SELECT *, bool_or(own) OVER (PARTITION BY pr) AS brings FROM s) SELECT pr, test, score, row_number() OVER (PARTITION BY pr ORDER BY score DESC, test) AS rank FROM w WHERE score >= 15 QUALIFY rank <= CASE WHEN brings THEN 30 ELSE 25 END")
def win9_capped_tests(t):
    s = t("events").selectExpr("user_id AS pr", "event_id AS test", "event_id * 7 % 100 AS score", "user_id % 2 = 0 AND event_type = 'view' AS own")
    return C.capped_tests(s, "pr", "own").select("pr", "test", "score", "rank")


FLAT = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"
BUDGETS = ", ".join(f"array_to_string(list_transform(lines, lambda x: CASE WHEN length({FLAT}) <= {n} THEN {FLAT} ELSE rtrim(substr({FLAT}, 1, {n - 1})) || '…' END), chr(10)) AS b{n}" for n in (300, 200, 140, 100, 60))


@query(f"WITH d AS (SELECT lang, doc_id // 40 AS g, list(text ORDER BY doc_id) AS lines FROM documents GROUP BY ALL), b AS (SELECT lang, g, {BUDGETS} FROM d) SELECT lang, g, {{0}}::INT AS most, md5({{1}}) AS body FROM b".replace("{0}", "CASE " + " ".join(f"WHEN length(b{n}) <= 1500 THEN {n}" for n in (300, 200, 140, 100, 60)) + " END").replace("{1}", "CASE " + " ".join(f"WHEN length(b{n}) <= 1500 THEN b{n}" for n in (300, 200, 140, 100, 60)) + " END"))
def win16_text_budget(t):
    d = t("documents").groupBy("lang", F.expr("doc_id div 40").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]).alias("lines"))
    most, body = C.text_budget(F.col("lines"))
    return d.select("lang", "g", most.alias("most"), F.md5(body.cast("binary")).alias("body"))
