"""Diffs, logs, JSON, pages: landed text to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import diffs as D
from ..shared import new_path
from ..sources import landing as L
from ..sources import records as S
from .catalog import query

FILE = "'f' || (pr % 7) || '.java'"
CUST = "(SELECT o_orderkey AS pr, o_custkey AS c FROM orders)"


@query(f"""SELECT pr, {FILE} AS path, line_no, text, new_file FROM (SELECT pr, 1::BIGINT AS line_no, '++ first' AS text, true AS new_file FROM {CUST} WHERE pr % 5 = 0 UNION ALL SELECT pr, 2, CAST(c AS VARCHAR), true FROM {CUST} WHERE pr % 5 = 0
 UNION ALL SELECT pr, c + 11, 'new ' || c, false FROM {CUST} WHERE pr % 5 > 1 UNION ALL SELECT pr, c + 12, 'more', false FROM {CUST} WHERE pr % 5 > 1 UNION ALL SELECT pr, c + 42, 'inserted', false FROM {CUST} WHERE pr % 5 > 1)""")
def src16_added_lines(t):
    return D.added_lines(D.diff_lines(t("diffs")))


@query(f"""SELECT pr, {FILE} AS path, start, "end", kind, lines FROM (SELECT pr, 1::BIGINT AS start, 2::BIGINT AS "end", 'changed' AS kind, 2::BIGINT AS lines FROM {CUST} WHERE pr % 5 = 1 UNION ALL SELECT pr, c + 11, c + 11, 'changed', 1 FROM {CUST} WHERE pr % 5 > 1 UNION ALL SELECT pr, c + 38, c + 43, 'insertion', 0 FROM {CUST} WHERE pr % 5 > 1)""")
def src17_old_side_hunks(t):
    return D.old_side_hunks(D.diff_lines(t("diffs")))


@query(f"""SELECT pr, 'head' AS side, 1::BIGINT AS start, 2::BIGINT AS "end" FROM {CUST} WHERE pr % 5 = 0 UNION ALL SELECT pr, 'base', 1, 2 FROM {CUST} WHERE pr % 5 = 1 UNION ALL SELECT pr, 'base', c + 10, c + 12 FROM {CUST} WHERE pr % 5 > 1
 UNION ALL SELECT pr, 'head', c + 10, c + 13 FROM {CUST} WHERE pr % 5 > 1 UNION ALL SELECT pr, 'head', c + 42, c + 42 FROM {CUST} WHERE pr % 5 > 1""")
def src18_hunk_ranges(t):
    return D.hunk_ranges(t("diffs"))


@query("SELECT o_orderkey AS pr, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'T' || o_custkey END, '') AS title, o_orderkey % 3 = 0 AS merged, o_orderstatus = 'P' AS draft, 'dev' || o_custkey AS author, o_orderpriority AS base, md5(CAST(o_orderkey AS VARCHAR)) AS head, ['x', o_orderstatus] AS labels FROM orders")
def src1_changes(t):
    raw = t("orders").selectExpr("""concat('{"number": ', o_orderkey, ', "title": ', CASE WHEN o_orderkey % 2 = 0 THEN concat('"T', o_custkey, '"') ELSE 'null' END, ', "merged_at": ', CASE WHEN o_orderkey % 3 = 0 THEN '"2024-01-01T00:00:00Z"' ELSE 'null' END, CASE WHEN o_orderstatus = 'P' THEN ', "draft": true' ELSE '' END,
      ', "user": {"login": "dev', o_custkey, '"}, "base": {"ref": "', o_orderpriority, '"}, "head": {"sha": "', md5(CAST(o_orderkey AS STRING)), '"}, "labels": [{"name": "x"}, {"name": "', o_orderstatus, '"}]}') AS value""")
    return S.changes(raw).select("pr", "title", "merged", "draft", "author", "base", "head", "labels")


@query("SELECT event_id AS id, 'dev' || user_id AS author, CASE WHEN event_id % 2 = 0 THEN event_id ELSE user_id END AS line, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS body FROM events")
def src3_review_comments(t):
    raw = t("events").selectExpr("""concat('{"id": ', event_id, ', "user": {"login": "dev', user_id, '"}, "body": ', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE concat('"', event_type, '"') END, ', "line": ', CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS STRING) ELSE 'null' END, ', "original_line": ', user_id, '}') AS value""")
    return S.comments(raw).select("id", "author", "line", "body")


@query("SELECT CAST(unnest([event_id, user_id, event_id + 1]) AS VARCHAR) AS item FROM events")
def src4_flattened_pages(t):
    return S.flattened_pages(t("events").selectExpr("concat('[[', event_id, ',', user_id, '],[],[', event_id + 1, ']]') AS value"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'blocks' ELSE 'is blocked by' END AS relation, CASE WHEN event_id % 3 = 0 THEN 'PROJ-' || user_id ELSE 'PROJ-' || event_id END AS key FROM events")
def src6_links(t):
    e = t("events").selectExpr("event_id AS id", "CASE WHEN event_id % 3 = 0 THEN concat('PROJ-', user_id) END AS o", "concat('PROJ-', event_id) AS i")
    return e.select("id", S.link(F.col("o"), F.col("i"), F.lit("blocks"), F.lit("is blocked by")).alias("l")).select("id", "l.*")


@query("SELECT DISTINCT 'dev' || o_custkey AS login, display FROM orders JOIN {people} ON login = 'dev' || o_custkey")
def src7_lookup_keys(t):
    keys = t("changes").select(F.col("author").alias("login")).distinct()
    return keys.join(t("people").select("login", "display"), "login")


@query("""SELECT sha256(CAST(c_custkey AS VARCHAR)) AS request, body, CASE WHEN n IS NULL THEN 'never landed' END AS error FROM customer LEFT JOIN (SELECT user_id, arg_max(props, {'a': ts, 'b': event_id}) AS body, count(*) AS n FROM events GROUP BY user_id) AS l ON user_id = c_custkey""")
def src30_landed(t):
    """Two batches land, one of them twice; every customer's request is then replayed."""
    e = t("events").select(L.request_key(F.col("user_id").cast("string")).alias("request"), F.col("props").alias("body"), F.col("ts").alias("fetched_at"), "event_id")
    path = new_path(t.spark, "landing")
    for turn in (1, 0, 1):
        L.land(e.filter(F.col("event_id") % 2 == turn), path, ["request"], ["fetched_at", "event_id"], 8)
    asked = t("customer").select(L.request_key(F.col("c_custkey").cast("string")).alias("request"))
    return L.replay(asked, path, ["request"], 8).select("request", "body", "error")


@query()
def src8_page_lines(t):
    return t("pages").select("page_id", S.text_lines("html").alias("lines"))


@query("SELECT seq, CASE WHEN seq % 3 = 0 THEN 'classic' WHEN seq % 3 = 1 THEN 'totals' END AS layout, CASE WHEN seq % 3 = 0 THEN ref ELSE '' END AS ref, CASE WHEN seq % 3 < 2 THEN CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END END AS overall, CASE WHEN seq % 3 < 2 THEN passed END AS passed, CASE WHEN seq % 3 < 2 THEN failed END AS failed, CASE WHEN seq % 3 = 2 THEN 'unknown layout' END AS error FROM {ci_runs}")
def src8_src9_ci_pages(t):
    page = t("ci_runs").selectExpr("seq", "ref", """CASE WHEN seq % 3 = 0 THEN array(concat('CI results for ', ref, ': PASS'), concat('- Passed: ', passed), concat('- Failed: ', failed)) WHEN seq % 3 = 1 THEN array('[Totals]', concat('passed ', passed), concat('failed ', failed)) ELSE array('nothing here') END AS lines""")
    out = page.select("seq", S.ci_page(F.col("lines")).alias("p")).select("seq", "p.*")
    return out.withColumn("ref", F.coalesce("ref", F.lit("")))


@query("SELECT 'f' || (event_id % 20) AS path, md5(CAST(user_id AS VARCHAR)) || '00000000' AS sha, count(*) AS lines FROM events GROUP BY ALL")
def src22_blame(t):
    porcelain = F.concat(F.md5(F.col("user_id").cast("string").cast("binary")), F.lit("00000000 1 2\nauthor Someone\n\tcode line"))
    text = t("events").select(F.concat(F.lit("f"), (F.col("event_id") % 20).cast("string")).alias("path"), porcelain.alias("porcelain"))
    return D.blame(text)


@query("SELECT sha, parents, email, merge, message FROM (SELECT seq, sha, CASE WHEN seq % 4 = 0 THEN ['p1', 'p2'] WHEN seq % 4 = 1 THEN [] ELSE ['p' || seq] END AS parents, lower(login || '@Mail.example') AS email, seq % 4 = 0 AS merge, substr(message, 1, 2000) AS message FROM {commits})")
def src21_git_log(t):
    raw = t("commits").selectExpr("concat_ws(chr(31), sha, CASE WHEN seq % 4 = 0 THEN 'p1 p2' WHEN seq % 4 = 1 THEN '' ELSE concat('p', seq) END, concat(login, '@Mail.example'), CAST(ts AS STRING), message) AS value")
    return D.git_log(raw).select("sha", "parents", "email", "merge", "message")


@query("""SELECT pr, status, previous_path, path FROM (SELECT pr, 'M' AS status, NULL::VARCHAR AS previous_path, 'a/' || author AS path FROM {changes} UNION ALL SELECT pr, 'R', 'old ' || author, 'new' FROM {changes} WHERE pr % 2 = 0 UNION ALL SELECT pr, 'D', NULL, 'z' FROM {changes} WHERE pr % 3 = 0)""")
def src20_name_status(t):
    raw = t("changes").select("pr", F.concat(F.lit("M\0a/"), "author", F.lit("\0"), F.when(F.col("pr") % 2 == 0, F.concat(F.lit("R087\0old "), "author", F.lit("\0new\0"))).otherwise(""), F.when(F.col("pr") % 3 == 0, "D\0z\0").otherwise("")).alias("listing"))
    return D.name_status(raw)


@query("SELECT pr, i::INT AS idx, 'subject ' || i AS subject, CASE WHEN i = 0 THEN ['a.java', author] ELSE [] END AS paths FROM {changes}, range(2) r(i)")
def src32_commit_list(t):
    raw = t("changes").select("pr", F.concat(F.lit("\x1esubject 0\na.java\n"), "author", F.lit("\n\n\x1esubject 1\n")).alias("log"))
    return D.commit_list(raw)


@query("SELECT pr, k::INT AS k, 'src/A' || k || '.java' AS file, k::INT AS line_no, 'cannot find ' || author AS message FROM {changes}, range(1, 13) r(k) WHERE k <= 10")
def src29_compile_errors(t):
    lines = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.concat(F.lit("src/A"), k.cast("string"), F.lit(".java:"), k.cast("string"), F.lit(": error: cannot find "), F.col("author"), F.lit("\n   note"))))
    return D.compile_errors(t("changes").select("pr", lines.alias("log")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fenced' WHEN doc_id % 3 = 1 THEN 'bare' END AS kind FROM documents""")
def src23_reviewer_output(t):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('Here:\n```json\n{"kind": "fenced", "n": {"x": 1}}\n```\n'), "source")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('Sure {"kind": "bare"} '), "lang")).otherwise("no object { here")
    return t("documents").select("doc_id", F.variant_get(S.reviewer_output(text), "$.kind", "string").alias("kind"))


@query("SELECT pr, CASE WHEN pr % 4 <> 3 THEN head END AS head FROM {changes}")
def src31_snk1_embedded_model(t):
    doc = S.model_json("pr", "head", "title")
    page = F.when(F.col("pr") % 4 != 3, F.concat(F.lit('<html><script id="report-model">window.REPORT = '), doc, F.lit(";</script></html>"))).otherwise("<html>none</html>")
    return t("changes").select("pr", F.variant_get(S.embedded_model(page), "$.head", "string").alias("head"))


@query("SELECT doc_id, NOT contains(text, 'token = ') AS published FROM documents")
def snk3_leak_guard(t):
    ok, held = S.leak_guard(t("documents"), "text", ["token = "])
    return ok.select("doc_id", F.lit(True).alias("published")).unionByName(held.select("doc_id", F.lit(False).alias("published")))


@query("SELECT pr, lens, CASE WHEN n IS NULL THEN 'missing' WHEN bad THEN 'invalid' ELSE 'ran' END AS status, CASE WHEN bad THEN 'severity' END AS error FROM (SELECT DISTINCT pr FROM {findings}) p CROSS JOIN (VALUES ('src1'), ('src2')) l(lens) LEFT JOIN (SELECT pr, lens, count(*) AS n, bool_or(severity = 'nit' AND idx % 2 = 0) AS bad FROM {findings} GROUP BY ALL) USING (pr, lens)")
def src24_validated_outputs(t):
    f = t("findings")
    panel = F.explode(F.array(F.lit("src1"), F.lit("src2"))).alias("lens")
    got = f.groupBy("pr", "lens").agg(F.count(F.lit(1)).alias("n"), F.bool_or((F.col("severity") == "nit") & (F.col("idx") % 2 == 0)).alias("bad"))
    j = f.select("pr").distinct().select("pr", panel).join(got, ["pr", "lens"], "left")
    return j.select("pr", "lens", F.when(F.col("n").isNull(), "missing").when(F.col("bad"), "invalid").otherwise("ran").alias("status"), F.when(F.col("bad"), "severity").alias("error"))
