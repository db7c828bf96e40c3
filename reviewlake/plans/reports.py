"""Reports in XML and JSON, benchmark cases, and what is left of joins and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import checks as C
from ..operators import facts as K
from ..operators import findings as N
from ..operators import joins as J
from ..shared import new_path
from ..sources import landing as L
from ..sources import records as S
from .catalog import query
from .findings import ISSUE_SQL
from .gates import COPY_SQL, FACT_SQL, introduced_copies, marked, voted


SUITE_SQL = "WITH c AS (SELECT 'S' || user_id AS suite, 'c' || (event_id % 3) AS cls, 't' || event_id AS test, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'failure' WHEN event_id % 4 = 0 THEN 'skipped' END AS kind, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'Timeout occurred' WHEN event_id % 3 = 1 THEN 'address already in use' ELSE 'boom ' || event_id END WHEN 'view' THEN 'bad ' || event_id ELSE '' END AS message FROM events), b AS (SELECT *, CASE WHEN kind IS NULL THEN 'passed' WHEN kind = 'skipped' THEN 'skipped' WHEN message = 'address already in use' THEN 'environment' WHEN message = 'Timeout occurred' THEN 'timeout' ELSE 'failure' END AS bucket FROM c)"


def suites(t):
    """One suite element per test; a suite's tests are counted over its elements."""
    n = F.col("event_id").cast("string")
    msg = F.when(F.col("event_id") % 3 == 0, "Timeout occurred").when(F.col("event_id") % 3 == 1, "address already in use").otherwise(F.concat(F.lit("boom "), n))
    inner = F.when(F.col("event_type") == "error", F.concat(F.lit("<error>\n  "), msg, F.lit("\n  more</error>"))).when(F.col("event_type") == "view", F.concat(F.lit('<failure message="bad '), n, F.lit('">trace</failure>'))).when(F.col("event_id") % 4 == 0, "<skipped message='no'/>").otherwise("")
    case = F.concat(F.lit('<testcase classname="c'), (F.col("event_id") % 3).cast("string"), F.lit('" name="t'), n, F.lit('">'), inner, F.lit("</testcase>"))
    return S.xml_texts(t("events").select(F.concat(F.lit('<testsuite name="S'), F.col("user_id").cast("string"), F.lit('">'), case, F.lit("</testsuite>")).alias("x")), "x", S.SUITE)


@query(SUITE_SQL + " SELECT suite, cls, test, kind, message, bucket FROM b")
def src10_junit(t):
    return S.junit(suites(t))


@query(SUITE_SQL + " SELECT suite, count(*) AS run, count(DISTINCT cls) AS classes, count(*) FILTER (bucket = 'failure' AND kind = 'failure') AS failed, count(*) FILTER (bucket = 'failure' AND kind = 'error') AS errors, count(*) FILTER (bucket = 'skipped') AS skipped, count(*) FILTER (bucket = 'timeout') AS timeout, count(*) FILTER (bucket = 'environment') AS environment, count(*) FILTER (bucket = 'passed') AS passed FROM b GROUP BY suite")
def agg18_junit_totals(t):
    return S.junit_totals(S.junit(suites(t)))


@query("SELECT 'org/p' || (p_partkey % 5) || '/F' || p_partkey || '.java' AS file, n::INT AS line, (p_size % 3)::INT AS mi, n::INT AS ci, 0::INT AS mb, (p_size % 2)::INT AS cb FROM part, range(1, 4) r(n)")
def src11_coverage_report(t):
    line = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.concat(F.lit('<line nr="'), n.cast("string"), F.lit('" mi="'), (F.col("p_size") % 3).cast("string"), F.lit('" ci="'), n.cast("string"), F.lit('" mb="0" cb="'), (F.col("p_size") % 2).cast("string"), F.lit('"/>'))))
    src = F.concat(F.lit('<sourcefile name="F'), F.col("p_partkey").cast("string"), F.lit('.java">'), line, F.lit("</sourcefile>"))
    return S.coverage_report(S.xml_texts(t("part").select(F.concat(F.lit('<package name="org/p'), (F.col("p_partkey") % 5).cast("string"), F.lit('">'), src, F.lit("</package>")).alias("x")), "x", S.COVERED_PACKAGE))


def rule_files(t):
    v = t("part").withColumn("m", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("The method 'm"), F.col("p_partkey").cast("string"), F.lit("()' has a cognitive\n complexity of "), F.col("p_size").cast("string"))).otherwise(" Avoid   this "))
    one = F.concat(F.lit('<violation beginline="'), F.col("p_size").cast("string"), F.lit('" endline="99" rule="R'), (F.col("p_partkey") % 4).cast("string"), F.lit('" ruleset="Best Practices">'), "m", F.lit("</violation>"))
    return S.xml_texts(v.select(F.concat(F.lit('<file name="'), "p_brand", F.lit('">'), one, F.lit("</file>")).alias("x")), "x", S.RULE_FILE)


@query("SELECT p_brand AS file, 'R' || (p_partkey % 4) AS rule, 'bestpractices' AS category, p_size::INT AS begin, 99::INT AS \"end\", CASE WHEN p_size % 2 = 0 THEN 'The method ''m' || p_partkey || '()'' has a cognitive complexity of ' || p_size ELSE 'Avoid this' END AS message FROM part")
def src12_rule_report(t):
    return S.rule_report(rule_files(t))


@query("SELECT p_brand AS file, 'R' || (p_partkey % 4) AS rule, 'm' || p_partkey || '()' AS method, p_size::INT AS score, p_size::INT AS begin FROM part WHERE p_size % 2 = 0")
def src12_method_scores(t):
    return S.method_scores(S.rule_report(rule_files(t)))


@query("SELECT p_brand AS file, 'Line' || (p_partkey % 3) AS rule, p_size::INT AS line, 'm' AS message FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT 'empty ' || p_brand, NULL, NULL, NULL FROM part")
def src14_style_report(t):
    p = t("part")
    one = F.concat(F.lit('<error line="'), F.col("p_size").cast("string"), F.lit('" source="com.tools.checks.Line'), (F.col("p_partkey") % 3).cast("string"), F.lit('Check" message="m"/>'))
    full = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit('<file name="'), "p_brand", F.lit('">'), one, F.lit("</file>")).alias("x"))
    none = p.select("p_brand").distinct().select(F.concat(F.lit('<file name="empty '), "p_brand", F.lit('"></file>')).alias("x"))
    return S.style_report(S.xml_texts(full.unionByName(none), "x", S.STYLE_FILE))


@query("SELECT (100 + p_size)::INT AS tokens, 10::INT AS lines, CASE n WHEN 0 THEN 'a' || p_partkey ELSE 'b' END AS file, (p_size + n)::INT AS line, (p_size + n + 9)::INT AS endline FROM part, range(2) r(n)")
def src15_duplicate_report(t):
    file = lambda p, n: F.concat(F.lit('<file path="'), p, F.lit('" line="'), (F.col("p_size") + n).cast("string"), F.lit('" endline="'), (F.col("p_size") + n + 9).cast("string"), F.lit('"/>'))
    x = t("part").select(F.concat(F.lit('<duplication lines="10" tokens="'), (F.col("p_size") + 100).cast("string"), F.lit('">'), file(F.concat(F.lit("a"), F.col("p_partkey").cast("string")), 0), file(F.lit("b"), 1), F.lit("</duplication>")).alias("x"))
    return S.duplicate_report(S.xml_texts(x, "x", S.DUPLICATION)).drop("block")


@query("SELECT DISTINCT 'Rule' || p_size AS rule, lower(p_type) AS category FROM part WHERE p_size <> 7")
def src26_rule_catalogue(t):
    ref = F.concat(F.lit('<rule ref="category/java/'), F.lower("p_type"), F.lit(".xml/"), F.when(F.col("p_size") == 7, "NPathComplexity").otherwise(F.concat(F.lit("Rule"), F.col("p_size").cast("string"))), F.lit('"/>'))
    x = t("part").select(F.concat(F.lit('<ruleset name="r">'), ref, F.lit("</ruleset>")).alias("x"))
    return S.rule_catalogue(S.xml_texts(x, "x", S.RULE_SET))


@query(r"SELECT kind, pattern FROM (SELECT DISTINCT p_type FROM part), (VALUES ('RegexpSinglelineJava', 'bad @'), ('IllegalImport', 'import (static )?junit\.@\.'), ('IllegalImport', 'import (static )?sun\.'), ('IllegalInstantiation', 'new java\.@\b')) v(kind, raw), LATERAL (SELECT replace(raw, '@', p_type) AS pattern)")
def src27_banned_rules(t):
    p = t("part").select("p_type").distinct()
    mods = F.explode(F.array(
        F.concat(F.lit('<module name="RegexpSinglelineJava"><property name="format" value="bad '), "p_type", F.lit('"/></module>')),
        F.concat(F.lit('<module name="IllegalImport"><property name="illegalPkgs" value="junit.'), "p_type", F.lit(', sun"/></module>')),
        F.concat(F.lit('<module name="IllegalInstantiation"><property name="classes" value="java.'), "p_type", F.lit('"/></module>')),
    ))
    return S.banned_rules(S.xml_texts(p.select(mods.alias("x")), "x", S.MODULE))


TICKET_TEXT = '''CASE WHEN c_custkey % 41 = 3 THEN '{broken' ELSE concat('{"key": "PROJ-', c_custkey, '", "fields": {"summary": ', CASE WHEN c_custkey % 6 = 1 THEN 'null' ELSE concat('"', c_name, '"') END, ', "status": {"name": "', CASE c_custkey % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'Resolved' ELSE 'Closed' END, '"}, "resolution": ', CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '{"name": "Fixed"}' END,
 ', "components": [{"name": "', c_mktsegment, '"}, {"value": "Core"}, "odd", {"name": "", "value": "Tools"}], "labels": ["a', c_custkey % 5, '", 7, "b"], "fixVersions": ', CASE WHEN c_custkey % 4 = 0 THEN '{"name": "4.1"}' ELSE '[{"name": "4.0"}, {"name": "4.1"}]' END, ', "assignee": {"name": "dev', c_custkey, '", "displayName": "', c_name, '"}',
 ', "', CASE WHEN c_custkey % 2 = 0 THEN 'customfield_77' ELSE 'customfield_5' END, '": [{"name": "ann", "displayName": "Ann"}, {"key": "u', c_custkey, '"}], "', CASE WHEN c_custkey % 2 = 0 THEN 'customfield_78' ELSE 'customfield_77' END, '": ', CASE c_custkey % 5 WHEN 0 THEN '"plain plan"' WHEN 1 THEN '12' WHEN 2 THEN '[{"value": "unit"}, {"name": "dtest"}]' ELSE 'null' END,
 ', "comment": {"comments": [{"id": "', c_custkey * 10, '", "author": {"name": "ann", "displayName": "Ann"}, "created": "2024-01-01", "body": "see"}, {"id": "', c_custkey * 10 + 1, '", "body": null}]}, "attachment": [{"id": "1", "filename": "f.txt", "size": ', c_custkey, '}], "issuelinks": [{"type": {"name": "Relates", "outward": "blocks", "inward": "is blocked by"}, ', CASE WHEN c_custkey % 2 = 0 THEN '"outwardIssue"' ELSE '"inwardIssue"' END, ': {"key": "PROJ-', c_custkey + 1, '", "fields": {"status": {"name": "Open"}}}}]}}') END'''


@query('''WITH c AS (SELECT *, c_custkey % 41 = 3 AS bad, 'PROJ-' || c_custkey AS k FROM customer) SELECT CASE WHEN NOT bad THEN k END AS key, CASE WHEN NOT bad THEN 'https://tracker/browse/' || k END AS url, CASE WHEN bad OR c_custkey % 6 = 1 THEN '' ELSE c_name END AS summary, CASE WHEN NOT bad THEN CASE c_custkey % 3 WHEN 0 THEN 'Open' WHEN 1 THEN 'Resolved' ELSE 'Closed' END END AS status, CASE WHEN NOT bad AND c_custkey % 3 > 0 THEN 'Fixed' END AS resolution,
 CASE WHEN bad THEN '' ELSE c_mktsegment || '|Core|Tools' END AS components, CASE WHEN bad THEN '' ELSE 'a' || (c_custkey % 5) || '|b' END AS labels, CASE WHEN bad THEN '' WHEN c_custkey % 4 = 0 THEN '4.1' ELSE '4.0|4.1' END AS fix_versions, CASE WHEN bad THEN '' ELSE 'ann|u' || c_custkey END AS reviewers, CASE WHEN bad THEN '' ELSE 'dev' || c_custkey || ' ' || c_name END AS assignee,
 CASE WHEN bad THEN '' ELSE CASE c_custkey % 5 WHEN 0 THEN 'plain plan' WHEN 1 THEN '12' WHEN 2 THEN 'unit, dtest' ELSE '' END END AS test_doc_plan, CASE WHEN bad THEN '' ELSE c_custkey * 10 || ' ann see|' || (c_custkey * 10 + 1) || ' - ' END AS comments, CASE WHEN bad THEN '' ELSE 'f.txt ' || c_custkey END AS attachments, CASE WHEN bad THEN '' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'blocks' ELSE 'is blocked by' END || ' PROJ-' || (c_custkey + 1) || ' Open' END AS issuelinks,
 'a title' AS remotelinks, 'none' AS impacts, CASE WHEN bad THEN 'unreadable' END AS error FROM c''')
def src5_tickets(t):
    c = t("customer").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # rows are short, their documents long to read
    raw = c.selectExpr("CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS tracker", f"{TICKET_TEXT} AS value", '''concat('[{"object": {"title": "a title", "url": "u"}}]') AS remote''')
    fields = c.sparkSession.createDataFrame([("first", "customfield_77", "Reviewers"), ("first", "customfield_78", "Test and Documentation Plan"), ("second", "customfield_5", "Reviewers"), ("second", "customfield_77", "Test and Documentation Plan"), ("second", "customfield_6", "Other")], "tracker string, id string, name string")
    r = S.tickets(raw, fields, "https://tracker", remote="remote")
    bars = lambda c, *of: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in of])) if of else F.col(c), "|")
    return r.select(
        "key", "url", "summary", "status", "resolution", bars("components").alias("components"), bars("labels").alias("labels"), bars("fix_versions").alias("fix_versions"), bars("reviewers", "name").alias("reviewers"), bars("assignee", "name", "display").alias("assignee"), "test_doc_plan", bars("comments", "id", "author", "body").alias("comments"),
        bars("attachments", "filename", "size").alias("attachments"), bars("issuelinks", "relation", "key", "status").alias("issuelinks"), bars("remotelinks", "title").alias("remotelinks"), F.when(F.size("impacts") == 0, "none").alias("impacts"), "error",
    )


@query("SELECT event_id, v FROM (SELECT event_id, unnest(['{\"a\": ' || event_id || '}', '1', '\"x\"']) AS v FROM events)")
def src33_json_values(t):
    raw = t("events").selectExpr("event_id", """concat('{"a": ', event_id, '}\n[1, ["x"]]  !rest') AS text""")
    return raw.select("event_id", F.explode(S.json_values("text")).alias("v"))


@query("SELECT lower(n_name) AS alias, 'dev' || n_nationkey AS id FROM nation")
def src34_dimension(t):
    j = t("nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.lower("n_name"), F.concat(F.lit("dev"), F.col("n_nationkey").cast("string")))))).alias("j"))
    return j.select(F.explode(F.from_json("j", "map<string,string>")).alias("alias", "id"))


@query("SELECT 'B' || item_id || '-x' AS id, CASE WHEN item_id % 4 = 0 THEN 'url' WHEN item_id % 5 = 0 THEN 'terms' WHEN item_id % 6 = 0 THEN 'severity' WHEN item_id % 7 = 0 THEN 'lines' END AS error, 0::INT AS ord FROM benchmark")
def src25_cases(t):
    c = t("benchmark").select(F.concat(F.lit("B"), F.col("item_id").cast("string"), F.lit("-x")).alias("id"), S.case_error(F.when(F.col("item_id") % 4 == 0, "ftp:x").otherwise("https://x"), F.when(F.col("item_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("text")), F.when(F.col("item_id") % 6 == 0, "bad").otherwise("minor"), F.when(F.col("item_id") % 7 == 0, F.array(F.lit(5), F.lit(1)))).alias("error"))
    return S.selected_cases(c, "all")


@query("SELECT user_id AS pr, arg_max(md5(CAST(event_id AS VARCHAR)), {'a': ts, 'b': md5(CAST(event_id AS VARCHAR))}) AS head, count(*) AS heads FROM events GROUP BY user_id")
def snk2_latest(t):
    """Bundles written in two turns, under every head and as the latest, and read again."""
    e = t("events").select(F.col("user_id").alias("pr"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("head"), F.col("ts").alias("fetched_at"), "event_id")
    path = new_path(t.spark, "bundles")
    for turn in (1, 0):
        L.write_bundles(e.filter(F.col("event_id") % 2 == turn).drop("event_id"), path, 8)
    heads = L.read(t.spark, f"{path}/heads").groupBy("pr").agg(F.count(F.lit(1)).alias("heads"))
    return L.read(t.spark, f"{path}/latest").join(heads, "pr").select("pr", "head", "heads")


@query("SELECT seq, CASE WHEN seq % 3 = 0 THEN 'summary' WHEN seq % 3 = 1 THEN 'archive' ELSE 'other' END AS kind FROM {ci_runs}")
def prj15_attachment_kind(t):
    name = F.when(F.col("seq") % 3 == 0, "CI_Summary.HTML").when(F.col("seq") % 3 == 1, "results.tar.gz").otherwise("x.log")
    return t("ci_runs").select("seq", X.attachment_kind(name).alias("kind"))


@query(FACT_SQL + " SELECT pr, have, need::BIGINT AS need, have >= need AS enough FROM fx")
def prj31_votes_needed(t):
    """From the two facts that the rule reads, not from all of them."""
    have, need = (F.expr(x).cast("long") for x in (C.HAVE, C.NEEDED))
    f = t("subjects").select("pr").join(K.only_tests(t("touched")), "pr", "left").join(voted(t).select("pr", "counted", "author_vote"), "pr", "left")
    return f.select("pr", have.alias("have"), need.alias("need"), (have >= need).alias("enough"))


CLASSES = "SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN concat('class ', p_brand, ' { @Test public void a() {} }') WHEN 1 THEN concat('@RunWith(Parameterized.class) class ', p_brand) WHEN 2 THEN concat('class ', p_brand, ' extends  UnitBase {}') WHEN 3 THEN concat('abstract class UnitBaseless extends ', p_brand, ' {}') WHEN 4 THEN concat('class ', p_brand, ' extends UnitBases {}') ELSE p_name END AS text FROM part"


@query(r"SELECT id, contains(text, '@Test') OR contains(text, '@RunWith') OR regexp_matches(text, 'extends\s+UnitBase\b') AS runnable FROM (" + CLASSES + ")")
def prj33_runnable(t):
    part = t("part")
    kinds = CLASSES.partition("AS id, ")[2].rpartition(" AS text")[0]
    return part.select(F.col("p_partkey").alias("id"), F.expr(kinds).alias("text")).select("id", X.runnable_test(F.col("text")).alias("runnable"))


@query(COPY_SQL)
def jon15_introduced_duplication(t):
    return introduced_copies(marked(t))


@query("SELECT pr, list_sort(list(DISTINCT login)) AS authors FROM (SELECT pr, author AS login FROM {changes} UNION SELECT pr, login FROM {reviews} WHERE kind = 'purchase' AND pr IN (SELECT pr FROM {changes})) GROUP BY pr")
def jon20_author_keys(t):
    c = t("changes").select("pr", F.col("author").alias("login"))
    r = t("reviews").filter("kind = 'purchase'").select("pr", "login").join(c.select("pr"), "pr", "left_semi")
    return c.unionByName(r).groupBy("pr").agg(F.array_sort(F.collect_set("login")).alias("authors"))


@query("WITH f AS (SELECT DISTINCT user_id AS cls, event_id % 40 AS test FROM events WHERE event_type = 'error') SELECT cls, test FROM f WHERE NOT EXISTS (SELECT 1 FROM (VALUES (3, NULL), (5, 7), (8, 1)) e(c, t) WHERE e.c = f.cls AND (e.t IS NULL OR e.t = f.test))")
def jon26_without_artifacts(t):
    f = t("events").filter("event_type = 'error'").selectExpr("user_id AS cls", "event_id % 40 AS test").distinct()
    env = f.sparkSession.createDataFrame([(3, None), (5, 7), (8, 1)], "c long, t long")
    return f.join(F.broadcast(env), (F.col("cls") == F.col("c")) & (F.col("t").isNull() | (F.col("t") == F.col("test"))), "left_anti")


@query("SELECT rule, coalesce(b.n, s.n)::BIGINT AS violations, CASE WHEN b.n IS NOT NULL THEN 'baseline' ELSE 'sample' END AS source FROM (SELECT rule, count(*) AS n FROM {violations} WHERE side = 'head' GROUP BY rule) s LEFT JOIN (SELECT rule, count(*) AS n FROM {violations} WHERE side = 'base' AND rule < 'Rule3' GROUP BY rule) b USING (rule)")
def agg12_fallback_density(t):
    v = t("violations")
    s = v.filter("side = 'head'").groupBy("rule").agg(F.count(F.lit(1)).alias("s"))
    b = v.filter("side = 'base' AND rule < 'Rule3'").groupBy("rule").agg(F.count(F.lit(1)).alias("b"))
    return s.join(b, "rule", "left").select("rule", F.coalesce("b", "s").alias("violations"), F.when(F.col("b").isNotNull(), "baseline").otherwise("sample").alias("source"))


@query("WITH k AS (SELECT CAST(ts AS DATE) AS day, unnest(regexp_extract_all(message, '(?i)PROJ-\\d+')) AS key FROM {commits}) SELECT upper(key) AS key, min(day) AS day FROM k GROUP BY 1")
def agg35_first_linked_day(t):
    k = t("commits").select(F.col("ts").cast("date").alias("day"), F.explode(F.regexp_extract_all("message", F.lit(r"(?i)PROJ-\d+"), F.lit(0))).alias("key"))
    return k.groupBy(F.upper("key").alias("key")).agg(F.min("day").alias("day"))


@query("SELECT user_id AS pr, max(ts) AS newest, list_sort(list(DISTINCT event_type)) AS models FROM events GROUP BY user_id")
def agg41_provenance(t):
    return t("events").groupBy(F.col("user_id").alias("pr")).agg(F.max("ts").alias("newest"), F.array_sort(F.collect_set("event_type")).alias("models"))


@query("SELECT pr, list(kind ORDER BY CASE kind WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, kind) AS groups FROM (SELECT DISTINCT pr, kind FROM {reviews}) GROUP BY pr")
def win13_group_order(t):
    k = t("reviews").select("pr", "kind").distinct().withColumn("r", F.when(F.col("kind") == "error", 0).when(F.col("kind") == "view", 1).otherwise(2))
    return k.groupBy("pr").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "kind"))), lambda x: x["kind"]).alias("groups"))


@query(ISSUE_SQL + " SELECT pr, issue, \"primary\" FROM issues WHERE pr % 24 <> 0 UNION ALL SELECT pr, 'stored', min(id) FROM {panel} WHERE pr % 24 = 0 GROUP BY pr")
def fuz5_stored_or_merged_issues(t):
    f = t("panel")
    stored = f.filter("pr % 24 = 0").groupBy("pr").agg(F.lit("stored").alias("issue"), F.min("id").alias("primary"))
    return N.issues_of(f, stored).select("pr", "issue", "primary")


@query("SELECT pr, path, CASE WHEN file_id % 3 = 0 THEN 'trunk' ELSE 'merge base' END AS read_from FROM (SELECT DISTINCT pr, path FROM {changed_files}) JOIN {paths} USING (path)")
def snap3_history_reference(t):
    listing = t("paths").filter("file_id % 3 = 0").select("path", F.lit("trunk").alias("side"))
    return t("changed_files").select("pr", "path").distinct().join(listing, "path", "left").select("pr", "path", F.coalesce("side", F.lit("merge base")).alias("read_from"))


@query("SELECT pr, status FROM {changes} JOIN (SELECT o_orderkey AS pr, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE md5(CAST(o_orderkey AS VARCHAR)) END AS head, CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'tests-failed' WHEN 2 THEN 'odd' ELSE 'pass' END AS status FROM orders) USING (pr, head) WHERE status IN ('pass', 'tests-failed')")
def snap4_valid_runs(t):
    runs = t("orders").selectExpr("o_orderkey AS pr", "CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE md5(CAST(o_orderkey AS STRING)) END AS head", "CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'tests-failed' WHEN 2 THEN 'odd' ELSE 'pass' END AS status")
    return t("changes").select("pr", "head").join(runs, ["pr", "head"]).filter(F.col("status").isin("pass", "tests-failed")).select("pr", "status")


@query("SELECT event_id, TRY_CAST(props ->> '$.k' AS BIGINT) AS k, CASE WHEN event_id % 9 = 0 THEN 'unreadable' ELSE 'ok' END AS outcome FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{}' ELSE props END AS props FROM events)")
def str5_outcome_per_item(t):
    broken = F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props"))
    v = F.try_parse_json(broken)
    return t("events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.when(v.isNull(), "unreadable").otherwise("ok").alias("outcome"))
