"""Facts of changes from their evidence, the 31 checks over them, and votes.

The SQL says by hand what each check is to say; it doesn't read the operators' rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import deltas as D
from ..operators import facts as K
from ..operators import identity as I
from ..operators import introduced as N
from ..operators import joins as J
from . import deltas as B
from ..shared import bucketed
from .catalog import query
from .scalar import RESOLVED_SQL

BANNED = [("no-junit", r"import junit\."), ("no-unsafe", r"import sun\.")]


def voted(t):
    people, orders = t("people"), t("orders")
    involved = orders.selectExpr("o_orderkey AS pr", "concat('dev', o_custkey) AS who")
    return I.votes(t("approvals"), t("subjects"), involved, people.filter("committer").select(F.col("login").alias("id")), t("overrides"), people.select("login", "email"))


VOTE_SQL = """ro AS (SELECT login AS id FROM {people} WHERE committer), ml AS (SELECT login AS who, min(split_part(email, '@', 1)) AS id FROM {people} WHERE ends_with(lower(email), '@project.org') AND split_part(lower(email), '@', 1) IN (SELECT id FROM ro) GROUP BY login),
ov AS (SELECT source, who, min(id) AS id FROM {overrides} WHERE id IN (SELECT id FROM ro) GROUP BY ALL),
yes AS (SELECT a.*, 'dev' || o_custkey AS owner FROM {approvals} a LEFT JOIN orders ON o_orderkey = a.pr WHERE CASE WHEN source = 'review' THEN approved ELSE body IN ('+1', 'LGTM (+1)', 'thanks, +1 from me') END),
vt AS (SELECT pr, seq, made, y.source, y.who, CASE WHEN ov.id IS NOT NULL THEN ov.id WHEN y.source = 'comment' THEN ro.id WHEN ml.id IS NOT NULL THEN ml.id WHEN association IN ('MEMBER', 'OWNER') THEN 'forge:' || y.who END AS id,
 CASE WHEN ov.id IS NOT NULL THEN 'override' WHEN y.source = 'comment' THEN CASE WHEN ro.id IS NOT NULL THEN 'user name' END WHEN ml.id IS NOT NULL THEN 'address' WHEN association IN ('MEMBER', 'OWNER') THEN 'membership' END AS rule
 FROM yes y LEFT JOIN ov ON ov.source = y.source AND ov.who = y.who LEFT JOIN ml ON ml.who = y.who LEFT JOIN ro ON ro.id = y.who WHERE NOT (y.source = 'comment' AND y.who = owner)),
fi AS (SELECT pr, id, first(who ORDER BY source <> 'review', made, seq) AS who, first(source ORDER BY source <> 'review', made, seq) AS source, first(rule ORDER BY source <> 'review', made, seq) AS rule FROM vt WHERE id IS NOT NULL GROUP BY pr, id),
cn AS (SELECT pr, list(id ORDER BY id) AS ids, list(who || ' by ' || rule ORDER BY id) AS shown FROM fi GROUP BY pr), oo AS (SELECT pr, list_sort(list(DISTINCT who)) AS others FROM vt WHERE id IS NULL GROUP BY pr),
au AS (SELECT pr, coalesce(ov.id, ml.id, CASE WHEN association IN ('MEMBER', 'OWNER') THEN 'forge:' || author END) AS id FROM {subjects} s LEFT JOIN ov ON ov.source = 'review' AND ov.who = author LEFT JOIN ml ON ml.who = author),
vo AS (SELECT au.pr, coalesce(ids, []) AS ids, coalesce(shown, []) AS shown, coalesce(others, []) AS others, CASE WHEN NOT list_contains(coalesce(ids, []), au.id) THEN au.id END AS author_vote FROM au LEFT JOIN cn USING (pr) LEFT JOIN oo USING (pr))"""


@query(f"WITH {VOTE_SQL} SELECT pr, len(ids) AS have, array_to_string(ids, '|') AS counted, array_to_string(shown, '|') AS evidence, array_to_string(others, '|') AS others, author_vote FROM vo")
def agg20_jon19_votes(t):
    bars = lambda c: F.array_join(c, "|")
    shown = F.transform("counted", lambda c: F.concat(c["who"], F.lit(" by "), c["rule"]))
    return voted(t).select("pr", F.size("counted").cast("long").alias("have"), bars(F.transform("counted", lambda c: c["id"])).alias("counted"), bars(shown).alias("evidence"), bars(F.col("others")).alias("others"), "author_vote")


COPY_SQL = """WITH o AS (SELECT DISTINCT l_orderkey AS block, l_partkey AS file_id, l_linenumber * 10 AS line, l_linenumber * 10 + 4 AS endline FROM lineitem), m AS (SELECT o.*, EXISTS (SELECT 1 FROM {ranges} r WHERE r.file_id = o.file_id AND r.begin_line <= o.endline AND r.end_line >= o.line) AS hit, file_id % 4 = 0 AS fresh FROM o)
SELECT block, bool_or(hit) OR bool_and(fresh) AS introduced FROM m GROUP BY block"""


def occurrences(t):
    return t("lineitem").selectExpr("l_orderkey AS block", "l_partkey AS file_id", "l_linenumber * 10 AS line", "l_linenumber * 10 + 4 AS endline").distinct()


def marked(t):
    """occurrences with hit: whether a changed range overlaps it."""
    return J.covered(occurrences(t), t("ranges"), ["file_id"], "line", "endline", "begin_line", "end_line", "hit")


def introduced_copies(o):
    """block, introduced: whether one of its places was changed, or all are in new files. o: see marked."""
    return o.groupBy("block").agg((F.bool_or("hit") | F.bool_and(F.col("file_id") % 4 == 0)).alias("introduced"))


UNTYPED = ["Rule5", "Rule6"]
#: The facts that `introduced` gives.
INTRODUCED = ("style_new", "style_old", "style_fixed", "style_places", "complex_new", "complex_tests", "complex_top", "bugs_new", "bug_rules", "bugs_other", "usual_rules", "untyped_rules", "copies_new", "copies")


def introduced(t):
    """What analysis found new in the files of each change: a file belongs to the first change that touches it."""
    owners = t("owners")
    found = B.introduced(t).drop("pr").join(owners, "file_id").select("pr", "rule", F.expr(B.CATEGORY).alias("category"), F.col("path").startswith("test/").alias("in_test"), "is_new")
    rules, branch = B.baseline(t)
    sections = D.rule_section(found, rules.filter("branch = 'src1'"), branch.filter("branch = 'src1'"), N.added_production(t("touched")), UNTYPED, by=("pr",))
    o = bucketed(marked(t), "occurrences", key="block")  # read three times
    places = o.select(F.col("block").alias("pr"), "block", F.concat_ws("", F.col("file_id").cast("string"), F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.col("endline").cast("string")).alias("place"))
    return [*N.style_facts(B.style_delta(t), owners), *N.method_facts(B.method_delta(t, 15), owners), N.rule_facts(sections, t("static_runs").select("pr", "types")), *N.copy_facts(places, introduced_copies(o))]


def facts(t, wanted=None):
    """wanted: see facts.all_facts. Lines, files and commits of changes are read many times, so each is written once, if anything reads it; by change they are
    grouped without a shuffle."""
    asks = lambda *names: wanted is None or bool(wanted.intersection(names))
    by_rules = asks(*INTRODUCED)
    by_lines = asks("sensitive", *K.LINE_FACTS)
    by_files = by_rules or by_lines or asks(*K.file_facts(t("touched")).columns)
    by_commits = asks(*K.COMMIT_FACTS)
    if by_rules:
        t.by_file()
    t.by_change(*["touched"][:by_files], *["added"][:by_lines], *["change_commits"][:by_commits])
    changes = t("subjects")
    commits = t("change_commits").withColumn("paths", F.array("path"))
    f = K.all_facts(changes, t("tickets"), t("touched"), t("added"), t("ticket_ci"), commits, t("builds"), t("static_runs"), introduced(t) if by_rules else [], voted(t), BANNED, wanted=wanted)
    f = f.withColumn("style_file", F.expr("CASE WHEN base = 'project-3.0' THEN 'missing' WHEN pr % 29 = 4 THEN 'unreadable' ELSE 'read' END")).withColumn("has_latest", ~F.col("base").isin("project-3.0", "project-3.11")).withColumn("roster_read", F.col("pr") % 23 != 5)
    numbers = ["style_new", "style_old", "style_fixed", "complex_new", "complex_tests", "bugs_new", "bugs_other", "copies_new"]
    return f.fillna(0, [c for c in numbers if c in f.columns])


SURFACE_SQL = r"""(VALUES ('config', '^(conf/project[^/]*\.yaml|src/java/org/project/config/Config\.java)$'), ('native protocol', '^(src/java/org/project/transport/|doc/native_protocol)'), ('CQL grammar', '^src/antlr/'), ('CQL semantics', '^src/java/org/project/cql3/'), ('messaging', '^src/java/org/project/net/'),
 ('sstable format', '^src/java/org/project/io/table/'), ('commitlog / hints', '^src/java/org/project/(db/commitlog|hints)/'), ('schema / system tables', '^src/java/org/project/(schema/|db/SystemKeyspace)'), ('admin tool', '^src/java/org/project/tools/admin/'), ('JMX', 'MBean\.java$'), ('metrics', '^src/java/org/project/metrics/'),
 ('virtual tables', '^src/java/org/project/db/virtual/'), ('guardrails', '^src/java/org/project/db/guardrails/'), ('dependencies', '^(\.build/(build-resolve|parent-pom-template|deps-template|build-deps-template)\.xml|lib/)')) r(surface, rx)"""
SENSITIVE_SQL = r"""SELECT pr, path FROM {touched} WHERE starts_with(path, 'src/java/') AND regexp_matches(path, 'Serializ\w*\.java$|^src/java/org/project/net/(MessagingService|Verb|Message)\.java$|^src/java/org/project/io/table/format/[^/]*(Version|Format|Descriptor)[^/]*\.java$|^src/java/org/project/io/table/(Descriptor|Component)\.java$|^src/java/org/project/io/table/metadata/|^src/java/org/project/hints/HintsDescriptor\.java$|^src/java/org/project/(schema/SchemaKeyspace|db/SystemKeyspace)[^/]*\.java$')
 UNION SELECT pr, path FROM {added} WHERE starts_with(path, 'src/java/') AND contains(text, 'VersionedSerializer<')"""


@query(f"SELECT DISTINCT pr, path, surface FROM {{touched}} JOIN {SURFACE_SQL} ON regexp_matches(path, rx)")
def jon1_surfaces(t):
    files = t("touched").select("pr", "path").distinct()
    rules = files.sparkSession.createDataFrame(K.SURFACES, "surface string, pattern string")
    return J.tag(files, "path", rules).select("pr", "path", "surface")


@query(SENSITIVE_SQL)
def jon2_sensitive_files(t):
    return K.sensitive_files(t("touched"), t("added"))


@query("SELECT DISTINCT pr, path, CASE WHEN starts_with(path, 'src/java/org/project/concurrent/') THEN 'src/java/org/project/concurrent/' WHEN starts_with(path, 'src/java/org/project/db/') THEN 'src/java/org/project/db/' END AS prefix FROM {touched} WHERE starts_with(path, 'src/java/org/project/concurrent/') OR starts_with(path, 'src/java/org/project/db/')")
def jon3_concurrency_prefixes(t):
    files = t("touched").select("pr", "path").distinct()
    rules = files.sparkSession.createDataFrame([("src/java/org/project/concurrent/",), ("src/java/org/project/db/",)], "prefix string")
    return J.tag_prefix(files, "path", rules).select("pr", "path", "prefix")


has = "coalesce(len({0}) > 0, false)".format
FACT_SQL = (
    RESOLVED_SQL.replace("{changes}", "{subjects}")
    + r""", kd AS (SELECT s.*, key, list_concat(list_concat(CASE WHEN list_contains(kt, key) THEN ['title'] ELSE [] END, CASE WHEN list_contains(kb, key) THEN ['branch'] ELSE [] END), CASE WHEN list_contains(ko, key) THEN ['body'] ELSE [] END) AS sources, list_sort(list_filter(list_distinct(list_concat(kt, kb)), lambda k: k <> key)) AS conflicts, regexp_matches(base, '^(trunk|project-\d+\.\d+)$') AS release FROM {subjects} s JOIN k2 USING (pr)),
tk AS (SELECT pr, label, component, summary, CASE WHEN kd.key IS NULL THEN NULL WHEN reached IS NULL THEN 'not found' WHEN reached THEN 'found' ELSE 'unavailable' END AS lookup, CASE WHEN reached THEN status END AS ticket_status, CASE WHEN reached THEN list_filter(string_split(fix_versions, ','), lambda v: v <> '') END AS versions FROM kd LEFT JOIN {tickets} t ON t.key = kd.key),
tw AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(versions, lambda v: CASE v WHEN '4.1' THEN 'project-4.1' WHEN '3.11' THEN 'project-3.11' WHEN '4.0' THEN 'project-4.0' WHEN '4.x' THEN 'project-4.1' WHEN '9.9' THEN 'trunk' END), lambda b: b IS NOT NULL))) AS wanted FROM tk),
hd AS (SELECT key, base, min(pr) AS sibling FROM kd WHERE key IS NOT NULL AND state = 'O' GROUP BY ALL), tg AS (SELECT pr, base, head AS want FROM kd UNION ALL SELECT a.pr, h.base, b.head FROM kd a JOIN hd h ON a.key = h.key AND a.base <> h.base JOIN kd b ON b.pr = h.sibling),
lc AS (SELECT key, target_branch AS base, sha, failed, upgrade FROM {ticket_ci} WHERE parsed AND target_branch IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key, target_branch ORDER BY created DESC, seq) = 1),
br AS (SELECT tg.pr, list_sort(list(DISTINCT tg.base)) AS targets, coalesce(list_sort(list(DISTINCT tg.base) FILTER (lc.base IS NULL)), []) AS no_ci, coalesce(list_sort(list(DISTINCT tg.base) FILTER (lc.base IS NOT NULL AND sha IS NULL)), []) AS unknown_sha, coalesce(list_sort(list(DISTINCT tg.base) FILTER (sha <> want)), []) AS stale, count(lc.base) AS compared FROM tg JOIN kd USING (pr) LEFT JOIN lc ON lc.key = kd.key AND lc.base = tg.base GROUP BY tg.pr),
ct AS (SELECT key, list_sort(list(DISTINCT base)) AS ci_branches, coalesce(list_sort(list(DISTINCT base) FILTER (NOT upgrade)), []) AS no_upgrade, coalesce(sum(failed), 0)::BIGINT AS ci_failed, coalesce(list_sort(list(DISTINCT base) FILTER (failed IS NULL)), []) AS uncounted FROM lc GROUP BY key),
ff AS (SELECT pr, coalesce(sum(additions + deletions) FILTER (regexp_matches(path, '^(src/java|pylib)/')), 0)::BIGINT AS prod_lines, coalesce(list_sort(list(DISTINCT CASE WHEN starts_with(path, 'test/unit/') THEN 'unit' WHEN starts_with(path, 'test/distributed/') THEN 'distributed' WHEN starts_with(path, 'test/microbench/') THEN 'microbench' ELSE 'other' END) FILTER (starts_with(path, 'test/'))), []) AS suites,
 bool_and(starts_with(path, 'test/')) AS all_tests, bool_or(regexp_matches(path, '^(src/java|pylib)/')) AS has_prod, coalesce(list_sort(list(DISTINCT path) FILTER (regexp_matches(path, '^(src/gen-java|lib)/'))), []) AS protected, coalesce(list_sort(list(DISTINCT path) FILTER (starts_with(path, 'src/antlr/'))), []) AS grammar, bool_or(path = 'conf/project.yaml') AS yaml, bool_or(path = 'conf/project_latest.yaml') AS recent,
 bool_or(path = 'src/java/org/project/config/Config.java') AS java, coalesce(list_sort(list(DISTINCT path) FILTER (starts_with(path, 'src/java/org/project/tools/admin/'))), []) AS admin, count(*) FILTER (starts_with(path, 'test/resources/admin/help/')) AS help, bool_or(starts_with(path, 'test/microbench/')) AS bench FROM {touched} GROUP BY pr),
sf AS (SELECT pr, list_sort(list(DISTINCT surface)) AS surfaces FROM {touched} JOIN """
    + SURFACE_SQL
    + r""" ON regexp_matches(path, rx) GROUP BY pr), sn AS (SELECT pr, list_sort(list(path)) AS sensitive FROM ("""
    + SENSITIVE_SQL
    + r""") GROUP BY pr),
al AS (SELECT *, lag(text) OVER (PARTITION BY pr, path ORDER BY line_no) AS before FROM {added}), lg AS (SELECT pr, count(*) FILTER (path = 'CHANGES.txt') AS log_lines, coalesce(list_sort(list(text) FILTER (path = 'CHANGES.txt' AND regexp_matches(text, '^ \* .+\((?:PROJ-\d+(?:,\s*)?)+\)\s*$'))), []) AS entries,
 list_sort(list(path || ':' || line_no || ' ' || CASE WHEN contains(text, 'import junit.') THEN 'no-junit' ELSE 'no-unsafe' END) FILTER (regexp_matches(path, '^src/java/.*\.java$') AND regexp_matches(text, 'import (junit|sun)\.') AND NOT contains(text, 'permit') AND NOT coalesce(contains(before, 'permit'), false))) AS banned,
 list_sort(list(path || ':' || line_no) FILTER (text = '@Deprecated' AND ends_with(path, '.java'))) AS deprecated, list_sort(list(path || ':' || line_no) FILTER (starts_with(text, 'int n = Integer') AND starts_with(path, 'src/java/'))) AS properties FROM al GROUP BY pr),
ul AS (SELECT pr, list_sort(list(path)) AS unlicensed FROM (SELECT pr, path FROM {added} WHERE new_file AND regexp_matches(path, '\.(java|py|sh|xml|g)$') AND NOT starts_with(path, 'test/resources/') GROUP BY pr, path HAVING NOT bool_or(contains(text, 'Licensed to'))) GROUP BY pr),
cm AS (SELECT pr, count(*) AS commits, count(*) FILTER (named = '' OR coalesce(named <> key OR contains(lower(split_part(message, chr(10), 1)), lower(key)), false)) AS bad, count(*) FILTER (regexp_matches(message, '\n(Assisted|Co-authored)-by: ')) AS trailers, bool_or(regexp_matches(message, '\n(Assisted-by: |Co-authored-by: Copilot)')) AS helped
 FROM (SELECT c.*, kd.key, upper(regexp_extract(message, '(?im)^patch by .+?[;,]\s*reviewed by .+? for (PROJ-\d+)', 1)) AS named FROM {change_commits} c JOIN kd USING (pr)) GROUP BY pr),
co AS (SELECT pr, min(idx) FILTER (starts_with(path, 'test/microbench/')) AS bench_first, min(idx) FILTER (starts_with(path, 'src/java/')) AS source_first FROM (SELECT *, starts_with(message, 'fixup!') AS fix, bool_and(starts_with(message, 'fixup!')) OVER (PARTITION BY pr) AS all_fix FROM {change_commits}) WHERE NOT fix OR all_fix GROUP BY pr),
ad AS (SELECT pr, coalesce(sum(additions) FILTER (regexp_matches(path, '^(src/java|pylib)/')), 0)::BIGINT AS added FROM {touched} GROUP BY pr),
sy AS (WITH q AS ("""
    + B.STYLE_DELTA_SQL
    + r""") SELECT pr, count(*) FILTER (kind = 'introduced') AS style_new, count(*) FILTER (kind = 'pre-existing') AS style_old, count(*) FILTER (kind = 'fixed') AS style_fixed, list_slice(list(path || ':' || line || ' ' || rule ORDER BY path, line, rule) FILTER (kind = 'introduced'), 1, 50) AS style_places FROM q JOIN {owners} USING (file_id) GROUP BY pr),
mt AS (WITH q AS ("""
    + B.METHOD_DELTA_SQL
    + r""") SELECT pr, count(*) FILTER (NOT starts_with(path, 'test/')) AS complex_new, count(*) FILTER (starts_with(path, 'test/')) AS complex_tests, list_slice(list(cls || '.' || sig || ' ' || score ORDER BY score DESC, path, cls, sig) FILTER (NOT starts_with(path, 'test/')), 1, 5) AS complex_top FROM q JOIN {owners} USING (file_id) WHERE starts_with(kind, 'introduced') AND score >= 15 GROUP BY pr),
rn AS ("""
    + B.NEW_SQL
    + f""", {B.BASE_SQL}, fd AS (SELECT o.pr, rule, {B.CATEGORY} AS category, starts_with(path, 'test/') AS in_test, is_new FROM nw JOIN {{owners}} o USING (file_id)), c AS (SELECT pr, rule, min(category) AS category, count(*) FILTER (is_new) AS introduced, count(*) FILTER (is_new AND NOT in_test) AS production FROM fd GROUP BY ALL),
 x AS (SELECT c.*, coalesce(violations, 0) AS violations, coalesce(loc, 0) AS loc, coalesce(files_hit::DOUBLE / scanned, 0) >= 0.25 AS house, coalesce(added, 0) AS added FROM c LEFT JOIN (SELECT * FROM br JOIN bb USING (branch) WHERE branch = 'src1') USING (rule) LEFT JOIN ad USING (pr)), y AS (SELECT *, CASE WHEN loc > 0 THEN violations::DOUBLE / loc * added ELSE 0 END AS expected FROM x)
 SELECT *, coalesce(CASE WHEN production > 0 AND violations > 0 AND loc > 0 AND added > 0 THEN 1 - list_sum(list_transform(range(production), lambda i: exp(-expected + i * ln(expected) - CASE WHEN i < 2 THEN 0 ELSE lgamma(i + 1) END))) >= 0.01 END, false) AS usual, rule IN ('Rule5', 'Rule6') AS needs_types FROM y),
rd AS (SELECT rn.*, needs_types AND NOT coalesce(types, false) AS blind, NOT house AND NOT usual AND introduced > 0 AND NOT (needs_types AND NOT coalesce(types, false)) AS counts, category IN ('errorprone', 'multithreading', 'security') AS red FROM rn LEFT JOIN {{static_runs}} USING (pr)),
"""
    + r"""bg AS (SELECT pr, coalesce(sum(production) FILTER (counts AND red), 0)::BIGINT AS bugs_new, coalesce(sum(production) FILTER (counts AND NOT red), 0)::BIGINT AS bugs_other, coalesce(list(rule || ' ' || production ORDER BY production DESC, rule) FILTER (counts AND red AND production > 0), []) AS bug_rules, coalesce(list(rule || ' is usual' ORDER BY rule) FILTER (usual AND NOT house AND production > 0), []) AS usual_rules, coalesce(list(rule || ' needs types' ORDER BY rule) FILTER (blind AND NOT house AND introduced > 0), []) AS untyped_rules FROM rd GROUP BY pr),
cp AS (WITH q AS ("""
    + COPY_SQL
    + r""") SELECT block AS pr, 1 AS copies_new, list_slice(list(l_partkey || ':' || n || '-' || (n + 4) ORDER BY l_partkey || ':' || n || '-' || (n + 4)), 1, 50) AS copies FROM q JOIN (SELECT DISTINCT l_orderkey AS block, l_partkey, l_linenumber * 10 AS n FROM lineitem) USING (block) WHERE introduced GROUP BY block), """
    + VOTE_SQL
    + r""", fx AS (SELECT kd.*, lookup, ticket_status, versions, wanted, targets, no_ci, unknown_sha, stale, compared, ci_branches, no_upgrade, ci_failed, uncounted, prod_lines, suites, all_tests, has_prod, protected, grammar, yaml, recent, java, admin, help, surfaces, sensitive, log_lines, entries, banned, deprecated, properties, unlicensed, commits, bad, trailers, helped, bench_first, source_first,
 CASE WHEN bu.head = kd.head AND bu.status <> 'not-built' THEN bu.status END AS build, compile_errors, run, failing, flaky, artifacts, executable, missed, unmeasured, sr.status AS static, expected, style_status, style_analyzed, rules_status, rules_analyzed, copies_status, copies_analyzed, catalog, CASE WHEN kd.base = 'project-3.0' THEN 'missing' WHEN kd.pr % 29 = 4 THEN 'unreadable' ELSE 'read' END AS style_file, coalesce(style_new, 0) AS style_new, coalesce(style_old, 0) AS style_old, coalesce(style_fixed, 0) AS style_fixed, coalesce(style_places, []) AS style_places, coalesce(complex_new, 0) AS complex_new, coalesce(complex_tests, 0) AS complex_tests, coalesce(complex_top, []) AS complex_top, coalesce(bugs_new, 0) AS bugs_new, coalesce(bugs_other, 0) AS bugs_other, bug_rules, usual_rules, untyped_rules, coalesce(copies_new, 0) AS copies_new, copies, len(ids) + CASE WHEN author_vote IS NOT NULL AND NOT coalesce(all_tests, false) THEN 1 ELSE 0 END AS have, CASE WHEN coalesce(all_tests, false) THEN 1 ELSE 2 END AS need, shown, CASE WHEN author_vote IS NOT NULL AND NOT coalesce(all_tests, false) THEN [kd.author || ' as author'] ELSE [] END AS own_vote, list_transform(others, lambda x: x || ' is no committer') AS other_votes,
 kd.pr % 23 <> 5 AS roster_read, kd.base NOT IN ('project-3.0', 'project-3.11') AS has_latest, list_filter([CASE WHEN bench THEN 'benchmark file' END, CASE WHEN label = 'Performance' THEN 'label' END, CASE WHEN component = 'Test/benchmark' THEN 'component' END], lambda x: x IS NOT NULL) AS strong, list_filter([CASE WHEN starts_with(summary, 'Faster') THEN 'title' END, CASE WHEN contains(body, 'JMH') THEN 'body' END], lambda x: x IS NOT NULL) AS medium,
 list_filter([CASE WHEN starts_with(branch, 'codex/') THEN 'branch name' END, CASE WHEN contains(body, 'copilot') THEN 'description' END], lambda x: x IS NOT NULL) AS hints
 FROM kd JOIN tw USING (pr) LEFT JOIN br USING (pr) LEFT JOIN ct ON ct.key = kd.key LEFT JOIN ff USING (pr) LEFT JOIN sf USING (pr) LEFT JOIN sn USING (pr) LEFT JOIN lg USING (pr) LEFT JOIN ul USING (pr) LEFT JOIN cm USING (pr) LEFT JOIN co USING (pr) LEFT JOIN sy USING (pr) LEFT JOIN mt USING (pr) LEFT JOIN bg USING (pr) LEFT JOIN cp USING (pr) LEFT JOIN {builds} bu ON bu.pr = kd.pr LEFT JOIN {static_runs} sr ON sr.pr = kd.pr LEFT JOIN vo ON vo.pr = kd.pr)"""
)
SOURCE = "WHEN key IS NULL AND NOT release THEN 'not-applicable' WHEN key IS NULL OR lookup IN ('unavailable', 'not found') THEN 'unknown'"
TICKET = "WHEN lookup = 'unavailable' THEN 'unknown' WHEN lookup IS DISTINCT FROM 'found' THEN 'not-applicable'"
GATE = "WHEN static IS NULL THEN 'unknown' WHEN static = 'no changed files' THEN 'not-applicable' WHEN static <> 'ran' THEN 'unknown' WHEN {0}_status = 'not-applicable' THEN 'not-applicable' WHEN {0}_status <> 'ran' THEN 'unknown' WHEN {0}_analyzed < expected{1} THEN 'unknown'"
STYLED = "static IS NOT NULL AND style_status = 'ran'"
#: id, owner, blocking, status, whether action is required, blocking where it differs, evidence
RULES = [
    ("jira.key-present", "contributor", True, "CASE WHEN key IS NOT NULL THEN 'pass' WHEN release THEN 'fail' ELSE 'warn' END", None, "key IS NOT NULL OR release", "[]"),
    ("jira.ticket-exists", "contributor", True, "CASE WHEN key IS NULL THEN 'not-applicable' WHEN lookup = 'unavailable' THEN 'unknown' WHEN lookup = 'not found' THEN 'fail' ELSE 'pass' END", None, None, "[]"),
    ("jira.key-consistent", "contributor", False, f"CASE WHEN key IS NULL THEN 'not-applicable' WHEN {has('conflicts')} THEN 'warn' ELSE 'pass' END", None, None, "conflicts"),
    ("jira.not-resolved", "reviewer", False, f"CASE {TICKET} WHEN ticket_status = 'Open' THEN 'pass' ELSE 'warn' END", None, None, "[]"),
    ("jira.fix-version", "contributor", False, f"CASE {TICKET} WHEN NOT release THEN 'not-applicable' WHEN len(versions) > 0 AND list_contains(wanted, base) THEN 'pass' ELSE 'warn' END", None, None, "wanted"),
    ("branches.coverage", "contributor", False, f"CASE {TICKET} WHEN len(wanted) = 0 THEN 'not-applicable' WHEN list_has_all(targets, wanted) THEN 'pass' ELSE 'warn' END", None, None, "wanted"),
    ("ci.evidence", "committer", True, f"CASE {SOURCE} WHEN len(no_ci) > 0 THEN 'fail' ELSE 'pass' END", None, None, "targets"),
    ("ci.freshness", "committer", False, f"CASE {SOURCE} WHEN compared = 0 THEN 'not-applicable' WHEN len(stale) + len(unknown_sha) > 0 THEN 'warn' ELSE 'pass' END", f"coalesce(CASE {SOURCE} WHEN compared = 0 THEN '' WHEN len(stale) > 0 THEN 'yes' END = 'yes', false)", None, "list_concat(stale, unknown_sha)"),
    ("ci.profile", "committer", True, f"CASE WHEN sensitive IS NULL THEN 'not-applicable' {SOURCE} WHEN ci_branches IS NULL THEN 'unknown' WHEN len(no_upgrade) > 0 THEN 'fail' ELSE 'pass' END", None, None, "sensitive"),
    ("ci.failures", "reviewer", False, "CASE WHEN ci_branches IS NULL THEN 'not-applicable' WHEN ci_failed > 0 THEN 'warn' WHEN len(uncounted) > 0 THEN 'unknown' ELSE 'pass' END", None, None, "ci_branches"),
    ("commits.message-format", "contributor", False, "CASE WHEN commits IS NULL THEN 'unknown' WHEN bad > 0 THEN 'warn' ELSE 'pass' END", "false", None, "[]"),
    ("commits.provenance", "contributor", False, "CASE WHEN len(hints) > 0 AND NOT coalesce(helped, false) THEN 'warn' ELSE 'pass' END", None, None, "hints"),
    ("changelog.entry", "contributor", False, "CASE WHEN NOT coalesce(has_prod, false) THEN 'not-applicable' WHEN coalesce(len(entries), 0) = 0 THEN 'warn' WHEN key IS NULL OR len(list_filter(entries, lambda x: contains(x, key))) > 0 THEN 'pass' ELSE 'warn' END", None, None, "entries"),
    ("commit.perf-structure", "contributor", False, "CASE WHEN len(strong) = 0 AND len(medium) < 2 THEN 'not-applicable' WHEN commits IS NULL THEN 'unknown' WHEN source_first IS NULL THEN 'not-applicable' WHEN bench_first < source_first THEN 'pass' ELSE 'warn' END", "coalesce((len(strong) > 0 OR len(medium) > 1) AND bench_first > source_first, false)", None, "list_concat(strong, medium)"),
    ("tests.present", "contributor", True, "CASE WHEN coalesce(prod_lines, 0) = 0 THEN 'not-applicable' WHEN len(suites) = 0 THEN 'fail' ELSE 'pass' END", None, None, "suites"),
    ("build.compiles", "contributor", True, "CASE WHEN build IS NULL THEN 'not-applicable' WHEN build = 'build-failed' THEN 'fail' WHEN build = 'timeout' OR (build = 'unknown' AND run IS NULL) THEN 'unknown' ELSE 'pass' END", None, "NOT coalesce(build = 'timeout' OR (build = 'unknown' AND run IS NULL), false)", "[]"),
    ("build.tests-pass", "contributor", True, "CASE WHEN build IS NULL OR build = 'build-failed' THEN 'not-applicable' WHEN build = 'timeout' OR run IS NULL OR build = 'unknown' THEN 'unknown' WHEN failing > 0 OR (build = 'tests-failed' AND artifacts = 0) THEN 'fail' WHEN artifacts > 0 OR flaky > 0 OR run = 0 THEN 'unknown' ELSE 'pass' END",
     None, "NOT coalesce(build <> 'build-failed' AND (build IN ('timeout', 'unknown') OR run IS NULL OR ((failing = 0 AND NOT (build = 'tests-failed' AND artifacts = 0)) AND (artifacts > 0 OR flaky > 0 OR run = 0)) OR (run = 0 AND failing > 0 AND build = 'pass' AND artifacts = 0 AND flaky = 0)), false)", "[]"),
    ("build.changed-line-coverage", "contributor", False, "CASE WHEN build IS NULL OR build = 'build-failed' OR executable = 0 THEN 'not-applicable' WHEN executable IS NULL THEN 'unknown' WHEN missed > 0 THEN 'warn' WHEN unmeasured > 0 THEN 'unknown' ELSE 'pass' END", "false", None, "[]"),
    ("static.checkstyle", "contributor", False, f"CASE {GATE.format('style', '')} WHEN style_new > 0 THEN 'warn' ELSE 'pass' END", None, None, "list_concat(style_places, [style_old || ' pre-existing, ' || style_fixed || ' fixed'])"),
    ("static.complexity", "contributor", False, f"CASE {GATE.format('rules', ' AND rules_analyzed = 0')} WHEN complex_new > 0 THEN 'warn' WHEN rules_analyzed < expected THEN 'unknown' ELSE 'pass' END", "false", None, "list_concat(complex_top, CASE WHEN complex_tests > 0 THEN [complex_tests || ' in tests'] ELSE [] END)"),
    ("static.pmd-rules", "contributor", False, f"CASE {GATE.format('rules', ' AND rules_analyzed = 0')} WHEN catalog <> 'ran' THEN 'unknown' WHEN bugs_new > 0 THEN 'warn' WHEN rules_analyzed < expected THEN 'unknown' ELSE 'pass' END", "false", None, "list_concat(list_concat(bug_rules, usual_rules), untyped_rules)"),
    ("static.duplication", "contributor", False, f"CASE {GATE.format('copies', '')} WHEN copies_new > 0 THEN 'warn' ELSE 'pass' END", "false", None, "copies"),
    ("static.banned-api", "contributor", False, f"CASE WHEN {STYLED} THEN 'not-applicable' WHEN style_file = 'missing' THEN 'not-applicable' WHEN style_file <> 'read' THEN 'unknown' WHEN banned IS NOT NULL THEN 'warn' ELSE 'pass' END", None, None, "banned"),
    ("static.license-header", "contributor", False, "CASE WHEN unlicensed IS NOT NULL THEN 'warn' ELSE 'pass' END", None, None, "unlicensed"),
    ("static.protected-paths", "contributor", False, f"CASE WHEN {has('protected')} OR {has('grammar')} THEN 'warn' ELSE 'pass' END", has("protected"), None, "list_concat(protected, grammar)"),
    ("static.deprecated-since", "contributor", False, f"CASE WHEN {STYLED} THEN 'not-applicable' WHEN deprecated IS NOT NULL THEN 'warn' ELSE 'pass' END", None, None, "deprecated"),
    ("compat.config-pairing", "contributor", True, "CASE WHEN NOT coalesce(yaml OR recent OR java, false) OR NOT has_latest THEN 'not-applicable' WHEN yaml THEN CASE WHEN recent THEN 'pass' ELSE 'fail' END WHEN recent THEN 'pass' ELSE 'warn' END", "coalesce(yaml AND NOT recent AND has_latest, false)", None, "[]"),
    ("compat.system-properties", "contributor", False, "CASE WHEN properties IS NOT NULL THEN 'warn' ELSE 'pass' END", None, None, "properties"),
    ("compat.command-help", "contributor", False, f"CASE WHEN NOT {has('admin')} THEN 'not-applicable' WHEN help > 0 THEN 'pass' ELSE 'warn' END", "false", None, "admin"),
    ("compat.surfaces", "reviewer", False, "CASE WHEN surfaces IS NULL THEN 'pass' ELSE 'warn' END", "false", None, "surfaces"),
    ("votes.committer-plus-ones", "reviewer", True, "CASE WHEN have >= need THEN 'pass' WHEN NOT roster_read AND have = 0 THEN 'unknown' ELSE 'fail' END", None, None, "list_concat(list_concat(shown, own_vote), other_votes)"),
]
RESULT_SQL = FACT_SQL + ", re AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT pr, '{i}' AS check_id, {s} AS status, {b if o is None else o} AS blocking, '{w}' AS owner, ({'NULL' if r is None else r})::BOOLEAN AS required, coalesce({e}, []) AS evidence FROM fx" for i, w, b, s, r, o, e in RULES) + "), rs AS (SELECT pr, check_id, status, blocking, owner, coalesce(required AND status IN ('fail', 'warn'), status IN ('fail', 'warn')) AS action_required, evidence FROM re)"


def results(t):
    """All checks of all changes, with their words."""
    return C.run_checks(facts(t))


def statuses(t):
    """What each check of each change says, where nothing but that is asked for."""
    return C.statuses(facts(t, C.asked()))


def flags(t):
    """What decides over each change, a row a change; of facts those alone are made that conditions read."""
    return C.flagged(facts(t, C.asked()))


@query(RESULT_SQL + " SELECT pr, check_id, status, blocking, owner, action_required, array_to_string(evidence, '|') AS evidence FROM rs")
def chk1_chk31_checks(t):
    return results(t).select("pr", "check_id", "status", "blocking", "owner", "action_required", F.array_join("evidence", "|").alias("evidence"))


SUMMARY_SQL = RESULT_SQL + """ SELECT pr, check_id, CASE check_id WHEN 'jira.key-present' THEN CASE status WHEN 'pass' THEN key || ' in ' || array_to_string(sources, ', ') WHEN 'warn' THEN 'no ticket, on a feature branch' ELSE 'no ticket key' END
 WHEN 'branches.coverage' THEN CASE status WHEN 'unknown' THEN 'the tracker could not be reached' WHEN 'warn' THEN 'no change for ' || array_to_string(list_filter(wanted, lambda b: NOT list_contains(targets, b)), ', ') WHEN 'pass' THEN len(wanted) || ' branches covered' ELSE CASE WHEN lookup = 'found' THEN 'no expected branches' ELSE 'no ticket' END END
 WHEN 'votes.committer-plus-ones' THEN CASE status WHEN 'unknown' THEN 'the roster could not be read' ELSE have || ' of ' || need END END AS summary,
 CASE check_id WHEN 'jira.key-present' THEN CASE status WHEN 'warn' THEN 'Add a ticket if the work will reach a release.' WHEN 'fail' THEN 'Put the key of a ticket in the title.' END WHEN 'branches.coverage' THEN CASE status WHEN 'warn' THEN 'Open a change for each branch.' END ELSE CASE status WHEN 'fail' THEN 'Ask for review.' END END AS action
 FROM rs JOIN fx USING (pr) WHERE check_id IN ('jira.key-present', 'branches.coverage', 'votes.committer-plus-ones')"""


@query(SUMMARY_SQL)
def chk1_chk6_chk31_summaries(t):
    some = {k: C.CHECKS[k] for k in ("jira.key-present", "branches.coverage", "votes.committer-plus-ones")}
    return C.run_checks(facts(t, C.asked(some, words=True)), some).select("pr", "check_id", "summary", "action")


def reviewed(changes, t):
    """changes with must_fix, ran, complete, approved of each one's panel: complete with three lenses, approved when all approve."""
    f = t("findings").groupBy("pr").agg(F.count(F.when(F.col("severity").isin("blocker", "major"), 1)).alias("must_fix"), (F.count_distinct("lens") >= 3).alias("complete"), F.bool_and(F.col("idx") % 5 != 4).alias("approved"), F.lit(True).alias("ran"))
    return changes.join(f, "pr", "left").fillna(0, ["must_fix"]).fillna(False, ["ran", "complete", "approved"])


def reviews_of(t):
    """pr, draft and what `reviewed` adds."""
    return reviewed(t("subjects").select("pr", "draft"), t)
