"""Base against head, coverage, rates, and who knows the code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deltas as D
from ..operators import identity as I
from ..operators import joins as J
from .catalog import query

METHOD_SQL = "WITH b AS (SELECT file_id, cls, name, sig, score FROM {methods} WHERE side = 'base'), h AS (SELECT file_id, cls, name, sig, score, touched FROM {methods} WHERE side = 'head'), bc AS (SELECT file_id, cls, name, count(*) AS n FROM {bodies} WHERE side = 'base' GROUP BY ALL), bn AS (SELECT file_id, name, count(*) AS n FROM {bodies} WHERE side = 'base' GROUP BY ALL), hc AS (SELECT file_id, cls, name, count(*) AS n FROM {bodies} WHERE side = 'head' GROUP BY ALL)"


def sides(t, view="methods"):
    return [t(view).filter(F.col("side") == s).drop("side") for s in ("base", "head")]


def method_delta(t, least=None):
    """least: the score from which head methods are asked about; none: all are."""
    base, head = sides(t)
    return D.method_delta(base, head if least is None else head.filter(F.col("score") >= least), t("renames"), *sides(t, "bodies"))


METHOD_DELTA_SQL = (METHOD_SQL + """, u AS (SELECT file_id, sig, min(score) AS s FROM b GROUP BY ALL HAVING count(*) = 1), j AS (SELECT h.*, r.base_file, r.new_file, e.score AS ex, u.s AS al, coalesce(bc.n, bn.n, 0) >= coalesce(hc.n, 0) AS enough, h.sig IN (SELECT sig FROM b) AS elsewhere FROM h JOIN {renames} r ON r.file_id = h.file_id LEFT JOIN b e ON e.file_id = base_file AND e.cls = h.cls AND e.sig = h.sig LEFT JOIN u ON u.file_id = base_file AND u.sig = h.sig
 LEFT JOIN bc ON bc.file_id = base_file AND bc.cls = h.cls AND bc.name = h.name LEFT JOIN bn ON bn.file_id = base_file AND bn.name = h.name LEFT JOIN hc ON hc.file_id = h.file_id AND hc.cls = h.cls AND hc.name = h.name), k AS (SELECT *, coalesce(ex, al, CASE WHEN base_file IS NOT NULL AND enough THEN 0 END) AS base FROM j)
SELECT file_id, cls, sig, score, base, CASE WHEN new_file THEN 'introduced-new-file' WHEN base IS NULL THEN CASE WHEN base_file IS NOT NULL AND elsewhere THEN 'moved' ELSE 'introduced-new-method' END WHEN score < base THEN 'pre-existing-improved' WHEN score = base THEN CASE WHEN touched THEN 'pre-existing-touched' ELSE 'pre-existing' END WHEN score < 15 THEN 'pre-existing-touched' WHEN base >= 15 THEN 'introduced-worsened' ELSE 'introduced-crossed' END AS kind,
 CASE WHEN ex IS NOT NULL THEN 'exact' WHEN al IS NOT NULL THEN 'signature' WHEN base_file IS NOT NULL AND enough THEN 'existed' END AS matched FROM k""")


@query(METHOD_DELTA_SQL)
def jon11_jon12_method_delta(t):
    return method_delta(t)


@query(METHOD_SQL + " SELECT file_id, cls, sig, score FROM b WHERE score >= 15 AND NOT EXISTS (SELECT 1 FROM h WHERE h.score >= 15 AND h.sig = b.sig AND ((h.file_id = b.file_id AND h.cls = b.cls) OR h.file_id <> b.file_id))")
def jon13_fixed(t):
    base, head = sides(t)
    return D.fixed_methods(base, head).select("file_id", "cls", "sig", "score")


REMOVED_SQL = """SELECT r.file_id, b.cls, b.sig, b.score AS base, CASE WHEN b.score >= 15 THEN 'fixed' ELSE 'pre-existing-improved' END AS kind FROM (SELECT * FROM {methods} WHERE side = 'base' AND score > 0) b JOIN (SELECT * FROM {renames} WHERE base_file IS NOT NULL AND NOT new_file) r ON r.base_file = b.file_id
 WHERE (r.file_id, b.cls, b.sig) NOT IN (SELECT (file_id, cls, sig) FROM {methods} WHERE side = 'head') AND (r.file_id, b.sig) NOT IN (SELECT (file_id, sig) FROM {methods} WHERE side = 'head' GROUP BY file_id, sig HAVING count(*) = 1)"""


def removed(t):
    return D.removed_methods(*sides(t), t("renames"))


@query(REMOVED_SQL)
def jon13_removed(t):
    return removed(t)


@query(f"""WITH q AS ({METHOD_DELTA_SQL}), g AS (SELECT pr, count(*) AS removed FROM ({REMOVED_SQL}) x JOIN {{owners}} USING (file_id) GROUP BY pr), x AS (SELECT o.pr, path, cls, sig, score, base, CASE WHEN base IS NULL THEN 'new' WHEN score > base THEN 'worse' WHEN score = base THEN 'same' ELSE 'better' END AS change, starts_with(path, 'test/') AS test,
 CASE WHEN score >= 30 THEN 'darkred' WHEN score >= 15 THEN 'red' WHEN score >= 10 THEN 'yellow' ELSE 'green' END AS band, coalesce(removed, 0) AS removed FROM q JOIN {{owners}} o USING (file_id) LEFT JOIN g USING (pr) WHERE kind <> 'pre-existing') SELECT *, row_number() OVER (PARTITION BY pr ORDER BY change NOT IN ('new', 'worse'), score DESC, test, path, sig, cls) AS place FROM x""")
def agg16_complexity_table(t):
    return D.complexity_table(method_delta(t), removed(t), t("owners"))


@query(METHOD_SQL + """, j AS (SELECT h.file_id, h.cls, h.sig, b.score AS e, u.s FROM h LEFT JOIN b USING (file_id, cls, sig) LEFT JOIN (SELECT file_id, sig, min(score) AS s FROM b GROUP BY ALL HAVING count(*) = 1) u USING (file_id, sig))
SELECT file_id, cls, sig, coalesce(e, s) AS base, CASE WHEN e IS NOT NULL THEN 0 WHEN s IS NOT NULL THEN 1 END AS level FROM j""")
def jon11_cascade(t):
    base, head = sides(t)
    out = J.cascade(head.select("file_id", "cls", "sig"), base.select("file_id", "cls", "sig", "score"), [["file_id", "cls", "sig"], ["file_id", "sig"]], "score", "base")
    return out.select("file_id", "cls", "sig", "base", "level")


STYLE_DELTA_SQL = """WITH h AS (SELECT file_id, rule, message, line, row_number() OVER (PARTITION BY file_id, rule, message ORDER BY line) AS k FROM {violations} WHERE side = 'head'), b AS (SELECT file_id, rule, message, line, row_number() OVER (PARTITION BY file_id, rule, message ORDER BY line) AS k FROM {violations} WHERE side = 'base')
SELECT file_id, rule, message, k, h.line, b.line AS base_line, CASE WHEN h.line IS NULL THEN 'fixed' WHEN b.line IS NULL THEN 'introduced' ELSE 'pre-existing' END AS kind FROM h FULL JOIN b USING (file_id, rule, message, k)"""


def style_delta(t):
    v = t("violations").select("file_id", "rule", "message", "line", "side")
    base, head = (v.filter(F.col("side") == s).drop("side") for s in ("base", "head"))
    return D.style_delta(base, head, ["file_id", "rule", "message"], ["line"])


@query(STYLE_DELTA_SQL)
def jon14_style_bag_match(t):
    return style_delta(t).select("file_id", "rule", "message", F.col("_k").alias("k"), "line", F.col("r_line").alias("base_line"), "kind")


@query("SELECT pr, file_id, line, rule, side FROM (SELECT DISTINCT pr, file_id, line, rule, side FROM {violations}) v WHERE EXISTS (SELECT 1 FROM {ranges} r WHERE r.file_id = v.file_id AND v.line BETWEEN r.begin_line AND r.end_line)")
def jon8_overlap(t):
    return D.touched(t("violations").select("pr", "file_id", "line", "rule", "side").distinct(), t("ranges"))


@query("SELECT file_id, line, (SELECT min(begin_line) FROM {ranges} r WHERE r.file_id = v.file_id AND r.begin_line >= v.line) AS body FROM (SELECT DISTINCT file_id, line FROM {violations}) v")
def jon9_nearest_following(t):
    return J.nearest(t("violations").select("file_id", "line").distinct(), t("ranges").withColumn("line", F.col("begin_line")), ["file_id"], "line", F.col("begin_line"), "body", following=True)


@query("SELECT file_id, line, (SELECT max(begin_line) FROM {ranges} r WHERE r.file_id = v.file_id AND r.begin_line <= v.line) AS declared FROM (SELECT DISTINCT file_id, line FROM {violations}) v")
def jon10_nearest_preceding(t):
    return J.nearest(t("violations").select("file_id", "line").distinct(), t("ranges").withColumn("line", F.col("begin_line")), ["file_id"], "line", F.col("begin_line"), "declared")


NEW_SQL = """WITH j AS (SELECT v.file_id, rule, pr, line, message, score, base_file, new_file, mapped FROM {violations} v JOIN {renames} r ON r.file_id = v.file_id WHERE side = 'head'), bs AS (SELECT file_id, rule, count(*) AS n FROM {violations} WHERE side = 'base' GROUP BY ALL),
w AS (SELECT j.*, row_number() OVER (PARTITION BY j.file_id, j.rule ORDER BY line, pr, message, score) AS k, count(*) OVER (PARTITION BY j.file_id, j.rule) AS now, coalesce(bs.n, 0) AS before FROM j LEFT JOIN bs ON bs.file_id = base_file AND bs.rule = j.rule),
nw AS (SELECT file_id, rule, pr, line, message, score, CASE WHEN new_file THEN true WHEN mapped THEN EXISTS (SELECT 1 FROM {ranges} r WHERE r.file_id = w.file_id AND w.line BETWEEN begin_line AND end_line) ELSE k > now - greatest(0, now - before) END AS is_new FROM w)"""


def introduced(t):
    v = t("violations")
    base, head = (v.filter(F.col("side") == s).drop("side") for s in ("base", "head"))
    return D.introduced_rules(base, head.select("file_id", "rule", "pr", "line", "message", "score"), t("renames"), t("ranges"), ["line", "pr", "message", "score"])


@query(NEW_SQL + " SELECT * FROM nw")
def jon16_introduced_rules(t):
    return introduced(t)


COUNTERS = "SELECT CASE WHEN l_partkey % 9 = 0 THEN -l_partkey ELSE l_partkey END AS file_id, l_linenumber * 10 + l_suppkey % 10 AS line, min(l_suppkey % 3) AS mi, max(CAST(l_quantity AS INT) % 3) AS ci, min(l_orderkey % 2) AS mb, min(l_orderkey % 4) AS cb FROM lineitem GROUP BY 1, 2"
STATE_SQL = f"WITH a AS (SELECT DISTINCT file_id, unnest(range(begin_line, end_line + 1)) AS line FROM {{ranges}}), c AS ({COUNTERS}), s AS (SELECT file_id, line, CASE WHEN ci IS NULL THEN 'nonexec' WHEN ci = 0 AND cb = 0 THEN 'missed' WHEN mi > 0 OR mb > 0 THEN 'partial' ELSE 'covered' END AS state, file_id IN (SELECT file_id FROM c) AS in_report FROM a LEFT JOIN c USING (file_id, line))"


def states(t):
    c = t("lineitem").groupBy(F.expr("CASE WHEN l_partkey % 9 = 0 THEN -l_partkey ELSE l_partkey END").alias("file_id"), (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10).alias("line")).agg(F.min(F.expr("l_suppkey % 3")).alias("mi"), F.max(F.expr("CAST(l_quantity AS INT) % 3")).alias("ci"), F.min(F.expr("l_orderkey % 2")).alias("mb"), F.min(F.expr("l_orderkey % 4")).alias("cb"))
    return D.line_coverage(D.added_lines(t("ranges")), c)


@query("SELECT DISTINCT file_id, unnest(range(begin_line, end_line + 1)) AS line FROM {ranges}")
def src19_added_lines(t):
    return D.added_lines(t("ranges"))


@query(STATE_SQL + " SELECT file_id, line, state, in_report FROM s")
def jon17_line_coverage(t):
    return states(t)


@query(STATE_SQL + """, g AS (SELECT file_id, count(*) FILTER (state = 'covered') AS covered, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'missed') AS missed, count(*) FILTER (state = 'nonexec') AS nonexec FROM s GROUP BY file_id)
SELECT *, covered + partial + missed AS executable, round(CASE WHEN covered + partial + missed > 0 THEN 100.0::DOUBLE * (covered + partial) / (covered + partial + missed) END, 1) AS pct FROM g""")
def agg17_coverage_totals(t):
    return D.coverage_totals(states(t))


@query("""WITH s AS (SELECT side, count(DISTINCT file_id) AS scanned FROM {violations} GROUP BY side), g AS (SELECT side, rule, count(DISTINCT file_id) AS files_hit, count(*) AS violations FROM {violations} GROUP BY ALL)
SELECT side, rule, files_hit, violations, scanned, files_hit::DOUBLE / scanned AS share, files_hit::DOUBLE / scanned >= 0.25 AS house FROM g JOIN s USING (side)""")
def src13_agg10_agg11_house_rules(t):
    return D.house_rules(t("violations"), t("violations").select("side", "file_id"))


RATES = "SELECT rule, part, observed, violations, loc, 2 * observed + part AS added FROM (SELECT rule, pr % 40 AS part, count(*) AS observed FROM {violations} WHERE side = 'head' GROUP BY ALL) h JOIN (SELECT rule, count(*) AS violations, 40 * count(*) + 100 AS loc FROM {violations} WHERE side = 'base' GROUP BY rule) b USING (rule)"


@query(f"""WITH r AS ({RATES}), e AS (SELECT *, violations::DOUBLE / loc * added AS expected FROM r), p AS (SELECT *, 1 - list_sum(list_transform(range(observed), lambda i: exp(-expected + i * ln(expected) - CASE WHEN i < 2 THEN 0 ELSE lgamma(i + 1) END))) AS p0 FROM e)
SELECT rule, part, observed, violations, loc, added, round(expected, 6) AS expected, round(p0, 6) AS p, p0 >= 0.01 AS usual FROM p""")
def agg13_rate_test(t):
    v = t("violations")
    head = v.filter("side = 'head'").groupBy("rule", (F.col("pr") % 40).alias("part")).agg(F.count(F.lit(1)).alias("observed"))
    base = v.filter("side = 'base'").groupBy("rule").agg(F.count(F.lit(1)).alias("violations")).withColumn("loc", F.col("violations") * 40 + 100)
    out = D.judged(head.join(base, "rule").withColumn("added", 2 * F.col("observed") + F.col("part")))
    return out.select("rule", "part", "observed", "violations", "loc", "added", F.round("expected", 6).alias("expected"), F.round("p", 6).alias("p"), "usual")


FILED = "SELECT source AS branch, doc_id AS file, text FROM documents"
RULED = "SELECT source AS branch, doc_id AS file, unnest(['Rule' || (n_chars % 17), 'Rule' || (doc_id % 5), 'Rule' || (doc_id % 5)]) AS rule FROM documents"


def baseline(t):
    d = t("documents")
    rule = lambda c: F.concat(F.lit("Rule"), c.cast("string"))
    rules = F.array(rule(F.col("n_chars") % 17), rule(F.col("doc_id") % 5), rule(F.col("doc_id") % 5))
    return D.branch_baseline(d.select(F.col("source").alias("branch"), F.col("doc_id").alias("file"), F.explode(rules).alias("rule")), d.select(F.col("source").alias("branch"), F.col("doc_id").alias("file"), "text"))


BASE_SQL = f"br AS (SELECT branch, rule, count(DISTINCT file) AS files_hit, count(*) AS violations FROM ({RULED}) GROUP BY ALL), bb AS (SELECT branch, count(DISTINCT file) AS scanned, sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\x0b\\x0c]'))))::BIGINT AS loc FROM ({FILED}) GROUP BY branch)"


@query(f"WITH {BASE_SQL} SELECT branch, rule, files_hit, violations, scanned, loc FROM br JOIN bb USING (branch)")
def agg10_branch_baseline(t):
    rules, branch = baseline(t)
    return rules.join(branch, "branch")


CATEGORY = "CASE WHEN rule IN ('Rule1', 'Rule2', 'Rule3') THEN 'design' WHEN rule LIKE 'Rule1%' THEN 'style' ELSE 'errorprone' END"
SECTION_SQL = NEW_SQL + f""", {BASE_SQL}, fd AS (SELECT rule, {CATEGORY} AS category, starts_with(path, 'test/') AS in_test, is_new FROM nw JOIN {{paths}} USING (file_id)), ct AS (SELECT rule, min(category) AS category, count(*) FILTER (is_new) AS introduced, count(*) FILTER (is_new AND in_test) AS in_tests, count(*) FILTER (NOT is_new) AS pre_existing FROM fd GROUP BY rule),
jj AS (SELECT ct.*, introduced - in_tests AS production, coalesce(violations, 0) AS violations, coalesce(loc, 0) AS loc, coalesce(files_hit::DOUBLE / scanned, 0) AS share FROM ct LEFT JOIN (SELECT * FROM br JOIN bb USING (branch) WHERE branch = 'src1') USING (rule)), ex AS (SELECT *, CASE WHEN loc > 0 THEN violations::DOUBLE / loc * 500 ELSE 0 END AS expected FROM jj),
pp AS (SELECT *, CASE WHEN production > 0 AND violations > 0 AND loc > 0 THEN 1 - list_sum(list_transform(range(production), lambda i: exp(-expected + i * ln(expected) - CASE WHEN i < 2 THEN 0 ELSE lgamma(i + 1) END))) END AS p0 FROM ex), sc AS (SELECT rule, category, introduced, in_tests, production, pre_existing, share, share >= 0.25 AS house, expected, p0, coalesce(p0 >= 0.01, false) AS usual, rule IN ('Rule5', 'Rule6') AS needs_types FROM pp),
se AS (SELECT *, CASE WHEN needs_types THEN 'untyped' WHEN house THEN 'house' WHEN usual THEN 'usual' ELSE 'counted' END AS class FROM sc)"""


def section(t):
    found = introduced(t).join(t("paths"), "file_id").select("rule", F.expr(CATEGORY).alias("category"), F.col("path").startswith("test/").alias("in_test"), "is_new")
    rules, branch = baseline(t)
    return D.rule_section(found, rules.filter("branch = 'src1'"), branch.filter("branch = 'src1'"), 500, ["Rule5", "Rule6"])


@query(SECTION_SQL + " SELECT rule, category, introduced, in_tests, production, pre_existing, round(share, 6) AS share, house, round(expected, 6) AS expected, round(p0, 6) AS p, usual, needs_types, class FROM se")
def agg14_set6_rule_section(t):
    s = section(t)
    return s.select("rule", "category", "introduced", "in_tests", "production", "pre_existing", F.round("share", 6).alias("share"), "house", F.round("expected", 6).alias("expected"), (F.round("p", 6) + 0.0).alias("p"), "usual", "needs_types", "class")


@query(SECTION_SQL + """ SELECT coalesce(category, 'total') AS category, sum(introduced)::BIGINT AS introduced, count(*) AS rules, coalesce(sum(introduced) FILTER (class = 'house'), 0)::BIGINT AS house, count(*) FILTER (class = 'house') AS house_rules, coalesce(sum(introduced) FILTER (class = 'usual'), 0)::BIGINT AS usual, count(*) FILTER (class = 'usual') AS usual_rules,
 coalesce(sum(introduced) FILTER (class = 'counted'), 0)::BIGINT AS counted, count(*) FILTER (class = 'counted') AS counted_rules FROM se WHERE class <> 'untyped' AND introduced > 0 GROUP BY GROUPING SETS ((category), ())""")
def agg15_category_rollup(t):
    return D.category_rollup(section(t)).withColumn("category", F.coalesce("category", F.lit("total")))


@query("SELECT rule, b.n AS before, h.n AS after FROM (SELECT rule, count(*) AS n FROM {violations} WHERE side = 'base' GROUP BY rule) b FULL JOIN (SELECT rule, count(*) AS n FROM {violations} WHERE side = 'head' GROUP BY rule) h USING (rule) WHERE b.n IS DISTINCT FROM h.n")
def agg33_rule_count_diff(t):
    v = t("violations")
    a, b = (v.filter(F.col("side") == s).groupBy("rule").agg(F.count(F.lit(1)).alias(n)) for s, n in (("base", "before"), ("head", "after")))
    return a.join(b, "rule", "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


SNAP_SQL = "WITH a AS (SELECT p_partkey AS name, md5(p_type) AS hash FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS name, md5(CASE WHEN p_size % 5 = 0 THEN 'x' ELSE p_type END) AS hash FROM part WHERE p_partkey % 4 <> 0)"


@query(SNAP_SQL + " SELECT name, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b USING (name) WHERE a.hash IS DISTINCT FROM b.hash")
def set7_snapshot_diff(t):
    p = t("part")
    a = p.filter("p_partkey % 3 <> 0").selectExpr("p_partkey AS name", "md5(p_type) AS hash")
    b = p.filter("p_partkey % 4 <> 0").selectExpr("p_partkey AS name", "md5(CASE WHEN p_size % 5 = 0 THEN 'x' ELSE p_type END) AS hash")
    return J.outer_diff(a, b, "name", "hash")


ROSTER = "SELECT login AS id, display FROM {people} WHERE committer"
NAMES = "SELECT c_custkey AS n, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN concat('dev', CAST(c_custkey AS STRING)) WHEN 2 THEN 'Someone Else' ELSE concat('Nick ', CAST(c_custkey % 10 AS STRING)) END AS name, CASE WHEN c_custkey % 8 = 0 THEN concat('DEV', CAST(c_custkey AS STRING), '@project.org') ELSE NULL END AS email FROM customer"
NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH r AS ({ROSTER}), n AS (SELECT *, {NORM.format('name')} AS nn, CASE WHEN ends_with(lower(email), '@project.org') THEN split_part(lower(email), '@', 1) END AS ee FROM ({NAMES})), d AS (SELECT {NORM.format('display')} AS nn, min(id) AS id FROM r GROUP BY 1)
SELECT n, coalesce(r1.id, CASE WHEN nn = 'nick 3' THEN 'dev3' END, r2.id, d.id, 'name:' || nn) AS person, CASE WHEN r1.id IS NOT NULL THEN 'by_email' WHEN nn = 'nick 3' THEN 'by_alias' WHEN r2.id IS NOT NULL THEN 'by_id' WHEN d.id IS NOT NULL THEN 'by_name' ELSE 'unknown' END AS rule
FROM n LEFT JOIN r r1 ON r1.id = ee LEFT JOIN r r2 ON r2.id = nn LEFT JOIN d USING (nn)""")
def jon18_identity(t):
    names = t("customer").selectExpr("c_custkey AS n", "CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN concat('dev', c_custkey) WHEN 2 THEN 'Someone Else' ELSE concat('Nick ', c_custkey % 10) END AS name", "CASE WHEN c_custkey % 8 = 0 THEN concat('DEV', c_custkey, '@project.org') END AS email")
    roster = t("people").filter("committer").selectExpr("login AS id", "display")
    alias = names.sparkSession.createDataFrame([("nick 3", "dev3")], "name string, id string")
    return I.resolve(names, roster, alias).select("n", "person", "rule")


CREDITS = "SELECT concat('src/F', CAST(l_partkey % 30 AS STRING)) AS path, concat('dev', CAST(o_custkey AS STRING)) AS person, CASE WHEN l_linenumber % 3 = 0 THEN 'reviewer' ELSE 'author' END AS role, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
EXPERT_SQL = f"WITH c AS ({CREDITS}), a AS (SELECT *, greatest(0.0::DOUBLE, (DATE '1999-06-01' - day) / 365.25::DOUBLE) AS age FROM c), x AS (SELECT path, person, round(sum(CASE role WHEN 'author' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * pow(0.5::DOUBLE, age / 2)), 2) AS score, count(*) FILTER (role = 'author') AS patches, count(*) FILTER (role <> 'author') AS reviews, max(day) AS latest FROM a WHERE age <= 5 GROUP BY path, person)"


def per_file(t):
    c = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).selectExpr("concat('src/F', l_partkey % 30) AS path", "concat('dev', o_custkey) AS person", "CASE WHEN l_linenumber % 3 = 0 THEN 'reviewer' ELSE 'author' END AS role", "CAST(o_orderdate AS DATE) AS day")
    return I.experts(c, "1999-06-01")


@query(EXPERT_SQL + " SELECT path, person, score, patches, reviews, latest FROM x")
def agg9_experts(t):
    return per_file(t)


@query(EXPERT_SQL + " SELECT person, round(sum(score), 2) AS score, sum(patches)::BIGINT AS patches, sum(reviews)::BIGINT AS reviews, count(*) AS files, max(latest) AS latest FROM x GROUP BY person")
def agg9_expert_totals(t):
    return I.expert_totals(per_file(t))


@query(EXPERT_SQL + ", g AS (SELECT person, round(sum(score), 2) AS score FROM x WHERE person NOT IN ('dev1', 'dev2') GROUP BY person) SELECT person, score FROM g ORDER BY score DESC, person LIMIT 5")
def out4_jon21_suggested_reviewers(t):
    x = per_file(t)
    authors = x.sparkSession.createDataFrame([("dev1",), ("dev2",)], "person string")
    return I.expert_totals(x).join(authors, "person", "left_anti").select("person", "score").orderBy(F.desc("score"), "person").limit(5)


@query("""WITH b AS (SELECT event_id - event_id % 3 AS seq, concat('f', CAST(user_id AS VARCHAR)) AS path, sum(1 + event_id % 9)::BIGINT AS lines FROM events GROUP BY ALL), c AS (SELECT seq, seq % 4 = 0 AS merge, CAST(ts AS DATE) AS day, CASE seq % 6 WHEN 0 THEN 'PROJ-' || (1000 + CAST(substr(login, 4) AS BIGINT)) WHEN 1 THEN 'PROJ-' || (1000 + CAST(substr(login, 4) AS BIGINT)) WHEN 2 THEN 'PROJ-' || (500 + CAST(substr(login, 4) AS BIGINT)) END AS key FROM {commits})
SELECT key, sum(lines)::BIGINT AS lines, count(DISTINCT path) AS files, count(DISTINCT seq) AS commits, max(day) AS last_changed FROM b JOIN c USING (seq) WHERE NOT merge GROUP BY key""")
def agg8_related_tickets(t):
    from ..functions import text as X

    blame = t("events").groupBy((F.col("event_id") - F.col("event_id") % 3).alias("sha"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path")).agg(F.sum(1 + F.col("event_id") % 9).alias("lines"))
    commits = t("commits").select(F.col("seq").alias("sha"), (F.col("seq") % 4 == 0).alias("merge"), X.primary_key(F.col("message")).alias("key"), F.col("ts").cast("date").alias("day"))
    return I.related_tickets(blame, commits)


@query("SELECT login, list_sort(list(DISTINCT lower(email))) AS emails FROM {people} GROUP BY login")
def agg40_emails(t):
    return t("people").groupBy("login").agg(F.array_sort(F.collect_set(F.lower("email"))).alias("emails"))
