"""Findings: pair scores, clusters, issues, duplicate blocks, panel benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bench as B
from ..operators import findings as D
from ..operators import refresh as R
from ..operators.ranking import top_k
from ..shared import materialise
from .catalog import query
from .scalar import identifiers_sql, words_sql

PAIR_SQL = f"""WITH s AS MATERIALIZED (SELECT pr, idx, lens, {identifiers_sql('problem')} AS pi, {words_sql('problem')} AS pw, {identifiers_sql('fix')} AS fi, nullif(regexp_extract(location, '^(.*\\.\\w+):(\\d+)$', 1), '') AS path, TRY_CAST(nullif(regexp_extract(location, '^(.*\\.\\w+):(\\d+)$', 2), '') AS BIGINT) AS line FROM {{panel}}),
jn AS (SELECT a.pr, a.idx AS i, b.idx AS j, a.pi AS pi, b.pi AS pi2, a.pw AS pw, b.pw AS pw2, a.fi AS fi, b.fi AS fi2, a.path AS pa, b.path AS pb, abs(a.line - b.line) AS far FROM s a JOIN s b ON a.pr = b.pr AND a.idx < b.idx AND a.lens <> b.lens),
j3 AS (SELECT *, len(list_intersect(pi, pi2)) AS xi, len(list_intersect(pw, pw2)) AS xw, len(list_intersect(fi, fi2)) AS xf FROM jn),
sc AS (SELECT pr, i, j, 0.4::DOUBLE * CASE WHEN len(pi) + len(pi2) = 0 THEN 0 ELSE xi::DOUBLE / (len(pi) + len(pi2) - xi) END + 0.3::DOUBLE * CASE WHEN len(pw) + len(pw2) = 0 THEN 0 ELSE xw::DOUBLE / (len(pw) + len(pw2) - xw) END + 0.3::DOUBLE * CASE WHEN len(fi) + len(fi2) = 0 THEN 0 ELSE xf::DOUBLE / (len(fi) + len(fi2) - xf) END AS tx,
 CASE WHEN pa IS NULL OR pb IS NULL THEN 0.1::DOUBLE WHEN pa <> pb THEN 0 WHEN far <= 3 THEN 0.3::DOUBLE WHEN far <= 10 THEN 0.15::DOUBLE ELSE 0 END AS bonus, xi + xw + xf AS shared FROM j3),
ps AS (SELECT pr, i, j, round(tx, 9) AS text, round(tx + bonus, 9) AS total FROM sc WHERE shared > 0)"""


@query(PAIR_SQL + " SELECT pr, i, j, text, total FROM ps")
def jon24_fuz1_pair_scores(t):
    return D.pair_scores(t("panel"))


@query(PAIR_SQL + " SELECT pr, i, j, total FROM ps WHERE text >= 0.18 AND total >= 0.4")
def fuz2_edges(t):
    return D.edges(D.pair_scores(t("panel"))).select("pr", "i", "j", "total")


@query("WITH RECURSIVE " + PAIR_SQL[5:] + """, e AS (SELECT pr, i AS a, j AS b FROM ps WHERE text >= 0.18 AND total >= 0.4 UNION SELECT pr, j, i FROM ps WHERE text >= 0.18 AND total >= 0.4), r AS (SELECT pr, a AS idx, a AS reach FROM e UNION SELECT r.pr, r.idx, e.b FROM r JOIN e ON e.pr = r.pr AND e.a = r.reach)
SELECT pr, idx, min(reach) AS root FROM r GROUP BY pr, idx""")
def fuz3_connected(t):
    return D.connected(D.edges(D.pair_scores(t("panel"))))


# greedy joins as a recursion over each change's edges, strongest first; c holds the cluster of each finding, l its lens
CLUSTER_SQL = "WITH RECURSIVE " + PAIR_SQL[5:] + """, e AS MATERIALIZED (SELECT pr, i, j, row_number() OVER (PARTITION BY pr ORDER BY total DESC, i, j) AS k FROM ps WHERE text >= 0.18 AND total >= 0.4), b AS (SELECT pr, list(lens ORDER BY idx) AS l, list(idx ORDER BY idx) AS c FROM s GROUP BY pr),
walk AS (SELECT pr, 0 AS k, l, c FROM b WHERE pr IN (SELECT pr FROM e)
 UNION ALL SELECT pr, k + 1, l, CASE WHEN list_has_any(list_filter(l, lambda x, y: c[y] = ci), list_filter(l, lambda x, y: c[y] = cj)) THEN c ELSE list_transform(c, lambda x: CASE WHEN x = greatest(ci, cj) THEN least(ci, cj) ELSE x END) END FROM (SELECT w.pr, w.k, l, c, c[i + 1] AS ci, c[j + 1] AS cj FROM walk w JOIN e ON e.pr = w.pr AND e.k = w.k + 1) AS step),
last AS (SELECT pr, arg_max(c, k) AS c FROM walk GROUP BY pr), clusters AS (SELECT s.pr, s.idx::BIGINT AS idx, coalesce(c[s.idx + 1], s.idx)::BIGINT AS cluster FROM s LEFT JOIN last USING (pr))"""
ISSUE_SQL = CLUSTER_SQL + f""", f AS (SELECT p.*, cluster, CASE severity WHEN 'blocker' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 WHEN 'nit' THEN 3 ELSE 4 END AS r, len({identifiers_sql("concat_ws(' ', problem, fix)")}) AS n, lower(trim(fix)) AS lf FROM {{panel}} p JOIN clusters USING (pr, idx)),
o AS (SELECT pr, cluster, list(location ORDER BY begins) AS locations FROM (SELECT pr, cluster, location, min(idx) AS begins FROM f GROUP BY ALL) AS places GROUP BY ALL),
g AS (SELECT pr, cluster, first(id ORDER BY r, -n, idx) AS primary, first(severity ORDER BY r, -n, idx) AS severity, first(rule ORDER BY r, -n, idx) AS rule, list(severity ORDER BY r, severity) AS spread, list(lens ORDER BY idx) AS lenses, list(id ORDER BY r, -n, idx) AS members, (count(DISTINCT lf) - 1)::INT AS other_fixes, min(r) AS r, min(idx) AS begins FROM f GROUP BY ALL),
issues AS (SELECT g.* EXCLUDE (r, begins), locations, 'issue-' || row_number() OVER (PARTITION BY pr ORDER BY r, -len(lenses), begins) AS issue FROM g JOIN o USING (pr, cluster))"""


@query(CLUSTER_SQL + " SELECT * FROM clusters")
def fuz3_clusters(t):
    return D.clusters(t("panel"))


@query(ISSUE_SQL + " SELECT * FROM issues")
def fuz4_win10_win11_issues(t):
    f = t("panel")
    return D.issues(f, D.clusters(f))


@query(ISSUE_SQL + """, z AS (SELECT *, row_number() OVER (PARTITION BY pr, cluster ORDER BY r, -n, idx) AS k FROM f), am AS (SELECT pr, cluster, string_agg(fix, ' ' ORDER BY k) AS also FROM (SELECT pr, cluster, lf, min(k) AS k, arg_min(fix, k) AS fix FROM z GROUP BY ALL) WHERE k > 1 GROUP BY pr, cluster),
zt AS (SELECT pr, cluster, first(rule || ' ' || problem || ' ' || fix ORDER BY k) AS own, string_agg(rule || ' ' || problem || ' ' || fix, ' ' ORDER BY k) AS members FROM z GROUP BY pr, cluster) SELECT pr, cluster, md5(lower(concat_ws(' ', own, also, members))) AS text FROM zt LEFT JOIN am USING (pr, cluster)""")
def prj30_issue_text(t):
    f = t("panel")
    return D.issue_text(f, D.clusters(f)).withColumn("text", F.md5(F.col("text").cast("binary")))


BLOCK_SQL = r"""WITH t AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(1, len(t) - 98)) AS pos FROM t WHERE len(t) >= 100),
w AS MATERIALIZED (SELECT doc_id, pos - 1 AS pos, md5(array_to_string(t[pos:pos + 99], ' ')) AS h FROM p), v AS (SELECT *, lag(pos) OVER (PARTITION BY h, doc_id ORDER BY pos) AS before, first_value(doc_id) OVER f AS doc_a, first_value(pos) OVER f AS pos_a FROM w WINDOW f AS (PARTITION BY h ORDER BY doc_id, pos)),
hits AS MATERIALIZED (SELECT CASE WHEN before IS NULL THEN doc_a ELSE doc_id END AS doc_a, doc_id AS doc_b, coalesce(before, pos_a) - pos AS shift, pos FROM v WHERE before IS NOT NULL OR doc_id > doc_a), c AS (SELECT DISTINCT doc_a, doc_b, shift FROM hits),
e AS (SELECT c.*, b.pos, b.pos - row_number() OVER (PARTITION BY c.doc_a, c.doc_b, shift ORDER BY b.pos) AS run FROM c JOIN w b ON b.doc_id = doc_b JOIN w a ON a.doc_id = c.doc_a AND a.pos = b.pos + shift AND a.h = b.h),
r AS (SELECT doc_a, doc_b, shift, min(pos) AS lo, max(pos) AS hi FROM e GROUP BY doc_a, doc_b, shift, run), blocks AS (SELECT doc_a, (lo + shift)::INT AS start_a, doc_b, lo::INT AS start_b, (hi - lo + 100)::INT AS tokens FROM r WHERE EXISTS (SELECT 1 FROM hits x WHERE x.doc_a = r.doc_a AND x.doc_b = r.doc_b AND x.shift = r.shift AND x.pos BETWEEN lo AND hi))"""


@query(BLOCK_SQL + " SELECT * FROM blocks")
def fuz6_duplicate_blocks(t):
    return D.duplicate_blocks(t("documents"))


@query(BLOCK_SQL + """, n AS (SELECT doc_a, start_a, tokens, count(*) + 1 AS copies FROM blocks GROUP BY ALL)
SELECT doc_a, start_a, tokens, doc_b AS doc_id, start_b AS start, copies FROM blocks JOIN n USING (doc_a, start_a, tokens) UNION ALL SELECT doc_a, start_a, tokens, doc_a, start_a, copies FROM n""")
def fuz6_holders(t):
    return D.holders(materialise(D.duplicate_blocks(t("documents")), "blocks"))


SEV = "CASE severity WHEN 'blocker' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END"


@query(f"""WITH f AS (SELECT *, {SEV} AS r, len({identifiers_sql("concat_ws(' ', problem, fix)")}) AS n, lower(trim(fix)) AS lf FROM {{panel}}), l AS (SELECT pr, lens, min(idx) AS first_idx FROM f GROUP BY ALL), o AS (SELECT pr, location, min(idx) AS first_idx FROM f GROUP BY ALL), x AS (SELECT pr, lf, min(idx) AS first_idx FROM f GROUP BY ALL)
SELECT pr, first(id ORDER BY r, -n, idx) AS primary, (SELECT array_to_string(list(lens ORDER BY first_idx), '|') FROM l WHERE l.pr = f.pr) AS lenses, (SELECT array_to_string(list(location ORDER BY first_idx), '|') FROM o WHERE o.pr = f.pr) AS locations, (SELECT count(*) - 1 FROM x WHERE x.pr = f.pr)::INT AS other_fixes FROM f GROUP BY pr""")
def win10_win12_primary(t):
    f = t("panel")
    one = f.select("pr", "idx", F.lit(0).cast("long").alias("cluster"))  # all of a change as one cluster
    return D.issues(f, one).select("pr", "primary", F.array_join("lenses", "|").alias("lenses"), F.array_join("locations", "|").alias("locations"), "other_fixes")


@query("""SELECT pr, count(*) FILTER (severity = 'blocker') AS blocker, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'nit') AS nit, count(*) FILTER (severity IN ('blocker', 'major')) AS must_fix FROM {findings} GROUP BY pr""")
def agg21_severity_counts(t):
    return t("findings").groupBy("pr").agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in X.SEVERITIES], F.count(F.when(F.col("severity").isin("blocker", "major"), 1)).alias("must_fix"))


@query("SELECT pr, lens, 'declined without a must-fix finding' AS problem FROM (SELECT pr, lens, bool_or(severity IN ('blocker', 'major')) AS must, bool_or(idx % 3 = 0) AS declines FROM {findings} GROUP BY pr, lens) WHERE declines AND NOT must")
def agg22_set5_synthesised_findings(t):
    f = t("findings").groupBy("pr", "lens").agg(F.bool_or(F.col("severity").isin("blocker", "major")).alias("must"), F.bool_or(F.col("idx") % 3 == 0).alias("declines"))
    return f.filter("declines AND NOT must").select("pr", "lens", F.lit("declined without a must-fix finding").alias("problem"))


IMPACT = "CASE idx % 8 WHEN 0 THEN 'data-loss' WHEN 1 THEN 'crash' WHEN 2 THEN 'hang' WHEN 3 THEN 'mixed-version-break' WHEN 4 THEN 'silent-wrong-result' WHEN 5 THEN 'performance' WHEN 6 THEN 'cosmetic' END"
SURE = "CASE CAST(pr / 12 AS INT) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END"


@query(f"""WITH f AS (SELECT id, severity AS given, {IMPACT} AS impact, {SURE.replace('CAST(pr / 12 AS INT)', '(pr // 12)')} AS confidence FROM {{findings}}), s AS (SELECT id, given, CASE WHEN impact IN ('data-loss', 'crash', 'hang', 'mixed-version-break') THEN CASE confidence WHEN 'high' THEN 'blocker' WHEN 'medium' THEN 'major' WHEN 'low' THEN 'minor' END
 WHEN impact = 'silent-wrong-result' THEN CASE WHEN confidence = 'low' THEN 'minor' WHEN confidence IS NOT NULL THEN 'major' END WHEN impact = 'performance' THEN CASE WHEN confidence = 'low' THEN 'nit' WHEN confidence IS NOT NULL THEN 'minor' END WHEN impact = 'cosmetic' THEN 'nit' END AS t FROM f)
SELECT id, coalesce(t, given) AS severity, coalesce(t, given) <> given AS corrected FROM s""")
def prj21_derived_severity(t):
    f = t("findings").selectExpr("id", "severity AS given", f"{IMPACT} AS impact", f"{SURE} AS confidence")
    return B.derive_severity(f).select("id", "severity", "corrected")


def known(t):
    k = t("known_issues")
    words = lambda c: F.filter(F.split(c, ","), lambda w: w != "")
    return k.select("case_id", "issue", "severity", "hard", words("files").alias("files"), F.col("first_line").alias("begin"), (F.col("first_line") + 6).alias("end"), words("terms").alias("terms"), words("any_of").alias("any_of"))


def reported(t):
    """The findings as the issues of runs: case_id is the change, the lens the run."""
    f = t("findings")
    return f.select(F.col("pr").alias("case_id"), F.col("lens").alias("run"), "id", "severity", F.array("location").alias("locations"), F.lower(F.concat_ws(" ", "rule", "problem", "fix")).alias("text"))


FOUND_SQL = r"""WITH kn AS (SELECT case_id, issue, severity, hard, list_filter(string_split(files, ','), lambda w: w <> '') AS files, first_line AS b, first_line + 6 AS e, list_filter(string_split(terms, ','), lambda w: w <> '') AS terms, list_filter(string_split(any_of, ','), lambda w: w <> '') AS any_of FROM {known_issues}),
rp AS (SELECT pr AS case_id, lens AS run, id, severity, location, nullif(regexp_extract(location, '^\s*([\w./-]+\.\w+)(?::(\d+))?', 1), '') AS path, TRY_CAST(nullif(regexp_extract(location, '^\s*([\w./-]+\.\w+)(?::(\d+))?', 2), '') AS BIGINT) AS line, lower(concat_ws(' ', rule, problem, fix)) AS text FROM {findings}),
pl AS (SELECT rp.case_id, run, id, issue, len(files) = 0 OR (path IS NOT NULL AND len(list_filter(files, lambda f: ends_with(path, f) OR ends_with(f, path))) > 0 AND (b IS NULL OR line IS NULL OR line BETWEEN b - 15 AND e + 15)) AS place, len(list_filter(terms, lambda w: NOT contains(text, lower(w)))) = 0 AND (len(any_of) = 0 OR len(list_filter(any_of, lambda w: contains(text, lower(w)))) > 0) AS words FROM rp JOIN kn ON kn.case_id = rp.case_id),
fd AS (SELECT case_id, run, id, issue FROM pl WHERE place AND words)"""


@query(FOUND_SQL + " SELECT case_id, run, id, issue FROM pl WHERE place")
def jon22_location_match(t):
    k = known(t).withColumn("terms", F.array().cast("array<string>")).withColumn("any_of", F.array().cast("array<string>"))
    return B.matches(reported(t), k)


@query(FOUND_SQL + " SELECT case_id, run, id, issue FROM pl WHERE words")
def jon23_text_match(t):
    return B.matches(reported(t), known(t).withColumn("files", F.array().cast("array<string>")))


@query(FOUND_SQL + """, rn AS (SELECT case_id, count(DISTINCT run) AS runs FROM rp GROUP BY case_id), ht AS (SELECT case_id, issue, count(DISTINCT run) AS hits FROM fd GROUP BY ALL), al AS (SELECT hard, severity, runs, coalesce(hits, 0) AS hits FROM kn JOIN rn USING (case_id) LEFT JOIN ht USING (case_id, issue)),
cl AS (SELECT 'all' AS class, runs, hits FROM al UNION ALL SELECT CASE WHEN hard THEN 'hard' ELSE 'soft' END, runs, hits FROM al UNION ALL SELECT 'major+', runs, hits FROM al WHERE severity IN ('blocker', 'major'))
SELECT c.class, coalesce(sum(runs), 0)::BIGINT AS possible, coalesce(sum(hits), 0)::BIGINT AS found, round(sum(hits)::DOUBLE / sum(runs), 6) AS recall FROM (VALUES ('all'), ('hard'), ('soft'), ('major+')) c(class) LEFT JOIN cl USING (class) GROUP BY c.class""")
def agg26_recall(t):
    r = reported(t)
    return B.recall(known(t), B.matches(r, known(t)), r.select("case_id", "run"))


@query(FOUND_SQL + " SELECT issue, min(run) AS run FROM fd GROUP BY issue HAVING count(DISTINCT run) = 1")
def agg27_unique_finds(t):
    return B.unique_finds(B.matches(reported(t), known(t)).select("issue", "run").distinct())


@query("WITH i AS (SELECT pr, location, list(DISTINCT lens) AS lenses FROM {findings} GROUP BY ALL), x AS (SELECT unnest(lenses) AS lens, len(lenses) = 1 AS alone FROM i) SELECT lens, count(*) AS issues, count(*) FILTER (alone) AS alone, round(count(*) FILTER (alone)::DOUBLE / count(*), 6) AS share FROM x GROUP BY lens")
def agg27_lens_shares(t):
    return B.lens_shares(t("findings").groupBy("pr", "location").agg(F.collect_set("lens").alias("lenses")))


KEY = "substr(sha1(concat_ws('|', CAST(case_id AS VARCHAR), location, '')), 1, 16)"


@query(FOUND_SQL + f""", si AS (SELECT case_id, run, min(id) AS id, location, min(severity) AS severity, {KEY} AS key FROM rp GROUP BY case_id, run, location), lb AS (SELECT key FROM si WHERE id % 3 = 0), f2 AS (SELECT fd.* FROM fd JOIN si USING (case_id, run, id)),
rn AS (SELECT case_id, run, count(*) AS findings, sum(length(text))::BIGINT AS tokens, count(*) * 7 AS seconds FROM rp GROUP BY ALL), ic AS (SELECT case_id, run, count(*) AS issues, count(*) FILTER (severity IN ('blocker', 'major')) AS must_fix FROM si GROUP BY ALL), fc AS (SELECT case_id, run, count(DISTINCT issue) AS found FROM f2 GROUP BY ALL),
un AS (SELECT case_id, run, count(*) AS unlabelled FROM si WHERE (case_id, run, id) NOT IN (SELECT (case_id, run, id) FROM f2) AND key NOT IN (SELECT key FROM lb) GROUP BY ALL), al AS (SELECT rn.*, issues, must_fix, coalesce(found, 0) AS found, coalesce(unlabelled, 0) AS unlabelled FROM rn JOIN ic USING (case_id, run) LEFT JOIN fc USING (case_id, run) LEFT JOIN un USING (case_id, run))
SELECT case_id, count(*) AS runs, {', '.join(f"array_to_string(list({c} ORDER BY run), '|') AS {c}" for c in ('findings', 'issues', 'must_fix', 'found', 'unlabelled', 'tokens', 'seconds'))}, round(1 - sum(issues)::DOUBLE / sum(findings), 6) AS duplicate_rate FROM al GROUP BY case_id""")
def agg28_set4_panel_scores(t):
    r = reported(t)
    key = X.label_key(F.col("case_id").cast("string"), F.col("location"), F.lit(""))
    one = r.withColumn("location", F.col("locations")[0]).groupBy("case_id", "run", "location").agg(F.min("id").alias("id"), F.min("severity").alias("severity")).withColumn("key", key)
    found = B.matches(r, known(t)).join(one.select("case_id", "run", "id"), ["case_id", "run", "id"], "left_semi")
    runs = r.groupBy("case_id", "run").agg(F.count(F.lit(1)).alias("findings"), F.sum(F.length("text")).alias("tokens"), (F.count(F.lit(1)) * 7).alias("seconds"))
    out = B.panel_scores(one, runs.select("case_id", "run", "findings"), found, runs.drop("findings"), one.filter("id % 3 = 0").select("key"))
    bars = {c: F.array_join(F.col(c).cast("array<string>"), "|") for c in ("findings", "issues", "must_fix", "found", "unlabelled", "tokens", "seconds")}
    return out.withColumns(bars)


@query(FOUND_SQL + ", f AS (SELECT DISTINCT run, issue FROM fd) SELECT 'src0' AS only_by, issue FROM f WHERE run = 'src0' AND issue NOT IN (SELECT issue FROM f WHERE run = 'src1') UNION ALL SELECT 'src1', issue FROM f WHERE run = 'src1' AND issue NOT IN (SELECT issue FROM f WHERE run = 'src0')")
def set1_compare_panels(t):
    return B.compare(B.matches(reported(t), known(t)).select("run", "issue").distinct(), "src0", "src1")


@query(FOUND_SQL + " SELECT case_id, issue FROM kn WHERE (case_id, issue) NOT IN (SELECT (case_id, issue) FROM fd)")
def set4_unmatched(t):
    k = known(t)
    return k.select("case_id", "issue").join(B.matches(reported(t), k).select("case_id", "issue").distinct(), ["case_id", "issue"], "left_anti")


@query("SELECT pr, count(*) FILTER (severity IN ('blocker', 'major')) AS must_fix, count(DISTINCT lens) FILTER (lens IN ('src0', 'src1', 'src2')) = 3 AS complete, count(DISTINCT lens) FILTER (lens IN ('src0', 'src1', 'src2')) = 3 AND bool_and(idx % 5 <> 4) AND count(*) FILTER (severity IN ('blocker', 'major')) = 0 AS approved FROM {findings} GROUP BY pr")
def agg21_verdict_of_panel(t):
    f = t("findings").select("pr", "lens", "severity", (F.col("idx") % 5 != 4).alias("approves"))
    return D.panel_verdict(f, ["src0", "src1", "src2"]).select("pr", "must_fix", "complete", "approved")


TURNS = "SELECT conv_id, turn, CASE WHEN turn % 7 <> 6 THEN DATE '2024-01-01' + INTERVAL '1' DAY * CAST(conv_id % 20 + turn AS INT) END AS day, text FROM conversations"


@query(f"SELECT conv_id, turn, substr(text, 1, 2000) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY day DESC, turn DESC, text) AS rank FROM ({TURNS}) WHERE day <= DATE '2024-01-15' QUALIFY rank <= 8")
def jon33_cutoff_context(t):
    c = t("conversations").withColumn("day", F.when(F.col("turn") % 7 != 6, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 20 + F.col("turn")).cast("int"))))
    c = top_k(R.as_of(c, F.col("day"), "2024-01-15"), ["conv_id"], [F.col("day").desc(), F.col("turn").desc(), F.col("text").asc()], 8)
    return c.select("conv_id", "turn", F.substring("text", 1, 2000).alias("text"), "rank")


@query("SELECT pr, lens, location FROM {findings} WHERE location = 'general' UNION ALL SELECT pr, lens, regexp_extract(location, '^(.*):', 1) FROM {findings} WHERE location <> 'general'")
def jon32_notes_by_file(t):
    f = t("findings")
    return f.select("pr", "lens", F.coalesce(X.location(F.col("location"))["path"], F.col("location")).alias("location"))
