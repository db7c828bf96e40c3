"""Projections and scalar text functions over paths, changes, commits and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .catalog import query

KIND_SQL = """CASE WHEN regexp_matches(path, '^test/(resources|data|conf)/') THEN 'test resource' WHEN regexp_matches(path, '^test/|/test/') THEN 'test' WHEN regexp_matches(path, '^src/gen-java/|/gen/|\\.(db|bin)$') THEN 'generated'
 WHEN regexp_matches(path, '^(src/java|pylib)/') THEN 'production' WHEN regexp_matches(path, '^doc/') OR (regexp_matches(path, '\\.(adoc|md)$') AND NOT starts_with(path, 'src/')) THEN 'doc' WHEN regexp_matches(path, '^(\\.build/|\\.circleci/|\\.jenkins/|build\\.xml|ide/|\\.github/)') THEN 'build' ELSE 'other' END"""
STOP_SQL = "['" + "','".join(X.STOP) + "']"
STEM_SQL = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') AND length(w) - {len(e)} >= 4 THEN substr(w, 1, length(w) - {len(e)})" for e in X.ENDINGS) + " ELSE w END"


def words_sql(text: str) -> str:
    return f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({STOP_SQL}, w)), lambda w: {STEM_SQL})))"


def identifiers_sql(text: str) -> str:
    raw = f"list_filter(regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*'), lambda t: NOT ends_with(t, 'java'))"
    parts = f"flatten(list_transform({raw}, lambda t: CASE WHEN contains(t, '.') THEN list_concat([t], string_split(t, '.')) ELSE [t] END))"
    return f"list_sort(list_distinct(list_filter({parts}, lambda p: regexp_matches(p, '[a-z][A-Z]') OR regexp_matches(p, '^[A-Z]{{2,}}[a-z]') OR contains(p, '.'))))"


@query(rf"""SELECT file_id, starts_with(path, 'test/') OR contains(path, '/test/') AS test, regexp_matches(path, '^test/(resources|data|conf)/') AS resource,
 regexp_matches(path, '^src/gen-java/|/gen/|\.(db|bin)$') AS generated, regexp_matches(path, '^doc/') OR (regexp_matches(path, '\.(adoc|md)$') AND NOT starts_with(path, 'src/')) AS doc,
 regexp_matches(path, '^(\.build/|\.circleci/|\.jenkins/|build\.xml|ide/|\.github/)') AS build, regexp_matches(path, '^(src/java|pylib)/') AND NOT regexp_matches(path, '^test/|/test/') AS prod, {KIND_SQL} AS kind FROM {{paths}}""")
def prj1_prj2_path_kinds(t):
    p = F.col("path")
    return t("paths").select("file_id", P.is_test(p).alias("test"), P.is_test_resource(p).alias("resource"), P.is_generated(p).alias("generated"), P.is_doc(p).alias("doc"), P.is_build(p).alias("build"), P.is_prod(p).alias("prod"), P.file_kind(p).alias("kind"))


@query(r"""SELECT file_id, CASE WHEN starts_with(path, 'test/unit/') THEN 'unit' WHEN starts_with(path, 'test/distributed/') THEN 'distributed' WHEN starts_with(path, 'test/') THEN 'other' END AS suite,
 CASE WHEN contains(path, 'org/project/') THEN CASE WHEN contains(split_part(path, 'org/project/', 2), '/') THEN split_part(split_part(path, 'org/project/', 2), '/', 1) ELSE '(root)' END END AS subsystem,
 NOT (regexp_matches(path, '^src/gen-java/|/gen/|\.(db|bin)$') OR regexp_matches(path, '^test/(resources|data|conf)/')) AS counted, regexp_matches(path, '\.(java|py|g|sh|xml|yaml)$') AS code FROM {paths}""")
def prj3_prj4_prj5_prj6_suites(t):
    p = F.col("path")
    return t("paths").select("file_id", P.test_suite(p).alias("suite"), P.subsystem(p).alias("subsystem"), P.counted(p, F.lit(False)).alias("counted"), P.is_code(p).alias("code"))


KEY_SQL = r"list_transform(regexp_extract_all(coalesce({0}, ''), '(?i)\bPROJ[-_ ]?(\d{{3,6}})\b', 1), lambda n: 'PROJ-' || n)"
BRANCH_SQL = "CASE WHEN len(kb) > 0 THEN kb ELSE list_transform(list_filter(string_split_regex(coalesce(branch, ''), '[/_-]'), lambda s: regexp_full_match(s, '\\d{4,6}')), lambda n: 'PROJ-' || n) END"
RESOLVED_SQL = f"""WITH k0 AS (SELECT pr, branch, {KEY_SQL.format("title")} AS kt, {KEY_SQL.format("branch")} AS kb, {KEY_SQL.format("body")} AS ko FROM {{changes}}), k1 AS (SELECT pr, kt, {BRANCH_SQL} AS kb, ko FROM k0), k2 AS (SELECT *, coalesce(kt[1], kb[1], ko[1]) AS key FROM k1)"""


@query(RESOLVED_SQL + """ SELECT pr, key, CASE WHEN key IS NULL THEN [] ELSE list_concat(CASE WHEN list_contains(kt, key) THEN ['title'] ELSE [] END, CASE WHEN list_contains(kb, key) THEN ['branch'] ELSE [] END, CASE WHEN list_contains(ko, key) THEN ['body'] ELSE [] END) END AS sources,
 list_sort(list_filter(list_distinct(list_concat(kt, kb)), lambda k: k <> key)) AS conflicts, list_sort(list_distinct(list_concat(list_concat(kt, kb), ko))) AS mentioned FROM k2""")
def prj7_prj8_set3_resolve_key(t):
    none = F.array().cast("array<string>")
    return t("changes").select("pr", X.key_struct(F.col("title"), F.col("branch"), F.col("body"), none).alias("k")).select("pr", "k.*")


CREDIT_SQL = r"""WITH f AS (SELECT seq, message, trim(regexp_replace(message, '\s+', ' ', 'g')) AS flat FROM {commits}),
g AS (SELECT *, regexp_matches(flat, '(?i)patch by (.+?)[;,]\s*re[a-z]*w[a-z]*[- ]by (.+?)(?:\s+for\s+(PROJ-\d+)|\s*$)') AS has, regexp_matches(flat, '(?i)patch by (.+?)(?:\s+for\s+(PROJ-\d+)|\s*$)') AS som,
 regexp_extract(flat, '(?i)patch by (.+?)[;,]\s*re[a-z]*w[a-z]*[- ]by (.+?)(?:\s+for\s+(PROJ-\d+)|\s*$)', ['a', 'r', 'k']) AS x, regexp_extract(flat, '(?i)patch by (.+?)(?:\s+for\s+(PROJ-\d+)|\s*$)', ['a', 'k']) AS y FROM f),
n AS (SELECT seq, message, flat, has, som, CASE WHEN has THEN x.a WHEN som THEN y.a END AS a, CASE WHEN has THEN x.r END AS r, upper(CASE WHEN has THEN x.k WHEN som THEN y.k END) AS k,
 CASE WHEN regexp_matches(flat, '(?i)patch by') AND regexp_matches(flat, '(?i)\bfor\s+PROJ-\d+') THEN upper(regexp_extract(flat, '(?i)\bfor\s+(PROJ-\d+)', 1)) ELSE nullif(upper(regexp_extract(message, '(?i)\bPROJ-\d+\b')), '') END AS primary_key FROM g)"""
NAMES_SQL = r"coalesce(list_filter(list_transform(string_split_regex(regexp_replace(trim({0}), '\.+$', ''), '(?i)\s*(?:,|\band\b|&|\+)\s*'), lambda p: trim(regexp_replace(trim(p), '^[''\"]+|[''\"]+$', '', 'g'))), lambda p: NOT list_contains(['tbd', 'tba', '?', '', 'none', 'n/a'], lower(p))), [])"


@query(CREDIT_SQL + f" SELECT seq, {NAMES_SQL.format('a')} AS authors, {NAMES_SQL.format('r')} AS reviewers, coalesce(nullif(k, ''), primary_key) AS key, has OR som AS credited, primary_key FROM n")
def prj9_prj10_credits(t):
    return t("commits").select("seq", X.credit(F.col("message")).alias("c"), X.primary_key(F.col("message")).alias("primary_key")).select("seq", "c.*", "primary_key")


@query(r"""SELECT seq, list_filter(list_transform(list_filter(string_split(message, chr(10)), lambda x: regexp_matches(x, '^[A-Za-z-]+:')), lambda x: lower(trim(split_part(x, ':', 1))) || '=' || trim(substr(x, strpos(x, ':') + 1))), lambda p: list_contains(['co-authored-by', 'assisted-by', 'generated-by', 'signed-off-by'], split_part(p, '=', 1))) AS trailers FROM {commits}""")
def src2_trailers(t):
    return t("commits").select("seq", F.transform(X.trailers(F.col("message")), lambda p: F.concat_ws("=", p["name"], p["value"])).alias("trailers"))


ACCENTED = "CASE c_custkey % 3 WHEN 0 THEN concat('Zoë  Ünal-', c_name) WHEN 1 THEN concat('ÉLODIE O''Neil ', c_name) ELSE c_name END"


@query(rf"""SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(strip_accents({ACCENTED})), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM customer""")
def prj11_normalise_name(t):
    return t("customer").selectExpr("c_custkey AS id", f'{ACCENTED.replace("O\'\'Neil", "O\\\'Neil")} AS n').select("id", X.normalise_name(F.col("n")).alias("name"))


@query(r"""WITH v AS (SELECT s_suppkey AS id, CASE s_suppkey % 7 WHEN 0 THEN '4.x' WHEN 1 THEN '3.11.2' WHEN 2 THEN '3.x' WHEN 3 THEN '9.9' WHEN 4 THEN 'later' WHEN 5 THEN '4.0-beta' ELSE '3' END AS version FROM supplier)
SELECT id, version, CASE WHEN version IN ('4.x') THEN 'project-4.1' WHEN version IN ('3.11.2', '3.x', '3') THEN 'project-3.11' WHEN version = '4.0-beta' THEN 'project-4.0' WHEN version = '9.9' THEN 'trunk' END AS branch FROM v""")
def prj12_version_to_branch(t):
    v = t("supplier").selectExpr("s_suppkey AS id", "CASE s_suppkey % 7 WHEN 0 THEN '4.x' WHEN 1 THEN '3.11.2' WHEN 2 THEN '3.x' WHEN 3 THEN '9.9' WHEN 4 THEN 'later' WHEN 5 THEN '4.0-beta' ELSE '3' END AS version")
    return v.withColumn("branch", X.version_branch(F.col("version"), ["project-3.0", "project-3.11", "project-4.0", "project-4.1"]))


@query("SELECT pr, regexp_full_match(base, 'project-\\d+\\.\\d+') AS release, CASE WHEN base = 'trunk' THEN 'main line' ELSE 'maintenance' END AS line FROM {changes}")
def prj13_release_branch(t):
    return t("changes").select("pr", F.col("base").rlike(r"^project-\d+\.\d+$").alias("release"), F.when(F.col("base") == "trunk", "main line").otherwise("maintenance").alias("line"))


@query("SELECT seq, CASE WHEN contains(ref, '3.0') THEN 'project-3.0' WHEN contains(ref, '3.11') THEN 'project-3.11' WHEN contains(ref, '4.0') THEN 'project-4.0' WHEN contains(ref, '4.1') THEN 'project-4.1' END AS branch FROM {ci_runs}")
def prj14_guess_branch(t):
    from ..operators.changes import guess_branch

    return t("ci_runs").select("seq", guess_branch([F.col("ref")], [(r"3\.0", "project-3.0"), (r"3\.11", "project-3.11"), (r"4\.0", "project-4.0"), (r"4\.1", "project-4.1")]).alias("branch"))


@query("SELECT seq, seq % 5 IN (0, 1) AS approves FROM {reviews}")
def prj16_plus_one(t):
    return t("reviews").select("seq", X.plus_one(F.col("text")).alias("approves"))


@query(f"SELECT doc_id, len({words_sql('text')}) AS n, md5(array_to_string({words_sql('text')}, ' ')) AS words FROM documents")
def prj17_words(t):
    w = F.array_sort(X.words(F.col("text")))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.concat_ws(" ", w).cast("binary")).alias("words"))


@query(f"SELECT doc_id, {identifiers_sql('text')} AS ids FROM documents")
def prj18_identifiers(t):
    return t("documents").select("doc_id", F.array_sort(X.identifiers(F.col("text"))).alias("ids"))


@query(f"""WITH w AS (SELECT id, {words_sql('problem')} AS a, {words_sql('fix')} AS b FROM {{findings}})
SELECT id, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS score FROM w""")
def prj19_jaccard(t):
    return t("findings").select("id", X.jaccard(X.words(F.col("problem")), X.words(F.col("fix"))).alias("score"))


PLACED = "SELECT id, CASE WHEN idx % 4 = 0 THEN location WHEN idx % 4 = 1 THEN replace(location, ':', ' line ') WHEN idx % 4 = 2 THEN concat('  ', location, ' (see below)') ELSE 'no place' END AS location FROM {findings}"


@query(rf"SELECT id, nullif(regexp_extract(location, '^(.*\.\w+):(\d+)$', 1), '') AS path, TRY_CAST(nullif(regexp_extract(location, '^(.*\.\w+):(\d+)$', 2), '') AS BIGINT) AS line, nullif(regexp_extract(location, '^\s*([\w./-]+\.\w+)(?::(\d+))?', 1), '') AS loose_path, TRY_CAST(nullif(regexp_extract(location, '^\s*([\w./-]+\.\w+)(?::(\d+))?', 2), '') AS BIGINT) AS loose_line FROM ({PLACED})")
def prj20_location(t):
    f = t("findings")
    x = f.sparkSession.sql(PLACED, findings=f)
    return x.select("id", X.location(F.col("location")).alias("l"), X.loose_location(F.col("location")).alias("m")).select("id", "l.*", F.col("m.path").alias("loose_path"), F.col("m.line").alias("loose_line"))


@query(r"""WITH s AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents), f AS (SELECT doc_id, text, flat, regexp_replace(CASE WHEN strpos(flat, '. ') > 1 THEN substr(flat, 1, strpos(flat, '. ') - 1) ELSE flat END, '[.:;]+$', '') AS one FROM s),
c AS (SELECT *, regexp_replace(substr(one, 1, 150), ' [^ ]*$', '') AS cut FROM f), o AS (SELECT *, CASE WHEN (length(cut) - length(replace(cut, '`', ''))) % 2 = 1 THEN regexp_replace(cut, '`[^`]*$', '') ELSE cut END AS even FROM c)
SELECT doc_id, CASE WHEN length(one) <= 150 THEN one ELSE regexp_replace(even, '[ ,;:]+$', '') || '…' END AS sentence, CASE WHEN flat <> '' AND length(flat) <= 80 THEN flat END AS title, CASE WHEN length(flat) <= 60 THEN flat ELSE rtrim(substr(flat, 1, 59)) || '…' END AS clipped,
 trim(substr(trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9\s_.:()-]', '', 'g'), '\s+', ' ', 'g')), 1, 80)) AS sanitised FROM o""")
def prj22_prj24_prj25_sentences(t):
    x = F.col("text")
    return t("documents").select("doc_id", X.first_sentence(x).alias("sentence"), X.clean_title(x).alias("title"), X.clip(x, 60).alias("clipped"), X.sanitise_title(x).alias("sanitised"))


LABELLED = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_-') WHEN 1 THEN repeat(concat(p_name, '  '), 14) WHEN 2 THEN concat(p_name, ' ', p_type, ' (', repeat(p_type, 20), ')') ELSE concat(p_name, ': ', repeat(concat(p_type, ' '), 20)) END AS rule,
 CASE p_partkey % 3 WHEN 0 THEN concat('src/a/', replace(p_name, ' ', ''), '.java:', CAST(p_size AS STRING), ' (note)') WHEN 1 THEN concat('in src/b/', p_brand, '.java') ELSE concat('  ', p_name) END AS location, CASE p_partkey % 5 WHEN 0 THEN concat(' The  ', p_name) WHEN 1 THEN repeat(p_name, 30) ELSE NULL END AS title FROM {part}"""


@query(rf"""WITH l AS ({LABELLED.replace("{part}", "part")}), a AS (SELECT *, trim(regexp_replace(rule, '\s+', ' ', 'g')) AS r0 FROM l), b AS (SELECT *, CASE WHEN contains(r0, ' ') THEN r0 ELSE regexp_replace(r0, '[_-]+', ' ', 'g') END AS r1 FROM a), c AS (SELECT *, CASE WHEN length(r1) > 90 THEN regexp_replace(r1, '\s*\([^()]*\)\s*$', '') ELSE r1 END AS r2 FROM b),
d AS (SELECT *, CASE WHEN length(r2) > 90 THEN trim(split_part(r2, ':', 1)) ELSE r2 END AS r3 FROM c), e AS (SELECT *, CASE WHEN length(r3) > 90 THEN regexp_replace(regexp_replace(substr(r3, 1, 90), ' [^ ]*$', ''), '[ ,;:]+$', '') || '…' ELSE r3 END AS r4 FROM d), f AS (SELECT id, upper(substr(r4, 1, 1)) || substr(r4, 2) AS words, title,
 CASE WHEN regexp_matches(location, '[^/\s:()]+:\d+') THEN regexp_extract(location, '([^/\s:()]+:\d+)', 1) WHEN regexp_matches(location, '[^/\s:()]+\.\w+') THEN regexp_extract(location, '([^/\s:()]+\.\w+)', 1) ELSE trim(location) END AS place, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS t FROM e)
SELECT id, words, place, CASE WHEN t <> '' AND length(t) <= 80 THEN t ELSE words || ' — ' || place END AS title FROM f""")
def prj23_labels(t):
    part = t("part")
    x = part.sparkSession.sql(LABELLED, part=part)
    rule, place = F.col("rule"), F.col("location")
    return x.select("id", X.humanise(rule).alias("words"), X.short_location(place).alias("place"), X.finding_title(F.col("title"), rule, place).alias("title"))


@query("""SELECT pr, path, score, CASE WHEN score >= 30 THEN 'darkred' WHEN score >= 15 THEN 'red' WHEN score >= 10 THEN 'yellow' ELSE 'green' END AS band, CASE WHEN score % 5 = 0 THEN 'new' WHEN score > 25 THEN 'worse' WHEN score < 25 THEN 'better' ELSE 'same' END AS change FROM {violations} JOIN {paths} USING (file_id)""")
def prj27_bands(t):
    base = F.when(F.col("score") % 5 != 0, F.lit(25))
    return t("violations").join(t("paths"), "file_id").select("pr", "path", "score", X.complexity_band(F.col("score")).alias("band"), X.change_label(base, F.col("score")).alias("change"))


@query("SELECT id, substr(sha1(concat_ws('|', CAST(pr AS VARCHAR), location, substr(problem, 1, 200))), 1, 16) AS key FROM {findings}")
def prj29_label_key(t):
    return t("findings").select("id", X.label_key(F.col("pr").cast("string"), F.col("location"), F.col("problem")).alias("key"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r\x0b\x0c]')))::BIGINT AS lines FROM documents")
def prj32_nonblank_lines(t):
    return t("documents").select("doc_id", X.nonblank_lines(F.col("text")).alias("lines"))


SPANS = "SELECT doc_id, 1 AS begin, 3 AS finish FROM {documents} UNION ALL SELECT doc_id, doc_id % 5 + 2, doc_id % 5 + 6 FROM {documents}"


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents), r AS ({SPANS.format(documents='documents')})
SELECT doc_id, (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id AND regexp_matches(line, '[^ \t\r\x0b\x0c]') AND EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND n BETWEEN begin AND finish)) AS lines FROM documents d""")
def prj32_nonblank_within(t):
    docs = t("documents")
    spans = docs.selectExpr("doc_id", "inline(array(struct(1L AS begin, 3L AS end), struct(doc_id % 5 + 2 AS begin, doc_id % 5 + 6 AS end)))")
    return X.nonblank_within(docs, spans, "doc_id")
