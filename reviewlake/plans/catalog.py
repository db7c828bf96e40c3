"""The registry of queries, and the evidence tables derived from the given ones.

The given tables hold no changes, so VIEWS derive each evidence table from them; the text of a view is plain SQL that
both engines read. A query takes views by name and applies operators; its SQL says the same thing in another way.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import bucketed, materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ROOT = """CASE p_partkey % 12 WHEN 0 THEN 'src/java/org/project/db/' WHEN 1 THEN 'src/java/org/project/net/' WHEN 2 THEN 'src/java/org/project/concurrent/' WHEN 3 THEN 'src/java/org/project/'
 WHEN 4 THEN 'test/unit/org/project/' WHEN 5 THEN 'test/distributed/org/' WHEN 6 THEN 'test/data/' WHEN 7 THEN 'src/gen-java/org/' WHEN 8 THEN 'doc/' WHEN 9 THEN '.build/' WHEN 10 THEN 'pylib/lib/' ELSE 'conf/' END"""
EXT = "CASE p_size % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.py' WHEN 2 THEN '.md' ELSE '.bin' END"

VIEWS = {
    "paths": f"SELECT p_partkey AS file_id, concat({ROOT}, replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING), {EXT}) AS path FROM {{part}}",
    "changes": """SELECT o_orderkey AS pr, concat('dev', CAST(o_custkey AS STRING)) AS author, o_orderstatus AS state, CASE o_orderpriority WHEN '1-URGENT' THEN 'project-3.0' WHEN '2-HIGH' THEN 'project-3.11' WHEN '3-MEDIUM' THEN 'project-4.0' WHEN '4-NOT SPECIFIED' THEN 'project-4.1' ELSE 'trunk' END AS base,
 o_orderdate AS updated_at, o_orderstatus = 'P' AS draft, md5(CAST(o_orderkey AS STRING)) AS head,
 CASE o_orderkey % 4 WHEN 0 THEN concat('PROJ-', CAST(1000 + o_custkey AS STRING), ': tidy up') WHEN 1 THEN concat('fix proj_', CAST(1000 + o_custkey AS STRING), ' and PROJ ', CAST(2000 + o_custkey AS STRING)) WHEN 2 THEN 'no ticket at all' ELSE NULL END AS title,
 CASE o_orderkey % 3 WHEN 0 THEN concat('user/', CAST(1000 + o_custkey AS STRING), '-4.0') WHEN 1 THEN concat('proj-', CAST(1001 + o_custkey AS STRING)) ELSE 'feature/misc' END AS branch,
 CASE o_orderkey % 5 WHEN 0 THEN concat('see PROJ-', CAST(1000 + o_custkey AS STRING), ' PROJ-77') WHEN 1 THEN '' ELSE 'text' END AS body FROM {orders}""",
    "changed_files": "SELECT l_orderkey AS pr, path, CAST(l_quantity AS INT) AS additions, l_linenumber AS deletions, CASE l_returnflag WHEN 'N' THEN 'M' ELSE l_returnflag END AS status, path LIKE '%.bin' AS bin FROM {lineitem} JOIN {paths} ON l_partkey = file_id",
    "people": "SELECT concat('dev', CAST(c_custkey AS STRING)) AS login, c_name AS display, CASE WHEN c_custkey % 3 = 0 THEN concat('dev', CAST(c_custkey AS STRING), '@project.org') ELSE concat('dev', CAST(c_custkey AS STRING), '@mail.example') END AS email, c_custkey % 4 <> 3 AS committer FROM {customer}",
    "commits": """SELECT event_id AS seq, md5(CAST(event_id AS STRING)) AS sha, ts, concat('dev', CAST(user_id AS STRING)) AS login, CASE event_id % 6
 WHEN 0 THEN concat('Patch by Customer#', lpad(CAST(user_id AS STRING), 9, '0'), '; reviewed by Ann Lee and Bob for PROJ-', CAST(1000 + user_id AS STRING)) WHEN 1 THEN concat('tidy PROJ-', CAST(1000 + user_id AS STRING), chr(10), 'Signed-off-by: dev', CAST(user_id AS STRING)) WHEN 2 THEN concat('patch  by Zoë,', chr(10), ' reviwed by tbd, N/A & Max+Eve. for proj-', CAST(500 + user_id AS STRING))
 WHEN 3 THEN 'patch by "Kim" and TBA' WHEN 4 THEN 'misc cleanup' ELSE concat('follow up', chr(10), 'Co-authored-by: Ann Lee', chr(10), 'Generated-by: tool', chr(10), 'note: none') END AS message FROM {events}""",
    "reviews": "SELECT event_id AS seq, CAST(floor(value * 10) AS BIGINT) % 400 AS pr, concat('dev', CAST(user_id AS STRING)) AS login, event_type AS kind, ts, CASE event_id % 5 WHEN 0 THEN '+1' WHEN 1 THEN 'LGTM +1 from me' WHEN 2 THEN '+10 lines' WHEN 3 THEN 'thanks' ELSE 'c++1' END AS text FROM {events}",
    "ci_runs": "SELECT event_id AS seq, concat('project-', CASE event_id % 5 WHEN 0 THEN '3.0' WHEN 1 THEN '3.11' WHEN 2 THEN '4.0' WHEN 3 THEN '4.1' ELSE 'x' END) AS ref, CAST(floor(value * 10) AS BIGINT) % 400 AS pr, ts AS created, CASE WHEN event_id % 4 = 0 THEN NULL ELSE md5(CAST(CAST(floor(value * 10) AS BIGINT) % 400 AS STRING)) END AS sha, CAST(floor(value) AS BIGINT) % 7 AS failed, 100 + user_id AS passed FROM {events}",
    "findings": """SELECT doc_id AS id, doc_id - doc_id % 12 AS pr, source AS lens, doc_id % 12 AS idx, CASE doc_id % 4 WHEN 0 THEN 'minor' WHEN 1 THEN 'blocker' WHEN 2 THEN 'nit' ELSE 'major' END AS severity,
 CASE WHEN doc_id % 7 = 3 THEN 'general' ELSE concat('src/File', CAST(doc_id % 3 AS STRING), '.java:', CAST(n_chars % 40 AS STRING)) END AS location, substr(text, 1, CAST(floor(length(text) / 2) AS INT)) AS problem, substr(text, CAST(floor(length(text) / 2) AS INT) + 1) AS fix, concat('rule', CAST(doc_id % 5 AS STRING)) AS rule FROM {documents}""",
    "panel": """SELECT l_orderkey * 100 + idx AS id, l_orderkey AS pr, concat('lens', CAST(l_linenumber % 4 AS STRING)) AS lens, idx, CASE l_returnflag WHEN 'A' THEN 'major' WHEN 'R' THEN 'nit' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'minor' ELSE 'blocker' END END AS severity,
 CASE WHEN l_suppkey % 5 = 0 THEN 'general' ELSE concat('src/File', CAST(l_suppkey % 2 AS STRING), '.java:', CAST(l_partkey % 12 AS STRING)) END AS location, concat('The result of ', topic, ' is ignored when ', CASE l_partkey % 3 WHEN 0 THEN 'closing streams' WHEN 1 THEN 'the directory fails' ELSE 'flushing' END, ' in ', topic2) AS problem, concat('check what ', topic, ' gives', CASE WHEN l_partkey % 2 = 0 THEN ' and log it' ELSE '' END) AS fix, concat('rule', CAST(l_suppkey % 5 AS STRING)) AS rule
 FROM (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN 'FileUtils.deleteIfExists' WHEN 1 THEN 'commitLog.syncAll' ELSE 'readBuffer' END AS topic, CASE l_partkey % 2 WHEN 0 THEN 'TableReader.closeAll' ELSE 'writeHandler' END AS topic2, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS idx FROM {lineitem}) AS topics""",
    "violations": "SELECT l_partkey AS file_id, l_orderkey AS pr, l_linenumber * 10 AS line, concat('Rule', CAST(l_suppkey % 17 AS STRING)) AS rule, l_returnflag AS message, CASE l_linestatus WHEN 'F' THEN 'base' ELSE 'head' END AS side, CAST(l_quantity AS INT) AS score FROM {lineitem}",
    "diffs": """SELECT o_orderkey AS pr, concat('diff --git a/f', CAST(o_orderkey % 7 AS STRING), '.java b/f', CAST(o_orderkey % 7 AS STRING), '.java', chr(10), CASE WHEN o_orderkey % 5 = 0 THEN concat('new file mode 100644', chr(10), '--- /dev/null') ELSE concat('--- a/f', CAST(o_orderkey % 7 AS STRING), '.java') END, chr(10), '+++ ', CASE WHEN o_orderkey % 5 = 1 THEN '/dev/null' ELSE concat('b/f', CAST(o_orderkey % 7 AS STRING), '.java') END, chr(10),
 CASE WHEN o_orderkey % 5 = 0 THEN concat('@@ -0,0 +1,2 @@', chr(10), '+++ first', chr(10), '+', CAST(o_custkey AS STRING)) WHEN o_orderkey % 5 = 1 THEN concat('@@ -1,2 +0,0 @@', chr(10), '-gone', chr(10), '--- gone')
 ELSE concat('@@ -', CAST(10 + o_custkey AS STRING), ',3 +', CAST(10 + o_custkey AS STRING), ',4 @@ void f()', chr(10), ' context', chr(10), '-old ', CAST(o_custkey AS STRING), chr(10), '+new ', CAST(o_custkey AS STRING), chr(10), '+more', chr(10), ' context', chr(10), '@@ -', CAST(40 + o_custkey AS STRING), ',0 +', CAST(42 + o_custkey AS STRING), ' @@', chr(10), '+inserted') END) AS diff FROM {orders}""",
    "ranges": "SELECT DISTINCT l_partkey AS file_id, l_linenumber * 10 - CAST(l_quantity AS INT) % 5 AS begin_line, l_linenumber * 10 + CAST(l_quantity AS INT) % 12 AS end_line FROM {lineitem}",
    "methods": "SELECT l_partkey AS file_id, concat('C', CAST(l_linenumber % 3 AS STRING)) AS cls, concat('m', CAST(l_suppkey % 4 AS STRING)) AS name, concat('m', CAST(l_suppkey % 4 AS STRING), '(', l_returnflag, CAST(l_partkey % 9973 AS STRING), ')') AS sig, CASE l_linestatus WHEN 'F' THEN 'base' ELSE 'head' END AS side, max(CAST(l_quantity AS INT)) AS score, max(l_linenumber) % 2 = 0 AS touched FROM {lineitem} GROUP BY l_partkey, l_linenumber % 3, l_suppkey % 4, l_returnflag, l_partkey % 9973, l_linestatus",
    "bodies": "SELECT l_partkey AS file_id, concat('C', CAST(l_linenumber % 3 AS STRING)) AS cls, concat('m', CAST(l_suppkey % 4 AS STRING)) AS name, CASE l_linestatus WHEN 'F' THEN 'base' ELSE 'head' END AS side FROM {lineitem}",
    "renames": "SELECT p_partkey AS file_id, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_partkey + 1 ELSE p_partkey END AS base_file, p_partkey % 11 = 0 AND p_partkey % 2 = 0 AS new_file, p_partkey % 3 <> 0 AS mapped FROM {part}",
    "known_issues": """SELECT pr AS case_id, id AS issue, severity, id % 4 = 0 AS hard, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'File1.java' WHEN 2 THEN 'repo/src/File2.java' ELSE 'src/File0.java,src/File1.java' END AS files, CASE WHEN id % 3 > 0 THEN id % 40 END AS first_line, concat(split_part(problem, ' ', 2), ',', split_part(problem, ' ', 4)) AS terms,
 CASE WHEN id % 2 = 0 THEN concat(split_part(fix, ' ', 2), ',', split_part(fix, ' ', 3)) ELSE '' END AS any_of FROM {findings} WHERE idx % 3 = 0""",
    "subjects": """SELECT pr, author, state, CASE WHEN pr % 13 = 0 THEN 'feature/index' ELSE base END AS base, updated_at, draft, head, title, CASE WHEN pr % 19 = 0 THEN concat('codex/', branch) ELSE branch END AS branch,
 CASE WHEN pr % 17 = 0 THEN 'made with copilot, see the JMH run' ELSE body END AS body, CASE pr % 6 WHEN 0 THEN 'MEMBER' ELSE 'NONE' END AS association FROM {changes}""",
    "tickets": """SELECT concat('PROJ-', CAST(1000 + c_custkey AS STRING)) AS key, c_custkey % 9 <> 1 AS reached, CASE c_custkey % 5 WHEN 0 THEN 'Resolved' WHEN 1 THEN 'Closed' ELSE 'Open' END AS status, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '4.1' WHEN 2 THEN '3.11,4.0' ELSE '4.x,9.9,later' END AS fix_versions,
 CASE WHEN c_custkey % 6 = 0 THEN 'Performance' ELSE 'x' END AS label, CASE WHEN c_custkey % 10 = 0 THEN 'Test/benchmark' ELSE 'Core' END AS component, CASE WHEN c_custkey % 7 = 0 THEN concat('Faster ', c_name) ELSE c_name END AS summary, concat('dev', CAST(c_custkey AS STRING)) AS assignee FROM {customer} WHERE c_custkey % 9 <> 0""",
    "ticket_ci": """SELECT event_id AS seq, concat('PROJ-', CAST(1000 + user_id AS STRING)) AS key, ts AS created, CASE event_id % 7 WHEN 0 THEN 'project-3.0' WHEN 1 THEN 'project-3.11' WHEN 2 THEN 'project-4.0' WHEN 3 THEN 'project-4.1' WHEN 4 THEN 'trunk' WHEN 5 THEN 'feature/index' END AS target_branch, event_id % 11 <> 0 AS parsed,
 CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 < 3 THEN md5(CAST(first_pr AS STRING)) ELSE md5('x') END AS sha, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 3 END AS failed, event_id % 2 = 0 AS upgrade FROM {events} LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_pr FROM {orders} GROUP BY o_custkey) AS firsts ON user_id = o_custkey""",
    "touched": """SELECT l_orderkey AS pr, CASE (l_partkey + l_suppkey * 3 + l_linenumber) % 60 WHEN 0 THEN 'conf/project.yaml' WHEN 1 THEN 'conf/project_latest.yaml' WHEN 2 THEN 'src/java/org/project/config/Config.java' WHEN 3 THEN 'CHANGES.txt' WHEN 4 THEN 'src/java/org/project/net/Verb.java' WHEN 5 THEN 'src/java/org/project/tools/admin/Status.java' WHEN 6 THEN 'test/resources/admin/help/status'
 WHEN 7 THEN 'src/antlr/Cql.g' WHEN 8 THEN 'lib/a.jar' WHEN 9 THEN 'src/java/org/project/io/table/format/BigFormat.java' WHEN 10 THEN 'test/microbench/B.java' WHEN 11 THEN 'src/java/org/project/hints/HintsDescriptor.java' WHEN 12 THEN 'src/java/org/project/db/RowSerializer.java' WHEN 13 THEN 'src/java/org/project/metrics/TableMBean.java' WHEN 14 THEN 'src/java/org/project/schema/SchemaKeyspace.java' WHEN 15 THEN 'CHANGES.txt' ELSE path END AS path,
 CAST(l_quantity AS INT) AS additions, l_linenumber AS deletions, path LIKE '%.bin' AS bin, l_returnflag = 'A' AS new_file, l_suppkey AS k, l_linenumber AS n FROM {lineitem} JOIN {paths} ON l_partkey = file_id""",
    "added": """SELECT t.pr, path, n * 100000 + k AS line_no, new_file, CASE (k + n) % 11 WHEN 0 THEN 'int n = Integer.getInteger("n");' WHEN 1 THEN '// System.getProperty("n")' WHEN 2 THEN '@Deprecated' WHEN 3 THEN 'class S implements Comparable<S>, VersionedSerializer<S>' WHEN 4 THEN concat(' * Tidy up (PROJ-', CAST(1000 + o_custkey AS STRING), ')')
 WHEN 5 THEN ' * Other work (PROJ-777)' WHEN 6 THEN 'import junit.Assert; // permit' WHEN 7 THEN 'import sun.misc.Unsafe;' WHEN 8 THEN 'Licensed to the project' ELSE 'return 0;' END AS text FROM {touched} AS t JOIN {orders} ON t.pr = o_orderkey""",
    "change_commits": """SELECT l_orderkey AS pr, l_linenumber - 1 AS idx, CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN concat('Tidy', chr(10), chr(10), 'patch by Ann; reviewed by Bob for PROJ-', CAST(1000 + o_custkey AS STRING)) WHEN 1 THEN concat('PROJ-', CAST(1000 + o_custkey AS STRING), ' tidy') WHEN 2 THEN 'patch by Ann, reviewed by Kim for PROJ-555'
 WHEN 3 THEN concat('fixup! tidy', chr(10), 'Assisted-by: tool') WHEN 4 THEN concat('work', chr(10), 'Co-authored-by: Copilot <x@y>') ELSE 'work' END AS message, CASE l_suppkey % 3 WHEN 0 THEN 'test/microbench/B.java' WHEN 1 THEN 'src/java/org/project/A.java' ELSE 'doc/x.md' END AS path FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "builds": """SELECT o_orderkey AS pr, CASE WHEN o_orderkey % 8 = 0 THEN 'old' ELSE md5(CAST(o_orderkey AS STRING)) END AS head, CASE o_orderkey % 9 WHEN 0 THEN 'build-failed' WHEN 1 THEN 'tests-failed' WHEN 2 THEN 'timeout' WHEN 3 THEN 'unknown' WHEN 4 THEN 'not-built' ELSE 'pass' END AS status, o_orderkey % 4 AS compile_errors,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 50 END AS run, CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 3 ELSE 0 END AS failing, CASE WHEN o_orderkey % 6 = 5 THEN 1 ELSE 0 END AS flaky, CASE WHEN o_orderkey % 14 = 3 THEN 2 ELSE 0 END AS artifacts, CASE WHEN o_orderkey % 15 = 2 THEN NULL ELSE o_orderkey % 4 * 5 END AS executable, o_orderkey % 3 AS missed, CASE WHEN o_orderkey % 21 = 6 THEN 1 ELSE 0 END AS unmeasured FROM {orders} WHERE o_orderkey % 12 <> 7""",
    "static_runs": """SELECT o_orderkey AS pr, CASE o_orderkey % 10 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'no changed files' ELSE 'ran' END AS status, CASE o_orderkey % 11 WHEN 4 THEN 'not-applicable' WHEN 6 THEN 'failed' ELSE 'ran' END AS style_status, CASE WHEN o_orderkey % 10 = 2 THEN 2 WHEN o_orderkey % 20 = 3 THEN 0 ELSE 3 END AS style_analyzed,
 CASE o_orderkey % 13 WHEN 2 THEN 'failed' ELSE 'ran' END AS rules_status, CASE WHEN o_orderkey % 10 = 4 THEN 2 WHEN o_orderkey % 20 = 5 THEN 0 ELSE 3 END AS rules_analyzed, CASE o_orderkey % 17 WHEN 3 THEN 'skipped' ELSE 'ran' END AS catalog, o_orderkey % 3 = 0 AS types, CASE o_orderkey % 19 WHEN 7 THEN 'not-applicable' ELSE 'ran' END AS copies_status, CASE WHEN o_orderkey % 8 = 6 THEN 1 ELSE 3 END AS copies_analyzed, 3 AS expected FROM {orders} WHERE o_orderkey % 7 <> 0""",
    "unit_tests": """SELECT p_partkey AS k, concat('org/', CASE p_partkey % 5 WHEN 0 THEN concat('Class', CAST(p_partkey AS STRING), 'Test') WHEN 1 THEN concat('Class', CAST(p_partkey - 1 AS STRING), 'ExtraFlagTest') ELSE concat('Other', CAST(p_partkey AS STRING), 'Test') END, '.java') AS test,
 concat(CASE WHEN p_partkey % 17 = 3 THEN '' ELSE '@Test ' END, 'void a() ', chr(123), ' new Class', CAST(p_partkey AS STRING), '(); Class', CAST(p_partkey AS STRING), '.run', CAST(p_partkey % 9 AS STRING), '(1); Class', CAST(p_partkey + 1 AS STRING), ' x; x.stop', CAST(p_partkey % 7 AS STRING), ' (2); HubClass h; Abc a; Sub', CAST(p_partkey AS STRING), ' s; Kind', CAST(p_partkey + 2 AS STRING), ' t; t = Kind', CAST(p_partkey + 2 AS STRING), '.X; ', chr(125)) AS text FROM {part}""",
    "changed_classes": "SELECT o_orderkey AS pr, concat('Class', CAST(o_custkey AS STRING)) AS cls FROM {orders} UNION ALL SELECT o_orderkey AS pr, CASE o_orderkey % 4 WHEN 0 THEN 'HubClass' WHEN 1 THEN 'Abc' WHEN 2 THEN concat('Class', CAST(o_custkey + 5 AS STRING)) ELSE concat('Class', CAST(o_custkey AS STRING), 'Extra') END AS cls FROM {orders}",
    "changed_methods": "SELECT o_orderkey AS pr, concat('run', CAST(o_orderkey % 9 AS STRING)) AS method FROM {orders} UNION ALL SELECT o_orderkey AS pr, concat('stop', CAST(o_custkey % 7 AS STRING)) AS method FROM {orders} UNION ALL SELECT o_orderkey AS pr, concat('many', CAST(n_nationkey AS STRING), 'x', CAST(r_regionkey AS STRING)) AS method FROM {orders} CROSS JOIN {nation} CROSS JOIN {region} WHERE o_orderkey % 50 = 7",
    "changed_tests": "SELECT o_orderkey AS pr, test FROM {orders} JOIN {unit_tests} ON k = o_custkey AND o_orderkey % 6 = 0",
    "class_sources": "SELECT c_custkey AS k, concat('public class Sub', CAST(c_custkey AS STRING), '<T extends Comparable<T>> extends Base<Class', CAST(c_custkey AS STRING), '> implements Class', CAST(c_custkey + 1 AS STRING), ', Other ', chr(123), chr(10), 'enum Kind', CAST(c_custkey AS STRING), chr(10), ' implements Class', CAST(c_custkey AS STRING), '<String> ', chr(123), ' A; ', chr(125), chr(10), 'class Class', CAST(c_custkey + 5 AS STRING), ' extends Class', CAST(c_custkey AS STRING), ' ', chr(123), ' ', chr(125)) AS text FROM {customer}",
    "owners": "SELECT l_partkey AS file_id, min(l_orderkey) AS pr, path FROM {lineitem} JOIN {paths} ON l_partkey = file_id GROUP BY l_partkey, path",
    "approvals": "SELECT event_id AS seq, CAST(floor(event_id / 3) AS BIGINT) AS pr, concat('dev', CAST(user_id AS STRING)) AS who, CASE event_id % 2 WHEN 0 THEN 'review' ELSE 'comment' END AS source, ts AS made, event_type <> 'view' AS approved, CASE event_id % 5 WHEN 0 THEN '+1' WHEN 1 THEN 'LGTM (+1)' WHEN 2 THEN '+10 lines' WHEN 3 THEN 'thanks, +1 from me' ELSE 'c++1' END AS body, CASE event_id % 7 WHEN 0 THEN 'MEMBER' WHEN 1 THEN 'OWNER' ELSE 'NONE' END AS association FROM {events}",
    "overrides": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'comment' ELSE 'review' END AS source, concat('dev', CAST(c_custkey AS STRING)) AS who, concat('dev', CAST(c_custkey + 1 AS STRING)) AS id FROM {customer} WHERE c_custkey % 25 < 2",
}


def text_of(view: str) -> str:
    """The SQL of a view with the views it reads in their place; given tables stay names."""
    return re.sub(r"\{(\w+)\}", lambda m: f"({text_of(m[1])}) AS {m[1]}_" if m[1] in VIEWS else m[1], VIEWS[view])


def oracle(sql: str) -> str:
    """sql with {view} replaced by the view's text, for an engine that has the given tables."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    used: list[str] = []

    def need(v: str) -> None:
        for w in re.findall(r"\{(\w+)\}", VIEWS[v]):
            if w in VIEWS:
                need(w)
        if v not in used:
            used.append(v)

    for n in sorted(names):
        need(n)
    heads = [f"v_{v} AS ({re.sub(r'{(\w+)}', lambda m: f'v_{m[1]}' if m[1] in VIEWS else m[1], VIEWS[v])})" for v in used]
    body = re.sub(r"\{(\w+)\}", r"v_\1", sql).strip()
    if not heads:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(heads)}, {body[15:]}"
    return f"WITH {', '.join(heads)}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {', '.join(heads)} {body}"


def table(spark: SparkSession, sf_dir: str, name: str, written: dict[str, DataFrame] | None = None) -> DataFrame:
    """A given table, or a view over the given tables; what is written already is taken from there."""
    if written and name in written:
        return written[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inner = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: table(spark, sf_dir, n, written) for n in inner})


class Tables:
    """Gives the given tables and the views over them by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.written = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name, self.written)

    def by_file(self) -> None:
        """Write the columns of lineitem that views read, once, in buckets of the file, and the owners of files: what is made by file of the views over it is
        made without a shuffle."""
        if "owners" in self.written:
            return
        lines = self("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
        self.written["lineitem"] = bucketed(lines, "lineitem", key="l_partkey")
        self.written["owners"] = bucketed(self("owners"), "owners", key="file_id")

    def by_change(self, *names: str) -> None:
        """Write these views once, bucketed by change, for all who read them later."""
        for name in names:
            if name not in self.written:
                self.written[name] = bucketed(self(name), name)

    def once(self, *names: str) -> None:
        """Write these views once, for all who read them later."""
        for name in names:
            if name not in self.written:
                self.written[name] = materialise(self(name), name)


def comparable(name: str, lists: tuple[str, ...] = (), days: tuple[str, ...] = (), times: tuple[str, ...] = ()) -> None:
    """Give lists as text with bars between, days as text and times as microseconds, in a query and its SQL alike: engines and
    data frames print such values in ways of their own."""
    inner = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = inner(spark, sf_dir)
        new = {c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists} | {c: F.col(c).cast("string") for c in days} | {c: F.unix_micros(F.col(c).cast("timestamp")) for c in times}
        return df.withColumns(new)

    QUERIES[name] = run
    new = [f"array_to_string({c}, '|') AS {c}" for c in lists] + [f"CAST({c} AS VARCHAR) AS {c}" for c in days] + [f"epoch_us({c}) AS {c}" for c in times]
    SQL[name] = f"SELECT * REPLACE ({', '.join(new)}) FROM ({SQL[name]}) AS q"


def query(sql: str | None = None):
    """Register a function of Tables as a query, and its SQL."""

    def put(f):
        name = f.__name__
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = oracle(sql)
        return f

    return put
