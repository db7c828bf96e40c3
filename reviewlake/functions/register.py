"""Scalar functions and a table function by name, for SQL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.deltas import poisson_tail
from ..sources.records import text_lines
from . import text as X
from .paths import RULES

STOP = ", ".join(f"'{w}'" for w in X.STOP)
STEM = "CASE " + " ".join(f"WHEN endswith(w, '{e}') AND length(w) - {len(e)} >= 4 THEN left(w, length(w) - {len(e)})" for e in X.ENDINGS) + " ELSE w END"
TOKEN = r"([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*)"


def prefixes(path: str, starts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"startswith({path}, '{s}')" for s in starts) + ")"


#: name, arguments, result and body of each SQL function, the same rules as the column functions of this package
FUNCTIONS = {
    "is_test_path": ("p STRING", "BOOLEAN", f"{prefixes('p', RULES.test)} OR contains(p, '{RULES.test_inside}')"),
    "is_production_path": ("p STRING", "BOOLEAN", f"{prefixes('p', RULES.prod)} AND NOT is_test_path(p)"),
    "keys_in_text": ("t STRING", "ARRAY<STRING>", rf"transform(regexp_extract_all(coalesce(t, ''), '(?i)\\b{X.PROJECT}[-_ ]?(\\d{{3,6}})\\b', 1), n -> concat('{X.PROJECT}-', n))"),
    "keys_in_branch": ("t STRING", "ARRAY<STRING>", rf"CASE WHEN size(keys_in_text(t)) > 0 THEN keys_in_text(t) ELSE transform(filter(split(coalesce(t, ''), '[/_-]'), x -> x RLIKE '^\\d{{4,6}}$'), n -> concat('{X.PROJECT}-', n)) END"),
    "is_release_branch": ("t STRING", "BOOLEAN", r"t RLIKE '^project-\\d+\\.\\d+$'"),
    "has_plus_one": ("t STRING", "BOOLEAN", r"t RLIKE '(^|[\\s(\\[])\\+1\\b'"),
    "words_of": ("t STRING", "ARRAY<STRING>", f"array_sort(array_distinct(transform(filter(regexp_extract_all(lower(t), '([a-z]+)', 1), w -> length(w) > 2 AND w NOT IN ({STOP})), w -> {STEM})))"),
    "identifiers_of": ("t STRING", "ARRAY<STRING>", rf"array_sort(array_distinct(filter(flatten(transform(filter(regexp_extract_all(t, '{TOKEN}', 1), x -> NOT endswith(x, 'java')), x -> CASE WHEN contains(x, '.') THEN concat(array(x), split(x, '\\.')) ELSE array(x) END)), p -> p RLIKE '[a-z][A-Z]' OR p RLIKE '^[A-Z]{{2,}}[a-z]' OR contains(p, '.'))))"),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "coalesce(try_divide(CAST(size(array_intersect(a, b)) AS DOUBLE), size(array_union(a, b))), 0D)"),
    "location_path": ("t STRING", "STRING", r"nullif(regexp_extract(t, '^(.*\\.\\w+):(\\d+)$', 1), '')"),
    "location_line": ("t STRING", "BIGINT", r"try_cast(nullif(regexp_extract(t, '^(.*\\.\\w+):(\\d+)$', 2), '') AS BIGINT)"),
}


@F.udtf(returnType=T.StructType([T.StructField("path", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("new_file", T.BooleanType())]))
class DiffLines:
    """Added lines of a unified diff, with their numbers in the new file; deleted files have none."""

    def eval(self, diff: str):
        path, at, fresh, left = None, 0, False, [0, 0]
        for line in (diff or "").split("\n"):
            if max(left) > 0:
                if line[:1] == "+" and path:
                    yield path, at, line[1:], fresh
                at += line[:1] != "-"
                left = [left[0] - (line[:1] != "+"), left[1] - (line[:1] != "-")]
            elif line.startswith("diff --git "):
                path, fresh = None, False
            elif line.startswith("--- "):
                fresh = line == "--- /dev/null"
            elif line.startswith("+++ "):
                path = None if line == "+++ /dev/null" else line[4:].removeprefix("b/")
            elif m := re.match(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
                at, left = int(m[2]), [int(m[1] or 1), int(m[3] or 1)]


def register(spark: SparkSession) -> None:
    """Make the functions, the Arrow functions norm_name, text_lines and poisson_tail, and the table function diff_lines known to SQL."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, udf in (("norm_name", X.folded), ("text_lines", text_lines), ("poisson_tail", poisson_tail)):
        spark.udf.register(name, udf)
    spark.udtf.register("diff_lines", DiffLines)
