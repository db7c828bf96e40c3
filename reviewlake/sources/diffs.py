"""Diffs, hunks, logs, blame and listings as text tables: one row per line with its place, numbered by windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
HEADER = re.compile(HUNK, re.ASCII)
#: Lines of a batch that goes back to Spark.
AT_ONCE = 20_000


def lines_of(df: DataFrame, by: str, text: str) -> DataFrame:
    """by, pos, line: the lines of a text column, in place."""
    return df.select(by, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def numbered(text: str | None) -> Iterator[tuple]:
    """pos, line, file, old_path, new_path, hunk, old_line and new_line of each line in a hunk of one diff."""
    lines, files, file = (text or "").split("\n"), {}, 0
    for line in lines:
        file += line.startswith("diff --git ")
        for side, mark in enumerate(("--- ", "+++ ")):
            if line.startswith(mark) and (file, side) not in files:
                files[file, side] = line[4:].removeprefix(("a/", "b/")[side])
    file = hunk = old = new = 0
    for pos, line in enumerate(lines):
        if line.startswith("diff --git "):
            file, hunk = file + 1, 0
        if at := HEADER.match(line):
            # "-40,0" means after line 40: the next base line is 41; the same for the other side
            hunk, old, new = hunk + 1, int(at[1]) + (at[2] == "0"), int(at[3]) + (at[4] == "0")
        elif hunk:
            yield pos, line, file, files.get((file, 0)), files.get((file, 1)), hunk, old, new
            old += line[:1] in (" ", "-") and line != ""
            new += line[:1] in (" ", "+", "")


def diff_lines(df: DataFrame, by: str = "pr", text: str = "diff") -> DataFrame:
    """by, pos, line, file (ordinal), old_path, new_path, hunk (ordinal in the diff's file), old_line, new_line of lines in hunks.

    A file begins at its diff header; hunk headers give the first line numbers, and running counts of kept, added and
    deleted lines give the rest. A diff is one row, so its lines are numbered where they are, without a sort. Diffs are dealt out by
    key before they are cut: few compressed splits can hold very many.
    """
    kinds = [("pos", T.IntegerType()), ("line", T.StringType()), ("file", T.LongType()), ("old_path", T.StringType()), ("new_path", T.StringType()), ("hunk", T.LongType()), ("old_line", T.LongType()), ("new_line", T.LongType())]
    shape = [(n, {"int": pa.int32(), "bigint": pa.int64()}.get(t.simpleString(), pa.string())) for n, t in kinds]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []

            def out(batch=batch) -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), shape, strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[by, *[n for n, _ in shape]])

            for k, diff in enumerate(batch.column(1)):
                for row in numbered(diff.as_py()):
                    rows.append(row)
                    at.append(k)
                    if len(rows) == AT_ONCE:
                        yield out()
                        rows, at = [], []
            if rows:
                yield out()

    schema = T.StructType([T.StructField(by, df.schema[by].dataType), *[T.StructField(n, t) for n, t in kinds]])
    return df.select(by, F.col(text).cast("string").alias("_text")).repartition(by).mapInArrow(number, schema)


def added_lines(lines: DataFrame, by: str = "pr") -> DataFrame:
    """by, path, line_no, text, new_file of lines added; deleted files give none."""
    new = F.col("line").startswith("+") & (F.col("new_path") != "/dev/null")
    return lines.filter(new).select(by, F.col("new_path").alias("path"), F.col("new_line").alias("line_no"), F.expr("substring(line, 2)").alias("text"), (F.col("old_path") == "/dev/null").alias("new_file"))


def old_side_hunks(lines: DataFrame, by: str = "pr", context: int = 3) -> DataFrame:
    """Base ranges to look up history for: of deleted lines, else `context` lines each side of where lines are inserted."""
    gone, new = F.col("line").startswith("-"), F.col("line").startswith("+")
    g = lines.filter(F.col("old_path") != "/dev/null").groupBy(by, "file", "hunk", "old_path", "new_path").agg(F.min(F.when(gone, F.col("old_line"))).alias("lo"), F.max(F.when(gone, F.col("old_line"))).alias("hi"), F.count(F.when(gone, 1)).alias("lines"), F.min(F.when(new, F.col("old_line"))).alias("at"))
    changed = F.col("lines") > 0
    after = F.col("at") - 1
    out = g.filter(changed | F.col("at").isNotNull())
    return out.select(by, F.col("old_path").alias("path"), F.when(changed, F.col("lo")).otherwise(F.greatest(F.lit(1), after - context + 1)).alias("start"), F.when(changed, F.col("hi")).otherwise(after + context).alias("end"), F.when(changed, "changed").otherwise("insertion").alias("kind"), "lines")


def hunk_ranges(df: DataFrame, by: str = "pr", text: str = "diff") -> DataFrame:
    """by, side, start, end of each hunk header, both sides; a count left out is 1, sides without lines are dropped."""
    h = lines_of(df, by, text).filter(F.col("line").rlike(HUNK))
    side = lambda name, a, n: F.struct(F.lit(name).alias("side"), F.regexp_extract("line", HUNK, a).cast("long").alias("start"), F.coalesce(F.nullif(F.regexp_extract("line", HUNK, n), F.lit("")).cast("long"), F.lit(1)).alias("n"))
    return h.select(by, F.explode(F.array(side("base", 1, 2), side("head", 3, 4))).alias("s")).filter("s.n > 0").select(by, "s.side", "s.start", (F.col("s.start") + F.col("s.n") - 1).alias("end"))


def blame(df: DataFrame, by: str = "path", text: str = "porcelain") -> DataFrame:
    """by, sha, lines of porcelain blame: one header of a 40-digit sha per line."""
    rows = lines_of(df, by, text).withColumn("sha", F.regexp_extract("line", r"^([0-9a-f]{40}) \d+ \d+", 1)).filter("sha <> ''")
    return rows.groupBy(by, "sha").agg(F.count(F.lit(1)).alias("lines"))


def git_log(df: DataFrame, text: str = "value", field: str = "\x1f") -> DataFrame:
    """sha, parents, merge, email, date, message (2,000 characters at most) of records with fields parted by \\x1f."""
    p = F.split(text, field)
    return df.select(p[0].alias("sha"), F.filter(F.split(p[1], " "), lambda x: x != "").alias("parents"), F.lower(p[2]).alias("email"), p[3].alias("date"), F.substring(p[4], 1, 2000).alias("message")).withColumn("merge", F.size("parents") > 1)


def name_status(df: DataFrame, by: str = "pr", text: str = "listing") -> DataFrame:
    """by, status, previous_path, path of NUL-separated listings: renames and copies take two paths. Tokens are walked in order
    by a fold that stays in the JVM."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), "\0"), lambda x: x != "")
    row = "struct<status:string,previous_path:string,path:string>"
    zero = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("string").alias("p"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc, tok):
        two = F.coalesce(acc["s"].rlike("^[RC]"), F.lit(False))
        want_first = acc["s"].isNull()
        half = two & acc["p"].isNull() & ~want_first
        done = F.concat(acc["out"], F.array(F.struct(F.substring(acc["s"], 1, 1).alias("status"), acc["p"].alias("previous_path"), tok.alias("path")).cast(row)))
        return F.struct(F.when(want_first, tok).when(half, acc["s"]).alias("s"), F.when(half, tok).alias("p"), F.when(want_first | half, acc["out"]).otherwise(done).alias("out"))

    return df.select(by, F.explode(F.aggregate(tokens, zero, step, lambda a: a["out"])).alias("f")).select(by, "f.*")


def commit_list(df: DataFrame, by: str = "pr", text: str = "log", mark: str = "\x1e") -> DataFrame:
    """by, idx, subject, paths: commits oldest first, each a record mark, a subject line and touched paths."""
    recs = F.filter(F.split(F.coalesce(text, F.lit("")), mark), lambda x: F.trim(x) != "")
    x = df.select(by, F.posexplode(recs).alias("idx", "rec")).withColumn("l", F.split("rec", "\n"))
    return x.select(by, "idx", F.col("l")[0].alias("subject"), F.filter(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda p: p != "").alias("paths"))


def compile_errors(df: DataFrame, by: str = "pr", text: str = "log", most: int = 10) -> DataFrame:
    """by, file, line, message (300 characters at most) of the first errors of a build log."""
    rx = r"^(\S+):(\d+): error: (.*)$"
    w = W.partitionBy(by).orderBy("pos")
    x = lines_of(df, by, text).filter(F.col("line").rlike(rx)).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    return x.select(by, "k", F.regexp_extract("line", rx, 1).alias("file"), F.regexp_extract("line", rx, 2).cast("int").alias("line_no"), F.substring(F.regexp_extract("line", rx, 3), 1, 300).alias("message"))
