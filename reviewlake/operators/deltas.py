"""What a change introduces and what it inherits: analysis results of the base and head side."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .joins import bag_match, covered, label, overlapping
from .ranking import ranked


def style_delta(base: DataFrame, head: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """introduced, pre-existing or fixed, by bag match of equal errors: the k-th copy at head is that at base."""
    m = bag_match(head, base, on, order)
    kind = F.when(F.col("_left").isNull(), "fixed").when(F.col("_right").isNull(), "introduced").otherwise("pre-existing")
    return m.withColumn("kind", kind)


def introduced_rules(base: DataFrame, head: DataFrame, files: DataFrame, ranges: DataFrame, order: list[str]) -> DataFrame:
    """head violations (file_id, rule, line, ...) with is_new: all of a new file; where the file has a line map, those whose line was
    added; else, by count, the last ones of each rule. files: file_id, base_file, new_file, mapped; ranges: added lines. Rows stay with their file."""
    j = head.join(files, "file_id")
    columns = [*head.columns, "is_new"]
    whole = j.filter("new_file").withColumn("is_new", F.lit(True))
    mapped = covered(j.filter("NOT new_file AND mapped"), ranges, ["file_id"], "line", "line", "begin_line", "end_line", "is_new")
    rest = j.filter("NOT new_file AND NOT mapped").select(*head.columns)
    some = files.filter("NOT new_file AND NOT mapped").select("file_id", "base_file")
    was = base.groupBy(F.col("file_id").alias("base_file"), "rule").agg(F.count(F.lit(1)).alias("_before"))
    before = was.join(some, "base_file").filter("rule IS NOT NULL").select("file_id", "rule", "_before")
    by = W.partitionBy("file_id", "rule")
    met = rest.withColumn("_row", F.lit(1)).unionByName(before, allowMissingColumns=True)
    met = met.withColumn("_k", F.row_number().over(by.orderBy(F.col("_row").desc_nulls_last(), *order))).withColumn("_now", F.count("_row").over(by)).withColumn("_was", F.coalesce(F.sum("_before").over(by), F.lit(0)))
    counted = met.filter("_row = 1").withColumn("is_new", F.col("_k") > F.col("_now") - F.greatest(F.lit(0), F.col("_now") - F.col("_was")))
    return whole.select(columns).unionByName(mapped.select(columns)).unionByName(counted.select(columns))


def method_delta(base: DataFrame, head: DataFrame, files: DataFrame, base_bodies: DataFrame, head_bodies: DataFrame, threshold: int = 15) -> DataFrame:
    """Head scores against those of the base file, which renames give, with the kind of change.

    A method's base score is that of the same class and signature there, else of the only method of that signature. Without one it
    existed (score 0) when the base file has at least as many bodies of its name as the head file: in its class, or at all where
    that class has none. Else it moved when a base file has the signature, else it is new; all in new files are.
    base, head: file_id, cls, name, sig, score (head also touched), one row per method; files: file_id, base_file (null: none),
    new_file; bodies: file_id, cls, name, one row each.
    """
    n = int(head.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = F.col("_t")
    over = lambda *by: W.partitionBy(*by)
    where = lambda value, *by: F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]), value)
    # methods of a file meet the bodies there, then what the base file has, in windows within the file, so each is dealt out by file alone
    here = head_bodies.groupBy("file_id", "cls", "name").agg(F.count(F.lit(1)).alias("_n"))
    h = head.withColumn("_t", F.lit(0)).unionByName(here, allowMissingColumns=True)
    h = h.withColumn("_here", where(F.sum("_n").over(over("file_id", "cls", "name")), "cls", "name")).filter("_t = 0").drop("_n", "_t")
    h = h.join(files.select("file_id", "base_file", "new_file"), "file_id")
    new = h.filter("base_file IS NULL")
    at = F.col("file_id").alias("_file")
    was = base.select(at, "cls", "sig", F.col("score").alias("_was"), F.lit(1).alias("_t"))
    bodies = base_bodies.groupBy(at, "cls", "name").agg(F.count(F.lit(1)).alias("_n")).withColumn("_t", F.lit(2))
    j = h.filter("base_file IS NOT NULL").withColumn("_t", F.lit(0)).repartition(n, "base_file").withColumnRenamed("base_file", "_file").unionByName(was, allowMissingColumns=True).unionByName(bodies, allowMissingColumns=True)
    old = F.when(t == 1, F.col("_was"))
    j = j.withColumn("_exact", where(F.max(old).over(over("_file", "cls", "sig")), "cls", "sig"))
    one = over("_file", "sig")
    j = j.withColumn("_alone", where(F.when(F.count(F.when(t == 1, 1)).over(one) == 1, F.min(old).over(one)), "sig"))
    j = j.withColumn("_in_class", where(F.sum("_n").over(over("_file", "cls", "name")), "cls", "name")).withColumn("_in_file", where(F.sum("_n").over(over("_file", "name")), "name"))
    j = j.filter("_t = 0").drop("_t", "_was", "_n").withColumnRenamed("_file", "base_file").unionByName(new, allowMissingColumns=True)
    j = j.join(base.select("sig", F.lit(True).alias("_elsewhere")).distinct(), "sig", "left")
    found = F.coalesce("_exact", "_alone")
    existed = F.col("base_file").isNotNull() & found.isNull() & (F.coalesce("_in_class", "_in_file", F.lit(0)) >= F.coalesce("_here", F.lit(0)))
    before = F.coalesce(found, F.when(existed, 0))
    other = F.when(F.col("base_file").isNotNull() & F.coalesce("_elsewhere", F.lit(False)), "moved").otherwise("introduced-new-method")
    kind = F.when(F.col("new_file"), "introduced-new-file").when(before.isNull(), other).otherwise(label(F.col("score"), before, F.lit(threshold), F.col("touched")))
    level = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_alone").isNotNull(), "signature").when(existed, "existed")
    return j.select("file_id", "cls", "sig", "score", before.alias("base"), kind.alias("kind"), level.alias("matched"))


def fixed_methods(base: DataFrame, head: DataFrame, threshold: int = 15) -> DataFrame:
    """Base breaches with none left at head: not the same method, and no breach of that signature in another file."""
    breach = base.filter(F.col("score") >= threshold)
    still = head.filter(F.col("score") >= threshold)
    gone = breach.join(still, ["file_id", "cls", "sig"], "left_anti")
    other = still.select("sig", F.col("file_id").alias("_f"))
    return gone.join(other, (gone.sig == other.sig) & (gone.file_id != other._f), "left_anti")


def removed_methods(base: DataFrame, head: DataFrame, files: DataFrame, threshold: int = 15) -> DataFrame:
    """Base methods with a score whose file has a head side without them: neither the same class and signature nor, as the only one of its
    signature, another. kind is fixed from the threshold on, else pre-existing-improved; file_id is the head file's."""
    at = files.filter("base_file IS NOT NULL AND NOT new_file").select("file_id", "base_file")
    was = base.filter("score > 0").withColumnRenamed("file_id", "base_file").join(at, "base_file")
    only = head.groupBy("file_id", "sig").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    gone = was.join(head.select("file_id", "cls", "sig"), ["file_id", "cls", "sig"], "left_anti").join(only, ["file_id", "sig"], "left_anti")
    return gone.select("file_id", "cls", "sig", F.col("score").alias("base"), F.when(F.col("score") >= threshold, "fixed").otherwise("pre-existing-improved").alias("kind"))


def complexity_table(delta: DataFrame, removed: DataFrame, owners: DataFrame) -> DataFrame:
    """pr, path, cls, sig, score, base, change (new, worse, same, better), test, band, removed (how many methods the change takes away) and place:
    methods that the change adds or makes worse first, then by score, production before tests, file and method. Methods that
    are neither touched nor of another score aren't listed. delta: see method_delta; owners: file_id, pr, path."""
    change = X.change_label(F.col("base"), F.col("score"))
    x = delta.filter("kind <> 'pre-existing'").join(owners, "file_id").withColumn("change", change).withColumn("test", F.col("path").startswith("test/"))
    gone = removed.join(owners, "file_id").groupBy("pr").agg(F.count(F.lit(1)).alias("removed"))
    x = x.join(gone, "pr", "left").fillna(0, ["removed"])
    order = [(~F.col("change").isin("new", "worse")).asc(), F.col("score").desc(), F.col("test").asc(), F.col("path").asc(), F.col("sig").asc(), F.col("cls").asc()]
    return ranked(x.select("pr", "path", "cls", "sig", "score", "base", "change", "test", X.complexity_band(F.col("score")).alias("band"), "removed"), ["pr"], order, "place")


def added_lines(ranges: DataFrame, begin: str = "begin_line", end: str = "end_line") -> DataFrame:
    """One row per line of the ranges, each line once per file. Ranges meet as 64 bits of a number, so that single lines are neither
    shuffled nor kept in memory."""
    whole = ranges.select(F.sequence(begin, end).alias("line")).schema["line"].dataType.elementType
    x = ranges.filter(F.col(begin).isNotNull() & F.col(end).isNotNull()).select("file_id", F.least(begin, end).cast("long").alias("_lo"), F.greatest(begin, end).cast("long").alias("_hi"))
    x = x.withColumn("_b", F.explode(F.expr("sequence(shiftright(_lo, 6), shiftright(_hi, 6))")))
    x = x.select("file_id", "_b", F.expr("CAST(greatest(_lo - _b * 64, 0) AS INT)").alias("_from"), F.expr("CAST(least(_hi - _b * 64, 63) AS INT)").alias("_to"))
    g = x.groupBy("file_id", "_b").agg(F.bit_or(F.expr("shiftleft(shiftrightunsigned(-1L, 63 - _to + _from), _from)")).alias("_bits"))
    return g.select("file_id", "_b", F.explode(F.expr("filter(sequence(0, 63), i -> getbit(_bits, i) = 1)")).alias("_i")).select("file_id", (F.col("_b") * 64 + F.col("_i")).cast(whole).alias("line"))


def line_coverage(lines: DataFrame, counters: DataFrame) -> DataFrame:
    """Per added line: missed, partial, covered, or nonexec where the report has no counter, and in_report: whether it has the
    file at all. counters: file_id, line, mi, ci, mb, cb."""
    state = F.when(F.col("ci").isNull(), "nonexec").when((F.col("ci") == 0) & (F.col("cb") == 0), "missed").when((F.col("mi") > 0) | (F.col("mb") > 0), "partial").otherwise("covered")
    known = counters.select("file_id", F.lit(True).alias("_in")).distinct()
    j = lines.join(counters, ["file_id", "line"], "left").join(known, "file_id", "left")
    return j.select("file_id", "line", state.alias("state"), F.coalesce("_in", F.lit(False)).alias("in_report"))


def coverage_totals(states: DataFrame) -> DataFrame:
    """Counts of each state per file and the share of executable lines that ran, to one digit; null when there are none."""
    counts = [F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("covered", "partial", "missed", "nonexec")]
    t = states.groupBy("file_id").agg(*counts).withColumn("executable", F.col("covered") + F.col("partial") + F.col("missed"))
    return t.withColumn("pct", F.round(F.try_divide(100.0 * (F.col("covered") + F.col("partial")), F.col("executable")), 1))


def tail(k: int, mu: float) -> float:
    """P(X >= k) of a Poisson count. Above the mean it is summed from k up, so that a tiny tail keeps its digits; below it is what
    the sum from k - 1 down leaves of 1. Either way terms shrink from the first, so the sum ends by its precision."""
    if k <= 0:
        return 1.0
    if mu <= 0:
        return 0.0
    up = k >= mu
    j = k if up else k - 1
    term = math.exp(j * math.log(mu) - mu - math.lgamma(j + 1))
    total = term
    while term > total * 1e-17 and (up or j > 0):
        j, term = (j + 1, term * mu / (j + 1)) if up else (j - 1, term * j / mu)
        total += term
    return min(total, 1.0) if up else max(0.0, 1.0 - total)


@F.pandas_udf(T.DoubleType())
def poisson_tail(k: pd.Series, mu: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(m) else tail(int(a), float(m)) for a, m in zip(k, mu, strict=True)], dtype="float64")


def judged(rates: DataFrame, usual_from: float = 0.01) -> DataFrame:
    """rates (observed, violations, loc, added) with expected, p and usual: whether the observed count is no more than the
    branch's own rate explains. Undefined (not usual, no p) when any input is 0 or less."""
    known = (F.col("observed") > 0) & (F.col("violations") > 0) & (F.col("loc") > 0) & (F.col("added") > 0)
    out = rates.withColumn("expected", F.coalesce(F.try_divide(F.col("violations").cast("double"), F.col("loc")) * F.col("added"), F.lit(0.0)))
    out = out.withColumn("p", F.when(known, poisson_tail("observed", "expected")))
    return out.withColumn("usual", F.coalesce(F.col("p") >= usual_from, F.lit(False)))


def branch_baseline(violations: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per branch and rule: files_hit, violations; per branch: scanned files, loc, their lines that aren't blank).
    violations: branch, file, rule; files: branch, file, text."""
    rules = violations.groupBy("branch", "rule").agg(F.count_distinct("file").alias("files_hit"), F.count(F.lit(1)).alias("violations"))
    return rules, files.groupBy("branch").agg(F.count_distinct("file").alias("scanned"), F.sum(X.nonblank_lines(F.col("text"))).alias("loc"))


def rule_section(found: DataFrame, rules: DataFrame, branch: DataFrame, added: int | DataFrame, needs_types: list[str], house_from: float = 0.25, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per rule that fires, or per `by` and rule: introduced, in_tests, production and pre_existing violations, category, share of the branch's
    files it hits, house (style of the house), expected and p of its production count, usual, needs_types and class: untyped,
    house, usual or counted, of which each rule is one.

    found: rule, category, in_test, is_new; rules, branch: a baseline of one branch (see branch_baseline); added: production lines, or a table of them (*by, added).
    """
    new = F.col("is_new")
    n = found.groupBy(*by, "rule").agg(F.min("category").alias("category"), F.count(F.when(new, 1)).alias("introduced"), F.count(F.when(new & F.col("in_test"), 1)).alias("in_tests"), F.count(F.when(~new, 1)).alias("pre_existing"))
    base = rules.join(F.broadcast(branch), "branch").select("rule", "violations", "loc", (F.col("files_hit") / F.col("scanned")).alias("share"))  # one row per branch
    j = n.join(base, "rule", "left").fillna(0, ["violations", "loc", "share"]).withColumn("production", F.col("introduced") - F.col("in_tests"))
    j = j.join(added, list(by), "left").fillna(0, ["added"]) if isinstance(added, DataFrame) else j.withColumn("added", F.lit(added))
    j = judged(j.withColumn("observed", F.col("production"))).withColumn("house", F.col("share") >= house_from).withColumn("needs_types", F.col("rule").isin(*needs_types))
    kind = F.when(F.col("needs_types"), "untyped").when(F.col("house"), "house").when(F.col("usual"), "usual").otherwise("counted")
    return j.withColumn("class", kind).drop("observed", "added", "violations", "loc")


def category_rollup(section: DataFrame) -> DataFrame:
    """Per category and in all (category null): introduced violations, rules with any, and how many of both are house style, usual or
    counted; rules that need types are left out."""
    x = section.filter("class <> 'untyped' AND introduced > 0")
    of = lambda k: [F.coalesce(F.sum(F.when(F.col("class") == k, F.col("introduced"))), F.lit(0)).alias(k), F.count(F.when(F.col("class") == k, 1)).alias(f"{k}_rules")]
    return x.rollup("category").agg(F.sum("introduced").alias("introduced"), F.count(F.lit(1)).alias("rules"), *of("house"), *of("usual"), *of("counted"))


def house_rules(violations: DataFrame, files: DataFrame, share_from: float = 0.25) -> DataFrame:
    """Per side and rule: files hit, violations, share of files scanned, and whether that makes it house style."""
    scanned = files.groupBy("side").agg(F.count_distinct("file_id").alias("scanned"))
    hit = violations.groupBy("side", "rule").agg(F.count_distinct("file_id").alias("files_hit"), F.count(F.lit(1)).alias("violations"))
    out = hit.join(F.broadcast(scanned), "side")  # one row per side
    return out.withColumn("share", F.col("files_hit") / F.col("scanned")).withColumn("house", F.col("share") >= share_from)


def touched(points: DataFrame, ranges: DataFrame) -> DataFrame:
    return overlapping(points, ranges, ["file_id"], "line", "line", "begin_line", "end_line")
