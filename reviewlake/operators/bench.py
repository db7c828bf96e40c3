"""How well a panel of reviewers finds known defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Severity of each impact for high, medium and low confidence.
CONFIDENCES = ("high", "medium", "low")
SEVERITY_TABLE = {
    "data-loss": ("blocker", "major", "minor"), "crash": ("blocker", "major", "minor"), "hang": ("blocker", "major", "minor"), "mixed-version-break": ("blocker", "major", "minor"),
    "silent-wrong-result": ("major", "major", "minor"), "performance": ("minor", "minor", "nit"), "cosmetic": ("nit", "nit", "nit"),
}


def derive_severity(findings: DataFrame, table: dict[str, tuple[str, str, str]] = SEVERITY_TABLE, cosmetic: str = "cosmetic") -> DataFrame:
    """findings (given, impact, confidence) with severity by the table, and corrected: whether that differs from what was given.
    A finding without an impact, or without a confidence that its impact needs, keeps the given one."""
    cases = [F.when((F.col("impact") == i) & (F.col("confidence") == c), s) for i, row in table.items() for c, s in zip(CONFIDENCES, row, strict=True)]
    bare = F.when((F.col("impact") == cosmetic) & F.col("confidence").isNull(), table[cosmetic][0])
    out = findings.withColumn("severity", F.coalesce(bare, *cases, F.col("given")))
    return out.withColumn("corrected", F.col("severity") != F.col("given"))


def in_place(locations: Column, files: Column, begin: Column, end: Column, margin: int = 15) -> Column:
    """Whether one of an issue's locations is where a known issue lies: a path that ends in one of its files, or the other way round,
    and a line within the margin of its range; a missing line or range fits, and so does everything where no file is known."""
    at = F.transform(locations, lambda x: X.loose_location(x))
    near = lambda line: begin.isNull() | line.isNull() | line.between(begin - margin, end + margin)
    fits = F.exists(at, lambda x: x["path"].isNotNull() & F.exists(files, lambda f: x["path"].endswith(f) | f.endswith(x["path"])) & near(x["line"]))
    return (F.size(files) == 0) | F.coalesce(fits, F.lit(False))


def says(text: Column, terms: Column, any_of: Column) -> Column:
    """Whether a lower-case text holds all terms, in any case, and, where there are such, one of any_of."""
    return F.forall(terms, lambda t: text.contains(F.lower(t))) & ((F.size(any_of) == 0) | F.exists(any_of, lambda t: text.contains(F.lower(t))))


def matches(issues: DataFrame, known: DataFrame, margin: int = 15) -> DataFrame:
    """(case_id, run, id, issue): the issues that are a known issue of their case, by place and by words.

    issues: case_id, run, id, locations, text (lower-case); known: case_id, issue, files, begin, end, terms, any_of. Both meet by
    case, of which each has a panel's issues and a few known ones; every pair is looked at once, in the join's own condition.
    """
    j = issues.join(known.select("case_id", "issue", "files", "begin", "end", "terms", "any_of"), "case_id")
    hit = in_place(F.col("locations"), F.col("files"), F.col("begin"), F.col("end"), margin) & says(F.col("text"), F.col("terms"), F.col("any_of"))
    return j.filter(hit).select("case_id", "run", "id", "issue")


def recall(known: DataFrame, found: DataFrame, runs: DataFrame) -> DataFrame:
    """class, possible, found, recall: found over possible (known issue and run of its case) pairs, of all, hard, soft and major or
    worse ones; recall is null for a class without any. known: case_id, issue, hard, severity; found: case_id, run, issue."""
    n = runs.select("case_id", "run").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("runs"))
    hits = found.select("case_id", "run", "issue").distinct().groupBy("case_id", "issue").agg(F.count(F.lit(1)).alias("hits"))
    j = known.join(n, "case_id").join(hits, ["case_id", "issue"], "left").fillna(0, ["hits"])
    bad = F.col("severity").isin("blocker", "major")
    classes = F.filter(F.array(F.lit("all"), F.when(F.col("hard"), "hard").otherwise("soft"), F.when(bad, "major+")), lambda c: c.isNotNull())
    every = j.select(F.explode(classes).alias("class"), "runs", "hits").groupBy("class").agg(F.sum("runs").alias("possible"), F.sum("hits").alias("found"))
    names = known.sparkSession.createDataFrame([(c,) for c in ("all", "hard", "soft", "major+")], "class string")
    out = names.join(every, "class", "left").fillna(0, ["possible", "found"])
    return out.withColumn("recall", F.round(F.try_divide("found", "possible"), 6))


def lens_shares(issues: DataFrame) -> DataFrame:
    """Per lens: issues it reports, those it reports alone, and their share. issues: lenses."""
    x = issues.select(F.explode("lenses").alias("lens"), (F.size("lenses") == 1).alias("alone"))
    return x.groupBy("lens").agg(F.count(F.lit(1)).alias("issues"), F.count(F.when(F.col("alone"), 1)).alias("alone")).withColumn("share", F.round(F.col("alone") / F.col("issues"), 6))


def field(name: str):
    return lambda x: x[name]


def panel_scores(issues: DataFrame, raw: DataFrame, found: DataFrame, runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per case: runs, and lists in their order of raw findings, issues, must-fix issues, known issues found, unmatched issues that
    nobody labelled, tokens and seconds; and the duplicate rate over all.

    issues: case_id, run, id, severity, key; raw: case_id, run, findings; runs: case_id, run, tokens, seconds; labels: key.
    """
    open_ = issues.join(found.select("case_id", "run", "id").distinct(), ["case_id", "run", "id"], "left_anti").join(labels.select("key").distinct(), "key", "left_anti")
    must = F.col("severity").isin("blocker", "major")
    j = runs.join(raw, ["case_id", "run"], "left")
    j = j.join(issues.groupBy("case_id", "run").agg(F.count(F.lit(1)).alias("issues"), F.count(F.when(must, 1)).alias("must_fix")), ["case_id", "run"], "left")
    j = j.join(found.groupBy("case_id", "run").agg(F.count_distinct("issue").alias("found")), ["case_id", "run"], "left")
    j = j.join(open_.groupBy("case_id", "run").agg(F.count(F.lit(1)).alias("unlabelled")), ["case_id", "run"], "left").fillna(0)
    names = ["findings", "issues", "must_fix", "found", "unlabelled", "tokens", "seconds"]
    row = F.array_sort(F.collect_list(F.struct("run", *names)))
    g = j.groupBy("case_id").agg(row.alias("r"))
    rate = 1 - F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["issues"]) / F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["findings"])
    return g.select("case_id", F.size("r").cast("long").alias("runs"), *[F.transform("r", field(n)).alias(n) for n in names], F.round(rate, 6).alias("duplicate_rate"))


def unique_finds(found: DataFrame) -> DataFrame:
    """Issues that one run alone found, and which."""
    return found.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("run").alias("run")).filter("n = 1").select("issue", "run")


def compare(found: DataFrame, a: str, b: str) -> DataFrame:
    """Issues found by a alone and by b alone."""
    pa, pb = (found.filter(F.col("run") == x).select("issue") for x in (a, b))
    return pa.subtract(pb).select(F.lit(a).alias("only_by"), "issue").unionByName(pb.subtract(pa).select(F.lit(b).alias("only_by"), "issue"))
