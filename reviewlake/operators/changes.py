"""Changes as a whole: tickets and siblings, branches and their CI, how hard a review is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .joins import tags
from .ranking import budgeted, latest, ranked, top_k


def guess_branch(texts: list[Column], hints: list[tuple[str, str]]) -> Column:
    """The branch of the first hint that the first matching text holds."""
    return F.coalesce(*[F.when(t.rlike(p), b) for t in texts for p, b in hints])


def ticket_groups(changes: DataFrame, key: str = "key") -> DataFrame:
    """pr, key, size, first: each change's group of changes with its resolved key, by its size and least member. A group with a
    great many changes is never spelt out in pairs."""
    a = changes.filter(F.col(key).isNotNull())
    g = a.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min("pr").alias("first"))
    return a.select("pr", key).join(g, key)


def siblings_of(wanted: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """(pr, key, sibling, is_self) for stated changes: all that share the resolved key of each."""
    other = changes.filter(F.col(key).isNotNull()).select(key, F.col("pr").alias("sibling"))
    return wanted.select("pr", key).join(other, key).withColumn("is_self", F.col("pr") == F.col("sibling"))


def targeted_branches(changes: DataFrame, key: str = "key", open_state: str = "O") -> DataFrame:
    """pr, base, sibling: the own change and the first open sibling on each other base branch. A ticket's open changes are first
    cut down to one per branch, so a change meets as many rows as there are branches."""
    a = changes.filter(F.col(key).isNotNull())
    heads = a.filter(F.col("state") == open_state).groupBy(key, "base").agg(F.min("pr").alias("sibling"))
    own = a.select("pr", F.col("base"), F.col("pr").alias("sibling"))
    mine = a.select("pr", key, F.col("base").alias("_own"))
    others = mine.join(heads, key).filter(F.col("base") != F.col("_own")).select("pr", "base", "sibling")
    return own.unionByName(others)


def map_ci(runs: DataFrame, changes: DataFrame, hints: list[tuple[str, str]]) -> DataFrame:
    """runs with target_branch and mapped_by: the change of the run's head, else the hint in its ref."""
    heads = changes.groupBy(F.col("head").alias("sha")).agg(F.min("base").alias("_base"))
    out = runs.join(heads, "sha", "left")
    guess = guess_branch([F.col("ref")], hints)
    return out.withColumn("target_branch", F.coalesce("_base", guess)).withColumn("mapped_by", F.when(F.col("_base").isNotNull(), "head").when(guess.isNotNull(), "name")).drop("_base")


def latest_ci(runs: DataFrame) -> DataFrame:
    """The newest run per change and branch; of equals the first."""
    return latest(runs.filter("target_branch IS NOT NULL"), ["pr", "target_branch"], "created", "seq")


@dataclass(frozen=True)
class Triage:
    """Points of each band (strictly above the bound), of surfaces and of missing tests, and ratings."""

    lines: tuple = ((1000, 4), (400, 2), (100, 1))
    files: tuple = ((30, 2), (10, 1))
    subsystems: tuple = ((4, 2), (2, 1))
    branches: tuple = ((2, 1),)
    surface: int = 1
    hard_surface: int = 1
    concurrency: int = 2
    no_tests: int = 1
    moderate: int = 2
    hard: int = 5
    small_lines: int = 50
    split_lines: int = 1000
    surfaces: tuple = (("network", r"/net/"), ("storage", r"/db/"), ("config", r"^conf/"), ("tools", r"^pylib/"))
    hard_surfaces: tuple = ("network", "storage")
    concurrent: tuple = ("src/java/org/project/concurrent/",)
    serial: str = r"/db/blue_"


def band(value: Column, bands) -> Column:
    return F.coalesce(*[F.when(value > n, p) for n, p in bands], F.lit(0))


def triage_signals(files: DataFrame, cfg: Triage = Triage(), rules: P.PathRules = P.RULES) -> DataFrame:
    """One row per change: sizes, subsystems, surfaces, concurrency paths, tests, serialization. files: pr, path, additions,
    deletions, bin. Sums are combined before the one shuffle, by change."""
    p = F.col("path")
    n = F.col("additions") + F.col("deletions")
    ok, prod = P.counted(p, F.col("bin"), rules), P.is_prod(p, rules)
    ok_prod = ok & prod
    return files.groupBy("pr").agg(
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("lines"), F.sum(ok.cast("long")).alias("files"), F.coalesce(F.sum(F.when(ok_prod, n)), F.lit(0)).alias("prod_lines"),
        F.sum(ok_prod.cast("long")).alias("prod_files"), F.array_sort(F.collect_set(F.when(ok_prod, P.subsystem(p, rules)))).alias("subsystems"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(tags(p, list(cfg.surfaces)))))).alias("surfaces"), F.array_sort(F.collect_set(F.coalesce(*[F.when(ok_prod & p.startswith(c), c) for c in cfg.concurrent]))).alias("concurrency"),
        F.bool_or(P.test_suite(p, rules).isNotNull()).alias("has_tests"), F.bool_or(prod & p.rlike(cfg.serial)).alias("serial"),
    )


def triage_rating(s: DataFrame, cfg: Triage = Triage()) -> DataFrame:
    """signals with points, rating and split: bands add up, small changes are capped at moderate, and serialization code is
    always hard. branches is the number of target branches."""
    hard = F.size(F.array_intersect("surfaces", F.array(*[F.lit(x) for x in cfg.hard_surfaces])))
    points = band(F.col("lines"), cfg.lines) + band(F.col("files"), cfg.files) + band(F.size("subsystems"), cfg.subsystems) + cfg.surface * F.size("surfaces") + cfg.hard_surface * hard
    points = points + F.when(F.size("concurrency") > 0, cfg.concurrency).otherwise(0) + band(F.col("branches"), cfg.branches) + F.when((F.col("prod_files") > 0) & ~F.col("has_tests"), cfg.no_tests).otherwise(0)
    s = s.withColumn("points", points.cast("long"))
    rating = F.when(F.col("serial"), "hard").when((F.col("points") >= cfg.hard) & (F.col("lines") < cfg.small_lines), "moderate").when(F.col("points") >= cfg.hard, "hard").when(F.col("points") >= cfg.moderate, "moderate").otherwise("easy")
    return s.withColumn("rating", rating).withColumn("split", F.col("prod_lines") > cfg.split_lines)


def split_advice(files: DataFrame, bound: int = 1000, k: int = 5, rules: P.PathRules = P.RULES) -> DataFrame:
    """pr, path, lines, rank: the k largest counted files of changes with more than `bound` changed production lines."""
    p, n = F.col("path"), F.col("additions") + F.col("deletions")
    f = files.filter(P.counted(p, F.col("bin"), rules))
    big = f.groupBy("pr").agg(F.sum(F.when(P.is_prod(p, rules), n)).alias("_prod")).filter(F.col("_prod") > bound).select("pr")
    return top_k(f.groupBy("pr", "path").agg(F.sum(n).alias("lines")).join(big, "pr", "left_semi"), ["pr"], [F.col("lines").desc(), p.asc()], k)


def selected_parts(parts: DataFrame, files: DataFrame, budget: int, by: str = "pr", tie: str = "start", rules: P.PathRules = P.RULES) -> DataFrame:
    """parts (files, or hunks of files) with rank, taken and skipped: of each change the first `budget` by production first, the
    largest file first, then path and place. files: pr, path, additions, deletions."""
    size = files.groupBy(by, "path").agg(F.sum(F.col("additions") + F.col("deletions")).alias("_size"))
    j = parts.join(size, [by, "path"], "left").fillna(0, ["_size"])
    order = [P.is_prod(F.col("path"), rules).desc(), F.col("_size").desc(), F.col("path").asc(), *([F.col(tie).asc()] if tie in parts.columns else [])]
    return budgeted(j, [by], order, budget).drop("_size")


def capped_tests(scored: DataFrame, by: str, own: str, floor: int = 15, cap: int = 25, cap_own: int = 30) -> DataFrame:
    """scored (by, test, score, own: whether the change brings the test) with rank: tests of at least `floor` points, the best `cap`
    of each change, or `cap_own` where it brings tests of its own."""
    most = F.when(F.bool_or(F.col(own)).over(W.partitionBy(by)), cap_own).otherwise(cap)
    x = scored.withColumn("_most", most).filter(F.col("score") >= floor)
    return ranked(x, [by], [F.col("score").desc(), F.col("test").asc()]).filter(F.col("rank") <= F.col("_most")).drop("_most")


def text_budget(lines: Column, most: int = 1500, limits: tuple[int, ...] = (300, 200, 140, 100, 60)) -> tuple[Column, Column]:
    """(limit, body) of a list of lines: the longest limit that, each line clipped to it, makes a body of at most `most` characters;
    nulls where even the shortest is too long."""
    bodies = [F.array_join(F.transform(lines, _clipped(n)), "\n") for n in limits]
    return F.coalesce(*[F.when(F.length(b) <= most, n) for n, b in zip(limits, bodies, strict=True)]), F.coalesce(*[F.when(F.length(b) <= most, b) for b in bodies])


def _clipped(n: int):
    return lambda x: X.clip(x, n)


def review_tier(files: DataFrame, rules: P.PathRules = P.RULES) -> DataFrame:
    """pr, lines and tier from changed lines outside tests: none, small under 50, large over 1000, else medium."""
    p = F.col("path")
    n = F.coalesce(F.sum(F.when(P.is_code(p, rules) & ~P.is_test(p, rules), F.col("additions") + F.col("deletions"))), F.lit(0))
    out = files.groupBy("pr").agg(n.alias("lines"))
    return out.withColumn("tier", F.when(F.col("lines") == 0, "none").when(F.col("lines") < 50, "small").when(F.col("lines") > 1000, "large").otherwise("medium"))


def risk_ranked(files: DataFrame, cfg: Triage = Triage(), k: int = 15, rules: P.PathRules = P.RULES) -> DataFrame:
    """Code files of each change by risk: lines times one plus weights for surfaces, concurrency and serialization; focus marks
    the first k."""
    p = F.col("path")
    weight = 1 + F.when(F.size(tags(p, list(cfg.surfaces))) > 0, 2.0).otherwise(0.0) + F.when(P.starts(p, cfg.concurrent), 1.5).otherwise(0.0) + F.when(p.rlike(cfg.serial), 2.0).otherwise(0.0)
    sized = files.filter(P.is_code(p, rules)).groupBy("pr", "path").agg(F.sum(F.col("additions") + F.col("deletions")).alias("lines"))
    out = ranked(sized.withColumn("risk", F.bround(F.col("lines") * weight, 1)), ["pr"], [F.col("risk").desc(), F.col("path").asc()])
    return out.withColumn("focus", F.col("rank") <= k)
