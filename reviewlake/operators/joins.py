"""Joins that Spark has no word for: overlap, nearest line, bag match, cascades of ever looser keys, rule dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import any_of


def overlapping(points: DataFrame, ranges: DataFrame, on: list[str], begin: str, end: str, r_begin: str, r_end: str, bucket: int = 256) -> DataFrame:
    """The rows of points whose [begin, end] overlaps a range of the same `on` key (a semi join).

    Both sides are cut in buckets of lines and meet by key and bucket, so a key with many ranges is no nested loop.
    `points` rows must be distinct by all columns, or repeats come back once for each copy, as they should.
    """
    rid = "_row"
    points = points.withColumn(rid, F.xxhash64(*[F.col(c) for c in points.columns]))
    cut = points.select(rid, *on, F.col(begin).alias("_b"), F.col(end).alias("_e"), F.explode(F.sequence(F.floor(F.col(begin) / bucket), F.floor(F.col(end) / bucket))).alias("_k")).distinct()
    spans = ranges.select(*on, F.col(r_begin).alias("_rb"), F.col(r_end).alias("_re")).distinct()
    spans = spans.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_rb") / bucket), F.floor(F.col("_re") / bucket))))
    hit = cut.join(spans, [*on, "_k"]).filter((F.col("_b") <= F.col("_re")) & (F.col("_e") >= F.col("_rb"))).select(rid).distinct()
    return points.join(hit, rid, "left_semi").drop(rid)


def nearest(left: DataFrame, right: DataFrame, on: list[str], at: str, value: Column, out: str, following: bool = False) -> DataFrame:
    """left with `out`: the value of the right row of the same key at the nearest `at` at or before (following: at or after).

    One sort of both sides together instead of a product: each left row takes the last value seen. Of right rows at one
    place the smallest value counts.
    """
    r = right.groupBy(*on, at).agg(F.min(value).alias(out))
    both = left.withColumn(out, F.lit(None).cast(r.schema[out].dataType)).withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = [F.col(at).desc() if following else F.col(at).asc(), F.col("_side").asc()]
    w = W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(out, F.last(out, ignorenulls=True).over(w)).filter("_side = 1").select(*left.columns, out)


def covered(points: DataFrame, ranges: DataFrame, on: list[str], begin: str, end: str, r_begin: str, r_end: str, out: str) -> DataFrame:
    """points with `out`: whether [begin, end] overlaps a range of the same `on` key, which must not be null.

    Of the ranges that begin no later than a point ends, that with the greatest end decides: one sort of both sides by key, which
    moves no row that is dealt out by the key already.
    """
    new = {c: f"_on{k}" for k, c in enumerate(on)}  # a union is seen to be dealt out by keys as its parts are only where they are renamed
    spans = ranges.filter(F.col(r_begin).isNotNull() & F.col(r_end).isNotNull()).select(*on, F.col(r_begin).cast("long").alias("_at"), F.col(r_end).cast("long").alias("_reach"), F.lit(0).alias("_side"))
    both = points.withColumn("_at", F.col(end).cast("long")).withColumn("_side", F.lit(1)).withColumnsRenamed(new).unionByName(spans.withColumnsRenamed(new), allowMissingColumns=True)
    w = W.partitionBy(*new.values()).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    hit = F.col(end).isNotNull() & F.coalesce(F.max("_reach").over(w) >= F.col(begin), F.lit(False))
    for c in new.values():
        hit &= F.col(c).isNotNull()
    return both.withColumn(out, hit).filter("_side = 1").select(*[F.col(new.get(c, c)).alias(c) for c in points.columns], out)


def bag_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Full outer join in which the k-th left row of a key meets the k-th right row, by `order`: the key, _k, and left and right
    flags. Every row is used once; one without a key meets none. Both sides meet in an aggregate by the whole key, so rows that are dealt out by a
    part of it stay where they are."""
    w = W.partitionBy(*on).orderBy(*order)
    alone = F.lit(False)
    for c in on:
        alone |= F.col(c).isNull()
    a = left.withColumn("_k", F.row_number().over(w)).withColumn("_left", F.lit(True)).withColumn("_s", F.when(alone, 1).otherwise(0))
    b = right.withColumn("_k", F.row_number().over(w)).select(*on, "_k", F.lit(True).alias("_right"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on], F.when(alone, 2).otherwise(0).alias("_s"))
    names = [c for c in dict.fromkeys([*a.columns, *b.columns]) if c not in (*on, "_k", "_s")]
    new = {c: f"_on{k}" for k, c in enumerate(on)}
    both = a.withColumnsRenamed(new).unionByName(b.withColumnsRenamed(new), allowMissingColumns=True).groupBy(*new.values(), "_k", "_s").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
    return both.select(*[F.col(v).alias(c) for c, v in new.items()], "_k", *names)


def tag(rows: DataFrame, text: str, rules: DataFrame, pattern: str = "pattern") -> DataFrame:
    """(row, rule) for every rule whose regular expression is found in the row's text.

    Rules are a dimension of bounded size, which is checked; each distinct text meets them once, then texts join back.
    """
    texts = rows.select(text).distinct()
    hits = texts.join(bounded(rules), F.expr(f"{text} RLIKE {pattern}"))
    return rows.join(hits, text)


def tag_prefix(rows: DataFrame, text: str, rules: DataFrame, prefix: str = "prefix") -> DataFrame:
    """(row, rule) for every rule whose prefix the row's text starts with; rules are a dimension, see tag."""
    texts = rows.select(text).distinct()
    hits = texts.join(bounded(rules), F.col(text).startswith(F.col(prefix)))
    return rows.join(hits, text)


def bounded(rules: DataFrame, most: int = 10_000) -> DataFrame:
    """rules, to be broadcast: their number is looked at first, and more than `most` are refused."""
    n = rules.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a dimension of over {most} rows is not broadcast")
    return F.broadcast(rules)


def tags(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Sorted names of the (name, pattern) rules that a path matches, as an array: the rule list in the plan itself."""
    return F.array_sort(F.filter(F.array(*[F.when(path.rlike(p), n) for n, p in rules]), lambda x: x.isNotNull()))


def cascade(left: DataFrame, right: DataFrame, levels: list[list[str]], value: str, out: str) -> DataFrame:
    """left with `out` and `level`: the right value under the first list of keys that fits; beyond the first level a key
    must be unique on the right."""
    found = []
    for k, keys in enumerate(levels):
        r = right.groupBy(*keys).agg(F.min(value).alias(f"_v{k}"), F.count(F.lit(1)).alias("_n"))
        left = left.join(r.filter("_n = 1").drop("_n") if k else r.drop("_n"), keys, "left")
        found.append(F.col(f"_v{k}"))
    level = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in enumerate(found)])
    return left.withColumn(out, F.coalesce(*found)).withColumn("level", level).drop(*[f"_v{k}" for k in range(len(levels))])


def matches_any(column: Column, patterns: list[str]) -> Column:
    return any_of(column.rlike(p) for p in patterns)


def label(score: Column, base: Column, threshold: Column, touched: Column) -> Column:
    """What a head score is, given the base score of the same method."""
    worse = F.when(score >= threshold, F.when(base >= threshold, "introduced-worsened").otherwise("introduced-crossed")).otherwise("pre-existing-touched")
    return F.when(score < base, "pre-existing-improved").when(score == base, F.when(touched, "pre-existing-touched").otherwise("pre-existing")).otherwise(worse)


def outer_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed or modified keys between two listings."""
    j = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return j.select(key, kind.alias("change")).filter("change IS NOT NULL")
