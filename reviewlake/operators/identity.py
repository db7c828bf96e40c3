"""Who is who: names, addresses and logins to people; who knows the code; who voted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def resolve(names: DataFrame, roster: DataFrame, aliases: DataFrame | None = None, domain: str = "@project.org") -> DataFrame:
    """names (name, email) with person and rule: the roster id in an address of the project, an alias of the normalised name, a
    name that is an id, a display name of the roster (the least id of several), else name:<normalised name>.

    roster: id, display; aliases: name (normalised), id. Each is a plain equi-join; Spark broadcasts what is small.
    """
    n = names.withColumn("_n", X.normalise_name(F.col("name"))).withColumn("_e", F.when(F.lower("email").endswith(domain), F.split_part(F.lower("email"), F.lit("@"), F.lit(1))))
    ids = roster.select(F.col("id").alias("_id")).distinct()
    n = n.join(ids.withColumnRenamed("_id", "_e").withColumn("by_email", F.col("_e")), "_e", "left")
    if aliases is not None:
        n = n.join(aliases.groupBy(F.col("name").alias("_n")).agg(F.min("id").alias("by_alias")), "_n", "left")
    else:
        n = n.withColumn("by_alias", F.lit(None).cast("string"))
    n = n.join(ids.withColumnRenamed("_id", "_n").withColumn("by_id", F.col("_n")), "_n", "left")
    shown = roster.groupBy(X.normalise_name(F.col("display")).alias("_n")).agg(F.min("id").alias("by_name"))
    n = n.join(shown, "_n", "left")
    rules = ("by_email", "by_alias", "by_id", "by_name")
    person = F.coalesce(*rules, F.concat(F.lit("name:"), F.col("_n")))
    rule = F.coalesce(*[F.when(F.col(r).isNotNull(), r) for r in rules], F.lit("unknown"))
    return n.withColumn("person", person).withColumn("rule", rule).drop("_n", "_e", *rules)


def decayed(age_years: Column, half_life: float = 2.0) -> Column:
    return F.pow(F.lit(0.5), age_years / half_life)


def experts(credits: DataFrame, today: str, window: float = 5.0, author: float = 1.0, reviewer: float = 0.6) -> DataFrame:
    """Per path and person: the decayed score (two digits), patches, reviews, latest. credits: path, person, role, day.
    Fixed values: five years of history, a half-life of two, a review worth 0.6 of a patch."""
    age = F.greatest(F.lit(0.0), F.datediff(F.lit(today).cast("date"), F.col("day")) / 365.25)
    c = credits.withColumn("_age", age).filter(F.col("_age") <= window)
    weight = F.when(F.col("role") == "author", author).otherwise(reviewer) * decayed(F.col("_age"))
    return c.groupBy("path", "person").agg(F.round(F.sum(weight), 2).alias("score"), F.count(F.when(F.col("role") == "author", 1)).alias("patches"), F.count(F.when(F.col("role") != "author", 1)).alias("reviews"), F.max("day").alias("latest"))


def expert_totals(per_file: DataFrame) -> DataFrame:
    """Per person over files: the sum of rounded file scores, all patches and reviews, and the files."""
    return per_file.groupBy("person").agg(F.round(F.sum("score"), 2).alias("score"), F.sum("patches").alias("patches"), F.sum("reviews").alias("reviews"), F.count(F.lit(1)).alias("files"), F.max("latest").alias("latest"))


def committers_of(voters: DataFrame, roster: DataFrame, overrides: DataFrame, emails: DataFrame, domain: str = "@project.org") -> DataFrame:
    """voters (source, who, association) with id and rule of those who are committers, nulls for others.

    By the overrides of the source first (source, who, id), as far as the id is on the roster. Then, on the tracker (source
    comment), a user name that is on the roster; on the forge (source review), an address of the project whose name is, the
    least of several, so that one person counts once on both; else membership of the organisation, as forge:<name>.
    """
    ids = roster.select(F.col("id").alias("_id")).distinct()
    listed = overrides.join(ids, F.col("id") == F.col("_id")).groupBy("source", "who").agg(F.min("id").alias("_listed"))
    local = F.split_part(F.lower("email"), F.lit("@"), F.lit(1))
    mail = emails.filter(F.lower("email").endswith(domain)).select(F.col("login").alias("who"), local.alias("_id")).join(ids, "_id").groupBy("who").agg(F.min("_id").alias("_mail"))
    v = voters.join(listed, ["source", "who"], "left").join(mail, "who", "left").join(ids.withColumn("who", F.col("_id")).withColumnRenamed("_id", "_direct"), "who", "left")
    tracker, member = F.col("source") == "comment", F.col("association").isin("MEMBER", "OWNER")
    found = {"override": F.col("_listed"), "user name": F.when(tracker, F.col("_direct")), "address": F.when(~tracker, F.col("_mail")), "membership": F.when(~tracker & member, F.concat(F.lit("forge:"), "who"))}
    rule = F.coalesce(*[F.when(c.isNotNull(), r) for r, c in found.items()])
    return v.withColumn("id", F.coalesce(*found.values())).withColumn("rule", rule).drop("_listed", "_mail", "_direct")


def votes(approvals: DataFrame, changes: DataFrame, involved: DataFrame, roster: DataFrame, overrides: DataFrame, emails: DataFrame) -> DataFrame:
    """Per change: counted (id, who, source, rule of each committer who approves, by id), others (who else does), author_vote (the
    author's id when a committer not counted yet).

    approvals: pr, seq, made, source, who, association, approved, body. A review counts when it approves, a tracker comment when
    it says +1 and isn't by an author or assignee of the ticket (involved: pr, who). Each committer counts once, by the first
    review, else the first comment. changes: pr, author, association.
    """
    yes = F.when(F.col("source") == "review", F.col("approved")).otherwise(X.plus_one(F.col("body")))
    v = approvals.filter(F.coalesce(yes, F.lit(False)))
    own = involved.select("pr", "who", F.lit("comment").alias("source")).distinct()
    v = committers_of(v.join(own, ["pr", "who", "source"], "left_anti"), roster, overrides, emails)
    first = F.struct((F.col("source") != "review").alias("late"), "made", "seq", "who", "source", "rule")
    each = v.filter("id IS NOT NULL").groupBy("pr", "id").agg(F.min(first).alias("f"))
    counted = each.groupBy("pr").agg(F.array_sort(F.collect_list(F.struct("id", "f.who", "f.source", "f.rule"))).alias("counted"))
    others = v.filter("id IS NULL").groupBy("pr").agg(F.array_sort(F.collect_set("who")).alias("others"))
    authors = committers_of(changes.select("pr", F.col("author").alias("who"), F.lit("review").alias("source"), "association"), roster, overrides, emails)
    out = authors.select("pr", F.col("id").alias("author_vote")).join(counted, "pr", "left").join(others, "pr", "left")
    none = F.array().cast("array<struct<id:string,who:string,source:string,rule:string>>")
    out = out.select("pr", F.coalesce("counted", none).alias("counted"), F.coalesce("others", F.array().cast("array<string>")).alias("others"), "author_vote")
    return out.withColumn("author_vote", F.when(~F.exists("counted", lambda c: c["id"] == F.col("author_vote")), F.col("author_vote")))


def related_tickets(blame: DataFrame, commits: DataFrame) -> DataFrame:
    """Per ticket (null: commits without a key): lines, files, commits and the last change of blamed lines; merges are left out.
    blame: sha, path, lines; commits: sha, key, day, merge."""
    j = blame.join(commits.filter(~F.coalesce("merge", F.lit(False))), "sha")
    return j.groupBy("key").agg(F.sum("lines").alias("lines"), F.count_distinct("path").alias("files"), F.count_distinct("sha").alias("commits"), F.max("day").alias("last_changed"))


def first_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_k = 1").drop("_k")
