"""Evidence tables to facts: one row per change with all that the requirement checks ask about."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .joins import tags
from .ranking import latest
from .selection import first_commit, perf_measured, perf_signals, perf_ticket, perf_words, scans

HOME = "^src/java/org/project/"
#: Compatibility surfaces by path, of a made-up project: defaults of our own, for which a caller gives the table of its project.
SURFACES = [
    ("config", r"^(conf/project[^/]*\.yaml|src/java/org/project/config/Config\.java)$"), ("native protocol", r"^(src/java/org/project/transport/|doc/native_protocol)"), ("CQL grammar", "^src/antlr/"), ("CQL semantics", f"{HOME}cql3/"), ("messaging", f"{HOME}net/"),
    ("sstable format", f"{HOME}io/table/"), ("commitlog / hints", f"{HOME}(db/commitlog|hints)/"), ("schema / system tables", f"{HOME}(schema/|db/SystemKeyspace)"), ("admin tool", f"{HOME}tools/admin/"), ("JMX", r"MBean\.java$"), ("metrics", f"{HOME}metrics/"),
    ("virtual tables", f"{HOME}db/virtual/"), ("guardrails", f"{HOME}db/guardrails/"), ("dependencies", r"^(\.build/(build-resolve|parent-pom-template|deps-template|build-deps-template)\.xml|lib/)"),
]
#: Production paths whose changes need upgrade tests, of the same project and for the same use.
SENSITIVE = [
    r"Serializ\w*\.java$", rf"{HOME}net/(MessagingService|Verb|Message)\.java$", rf"{HOME}io/table/format/[^/]*(Version|Format|Descriptor)[^/]*\.java$", rf"{HOME}io/table/(Descriptor|Component)\.java$", f"{HOME}io/table/metadata/",
    rf"{HOME}db/commitlog/CommitLogDescriptor\.java$", rf"{HOME}hints/HintsDescriptor\.java$", rf"{HOME}(schema/SchemaKeyspace|db/SystemKeyspace)[^/]*\.java$", rf"{HOME}transport/ProtocolVersion\.java$",
]
#: Words that point to a tool's help with a change, and branch prefixes that do.
AI_HINT = r"(?i)\b(claude|copilot|chatgpt|gpt-\d|codex|gemini|llm|ai[- ]generated|ai[- ]assisted)\b"
AI_BRANCH = r"(?i)^(claude|copilot|codex)/"


@dataclass(frozen=True)
class Project:
    """What the facts need to know of a project. The defaults are those of a made-up one."""

    name: str = X.PROJECT
    release: str = r"^(trunk|project-\d+\.\d+)$"
    branches: tuple[str, ...] = ("project-3.0", "project-3.11", "project-4.0", "project-4.1")
    serializer: str = r"implements\s+[^{]*\b(VersionedSerializer|VersionedAsymmetricSerializer|PartitionerDependentSerializer)\b"
    change_log: str = "CHANGES.txt"
    config: tuple[str, str, str] = ("conf/project.yaml", "conf/project_latest.yaml", "src/java/org/project/config/Config.java")
    admin: tuple[str, str] = ("src/java/org/project/tools/admin/", "test/resources/admin/help/")
    protected: tuple[str, ...] = ("src/gen-java/", "lib/")
    grammar: tuple[str, ...] = ("src/antlr/",)
    bench: str = "test/microbench/"
    source: str = "src/java/"
    licence: str = "Licensed to"
    surfaces: tuple[tuple[str, str], ...] = tuple(SURFACES)
    sensitive: tuple[str, ...] = tuple(SENSITIVE)


def sorted_set(condition: Column, value: Column) -> Column:
    return F.array_sort(F.collect_set(F.when(condition, value)))


def gathered(tables: list[DataFrame], key: str = "pr") -> DataFrame:
    """One row per key with the columns of all tables, null where a table lacks the key. Of a table's rows of one key, which are equal if there are several, one counts. Rows
    are dealt out by key together and sorted once, where joins would hold a sort of every table at the same time."""
    shapes = [[c for c in x.columns if c != key] for x in tables]
    row = [F.struct(*c) for c in shapes]
    kinds = [x.select(r.alias("s")).schema["s"].dataType for x, r in zip(tables, row, strict=True)]
    n = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a union is seen to be dealt out by a key as its parts are only where the key is renamed
    parts = [x.repartition(n, key).select(F.col(key).alias("_key"), *[row[k].alias(f"_{k}") if k == i else F.lit(None).cast(t).alias(f"_{k}") for k, t in enumerate(kinds)]) for i, x in enumerate(tables)]
    met = reduce(DataFrame.unionByName, parts).groupBy("_key").agg(*[F.first(f"_{k}", ignorenulls=True).alias(f"_{k}") for k in range(len(tables))])
    return met.select(F.col("_key").alias(key), *[F.col(f"_{k}")[c].alias(c) for k, names in enumerate(shapes) for c in names])


def asked_for(tables: list[DataFrame], wanted: set[str] | None, key: str = "pr") -> list[DataFrame]:
    """The tables with the wanted columns alone (none: all), without those that have none of them: an aggregate or a join that is
    gathered hides from the optimizer that nobody reads it."""
    if wanted is None:
        return tables
    cut = [(x, [c for c in x.columns if c in wanted and c != key]) for x in tables]
    return [x.select(key, *names) for x, names in cut if names]


def sensitive_path(path: Column, patterns: list[str] = SENSITIVE) -> Column:
    """Whether a path is a sensitive one of production."""
    return P.starts(path, ("src/java/",)) & P.any_of(path.rlike(p) for p in patterns)


def first_word(pattern: str) -> str | None:
    """The letters that each match of a pattern begins with, where it is plain from the pattern: whole letters before a class such as \\s, and no
    alternatives but in brackets."""
    m = re.match(r"([A-Za-z]{2,})\\[sbWw]", pattern)
    flat, before = pattern, None
    while flat != before:
        flat, before = re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", flat), flat
    return m[1] if m and "|" not in flat else None


def declaring_files(added: DataFrame, serializer: str = Project.serializer) -> DataFrame:
    """pr, path of production files whose added lines, together, match the pattern. Where each match begins with a word, only the lines of files
    with that word are gathered."""
    lines = added.filter(P.starts(F.col("path"), ("src/java/",)) & F.col("pr").isNotNull()).select("pr", "path", "line_no", "text")
    word = first_word(serializer)
    if word:
        lines = lines.withColumn("_has", F.max(F.col("text").contains(word)).over(W.partitionBy("pr", "path"))).filter("_has")
    whole = F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]))
    return lines.groupBy("pr", "path").agg(whole.alias("_text")).filter(F.col("_text").rlike(serializer)).select("pr", "path")


def sensitive_files(files: DataFrame, added: DataFrame, patterns: list[str] = SENSITIVE, serializer: str = Project.serializer) -> DataFrame:
    """pr, path of production files whose path is sensitive or whose added lines declare a serializer interface."""
    by_path = files.select("pr", "path").distinct().withColumn("_hit", sensitive_path(F.col("path"), patterns))
    return by_path.filter("_hit").select("pr", "path").unionByName(declaring_files(added, serializer)).distinct()


def only_tests(files: DataFrame) -> DataFrame:
    """pr, all_tests: whether a change touches tests alone."""
    return files.groupBy("pr").agg(F.bool_and(P.is_test(F.col("path"))).alias("all_tests"))


def file_facts(files: DataFrame, c: Project = Project()) -> DataFrame:
    """Per change, from its files in one shuffle."""
    p, n = F.col("path"), F.col("additions") + F.col("deletions")
    test_lines = P.is_test(p) & ~P.is_test_resource(p)
    yaml, recent, java = c.config
    return files.groupBy("pr").agg(
        F.coalesce(F.sum(F.when(P.is_prod(p), n)), F.lit(0)).alias("prod_lines"), F.coalesce(F.sum(F.when(test_lines, n)), F.lit(0)).alias("test_lines"), F.array_sort(F.collect_set(P.test_suite(p))).alias("suites"), F.bool_and(P.is_test(p)).alias("all_tests"), F.bool_or(P.is_prod(p)).alias("has_prod"),
        sorted_set(P.starts(p, c.protected), p).alias("protected"), sorted_set(P.starts(p, c.grammar), p).alias("grammar"), F.bool_or(p == yaml).alias("config_yaml"), F.bool_or(p == recent).alias("config_latest"), F.bool_or(p == java).alias("config_java"),
        sorted_set(p.startswith(c.admin[0]), p).alias("admin_files"), F.count(F.when(p.startswith(c.admin[1]), 1)).alias("admin_help"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(tags(p, list(c.surfaces)))))).alias("surfaces"), F.bool_or(p.startswith(c.bench)).alias("bench_files"),
    )


#: What line_facts and commit_facts give.
LINE_FACTS = ("log_lines", "log_entries", "banned", "deprecated", "properties", "unlicensed")
COMMIT_FACTS = ("commits", "bad_messages", "trailers", "helped", "bench_first", "source_first")


def line_facts(added: DataFrame, banned: list[tuple[str, str]], c: Project = Project()) -> list[DataFrame]:
    """Tables per change, to be gathered, from its added lines: change-log entries, banned, deprecated, property and licence findings as
    place lists."""
    entry = (F.col("path") == c.change_log) & F.col("text").rlike(rf"^ \* .+\((?:{c.name}-\d+(?:,\s*)?)+\)\s*$")
    log = added.groupBy("pr").agg(F.count(F.when(F.col("path") == c.change_log, 1)).alias("log_lines"), F.array_sort(F.collect_list(F.when(entry, F.col("text")))).alias("log_entries"))
    return [log, *[found.groupBy("pr").agg(F.array_sort(F.collect_list("place")).alias(name)) for name, found in scans(added, banned, c.licence).items()]]


def ticket_facts(keyed: DataFrame, tickets: DataFrame, c: Project = Project()) -> DataFrame:
    """pr with its ticket's lookup (found, not found, unavailable; null without a key), status, fix versions and the branches these map to, and what it says
    of performance (_strong, _medium). keyed: pr, key."""
    t = tickets.select("key", "reached", F.col("status").alias("_status"), "fix_versions", "label", "component", "summary", "assignee", *[x.alias(n) for n, x in zip(("_labelled", "_part", "_titled"), perf_ticket(F.array("label"), F.array("component"), F.col("summary")), strict=True)])
    found = F.col("reached")
    versions = F.filter(F.split("fix_versions", ","), lambda v: v != "")
    mapped = F.array_sort(F.array_distinct(F.filter(F.transform(versions, lambda v: X.version_branch(v, list(c.branches))), lambda b: b.isNotNull())))
    j = on_ticket(keyed.select("pr", "key"), t)
    j = j.withColumn("lookup", F.when(F.col("key").isNull(), None).when(found.isNull(), "not found").when(found, "found").otherwise("unavailable"))
    ok = F.col("lookup") == "found"
    j = j.withColumn("ticket_status", F.when(ok, F.col("_status"))).withColumn("versions", F.when(ok, versions)).withColumn("wanted", F.when(ok, mapped))
    return j.drop("key", "reached", "_status", "fix_versions")


def on_ticket(keyed: DataFrame, *tables: DataFrame) -> DataFrame:
    """keyed with the columns of tables of one row a key; changes without a key, of which there may be many, are not dealt out by it."""
    with_key = keyed.filter(F.col("key").isNotNull())
    return reduce(lambda a, b: a.join(b, "key", "left"), tables, with_key).unionByName(keyed.filter(F.col("key").isNull()), allowMissingColumns=True)


def branch_facts(keyed: DataFrame, runs: DataFrame) -> DataFrame:
    """A table per change, to be gathered: targets (its own branch and those of open siblings), and of these the branches without CI, with CI of another
    commit, of an unknown commit, without upgrade tests, with failures (and their sum) or without a count.

    runs: key, target_branch, seq, created, sha, failed, upgrade, parsed; the newest readable run per ticket and branch counts. A ticket's newest runs, and
    its first open change on each branch, are one row a ticket, of as many elements as there are branches; changes meet that row alone.
    """
    c = keyed.select("pr", "key", "base", "state", "head")
    usable = runs.filter(F.col("parsed") & F.col("target_branch").isNotNull())
    last = latest(usable, ["key", "target_branch"], "created", "seq").groupBy("key").agg(F.collect_list(F.struct(F.col("target_branch").alias("base"), "sha", "failed", "upgrade")).alias("_runs"))
    first = c.filter(F.col("key").isNotNull() & (F.col("state") == "O")).groupBy("key", "base").agg(F.min(F.struct("pr", "head"))["head"].alias("want"))
    opened = first.groupBy("key").agg(F.collect_list(F.struct("base", "want")).alias("_opened"))
    j = on_ticket(c.drop("state"), opened, last)
    own = F.array(F.struct("base", F.col("head").alias("want")))
    others = F.filter("_opened", lambda x: x["base"] != F.col("base"))
    j = j.select("pr", "_runs", F.concat(own, F.coalesce(others, F.array().cast("array<struct<base:string,want:string>>"))).alias("_to"))
    of = lambda x: F.try_element_at(F.filter("_runs", lambda r: r["base"] == x["base"]), F.lit(1))
    j = j.withColumn("_met", F.transform("_to", lambda x: F.struct(x["base"].alias("base"), x["want"].alias("want"), of(x).alias("run"))))
    bases = lambda of, keep: F.array_sort(F.array_distinct(F.transform(F.filter(of, lambda x: x["base"].isNotNull() & keep(x)), lambda x: x["base"])))
    failed = F.transform(F.filter("_runs", lambda r: r["failed"].isNotNull()), lambda r: r["failed"].cast("long"))
    return j.select(
        "pr", bases("_met", lambda x: F.lit(True)).alias("targets"), bases("_met", lambda x: x["run"].isNull()).alias("no_ci"), bases("_met", lambda x: x["run"].isNotNull() & x["run"]["sha"].isNull()).alias("unknown_sha"), bases("_met", lambda x: x["run"]["sha"] != x["want"]).alias("stale"),
        F.size(F.filter("_met", lambda x: x["run"].isNotNull())).cast("long").alias("compared"), bases("_runs", lambda r: F.lit(True)).alias("ci_branches"), bases("_runs", lambda r: ~r["upgrade"]).alias("no_upgrade"),
        F.aggregate(failed, F.lit(0).cast("long"), lambda a, b: a + b).alias("ci_failed"), bases("_runs", lambda r: r["failed"].isNull()).alias("uncounted"),
    )


def commit_facts(keyed: DataFrame, commits: DataFrame, c: Project = Project()) -> list[DataFrame]:
    """Tables per change, to be gathered: commits, those with a problem in their message, trailers, signs of a tool's help, and the index of the first commit
    that touches benchmarks and sources. commits: pr, idx, message, paths."""
    rx = rf"(?im)^patch by .+?[;,]\s*reviewed by .+? for ({c.name}-\d+)"
    named = F.upper(F.regexp_extract("message", rx, 1))
    subject = F.split_part("message", F.lit("\n"), F.lit(1))
    x = commits.join(keyed.select("pr", "key"), "pr", "left")
    bad = (named == "") | F.coalesce((named != F.col("key")) | F.lower(subject).contains(F.lower("key")), F.lit(False))
    trailers = X.trailers(F.col("message"))
    helped = F.exists(trailers, lambda t: t["name"].isin("assisted-by", "generated-by") | ((t["name"] == "co-authored-by") & t["value"].rlike(AI_HINT)))
    per = x.groupBy("pr").agg(F.count(F.lit(1)).alias("commits"), F.count(F.when(bad, 1)).alias("bad_messages"), F.sum(F.size(trailers)).alias("trailers"), F.bool_or(helped).alias("helped"))
    return [per, first_commit(commits.withColumn("subject", subject), {"bench_first": c.bench, "source_first": c.source})]


def all_facts(
    changes: DataFrame, tickets: DataFrame, files: DataFrame, added: DataFrame, runs: DataFrame, commits: DataFrame, builds: DataFrame, static: DataFrame, introduced: list[DataFrame], voted: DataFrame, banned: list[tuple[str, str]], c: Project = Project(), wanted: set[str] | None = None
) -> DataFrame:
    """One row per change. changes: pr, draft, base, head, title, branch, body, state; static: pr, status, expected and of
    each tool (style, rules, copies) its status and analyzed files, catalog, types; introduced: tables by pr of what analysis found new, see
    module introduced; voted: see identity.votes. What is known of a change is gathered in one sort, and the changes are joined
    with that. wanted: names of the facts that are read; nothing is grouped or joined for others."""
    none = F.array().cast("array<string>")
    k = changes.withColumn("_k", X.key_struct(F.col("title"), F.col("branch"), F.col("body"), none, c.name))
    # what is read of long texts is read before rows move
    hints = F.filter(F.array(F.when(F.col("branch").rlike(AI_BRANCH), "branch name"), F.when(F.col("body").rlike(AI_HINT), "description")), lambda x: x.isNotNull())
    words, measured = perf_words(F.col("title")), perf_measured(F.col("body"))
    keyed = k.select(*changes.columns, F.col("_k.key").alias("key"), F.col("_k.sources").alias("sources"), F.col("_k.conflicts").alias("conflicts"), hints.alias("hints"), words.alias("_words"), measured.alias("_measured"), F.col("base").rlike(c.release).alias("release"))
    if wanted is not None and wanted & {"strong", "medium"}:
        wanted = {*wanted, "_labelled", "_part", "_titled", *(["bench_files"] if "strong" in wanted else [])}
    build = builds.withColumnRenamed("head", "_build_head").withColumnRenamed("status", "build")
    if wanted is not None and "build" in wanted:
        wanted = {*wanted, "_build_head"}
    style = static.withColumnRenamed("status", "static")
    sens = sensitive_files(files, added, list(c.sensitive), c.serializer).groupBy("pr").agg(F.array_sort(F.collect_set("path")).alias("sensitive"))
    vote = voted.select("pr", "counted", "others", "author_vote")
    grouped = asked_for([file_facts(files, c), *line_facts(added, banned, c), branch_facts(keyed, runs), ticket_facts(keyed, tickets, c), *commit_facts(keyed, commits, c), *introduced, sens, build, style, vote], wanted)
    f = keyed.join(gathered(grouped), "pr", "left") if grouped else keyed
    if wanted is None or wanted & {"strong", "medium"}:
        bench = F.col("bench_files") if "bench_files" in f.columns else F.lit(None).cast("boolean")
        strong, medium = perf_signals(bench, F.col("_labelled"), F.col("_part"), F.col("_words") | F.coalesce("_titled", F.lit(False)), F.col("_measured"))
        f = f.withColumn("strong", strong).withColumn("medium", medium)
    if "build" not in f.columns:
        return f
    ours = F.col("_build_head").eqNullSafe(F.col("head")) & (F.col("build") != "not-built")
    return f.withColumn("build", F.when(ours, F.col("build")))
