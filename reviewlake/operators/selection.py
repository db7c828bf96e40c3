"""What to look at and what to run: review categories, tests, scenarios, line scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.paths import any_of
from .checks import by_change
from .joins import bounded
from .ranking import top_k


def signal_patterns(index: DataFrame, text: str = "text") -> DataFrame:
    """category, pattern: signals in back-ticks of the bullet lists under each heading of a markdown index.

    Identifiers of four characters or more match as words, with a final star as prefixes; a phrase counts when exactly one
    of its identifiers has five characters or more.
    """
    w = W.partitionBy("doc").orderBy("pos")
    x = index.select("doc", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    x = x.withColumn("category", F.last(F.when(F.col("line").startswith("## "), F.trim(F.expr("substring(line, 4)"))), ignorenulls=True).over(w))
    opens = F.when(F.lower("line").startswith("**diff signals"), F.lit(True)).when(F.col("line").startswith("## ") | ~F.col("line").rlike(r"^(-| |\s*$)"), F.lit(False))
    x = x.withColumn("on", F.last(opens, ignorenulls=True).over(w)).filter(F.col("on") & F.col("line").startswith("- ") & F.col("category").isNotNull())
    t = x.select("category", F.explode(F.regexp_extract_all("line", F.lit("`([^`]+)`"), F.lit(1))).alias("raw")).withColumn("t", F.regexp_replace(F.regexp_replace(F.trim("raw"), r"[()]+$", ""), r"\.$", ""))
    word = F.col("t").rlike(r"^[A-Za-z_][\w.]*\*?$")
    bare = F.regexp_replace("t", r"\*$", "")
    longs = F.filter(F.regexp_extract_all("t", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda i: F.length(i) >= 5)
    esc = F.replace(F.when(word, bare).otherwise(F.try_element_at(longs, F.lit(1))), F.lit("."), F.lit("\\."))
    tail = F.when(word & F.col("t").endswith("*"), r"\w*").otherwise(r"\b")
    ok = (word & (F.length("t") >= 4)) | (~word & (F.size(longs) == 1))
    return t.filter(ok).select("category", F.concat(F.lit(r"\b"), esc, tail).alias("pattern")).distinct()


#: A word's edge where words are of \w, as in other engines: Java's \b counts letters beyond ASCII too, though its \w doesn't.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def with_ascii_edges(pattern: Column) -> Column:
    """pattern with EDGE for each \b in it."""
    return F.regexp_replace(pattern, r"(?<!\\)((?:\\\\)*)\\b", "$1" + EDGE.replace("\\", "\\\\"))


def categories(texts: DataFrame, patterns: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """id, category, score, rank: distinct patterns found in each text, at least `least`, the best `most` per text. The patterns are
    a dimension of bounded size, which is checked; see with_ascii_edges."""
    exact = patterns.withColumn("_edged", with_ascii_edges(F.col("pattern")))
    hits = texts.join(bounded(exact), F.expr("text RLIKE _edged")).groupBy("id", "category").agg(F.count_distinct("pattern").alias("score"))
    return top_k(hits.filter(F.col("score") >= least), ["id"], [F.col("score").desc(), F.col("category").asc()], most)


def references(tests: DataFrame, classes: DataFrame) -> DataFrame:
    """test, cls, refs: how often each test names each changed class as a word. Tests are cut in words once and meet the classes by
    equality; class names of three letters or fewer are ignored."""
    words = tests.select("test", F.explode(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1))).alias("cls")).groupBy("test", "cls").agg(F.count(F.lit(1)).alias("refs"))
    return words.join(classes.filter(F.length("cls") > 3).select("cls").distinct(), "cls").select("test", "cls", "refs")


def without_hubs(refs: DataFrame, n_tests: int, share: float = 0.08) -> DataFrame:
    """refs without classes that over `share` of all tests name."""
    hubs = refs.groupBy("cls").agg(F.count_distinct("test").alias("n")).filter(F.col("n") > share * max(1, n_tests)).select("cls")
    return refs.join(hubs, "cls", "left_anti")


#: What an abstract base of tests hasn't.
RUNS = r"@Test|extends CQLTester|@RunWith"
EXTENDS = r"\b(?:class|interface|enum)\s+(\w+)[^{;]*?\b(?:extends|implements)\s+([^{]+)\{"


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle: what is cut out of texts is many times what Spark takes their size to be, so it would be broadcast through the driver."""
    return df.hint("merge")


def subtypes(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """(pr, sub): classes that extend or implement a class that the change pr changes and that it doesn't change itself, one hop. Type
    parameters are no supertypes. sources: text; classes: pr, cls."""
    e = sources.select(F.explode(F.regexp_extract_all("text", F.lit(EXTENDS), F.lit(0))).alias("m"))
    above = F.regexp_extract_all(F.regexp_replace(F.regexp_extract("m", EXTENDS, 2), "<[^>]*>", ""), F.lit(r"(\w+)"), F.lit(1))
    hop = e.select(F.regexp_extract("m", EXTENDS, 1).alias("sub"), F.explode(above).alias("cls")).distinct()
    c = classes.select("pr", "cls")  # repeats go with the pairs below; a set of all changed classes would fill a task's memory
    return hop.join(dealt(c), "cls").select("pr", "sub").distinct().join(dealt(c.withColumnRenamed("cls", "sub")), ["pr", "sub"], "left_anti")


def counted_tokens(tests: DataFrame, pattern: str, out: str) -> DataFrame:
    """(test, out, n): how often each test's text has each match of the pattern's group."""
    return tests.select("test", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias(out)).groupBy("test", out).agg(F.count(F.lit(1)).alias("n"))


def named_first(rows: DataFrame, name: str, each: int, most: int, order: int, says: str) -> DataFrame:
    """pr, test, points (`each` a hit, `most` at most) and the reason: the three names hit most."""
    worst = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(name).alias("name")))), 1, 3)
    g = rows.groupBy("pr", "test").agg(F.sum("n").alias("hits"), worst.alias("w"))
    return g.select("pr", "test", F.least(F.lit(most), each * F.col("hits")).cast("long").alias("points"), F.lit(order).alias("k"), F.concat(F.lit(says), F.array_join(F.transform("w", lambda x: x["name"]), ",")).alias("reason"))


def scored_tests(tests: DataFrame, classes: DataFrame, methods: DataFrame, subs: DataFrame, changed: DataFrame, least: int = 15, cap: int = 25, cap_own: int = 30, most_methods: int = 60, hub_share: float = 0.08) -> DataFrame:
    """(pr, test, score, reasons, rank) of the tests worth running for each change, the best `cap` by score and name, `cap_own` for a change
    that brings tests.

    Points: 1000 for tests of the change, 500 for a class's own test, 15 for its name as a prefix; two for each mention of a changed class
    up to 30, but not of names of three letters or fewer or of hubs, that over `hub_share` of all tests mention; where there is such a
    mention, five for each call of a changed method up to 30, unless the change has `most_methods` methods or more; one for each mention of
    a subtype up to 15. Tests that run nothing themselves go. reasons say what gave points, in that order.

    tests: test (a path), text; classes: pr, cls; methods: pr, method; subs: pr, sub; changed: pr, test. Texts are cut in tokens once,
    for all changes; changes meet tests where a token is equal, never as a product.
    """
    name = F.regexp_extract("test", r"([^/]+?)(?:\.java)?$", 1)
    runs = tests.filter(F.col("text").rlike(RUNS)).select("test", name.alias("name"))
    c = classes.select("pr", "cls").distinct()
    words = counted_tokens(tests, r"(\w+)", "word")
    hubs = words.groupBy("word").agg(F.count(F.lit(1)).alias("tests")).join(tests.agg(F.count(F.lit(1)).alias("_all"))).filter(F.col("tests") > hub_share * F.col("_all")).select("word")  # one row to each
    refs = c.filter(F.length("cls") > 3).join(dealt(words.join(hubs, "word", "left_anti").withColumnRenamed("word", "cls")), "cls")
    own = changed.select("pr", "test").distinct()
    some = methods.select("pr", "method").distinct()
    few = some.groupBy("pr").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") < most_methods).select("pr")
    # mentions first: a method that many tests call would meet each change of it with all these tests
    calls = refs.select("pr", "test").distinct().join(dealt(some.join(dealt(few), "pr")), "pr").join(dealt(counted_tokens(tests, r"[.\s](\w+)\s*\(", "method")), ["test", "method"])
    called = calls.groupBy("pr", "test").agg(F.sum("n").alias("h")).select("pr", "test", F.least(F.lit(30), 5 * F.col("h")).cast("long").alias("points"), F.lit(4).alias("k"), F.concat(F.lit("calls changed methods: "), F.col("h").cast("string")).alias("reason"))
    stems = F.filter(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda i: F.when(F.substring("name", i + 1, F.length("name")).rlike(r"^[A-Z]\w*Test$"), F.substring("name", F.lit(1), i))), lambda x: x.isNotNull())
    prefix = runs.filter(F.length("name") > 1).select("test", F.explode(stems).alias("cls")).join(dealt(c), "cls")
    exact = runs.filter(F.col("name").endswith("Test")).withColumn("cls", F.expr("substring(name, 1, length(name) - 4)")).join(dealt(c), "cls")
    row = lambda df, points, k, reason: df.select("pr", "test", F.lit(points).cast("long").alias("points"), F.lit(k).alias("k"), reason.alias("reason"))
    signals = [
        row(own, 1000, 1, F.lit("changed")), row(exact, 500, 2, F.concat(F.lit("own test of "), "cls")), row(prefix, 15, 2, F.concat(F.lit("name begins with "), "cls")), named_first(refs, "cls", 2, 30, 3, "mentions "), called,
        named_first(subs.select("pr", "sub").distinct().join(dealt(words.withColumnRenamed("word", "sub")), "sub"), "sub", 1, 15, 5, "mentions subtype "),
    ]
    s = reduce(DataFrame.unionByName, signals).groupBy("pr", "test").agg(F.sum("points").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("k", "reason"))), lambda x: x["reason"]).alias("reasons"))
    s = s.filter(F.col("score") >= least).join(dealt(runs.select("test")), "test", "left_semi")
    best = top_k(s, ["pr"], [F.col("score").desc(), F.col("test").asc()], max(cap, cap_own))
    return best.join(dealt(own.select("pr", F.lit(True).alias("_own")).distinct()), "pr", "left").filter(F.col("rank") <= F.when(F.col("_own"), cap_own).otherwise(cap)).drop("_own")


def scenarios(files: DataFrame, rules: list[dict], most: int = 3) -> DataFrame:
    """pr, scenario, priority, lines, files, rank: rules that cover enough changed lines; a change that none covers gets the smoke
    scenario. A rule fits a file by one of prefixes, a pattern, being sensitive, or one of its surfaces, where the change's text has a
    word of keywords, if there are such, and none of exclude. Files are dealt out by change once: a rule's lines are a window there,
    and each file has a row of its own beside its hits, for changes that no rule covers.

    files: pr, path, lines, title (text of the change), and, where rules ask for them, sensitive (boolean) and surfaces (array).
    rules: id, scenario, priority, min_lines, and any of prefixes, pattern, sensitive, surfaces, keywords, exclude.
    """
    hits = None
    for r in rules:
        hit = any_of(F.col("path").startswith(p) for p in r.get("prefixes") or ())
        if r.get("pattern"):
            hit |= F.col("path").rlike(r["pattern"])
        if r.get("sensitive"):
            hit |= F.coalesce("sensitive", F.lit(False))
        if r.get("surfaces"):
            hit |= F.coalesce(F.arrays_overlap("surfaces", F.array(*[F.lit(x) for x in r["surfaces"]])), F.lit(False))
        if r.get("keywords"):
            hit &= F.coalesce(F.col("title").rlike(f"(?i){r['keywords']}"), F.lit(False))
        if r.get("exclude"):
            hit &= ~F.coalesce(F.col("title").rlike(f"(?i){r['exclude']}"), F.lit(False))
        flag = F.when(hit, F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["scenario"]).alias("scenario"), F.lit(r["priority"]).alias("priority"), F.lit(r["min_lines"]).alias("min_lines")))
        hits = [*(hits or []), flag]
    smoke = F.struct(F.lit(None).cast("string").alias("rule"), F.lit("smoke").alias("scenario"), F.lit(0).alias("priority"), F.lit(0).alias("min_lines"))  # a row of each file
    x = files.repartition("pr").select("pr", "path", "lines", F.explode(F.filter(F.array(*(hits or []), smoke), lambda h: h.isNotNull())).alias("h")).select("pr", "path", "lines", "h.*")
    covered, own = F.sum("lines").over(W.partitionBy("pr", "rule")), F.col("rule").isNull()
    x = x.withColumn("_covered", covered).filter(own | (F.col("_covered") >= F.col("min_lines"))).withColumn("_own", own)
    lines, n = F.when(F.col("_own"), F.sum("lines")).otherwise(F.max("lines")), F.when(F.col("_own"), F.count(F.lit(1))).otherwise(F.lit(1))
    per_file = x.groupBy("pr", "_own", "scenario", "path").agg(lines.alias("lines"), n.alias("n"), F.max("priority").alias("priority"))
    s = per_file.groupBy("pr", "_own", "scenario").agg(F.max("priority").alias("priority"), F.sum("lines").alias("lines"), F.sum("n").alias("files"))
    s = s.withColumn("_none", F.min("_own").over(W.partitionBy("pr"))).filter(~F.col("_own") | F.col("_none")).drop("_own", "_none")
    return top_k(s, ["pr"], [F.col("priority").desc(), F.col("lines").desc(), F.col("scenario").asc()], most)


DEPENDENCIES = r"^(lib/|\.build/(build-resolve|parent-pom-template|deps-template|build-deps-template)\.xml)"


def ineligible_changes(files: DataFrame, most: int, home: str = "src/java/") -> DataFrame:
    """pr, reason: why a change gets no plan: documents only; without server code, tests, dependencies, build or generated files only;
    or too many server files; else null. files: pr, path."""
    p = F.col("path")
    server = p.startswith(home) & ~P.is_test(p) & P.counted(p, F.lit(False))
    k = files.groupBy("pr").agg(F.bool_and(P.is_doc(p)).alias("d"), F.bool_and(P.is_test(p) | P.is_test_resource(p)).alias("t"), F.bool_and(p.rlike(DEPENDENCIES)).alias("l"), F.bool_and(P.is_build(p)).alias("b"), F.bool_and(P.is_generated(p)).alias("g"), F.count_distinct(F.when(server, p)).alias("n"))
    without = F.when(F.col("t"), "tests only").when(F.col("l"), "dependencies only").when(F.col("b"), "build only").when(F.col("g"), "generated files only").otherwise("no server code")
    return k.select("pr", F.when(F.col("d"), "documents only").when(F.col("n") == 0, without).when(F.col("n") > most, "too many files").alias("reason"))


def banned_lines(lines: DataFrame, rules: list[tuple[str, str]], permit: str = "permit") -> DataFrame:
    """by, path, line_no, rule: the first rule that each added line breaks; comments, and lines with a permit on them or the added line
    before, are let through. lines: by, path, line_no, text."""
    w = W.partitionBy("by", "path").orderBy("line_no")
    ok = F.col("text").contains(permit) | F.coalesce(F.lag("text").over(w).contains(permit), F.lit(False)) | F.col("text").rlike(r"^\s*(//|\*|/\*)")
    x = lines.withColumn("_ok", ok).withColumn("rule", F.coalesce(*[F.when(F.col("text").rlike(p), n) for n, p in rules]))
    return x.filter(~F.col("_ok") & F.col("rule").isNotNull()).select("by", "path", "line_no", "rule")


COMMENT = r"^\s*(//|\*|/\*)"
#: Reads of system properties, and a deprecation mark that doesn't say since when.
PROPERTY = r"System\.(getProperty|setProperty|getenv)\s*\(|\b(Integer\.getInteger|Long\.getLong|Boolean\.getBoolean)\s*\("
DEPRECATED = r"@Deprecated\b(?!\s*\([^)]*since)"


def direct_properties(lines: DataFrame, own: str = "RelevantProperties.java") -> DataFrame:
    """by, path, line_no of added production lines that read a system property directly, outside the file made for it."""
    code = F.col("path").startswith("src/java/") & ~F.col("path").endswith(own)
    return lines.filter(code & F.col("text").rlike(PROPERTY) & ~F.col("text").rlike(COMMENT)).select("by", "path", "line_no")


def bare_deprecations(lines: DataFrame) -> DataFrame:
    """by, path, line_no of added Java lines that deprecate without saying since when."""
    return lines.filter(F.col("path").endswith(".java") & F.col("text").rlike(DEPRECATED) & ~F.col("text").rlike(COMMENT)).select("by", "path", "line_no")


def scans(added: DataFrame, banned: list[tuple[str, str]], licence: str) -> dict[str, DataFrame]:
    """All scans of added lines (pr, path, line_no, text, new_file), each as pr and place."""
    x = added.withColumnRenamed("pr", "by")
    place = F.concat_ws(":", "path", F.col("line_no").cast("string"))
    production = x.filter(F.col("path").startswith("src/java/") & F.col("path").endswith(".java"))
    found = {"banned": banned_lines(production, banned).withColumn("place", F.concat_ws(" ", place, "rule")), "deprecated": bare_deprecations(x).withColumn("place", place), "properties": direct_properties(x).withColumn("place", place), "unlicensed": unlicensed(x, licence).withColumn("place", F.col("path"))}
    return {k: v.select(F.col("by").alias("pr"), "place") for k, v in found.items()}


def unlicensed(lines: DataFrame, marker: str, within: int = 30, kinds: tuple[str, ...] = (".java", ".py", ".sh", ".xml", ".g"), never: str = "test/resources/") -> DataFrame:
    """by, path of new source files whose first `within` added lines lack the marker."""
    w = W.partitionBy("by", "path").orderBy("line_no")
    head = lines.filter(F.col("new_file") & _any_end(kinds) & ~F.col("path").startswith(never)).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= within)
    return head.groupBy("by", "path").agg(F.bool_or(F.col("text").contains(marker)).alias("_has")).filter("NOT _has").select("by", "path")


def _any_end(kinds: tuple[str, ...]) -> Column:
    return F.col("path").rlike("(" + "|".join(k.replace(".", r"\.") for k in kinds) + ")$")


def first_commit(commits: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """pr and for each kind the index of the first commit that touches a path with its prefix; fix-ups are ignored unless all are.
    commits: pr, idx, subject, paths."""
    fix = F.col("subject").rlike("^(fixup|squash)!")
    all_fix = F.bool_and(fix).over(W.partitionBy("pr"))
    x = commits.withColumn("_use", ~fix | all_fix).filter("_use")
    return x.groupBy("pr").agg(*[F.min(F.when(F.size(F.filter("paths", _starts(pre))) > 0, F.col("idx"))).alias(k) for k, pre in kinds.items()])


def _starts(prefix: str):
    return lambda p: p.startswith(prefix)


#: Words of changes about performance.
PERFORMANCE = r"(?i)\b(perf(ormance)?|faster|speed.?up|latency|throughput|allocation|megamorphic|avoid (an )?(extra )?cop(y|ies)|copy-on-write|optimi[sz]e|reduce (overhead|allocation))"


def perf_words(text: Column) -> Column:
    """Whether a title or summary has a word about performance."""
    return F.coalesce(text.rlike(PERFORMANCE), F.lit(False))


def perf_measured(body: Column) -> Column:
    """Whether a description mentions benchmarks."""
    return body.rlike(r"(?i)\b(jmh|benchmark)")


def perf_ticket(labels: Column, components: Column, summary: Column) -> tuple[Column, Column, Column]:
    """Whether a ticket is about performance by its label, its component and its summary."""
    return F.array_contains(F.transform(labels, lambda x: F.lower(x)), "performance"), F.array_contains(components, "Test/benchmark"), perf_words(summary)


def perf_signals(bench: Column, labelled: Column, part: Column, words: Column, measured: Column) -> tuple[Column, Column]:
    """(strong, medium) signals that a change is about performance, as arrays of names: a benchmark file, the ticket's label or
    component; a word in the title or the ticket's summary, a mention of benchmarks in the description."""
    keep = lambda a: F.filter(a, lambda x: x.isNotNull())
    return keep(F.array(F.when(bench, "benchmark file"), F.when(labelled, "label"), F.when(part, "component"))), keep(F.array(F.when(words, "title"), F.when(measured, "body")))


def status_word(status: Column, action_required: Column) -> Column:
    return F.when(status == "fail", "Must fix").when((status == "warn") & action_required, "Should fix").when(status == "warn", "Note").when(status == "pass", "Passed").when(status == "not-applicable", "Not needed").otherwise("Unknown")


def todo(results: DataFrame, findings: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """pr, source, item, owner, must, phase: open checks and must-fix findings of each change, one item per need; see todo_lists."""
    return todo_lists(results, findings, pairs).select("pr", F.explode("items").alias("i")).select("pr", "i.*")


def todo_lists(results: DataFrame, findings: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """pr, checks, items: of each change its open checks and must-fix findings, one item per need, in one row.

    A finding that asks for what a failing contributor check asks for (section and pattern in pairs) takes that check's item.
    What the contributor has to fix is now; without such items the first role that must act is.
    results: see checks.by_change; findings: pr, id, severity, text.
    """
    row = "array<struct<source:string,item:string,owner:string,must:boolean,fix:boolean>>"
    wanted = findings.filter(F.col("severity").isin("blocker", "major"))
    sections = F.filter(F.array(*[F.when(F.col("text").rlike(p), s) for s, p in pairs]), lambda s: s.isNotNull())
    found = F.struct(F.lit("finding").alias("source"), F.col("id").cast("string").alias("item"), F.lit("contributor").alias("owner"), F.lit(True).alias("must"), F.lit(True).alias("fix"))
    asks = wanted.groupBy("pr").agg(F.array_distinct(F.flatten(F.collect_set(sections))).alias("_taken"), F.collect_list(found).alias("_found"))

    def open_item(c: Column) -> Column:
        must = c["blocking"] & c["status"].isin("fail", "unknown")
        return F.struct(F.lit("check").alias("source"), c["check_id"].alias("item"), c["owner"].alias("owner"), must.alias("must"), ((c["owner"] == "contributor") & c["status"].isin("fail", "warn")).alias("fix"))

    taken = lambda x: F.coalesce(F.array_contains("_taken", F.split_part(x["item"], F.lit("."), F.lit(1))), F.lit(False)) & x["must"] & x["fix"]
    role = lambda x: F.coalesce(*[F.when(x["owner"] == r, k) for k, r in enumerate(("contributor", "committer", "reviewer"))], F.lit(3))
    j = by_change(results).select("pr", "checks").join(asks, "pr", "full_outer")
    j = j.withColumn("_open", F.transform(F.filter("checks", lambda c: c["status"].isin("fail", "warn", "unknown")), open_item).cast(row))
    j = j.withColumn("_all", F.concat(F.coalesce(F.filter("_open", lambda x: ~taken(x)), F.array().cast(row)), F.coalesce(F.col("_found").cast(row), F.array().cast(row))))
    j = j.withColumn("_fixes", F.exists("_all", lambda x: F.coalesce(x["fix"] & x["must"], F.lit(False)))).withColumn("_first", F.array_min(F.transform(F.filter("_all", lambda x: x["must"]), role)))
    now = lambda x: F.coalesce(F.when(F.col("_fixes"), x["fix"]).otherwise((role(x) == F.col("_first")) & x["must"]), F.lit(False))
    return j.select("pr", "checks", F.transform("_all", lambda x: F.struct(*[x[c].alias(c) for c in ("source", "item", "owner", "must")], F.when(now(x), "now").otherwise("then").alias("phase"))).alias("items"))


def headline(verdict: Column, fixes: Column) -> Column:
    """The words of a verdict."""
    n = F.when(fixes == 1, "1 fix").otherwise(F.concat(fixes.cast("string"), F.lit(" fixes")))
    words = {"needs-contributor-work": "Not ready to merge", "needs-work": "Needs changes", "awaiting-review": "Waiting for review", "requirements-met-unreviewed": "Not reviewed yet", "insufficient-evidence": "Cannot tell yet", "draft": "Draft"}
    base = F.coalesce(*[F.when(verdict == v, h) for v, h in words.items()], F.lit("Ready to merge"))
    return F.when(verdict.isin("needs-contributor-work", "needs-work") & (fixes > 0), F.concat(base, F.lit(": "), n)).otherwise(base)
