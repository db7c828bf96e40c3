"""The report model: nested rows from bucketed tables without a shuffle, and its rules."""

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import checks as C
from reviewlake.operators import facts as K
from reviewlake.operators import joins as J
from reviewlake.operators import report as M
from reviewlake.plans import QUERIES, gates
from reviewlake.plans.catalog import Tables


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def test_model_joins_without_a_shuffle(no_broadcast):
    spark = no_broadcast
    changes = M.bucketed(spark.range(50).select(F.col("id").alias("pr"), F.lit("t").alias("title")), "changes", 4)
    files = M.bucketed(spark.range(200).select((F.col("id") % 40).alias("pr"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.col("id").alias("n")), "files", 4)
    one = M.bucketed(spark.range(0, 50, 2).select(F.col("id").alias("pr"), F.lit("easy").alias("rating")), "triage", 4)
    m = M.model(changes, {"files": (files, ["path"])}, {"triage": one})
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    got = {r.pr: r for r in m.collect()}
    assert len(got) == 50 and got[45].files == [] and got[1].triage is None and got[2].triage.rating == "easy"
    assert [f.path for f in got[3].files] == sorted(f"f{k}" for k in range(3, 200, 40)) and got[3].files[0].n == int(got[3].files[0].path[1:])


def test_the_first_invalid_field_is_named(spark):
    schema = "pr long, title string, head string, checks array<struct<check_id:string,status:string,evidence:array<string>>>, recommendation struct<verdict:string>, triage struct<rating:string>, files array<struct<path:string>>, build struct<status:string>"
    good = [("a", "pass", []), ("b", "warn", ["x"])]
    row = lambda n, **kw: tuple({"pr": n, "title": "t", "head": "0" * 40, "checks": good, "recommendation": ("ready",), "triage": ("easy",), "files": [("p",)], "build": None, **kw}.values())
    cases = {
        None: {}, "title": {"title": None}, "head": {"head": "xyz"}, "checks[1].status": {"checks": [good[0], ("b", "odd", None), (None, "pass", [])]}, "checks[0].evidence": {"checks": [("a", "pass", None), (None, "odd", None)]}, "checks[2].check_id": {"checks": [*good, (None, "pass", [])]},
        "recommendation.verdict": {"recommendation": None, "triage": ("odd",)}, "triage.rating": {"triage": ("odd",)}, "files[1].path": {"files": [("p",), ("",)]}, "build.status": {"build": ("odd",)},
    }
    df = spark.createDataFrame([row(k, **kw) for k, kw in enumerate(cases.values())], schema)
    got = {r.pr: r.error for r in M.validated(df).collect()}
    assert [got[k] for k in range(len(cases))] == [f and f"invalid: {f}" for f in cases]
    valid, bad = M.quarantined(df)
    assert [r.pr for r in valid.collect()] == [0] and bad.count() == len(cases) - 1


def test_facts_meet_in_one_aggregate(spark):
    """Twenty tables by change are put together without a join, whose sorts would all be in one task's memory; a change lacks what a table
    hasn't of it."""
    tables = [spark.range(k, 40).select(F.col("id").alias("pr"), (F.col("id") * k).alias(f"n{k}"), F.array(F.lit(k)).alias(f"a{k}")) for k in range(20)]
    got = K.gathered(tables)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.pr: r for r in got.collect()}
    assert sorted(rows) == list(range(40))
    assert all((r[f"n{k}"], r[f"a{k}"]) == ((pr * k, [k]) if pr >= k else (None, None)) for pr, r in rows.items() for k in range(20))


def test_facts_have_few_joins_in_a_row(spark, sf):
    """Tickets, what is gathered, builds, runs and votes: five joins follow each other, whatever number of tables is gathered."""
    node, joins = gates.facts(Tables(spark, sf))._jdf.queryExecution().optimizedPlan(), 0
    while node.children().size() and node.nodeName() in ("Project", "Join", "Filter"):
        joins += node.nodeName() == "Join"
        node = node.children().apply(0)
    assert 0 < joins <= 5


def test_sections_are_made_without_another_shuffle_of_statuses(spark, sf):
    """Facts that only words of a check read aren't made, and statuses aren't dealt out by section."""
    t = Tables(spark, sf)
    f = gates.facts(t, C.asked())
    assert not {"style_places", "complex_top", "copies", "bug_rules"} & set(f.columns) and {"style_new", "banned"} <= set(f.columns)
    whole = {(r.pr, r.check_id): r.status for r in gates.results(t).collect()}
    got = C.statuses(f)
    assert {(r.pr, r.check_id): r.status for r in got.collect()} == whole and len(whole) == 31 * f.count()
    plan = C.worst(got)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pr" in plan and "section" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_statuses_of_a_check_that_is_a_function(spark):
    facts = spark.createDataFrame([(1, 3), (2, None)], "pr long, n int")
    rule = C.Check("a.n", "reviewer", False, (C.O("n > 2", "fail", "'many'"), C.O("n > 0", "warn", "'some'"), C.O(None, "pass", "'none'")), C.EMPTY)
    own = lambda f: f.selectExpr("pr", "'b.own' AS check_id", "'info' AS status")
    assert sorted(map(tuple, C.statuses(facts, {"a.n": rule, "b.own": own}).collect())) == [(1, "a.n", "fail"), (1, "b.own", "info"), (2, "a.n", "pass"), (2, "b.own", "info")]
    assert C.asked({"a.n": rule}) == {"n"} and C.asked({"a.n": rule, "b.own": own}) is None


def written(spark) -> set[str]:
    return {x.name for x in spark.catalog.listTables()}


@pytest.mark.parametrize("name", ["agg38_headlines", "out2_validated"])
def test_facts_and_results_are_not_written(spark, sf, name):
    """Lines, files and commits of changes are, but neither facts nor results, nor parts of a model."""
    before = written(spark)
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert {x.rsplit("_", 1)[0] for x in written(spark) - before} <= {"touched", "added", "change_commits", "lineitem", "owners", "occurrences"}
    assert ("style_places" in plan) == (name == "out2_validated")


@pytest.mark.parametrize("name", ["chk1_chk6_chk31_summaries", "prj28_perf_signals"])
def test_facts_that_a_query_does_not_read_are_not_made(spark, sf, name):
    before = written(spark)
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert {x.rsplit("_", 1)[0] for x in written(spark) - before} <= {"touched"}
    assert not [x for x in ("style_new", "copies_new", "banned", "bad_messages") if x in plan]


def test_flags_of_changes_are_those_of_their_results(spark, sf):
    """In one row a change, from fewer facts; a verdict is the same of both, and what a function checks counts too."""
    t = Tables(spark, sf)
    whole = gates.results(t)
    rows, flags = whole.select("pr", *C.FLAGS), gates.flags(t)
    one = flags.select("pr", F.explode("checks").alias("c")).select("pr", "c.*")
    assert rows.exceptAll(one).isEmpty() and one.exceptAll(rows).isEmpty()
    reviews = gates.reviews_of(t)
    assert C.recommend(whole, reviews).exceptAll(C.recommend(flags, reviews)).isEmpty()
    facts = spark.createDataFrame([(1, 3), (2, None)], "pr long, n int")
    rule = C.Check("a.n", "reviewer", True, (C.O("n > 2", "fail", "'many'"), C.O(None, "pass", "'none'")), C.EMPTY)
    own = lambda f: f.filter("n IS NULL").selectExpr("pr", "'b.own' AS check_id", "'warn' AS status", "false AS blocking", "'contributor' AS owner", "true AS action_required")
    got = {r.pr: [tuple(c) for c in r.checks] for r in C.flagged(facts, {"a.n": rule, "b.own": own}).collect()}
    assert got == {1: [("a.n", "fail", True, "reviewer", True)], 2: [("a.n", "pass", True, "reviewer", False), ("b.own", "warn", False, "contributor", True)]}


def test_what_is_bucketed_by_change_is_gathered_where_it_is(no_broadcast):
    n = int(no_broadcast.conf.get("spark.sql.shuffle.partitions"))
    a, b = (M.bucketed(no_broadcast.range(60).select((F.col("id") % k).alias("pr"), F.col("id").alias(f"n{k}")), "some", n).groupBy("pr").agg(F.max(f"n{k}").alias(f"n{k}")) for k in (10, 7))
    got = K.gathered([a, b])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.pr: (r.n10, r.n7) for r in got.collect()} == {k: (50 + k, max(x for x in range(60) if x % 7 == k) if k < 7 else None) for k in range(10)}


def test_sides_meet_where_their_file_is(no_broadcast):
    """Ranges, and base and head, without a shuffle of lines; keys that are null meet nothing."""
    n = int(no_broadcast.conf.get("spark.sql.shuffle.partitions"))
    lines = no_broadcast.createDataFrame([(1, 10, "a"), (1, 90, "a"), (2, 10, None), (2, 20, None), (3, None, "b")], "file_id long, line int, rule string")
    spans = no_broadcast.createDataFrame([(1, 8, 12), (1, 1, 9), (2, 30, 15), (3, 1, 99), (None, 1, 99)], "file_id long, lo int, hi int")
    x, y = M.bucketed(lines, "lines", n, key="file_id"), M.bucketed(spans, "spans", n, key="file_id")
    hit = J.covered(x, y, ["file_id"], "line", "line", "lo", "hi", "hit")
    bags = J.bag_match(x, x.filter("line < 20"), ["file_id", "rule"], ["line"])
    assert not [d for d in (hit, bags) if "Exchange" in d._jdf.queryExecution().executedPlan().toString()]
    assert sorted((r.file_id, r.line or 0, r.hit) for r in hit.collect()) == [(1, 10, True), (1, 90, False), (2, 10, False), (2, 20, False), (3, 0, False)]
    wide = J.covered(x.withColumn("end", F.col("line") + 25), y, ["file_id"], "line", "end", "lo", "hi", "hit")
    assert sorted((r.file_id, r.line) for r in wide.filter("hit").collect()) == [(1, 10), (2, 10)]
    assert sorted((r.file_id, r._k, r.line or 0, r.r_line or 0, bool(r._left), bool(r._right)) for r in bags.collect()) == [(1, 1, 10, 10, True, True), (1, 2, 90, 0, True, False), (2, 1, 0, 10, False, True), (2, 1, 10, 0, True, False), (2, 2, 20, 0, True, False), (3, 1, 0, 0, True, False)]


def test_scored_tests_are_not_sent_through_the_driver(spark, sf):
    """Texts and what is cut out of them are joined by a shuffle, small as Spark takes them to be: only hubs, and tables of one row, are broadcast."""
    plan = QUERIES["agg29_scored_tests"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 8
