"""Operators on small cases with known answers: clustering, rates, diffs, reports on disk, streams."""

import datetime as dt
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import text as X
from reviewlake.operators import checks, deltas, findings, refresh, selection
from reviewlake.operators import joins as J
from reviewlake.operators import ranking as R
from reviewlake.sources import diffs, records
from reviewlake.streaming import refresh as stream


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- rates


def test_poisson_tail():
    assert abs(deltas.tail(4, 3.0) - 0.352768) < 1e-6
    assert deltas.tail(0, 5.0) == 1.0 and deltas.tail(1, 0.0) == 0.0
    assert 0 < deltas.tail(60, 1.0) < 1e-60
    assert abs(deltas.tail(5, 200.0) - 1) < 1e-9
    assert deltas.tail(1, 760.0) == 1.0 and deltas.tail(5, 800.0) == 1.0 and abs(deltas.tail(760, 800.0) - 0.925) < 0.003
    for k, mu in ((1, 0.5), (3, 7.0), (7, 7.0), (30, 20.0), (10, 40.0)):
        p = [math.exp(-mu)]
        for i in range(1, k):
            p.append(p[-1] * mu / i)
        assert abs(deltas.tail(k, mu) - (1 - math.fsum(p))) < 1e-12


def test_rate_is_judged(spark):
    r = spark.createDataFrame([(4, 150, 100_000, 2000), (12, 150, 100_000, 2000), (0, 150, 100_000, 2000), (3, 0, 0, 10)], "observed long, violations long, loc long, added long")
    got = {x.observed: x for x in deltas.judged(r).collect()}
    assert got[4].expected == 3.0 and got[4].usual and not got[12].usual
    assert got[0].p is None and not got[0].usual and got[3].p is None


# -- clustering


def plain_clusters(n, lens, edges):
    group = {i: {i} for i in range(n)}
    for _, i, j in sorted((-t, i, j) for i, j, t in edges):
        a, b = group[i], group[j]
        if a is not b and not {lens[x] for x in a} & {lens[x] for x in b}:
            a |= b
            for x in b:
                group[x] = a
    return {i: min(g) for i, g in group.items()}


def finding(pr, idx, lens, problem, fix="", location="general", severity="minor"):
    return (pr, idx, lens, problem, fix, location, severity, f"{pr}-{idx}", "r")


SCHEMA = "pr long, idx long, lens string, problem string, fix string, location string, severity string, id string, rule string"


def test_findings_merge_by_topic_not_by_line(spark):
    f = [
        finding(1, 0, "correctness", "FileUtils.delete ignores the return value of deleteIfExists", "check deleteIfExists", "src/A.java:10", "major"),
        finding(1, 1, "resources", "deleteIfExists return value ignored in FileUtils.delete", "check deleteIfExists result", "src/A.java:11", "blocker"),
        finding(1, 2, "style", "Variable naming unclear here", "rename it", "src/A.java:10"),
        finding(1, 3, "correctness", "FileUtils.delete ignores the return value of deleteIfExists again", "check deleteIfExists", "src/A.java:12"),
        finding(2, 0, "correctness", "FileUtils.delete ignores the return value of deleteIfExists", "check deleteIfExists", "src/A.java:10"),
    ]
    df = spark.createDataFrame(f, SCHEMA)
    member = findings.clusters(df)
    assert rows(member, "pr", "idx", "cluster") == [(1, 0, 0), (1, 1, 0), (1, 2, 2), (1, 3, 3), (2, 0, 0)]
    got = {r.primary: r for r in findings.issues(df, member).collect()}
    assert got["1-1"].issue == "issue-1" and got["1-1"].severity == "blocker" and got["1-1"].lenses == ["correctness", "resources"] and got["1-1"].spread == ["blocker", "major"]


@pytest.mark.parametrize(("most", "few"), [(1 << 20, 64), (0, 64), (4, 3)])
def test_clusters_equal_greedy_walk(spark, most, few):
    """Walked, in rounds, and both; pairs of small changes and by the index."""
    rng = random.Random(11)
    words = ["alphaBeta", "GAmma", "delta", "epsilon", "zetaEta", "theta", "iotaKappa", "lambda", "sigma"]
    f = [finding(pr, i, f"l{rng.randrange(3)}", " ".join(rng.choices(words, k=4)), " ".join(rng.choices(words, k=3)), f"src/F.java:{rng.randrange(12)}") for pr in range(12) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(f, SCHEMA)
    edges = findings.edges(findings.pair_scores(df)).collect()
    assert rows(findings.pair_scores(df, few=few), "pr", "i", "j", "total") == rows(findings.pair_scores(df, few=0), "pr", "i", "j", "total")
    got = {(r.pr, r.idx): r.cluster for r in findings.clusters(df, most=most, few=few).collect()}
    assert len(got) == len(f)
    for pr in range(12):
        mine = [x for x in f if x[0] == pr]
        want = plain_clusters(len(mine), [x[2] for x in mine], [(e.i, e.j, e.total) for e in edges if e.pr == pr])
        assert {i: got[pr, i] for i in want} == want
        for c in set(want.values()):
            lenses = [x[2] for x in mine if want[x[1]] == c]
            assert len(lenses) == len(set(lenses))


def plain_blocks(docs, k):
    """Every place of k tokens against one earlier place, grown while the tokens of both agree."""
    tokens = {i: t.split() for i, t in docs if t and len(t.split()) >= k}
    places = {}
    for i in sorted(tokens):
        for p in range(len(tokens[i]) - k + 1):
            places.setdefault(tuple(tokens[i][p : p + k]), []).append((i, p))
    out = set()
    for found in places.values():
        for n, (i, p) in enumerate(found[1:], 1):
            a, s = found[n - 1] if found[n - 1][0] == i else found[0]
            x, y, m = tokens[a], tokens[i], k
            while s and p and x[s - 1] == y[p - 1]:
                s, p, m = s - 1, p - 1, m + 1
            while s + m < len(x) and p + m < len(y) and x[s + m] == y[p + m]:
                m += 1
            out.add((a, s, i, p, m))
    return sorted(out)


BLOCK = ("doc_a", "start_a", "doc_b", "start_b", "tokens")


def test_duplicate_blocks_are_maximal(spark):
    shared = [f"s{k}" for k in range(30)]
    docs = [(1, " ".join(["a", "b", *shared, "c"])), (2, " ".join(["x", *shared, "y", "z"])), (3, " ".join(["q"] * 8)), (4, " ".join(["m", *shared[:12]]))]
    got = findings.duplicate_blocks(spark.createDataFrame(docs, "doc_id long, text string"), k=10)
    assert rows(got, *BLOCK) == [(1, 2, 2, 1, 30), (1, 2, 4, 1, 12)]


@pytest.mark.parametrize("k", [2, 10, 25])
def test_duplicate_blocks_equal_brute_force(spark, k):
    """A hundred documents of shared passages, repeats inside one, periodic texts, texts of exactly k tokens, copies."""
    rng = random.Random(k)
    passages = [[f"p{n}x{i}" for i in range(rng.randint(k, 4 * k))] for n in range(12)]
    docs = [(1, None), (2, ""), (3, "w " * 200), (4, "w  w\t" * 60), (5, "a b c " * 50), (6, " ".join(passages[0][:k])), (7, " ".join(passages[0][: k - 1]))]
    for i in range(8, 100):
        text = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            text += p[cut : rng.randint(cut, len(p))] + [f"u{rng.randrange(40)}" for _ in range(rng.randint(0, 4))] + (p[:k] * rng.randint(0, 1))
        docs.append((i, " ".join(text)))
    docs.append((100, docs[50][1]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(findings.duplicate_blocks(df, k=k), *BLOCK)
    assert got == plain_blocks(docs, k)
    members = findings.holders(findings.duplicate_blocks(df, k=k)).collect()
    assert len(members) == len(got) + len({g[:2] + g[4:] for g in got}) and all(m.copies >= 2 for m in members)
    assert findings.duplicate_blocks(df.limit(0), k=k).count() == 0


def test_chance_collisions_give_no_block(spark, monkeypatch):
    """All windows hashed alike: the tokens are compared all the same."""
    real = findings.window_hashes
    monkeypatch.setattr(findings, "window_hashes", lambda t, k: real(t, k) % 3)
    docs = [(i, " ".join(f"t{(i * 7 + j * j) % 50}" for j in range(30))) for i in range(6)] + [(9, " ".join(f"t{j * j % 50}" for j in range(25)))]
    got = rows(findings.duplicate_blocks(spark.createDataFrame(docs, "doc_id long, text string"), k=10), *BLOCK)
    assert all(docs_equal(dict(docs), r) for r in got)


def docs_equal(texts, r):
    x, y = (texts[d].split()[s : s + r[4]] for d, s in ((r[0], r[1]), (r[2], r[3])))
    return x == y and len(x) == r[4] >= 10


def test_texts_move_once_for_two_documents(spark, monkeypatch):
    """No tokens are written, and documents that share three places are one row until their texts are compared."""
    written, real = {}, findings.materialise
    monkeypatch.setattr(findings, "materialise", lambda df, name: written.setdefault(name, real(df, name)))
    p = [" ".join(f"p{n}x{i}" for i in range(12)) for n in range(3)]
    docs = [(1, f"{p[0]} a {p[1]} b b {p[2]}"), (2, f"{p[2]} c {p[0]} d {p[1]}"), (3, " ".join(f"u{i}" for i in range(40)))]
    got = rows(findings.duplicate_blocks(spark.createDataFrame(docs, "doc_id long, text string"), k=10), *BLOCK)
    assert got == [(1, 0, 2, 13, 12), (1, 13, 2, 26, 12), (1, 27, 2, 0, 12)]
    assert not any(f.dataType.simpleString() in ("string", "array<string>") for df in written.values() for f in df.schema)
    assert [(r.doc_a, r.doc_b, len(r.seeds)) for r in written["pairs"].collect()] == [(1, 2, 3)]


def test_blocks_within_groups(spark):
    text = " ".join(f"s{i}" for i in range(20))
    df = spark.createDataFrame([(1, "a", text), (2, "b", text), (3, "a", text)], "doc_id long, g string, text string")
    assert rows(findings.duplicate_blocks(df, k=10, group="g"), *BLOCK) == [(1, 0, 3, 0, 20)]


# -- joins and rankings


def test_nearest_and_bag(spark):
    left = spark.createDataFrame([("f", 5), ("f", 10), ("g", 1)], "file_id string, line int")
    right = spark.createDataFrame([("f", 3), ("f", 10), ("f", 12)], "file_id string, line int")
    assert rows(J.nearest(left, right, ["file_id"], "line", F.col("line"), "n"), "file_id", "line", "n") == [("f", 5, 3), ("f", 10, 10), ("g", 1, None)]
    assert rows(J.nearest(left, right, ["file_id"], "line", F.col("line"), "n", following=True), "file_id", "line", "n") == [("f", 5, 10), ("f", 10, 10), ("g", 1, None)]
    h = spark.createDataFrame([("r", 1), ("r", 2), ("r", 3)], "rule string, line int")
    b = spark.createDataFrame([("r", 9), ("q", 1)], "rule string, line int")
    got = deltas.style_delta(b, h, ["rule"], ["line"])
    assert sorted(r.kind for r in got.collect()) == ["fixed", "introduced", "introduced", "pre-existing"]


def test_running_budget_is_greedy(spark):
    rng = random.Random(2)
    data = [(g, k, rng.randint(0, 90)) for g in range(20) for k in range(rng.randint(1, 12))]
    got = R.running_budget(spark.createDataFrame(data, "g int, k int, n int"), ["g"], [F.col("k").asc()], F.col("n"), 50, 120).collect()
    want = {}
    for g, items in itertools.groupby(sorted(data), key=lambda x: x[0]):
        left = 120
        for _, k, n in items:
            want[g, k] = min(n, 50, left)
            left -= want[g, k]
    assert {(r.g, r.k): r.shown for r in got} == want


def test_sentences_and_versions(spark):
    t = spark.createDataFrame([("Use e.g. this one. Then stop.",), ("No stop",), ("a" * 300,), (None,)], "t string")
    assert [r[0] for r in t.select(X.first_sentence(F.col("t"))).collect()] == ["Use e.g. this one", "No stop", "a" * 150 + "…", ""]
    n = spark.createDataFrame([("+1",), ("LGTM +1.",), ("+10",), ("c++1",), ("a +1 b",)], "t string")
    assert [r[0] for r in n.select(X.plus_one(F.col("t"))).collect()] == [True, True, False, False, True]


# -- checks


FACTS = {
    "key": ("string", "PROJ-1"), "sources": ("array<string>", ["title"]), "conflicts": ("array<string>", []), "release": ("boolean", True), "base": ("string", "project-4.1"), "lookup": ("string", "found"), "ticket_status": ("string", "Open"), "versions": ("array<string>", ["4.1"]), "wanted": ("array<string>", ["project-4.1"]),
    "targets": ("array<string>", ["project-4.1"]), "no_ci": ("array<string>", []), "unknown_sha": ("array<string>", []), "stale": ("array<string>", []), "compared": ("long", 1), "ci_branches": ("array<string>", ["project-4.1"]), "no_upgrade": ("array<string>", []), "ci_failed": ("long", 0), "uncounted": ("array<string>", []),
    "sensitive": ("array<string>", None), "commits": ("long", 1), "bad_messages": ("long", 0), "trailers": ("long", 0), "helped": ("boolean", False), "hints": ("array<string>", []), "has_prod": ("boolean", True), "log_lines": ("long", 1), "log_entries": ("array<string>", [" * x (PROJ-1)"]), "strong": ("array<string>", []), "medium": ("array<string>", []),
    "bench_first": ("int", None), "source_first": ("int", 0), "prod_lines": ("long", 10), "suites": ("array<string>", ["unit"]), "all_tests": ("boolean", False), "build": ("string", "pass"), "compile_errors": ("int", 0), "run": ("int", 5), "failing": ("int", 0), "flaky": ("int", 0), "artifacts": ("int", 0), "executable": ("int", 4), "missed": ("int", 0),
    "unmeasured": ("int", 0), "static": ("string", "ran"), "expected": ("int", 3), "style_status": ("string", "ran"), "style_analyzed": ("int", 3), "rules_status": ("string", "ran"), "rules_analyzed": ("int", 3), "copies_status": ("string", "ran"), "copies_analyzed": ("int", 3), "catalog": ("string", "ran"), "style_file": ("string", "read"),
    "style_new": ("long", 0), "style_old": ("long", 0), "style_fixed": ("long", 0), "style_places": ("array<string>", None), "complex_new": ("long", 0), "complex_tests": ("long", 0), "complex_top": ("array<string>", None), "bugs_new": ("long", 0), "bugs_other": ("long", 0), "bug_rules": ("array<string>", []), "usual_rules": ("array<string>", []), "untyped_rules": ("array<string>", []), "copies_new": ("long", 0), "copies": ("array<string>", None), "author": ("string", "me"), "others": ("array<string>", []),
    "banned": ("array<string>", None), "deprecated": ("array<string>", None), "properties": ("array<string>", None), "unlicensed": ("array<string>", None),
    "protected": ("array<string>", []), "grammar": ("array<string>", []), "config_yaml": ("boolean", False), "config_latest": ("boolean", False), "config_java": ("boolean", False), "has_latest": ("boolean", True), "admin_files": ("array<string>", []), "admin_help": ("long", 0), "surfaces": ("array<string>", []),
    "counted": ("array<struct<id:string,who:string,source:string,rule:string>>", [("a", "a", "review", "address"), ("b", "b", "review", "address")]), "author_vote": ("string", None), "roster_read": ("boolean", True),
}
#: check, facts that differ, status, action required, blocking
SAID = [
    ("jira.key-present", {"key": None, "release": False}, "warn", True, False), ("jira.key-present", {"key": None}, "fail", True, True), ("jira.not-resolved", {"key": None, "lookup": None, "ticket_status": None}, "not-applicable", False, False), ("jira.not-resolved", {"lookup": "unavailable", "ticket_status": None}, "unknown", False, False),
    ("jira.fix-version", {"lookup": None, "ticket_status": None}, "not-applicable", False, False), ("jira.fix-version", {"release": False}, "not-applicable", False, False), ("jira.fix-version", {"versions": [], "wanted": []}, "warn", True, False), ("ci.freshness", {"unknown_sha": ["x"]}, "warn", False, False), ("ci.freshness", {"unknown_sha": ["x"], "stale": ["y"]}, "warn", True, False),
    ("ci.failures", {"uncounted": ["x"]}, "unknown", False, False), ("ci.failures", {"uncounted": ["x"], "ci_failed": 2}, "warn", True, False), ("commits.message-format", {"bad_messages": 1}, "warn", False, False), ("build.compiles", {"build": "timeout"}, "unknown", False, False), ("build.compiles", {"build": None}, "not-applicable", False, True),
    ("build.tests-pass", {"flaky": 1}, "unknown", False, False), ("build.tests-pass", {"build": "tests-failed", "failing": 1}, "fail", True, True), ("build.changed-line-coverage", {"unmeasured": 1}, "unknown", False, False), ("build.changed-line-coverage", {"missed": 1, "unmeasured": 1}, "warn", False, False), ("build.changed-line-coverage", {"build": "build-failed"}, "not-applicable", False, False),
    ("static.checkstyle", {"style_new": 3, "style_analyzed": 2}, "unknown", False, False), ("static.checkstyle", {"style_new": 3, "rules_analyzed": 2}, "warn", True, False), ("static.checkstyle", {"style_status": "not-applicable"}, "not-applicable", False, False), ("static.complexity", {"complex_new": 1, "complex_top": ["m"], "rules_analyzed": 2}, "warn", False, False), ("static.complexity", {"rules_analyzed": 2}, "unknown", False, False),
    ("static.complexity", {"complex_new": 1, "complex_top": ["m"], "rules_analyzed": 0}, "unknown", False, False), ("static.pmd-rules", {"catalog": "skipped", "bugs_new": 2}, "unknown", False, False), ("static.pmd-rules", {"bugs_new": 2}, "warn", False, False), ("static.duplication", {"copies_new": 1, "copies_status": "failed"}, "unknown", False, False),
    ("static.banned-api", {"style_analyzed": 1, "banned": ["x"]}, "not-applicable", False, False), ("static.banned-api", {"style_status": "failed", "banned": ["x"]}, "warn", True, False), ("static.banned-api", {"static": None, "style_status": None, "style_file": "missing"}, "not-applicable", False, False), ("static.banned-api", {"static": None, "style_status": None, "style_file": "unreadable"}, "unknown", False, False), ("static.deprecated-since", {"static": None, "style_status": None, "deprecated": ["x"]}, "warn", True, False), ("static.license-header", {"unlicensed": ["a"]}, "warn", True, False), ("static.protected-paths", {"grammar": ["g"]}, "warn", False, False), ("static.protected-paths", {"protected": ["l"], "grammar": ["g"]}, "warn", True, False),
    ("compat.config-pairing", {"config_yaml": True}, "fail", True, True), ("compat.config-pairing", {"config_latest": True}, "pass", False, True), ("compat.config-pairing", {"config_java": True}, "warn", False, True), ("compat.config-pairing", {"config_yaml": True, "has_latest": False}, "not-applicable", False, True), ("compat.command-help", {"admin_files": ["a"]}, "warn", False, False), ("compat.surfaces", {"surfaces": ["x"]}, "warn", False, False),
    ("votes.committer-plus-ones", {"counted": [("a", "a", "review", "x")]}, "fail", True, True), ("votes.committer-plus-ones", {"counted": [("a", "a", "review", "x")], "author_vote": "c"}, "pass", False, True), ("votes.committer-plus-ones", {"counted": [("a", "a", "review", "x")], "all_tests": True}, "pass", False, True), ("votes.committer-plus-ones", {"counted": [], "author_vote": "c", "all_tests": True}, "fail", True, True),
]


def test_checks_say_what_they_should(spark):
    assert len(checks.CHECKS) == 31 and sum(c.blocking for c in checks.CHECKS.values()) == 9
    assert {c.owner for c in checks.CHECKS.values() if c.id in ("ci.failures", "votes.committer-plus-ones")} == {"reviewer"}
    facts = [(k, *[change.get(c, v) for c, (_, v) in FACTS.items()]) for k, (_, change, *_) in enumerate([("", {}), *SAID])]
    got = {(r.pr, r.check_id): r for r in checks.run_checks(spark.createDataFrame(facts, "pr int, " + ", ".join(f"{c} {t}" for c, (t, _) in FACTS.items()))).collect()}
    assert {r.status for (pr, _), r in got.items() if pr == 0} <= {"pass", "not-applicable"}
    for k, (check, _, *want) in enumerate(SAID, 1):
        r = got[k, check]
        assert [r.status, r.action_required, r.blocking] == want, (check, r)
        assert (r.action is None) == (r.status in ("pass", "not-applicable", "unknown")) and r.summary
    own = {"mine": lambda f: f.selectExpr("pr", "'mine' AS check_id", "'pass' AS status", "false AS blocking", "'reviewer' AS owner", "false AS action_required", "'ok' AS summary", "CAST(NULL AS STRING) AS action", "array('e') AS evidence")}
    assert checks.run_checks(spark.createDataFrame(facts[:1], "pr int, " + ", ".join(f"{c} {t}" for c, (t, _) in FACTS.items())), {**checks.CHECKS, **own}).count() == 32


# -- refresh and streams


def plain_keep(arrivals):
    standing = {}
    for pr, head, rich, seq in sorted(arrivals, key=lambda a: a[3]):
        old = standing.get(pr)
        if old is None or old[1] != head or rich or not old[2]:
            standing[pr] = (pr, head, rich, seq)
    return sorted(standing.values())


def test_keep_richer_equals_fold(spark):
    rng = random.Random(5)
    a = [(rng.randrange(30), f"h{rng.randrange(3)}", rng.random() < 0.4, k) for k in range(600)]
    got = refresh.keep_richer(spark.createDataFrame(a, "pr long, head string, has_results boolean, seq long"))
    assert rows(got, "pr", "head", "has_results", "seq") == plain_keep(a)


@pytest.mark.parametrize("files", [1, 4])
def test_stream_gives_the_same_in_any_batches(spark, tmp_path, files):
    rng = random.Random(6)
    a = [(rng.randrange(12), f"h{rng.randrange(3)}", rng.random() < 0.4, k) for k in range(120)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        part = [(p, h, False, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=s), r, s) for p, h, r, s in a[30 * k : 30 * k + 30]]
        spark.createDataFrame(part, stream.UPDATE).coalesce(1).write.mode("append").parquet(source)
    q = stream.refresh(spark, source, target, str(tmp_path / "state"), files)
    q.awaitTermination(120)
    got = stream.standing(spark, target)
    assert rows(got, "pr", "head", "has_results", "seq") == plain_keep(a)


def test_stream_picks_new_heads_once(spark, tmp_path):
    source = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, "a", False, t0, False, 1), (1, "a", False, t0, False, 2), (2, "b", False, t0, False, 3), (3, "c", False, t0, False, 4)], stream.UPDATE).coalesce(1).write.parquet(source)
    published = spark.createDataFrame([(1, "old"), (2, "b")], "pr long, head string")
    q = stream.to_refresh(stream.updates(spark, source), published).writeStream.format("memory").queryName("picked").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("picked"), "pr", "head") == [(1, "a"), (3, "c")]


# -- sources on disk


def test_reports_are_read_from_files(spark, tmp_path):
    (tmp_path / "t.xml").write_text('<testsuites><testsuite name="S"><testcase classname="c" name="ok"/><testcase classname="c" name="bad"><failure message="m">x</failure></testcase><system-out>out</system-out></testsuite></testsuites>')
    got = records.junit(records.xml_records(spark, str(tmp_path / "t.xml"), "testsuite", records.SUITE))
    assert rows(got, "test", "bucket") == [("bad", "failure"), ("ok", "passed")]
    (tmp_path / "p.xml").write_text('<pmd><file name="A.java"><violation beginline="3" endline="4" rule="R" ruleset="Best Practices">  Avoid\n this </violation></file><file name="B.java"/></pmd>')
    got = records.rule_report(records.xml_records(spark, str(tmp_path / "p.xml"), "file", records.RULE_FILE))
    assert rows(got, "file", "rule", "category", "message") == [("A.java", "R", "bestpractices", "Avoid this")]
    (tmp_path / "c.xml").write_text('<checkstyle><file name="A.java"><error line="3" source="a.b.EmptyCheck" message="m"/></file><file name="B.java"></file></checkstyle>')
    got = records.style_report(records.xml_records(spark, str(tmp_path / "c.xml"), "file", records.STYLE_FILE))
    assert sorted(map(str, rows(got, "file", "rule"))) == ["('A.java', 'Empty')", "('B.java', None)"]
    (tmp_path / "j.xml").write_text('<report><package name="o/p"><sourcefile name="F.java"><line nr="1" mi="0" ci="2" mb="0" cb="0"/></sourcefile></package></report>')
    got = records.coverage_report(records.xml_records(spark, str(tmp_path / "j.xml"), "package", records.COVERED_PACKAGE))
    assert rows(got, "file", "line", "ci") == [("o/p/F.java", 1, 2)]


def test_page_lines_and_values(spark):
    df = spark.createDataFrame([('<html><style>p{}</style><p>CI results for x: PASS</p><ul><li>Passed: 3</li></ul><script>no</script>a&amp;b</html>', '{"a": 1} [2, [3]]')], "h string, j string")
    r = df.select(records.text_lines("h").alias("l"), records.json_values("j").alias("v")).first()
    assert r.l == ["CI results for x: PASS", "Passed: 3", "a&b"] and r.v == ['{"a": 1}', "2", "3"]


def test_diff_of_several_files(spark):
    d = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +1,2 @@\n keep\n-gone\n-gone too\n+new\ndiff --git a/y b/y\nnew file mode 100644\n--- /dev/null\n+++ b/y\n@@ -0,0 +1,2 @@\n+--- odd\n+two\n"
    lines = diffs.diff_lines(spark.createDataFrame([(1, d), (2, None), (3, "")], "pr long, diff string"))
    assert rows(diffs.added_lines(lines), "path", "line_no", "text", "new_file") == [("x", 2, "new", False), ("y", 1, "--- odd", True), ("y", 2, "two", True)]
    assert rows(diffs.old_side_hunks(lines), "path", "start", "end", "kind") == [("x", 2, 3, "changed")]


def test_scenarios_fall_back_to_smoke(spark):
    f = spark.createDataFrame([(1, "src/a", 5, "t"), (2, "src/net/b", 50, "t")], "pr long, path string, lines long, title string")
    got = selection.scenarios(f, [{"id": "n", "scenario": "net", "pattern": "/net/", "keywords": None, "exclude": None, "min_lines": 10, "priority": 1}])
    assert rows(got, "pr", "scenario") == [(1, "smoke"), (2, "net")]


def test_scenarios_deal_files_out_once(spark):
    """Rules, the lines they cover and the changes that none covers come from one reading and one shuffle of the files; a rule called smoke is a
    scenario like any other, and rows of one path count where no rule fits."""
    files = [(1, "x/a", 5, "t"), (1, "x/b", 6, "t"), (1, "x/a", 2, "t"), (2, "x/a", 4, "t"), (2, "y/c", 1, "t"), (3, "y/d", 7, "t"), (3, "y/d", 7, "t"), (4, "z/e", 1, "t"), (5, "y/n", None, "t")]
    rule = lambda i, name, prefix, least, priority: {"id": i, "scenario": name, "prefixes": [prefix], "min_lines": least, "priority": priority}
    rules = [rule("p", "net", "x/", 10, 1), rule("q", "net", "x/a", 3, 2), rule("r", "smoke", "z/", 1, 5)]
    got = selection.scenarios(spark.createDataFrame(files, "pr long, path string, lines long, title string").repartition(3), rules)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = [(1, "net", 2, 11, 2, 1), (2, "net", 2, 4, 1, 1), (3, "smoke", 0, 14, 2, 1), (4, "smoke", 5, 1, 1, 1), (5, "smoke", 0, None, 1, 1)]
    assert rows(got, "pr", "scenario", "priority", "lines", "files", "rank") == want


def test_declaring_files_gather_lines_of_files_with_the_word(spark):
    from reviewlake.operators import facts

    lines = [(1, "src/java/A.java", 2, "implements B,"), (1, "src/java/A.java", 3, "VersionedSerializer<A>"), (1, "src/java/B.java", 1, "VersionedSerializer"), (2, "src/java/A.java", 1, "implements B {"), (2, "src/java/A.java", 2, "VersionedSerializer"), (3, "test/A.java", 1, "implements VersionedSerializer"), (4, "src/java/A.java", 9, None)]
    df = spark.createDataFrame(lines, "pr long, path string, line_no long, text string")
    assert rows(facts.declaring_files(df), "pr", "path") == [(1, "src/java/A.java")]
    assert rows(facts.declaring_files(df, "(?i)versionedserializer$"), "pr", "path") == [(1, "src/java/B.java"), (2, "src/java/A.java")]
    assert facts.first_word(r"ab\s+(c|d)") == "ab" and facts.first_word(r"ab\s+c|d") is None and facts.first_word("abs*") is None


def test_known_issues_are_found_in_their_case(spark):
    from reviewlake.operators import bench

    known = [(1, "k1", ["src/A.java"], 100, 110, ["leak"], []), (1, "k2", [], None, None, ["leak", "close"], ["socket", "file"]), (1, "k3", ["A.java"], None, None, [], []), (2, "k4", ["A.java"], 5, 6, [], ["x"])]
    issues = [(1, "r", "a", ["A.java:86"], "a leak"), (1, "r", "b", ["src/A.java"], "a leak on close of a file"), (1, "r", "c", ["in src/A.java:84"], "leak"), (1, "r", "d", ["src/A.java:84"], "leak"), (1, "r", "e", ["B.java:100", "x/src/A.java:125"], "leak"), (2, "r", "f", ["A.java:20"], "y x"), (2, "r", "g", ["A.java:22"], "x"), (3, "r", "h", ["A.java:5"], "x")]
    got = bench.matches(spark.createDataFrame(issues, "case_id int, run string, id string, locations array<string>, text string"), spark.createDataFrame(known, "case_id int, issue string, files array<string>, begin int, end int, terms array<string>, any_of array<string>"))
    assert rows(got, "id", "issue") == [("a", "k1"), ("a", "k3"), ("b", "k1"), ("b", "k2"), ("b", "k3"), ("d", "k3"), ("e", "k1"), ("e", "k3"), ("f", "k4")]


def test_words_of_patterns_end_at_letters_beyond_ascii(spark):
    texts = {1: "étionré", 2: "ation", 3: "x tion", 4: "tioné", 5: "_tion", 6: "a\\\\b"}
    patterns = spark.createDataFrame([("begin", r"\btion"), ("end", r"tion\b"), ("literal", r"\\\\b$")], "category string, pattern string")
    got = selection.categories(spark.createDataFrame(list(texts.items()), "id long, text string"), patterns, least=1)
    assert rows(got, "id", "category") == [(1, "begin"), (2, "end"), (3, "begin"), (3, "end"), (4, "begin"), (4, "end"), (5, "end"), (6, "literal")]


def test_calls_of_a_method_meet_changes_by_test_too(spark):
    """A method that every change has and every test calls: each change meets the one test that mentions its class, not all of them."""
    n = 30
    tests = spark.createDataFrame([(f"org/T{k}Test.java", f"@Test void a() {{ Klass{k} x; x.run(1); }}") for k in range(n)], "test string, text string")
    classes = spark.createDataFrame([(k, f"Klass{k}") for k in range(n)], "pr long, cls string")
    methods = spark.createDataFrame([(k, "run") for k in range(n)], "pr long, method string")
    out = selection.scored_tests(tests, classes, methods, classes.limit(0).withColumnRenamed("cls", "sub"), spark.createDataFrame([], "pr long, test string"), least=1, hub_share=0.5)
    assert not re.search(r"Join Inner, \(method#\d+ = method#\d+\)\s*$", out._jdf.queryExecution().optimizedPlan().toString(), re.M)
    assert rows(out, "pr", "test", "score") == [(k, f"org/T{k}Test.java", 7) for k in range(n)]


def test_diff_lines_need_no_sort(spark):
    """A diff is numbered where it is: whole diffs are dealt out, and no task sorts its lines."""
    d = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -40,0 +41,2 @@ f\n+one\n+two\n@@ -50,2 +53 @@\n k\n-gone"
    lines = diffs.diff_lines(spark.createDataFrame([(1, d), (1, d), (2, "@@ -1 +1 @@\n--- gone"), (3, None)], "pr long, diff string"))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Sort" not in plan and "Window" not in plan
    one = [(1, "+one", 41, 41), (1, "+two", 41, 42), (1, " k", 50, 53), (1, "-gone", 51, 54)]
    assert rows(lines, "pr", "line", "old_line", "new_line") == sorted([*one, *one, (2, "--- gone", 1, 1)])


def test_lines_of_ranges_meet_as_bits(spark):
    some = [(1, 1, 3), (1, 2, 5), (1, 60, 200), (1, 64, 127), (2, 63, 63), (2, 5, 2), (3, -70, -60), (4, None, 3), (4, 3, None), (None, 7, 8)]
    want = sorted({(f, n) for f, a, b in some if a is not None and b is not None for n in range(min(a, b), max(a, b) + 1)}, key=repr)
    got = deltas.added_lines(spark.createDataFrame(some, "file_id long, begin_line int, end_line int"))
    assert got.schema["line"].dataType.simpleString() == "int"
    assert sorted(((r.file_id, r.line) for r in got.collect()), key=repr) == want
    groups = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate" in x]
    assert len(groups) == 1 and "line" not in groups[0].split("]")[0]  # no single line is a key


def test_subtypes_keep_no_set_of_changed_classes(spark):
    sources = spark.createDataFrame([("class Sub extends Base { }",), ("class Own extends Base { }",)], "text string")
    classes = spark.createDataFrame([(1, "Base"), (1, "Base"), (2, "Base"), (2, "Own"), (2, "Own")], "pr long, cls string")
    got = selection.subtypes(sources, classes)
    assert rows(got, "pr", "sub") == [(1, "Own"), (1, "Sub"), (2, "Sub")]
    assert not re.search(r"Aggregate \[pr#\d+L?, cls#\d+\]", got._jdf.queryExecution().optimizedPlan().toString())


def test_each_text_is_worked_on_once(spark):
    """Issues and pair scores parse a text where it is distinct, and join what comes of it: no pattern is left above the join."""
    df = spark.createDataFrame([(1, i, f"l{i}", "the readBuffer of a.bC closes" if i % 2 else None, "check it" if i < 3 else None, None) for i in range(5)], "pr long, idx long, lens string, problem string, fix string, location string")
    got = findings.with_identifiers(df)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.idx: r._idents for r in got.collect()} == {0: 0, 1: 3, 2: 0, 3: 3, 4: 0}
    sets = findings.token_sets(df)
    assert "regexp_extract_all" not in sets._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.idx, tuple(r.pw), tuple(r.fi), r._n) for r in sets.collect()} == {(0, (), (), 5), (2, (), (), 5), (4, (), (), 5), (1, ("readbuffer", "clos"), (), 5), (3, ("readbuffer", "clos"), (), 5)}


def test_components_of_small_changes_take_no_rounds(spark):
    chain = spark.createDataFrame([(p, i, i + 1) for p in (1, 2) for i in range(40)] + [(3, 5, 9)], "pr long, i long, j long")
    want = {(p, i): 0 for p in (1, 2) for i in range(41)} | {(3, 5): 5, (3, 9): 5}
    spark.sparkContext.setJobGroup("components", "")
    got = {(r.pr, r.idx): r.root for r in findings.connected(chain).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want
    assert len(jobs) < 12
    assert {(r.pr, r.idx): r.root for r in findings.connected(chain, most=3).collect()} == want


def test_words_and_identifiers_equal_their_definition(spark):
    rng = random.Random(5)
    parts = ["closings", "stations", "ations", "ation", "buses", "readBuffer", "TableReader.closeAll", "a.b", "The", "IOException", "x9.y", "9abc", "fails.", "Zz_", "java", "Foo.java", "thing-ing", "ABc", "was", "does", "passed", "Été", "ab", "...", "a..bC", "éclair"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", ".", ",", "", "_"]) for _ in range(8)) for _ in range(300)] + ["", None]

    def stem(w):
        return next((w[: -len(e)] for e in X.ENDINGS if w.endswith(e) and len(w) - len(e) >= 4), w)

    def words(t):
        return list(dict.fromkeys(stem(w) for w in re.findall("[a-z]+", (t or "").lower()) if len(w) > 2 and w not in X.STOP))

    def identifiers(t):
        found = [w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*", t or "") if not w.endswith("java")]
        parts = [p for w in found for p in ([w, *w.split(".")] if "." in w else [w])]
        return list(dict.fromkeys(p for p in parts if re.search("[a-z][A-Z]", p) or re.search("^[A-Z]{2,}[a-z]", p) or "." in p))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    for r in df.select("t", X.words(df.t).alias("w"), X.identifiers(df.t).alias("i")).collect():
        assert (list(r.w), list(r.i)) == (words(r.t), identifiers(r.t)), r.t


def test_votes_needed_reads_two_facts_only(spark, sf):
    from reviewlake.plans import QUERIES

    plan = QUERIES["prj31_votes_needed"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not {"style_new", "log_entries", "bugs_new"} & set(re.findall(r"\w+(?=#)", plan))


def test_tickets_of_few_trackers_stay_where_they_are(spark):
    """Nothing is dealt out by tracker, even where Spark wouldn't broadcast by itself."""
    raw = spark.range(20).selectExpr("if(id % 2 = 0, 'a', 'b') AS tracker", """concat('{"key": "P-', id, '", "fields": {"f1": [{"name": "n"}]}}') AS value""")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = records.tickets(raw, spark.createDataFrame([("a", "f1", "Reviewers")], "tracker string, id string, name string"), "u")
        assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString()
        assert {(r.key, len(r.reviewers)) for r in got.collect()} == {(f"P-{i}", 1 - i % 2) for i in range(20)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
