"""Reviewers' findings: which of them are one issue, and what comes of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import checkpointed, materialise


@dataclass(frozen=True)
class Merge:
    """Weights of shared identifiers and words, bonuses of near locations, and the two floors."""

    problem_identifiers: float = 0.4
    problem_words: float = 0.3
    fix_identifiers: float = 0.3
    near: float = 0.30
    mid: float = 0.15
    elsewhere: float = 0.10
    near_lines: int = 3
    mid_lines: int = 10
    text_floor: float = 0.18
    total_floor: float = 0.40


def by_text(df: DataFrame, texts: list[str], name: str, **made: F.Column) -> DataFrame:
    """df with columns made of texts. Each distinct text is worked on once, as findings of a rule say the same again and again, and what comes
    of it is written, so that Spark knows its size when it joins it back."""
    once = materialise(df.select(*texts).distinct().select(*texts, *[c.alias(k) for k, c in made.items()]), name)
    keys = [f"_k{i}" for i in range(len(texts))]
    same = reduce(lambda x, y: x & y, [F.col(t).eqNullSafe(F.col(k)) for t, k in zip(texts, keys, strict=True)])
    return df.join(once.withColumnsRenamed(dict(zip(texts, keys, strict=True))), same).drop(*keys)


def with_identifiers(findings: DataFrame) -> DataFrame:
    """findings with _idents, the number of identifiers in problem and fix."""
    return by_text(findings, ["problem", "fix"], "identifiers", _idents=F.size(X.identifiers(F.concat_ws(" ", "problem", "fix"))))


def ranked_member(*more: str | F.Column) -> F.Column:
    """What members of an issue are sorted by: worst severity, most identifiers (see with_identifiers), earliest."""
    return F.struct(X.severity_rank(F.col("severity")).alias("r"), (-F.col("_idents")).alias("n"), F.col("idx"), *more)


def issue_text(findings: DataFrame, membership: DataFrame) -> DataFrame:
    """pr, cluster, text: all that an issue says, in small letters: rule, problem and fix of its primary finding, fixes of others that differ
    from those before, and rule, problem and fix of every member."""
    g = with_identifiers(findings).join(membership, ["pr", "idx"]).groupBy("pr", "cluster").agg(F.sort_array(F.collect_list(ranked_member("rule", "problem", "fix"))).alias("m"))
    key = lambda x: F.lower(F.trim(x["fix"]))
    new = lambda x, k: (k > 0) & ~F.exists(F.slice("m", F.lit(1), k), lambda y: key(y) == key(x))
    also = F.transform(F.filter("m", new), lambda x: x["fix"])
    every = F.flatten(F.transform("m", lambda x: F.array(x["rule"], x["problem"], x["fix"])))
    return g.select("pr", "cluster", F.lower(F.array_join(F.concat(F.slice(every, 1, 3), also, every), " ")).alias("text"))


def panel_verdict(findings: DataFrame, panel: list[str]) -> DataFrame:
    """Per change: counts of each severity, must_fix, complete (all of the panel ran) and approved (complete, all approve, nothing to
    fix). findings: pr, lens, severity, approves."""
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in X.SEVERITIES]
    ran = F.count_distinct(F.when(F.col("lens").isin(*panel), F.col("lens")))
    g = findings.groupBy("pr").agg(*counts, (ran == len(panel)).alias("complete"), F.bool_and("approves").alias("_all")).withColumn("must_fix", F.col("blocker") + F.col("major"))
    return g.withColumn("approved", F.col("complete") & F.col("_all") & (F.col("must_fix") == 0)).drop("_all")


def token_sets(findings: DataFrame) -> DataFrame:
    """pr, idx, lens, the sets that scoring needs, and _n, the findings of the change; texts stay behind."""
    at = X.location(F.col("location"))
    slim = findings.select("pr", "idx", "lens", "problem", "fix", at["path"].alias("path"), at["line"].alias("line"))
    made = by_text(slim, ["problem"], "problem-sets", pi=X.identifiers(F.col("problem")), pw=X.words(F.col("problem")))
    made = by_text(made, ["fix"], "fix-sets", fi=X.identifiers(F.col("fix"))).drop("problem", "fix")
    return made.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("pr")))


SETS = ("pi", "pw", "fi")
SET_NAMES = (*SETS, "path", "line")


def candidate_pairs(sets: DataFrame, few: int = 64) -> DataFrame:
    """(pr, i, j, lens_i, lens_j, paths and lines of both as a_*, b_*, and of each kind of set how many members both have together, x_*, and
    either, y_*) of different lenses, i before j, that share a word or identifier; others score 0 in text and never pass.

    Changes of up to `few` findings compare each with each, at most few² / 2 pairs; in larger ones findings meet by an inverted index on
    (change, token), only where they share something. The pairs are the same either way.
    """
    end = lambda x, k, p: x.select("pr", F.col("idx").alias(k), F.col("lens").alias(f"lens_{k}"), *[F.col(n).alias(f"{p}_{n}") for n in SET_NAMES])
    small = sets.filter(F.col("_n") <= few)
    apart = (F.col("i") < F.col("j")) & (F.col("lens_i") != F.col("lens_j"))
    near = end(small, "i", "a").join(end(small, "j", "b"), "pr").filter(apart)

    large = sets.filter(F.col("_n") > few)
    marked = lambda c, m: F.transform(c, lambda x: F.concat(F.lit(m), x))
    tokens = F.concat(marked("pi", "p"), marked("pw", "w"), marked("fi", "f"))
    index = large.select("pr", "idx", "lens", F.explode(F.transform(F.array_distinct(tokens), lambda t: F.xxhash64(t))).alias("token"))
    met = index.select("pr", "token", F.col("idx").alias("i"), F.col("lens").alias("lens_i")).join(index.select("pr", "token", F.col("idx").alias("j"), F.col("lens").alias("lens_j")), ["pr", "token"])
    far = met.filter(apart).select("pr", "i", "j").distinct().join(end(large, "i", "a"), ["pr", "i"]).join(end(large, "j", "b"), ["pr", "j"])

    # as the row of a generator the counts are worked out once, where a filter would be pushed below a projection and repeat them
    shared = F.inline(F.array(F.struct(*[F.size(F.array_intersect(f"a_{n}", f"b_{n}")).alias(f"x_{n}") for n in SETS])))
    kept = ["pr", "i", "j", "lens_i", "lens_j", "a_path", "a_line", "b_path", "b_line"]
    sizes = [(F.size(f"a_{n}") + F.size(f"b_{n}")).alias(f"y_{n}") for n in SETS]
    counted = near.unionByName(far).select(*kept, *sizes, shared).filter(" + ".join(f"x_{n}" for n in SETS) + " > 0")
    return counted.select(*kept, *[f"x_{n}" for n in SETS], *[(F.col(f"y_{n}") - F.col(f"x_{n}")).alias(f"y_{n}") for n in SETS])


def scored(findings: DataFrame, cfg: Merge, few: int = 64) -> DataFrame:
    """pr, i, j, lens_i, lens_j, text and total score of every candidate pair, rounded to nine digits so that ties are ties."""
    sets = materialise(token_sets(findings), "token-sets")  # read several times
    p = candidate_pairs(sets, few)
    like = lambda n: F.coalesce(F.try_divide(F.col(f"x_{n}").cast("double"), F.col(f"y_{n}")), F.lit(0.0))
    text = cfg.problem_identifiers * like("pi") + cfg.problem_words * like("pw") + cfg.fix_identifiers * like("fi")
    far = F.abs(F.col("a_line") - F.col("b_line"))
    bonus = F.when(F.col("a_path").isNull() | F.col("b_path").isNull(), cfg.elsewhere).when(F.col("a_path") != F.col("b_path"), 0.0).when(far <= cfg.near_lines, cfg.near).when(far <= cfg.mid_lines, cfg.mid).otherwise(0.0)
    return p.select("pr", "i", "j", "lens_i", "lens_j", F.round(text, 9).alias("text"), F.round(text + bonus, 9).alias("total"))


def pair_scores(findings: DataFrame, cfg: Merge = Merge(), few: int = 64) -> DataFrame:
    """pr, i, j, text and total score of every candidate pair."""
    return scored(findings, cfg, few).drop("lens_i", "lens_j")


def edges(scores: DataFrame, cfg: Merge = Merge()) -> DataFrame:
    return scores.filter((F.col("text") >= cfg.text_floor) & (F.col("total") >= cfg.total_floor))


JOINED = "pr long, idx long, cluster long"


def walked(e: DataFrame, apart: bool = True) -> DataFrame:
    """(pr, idx, cluster) of the ends of edges (pr, i, j, lens_i, lens_j, total), each change's walked strongest first. Where findings of one
    lens needn't stay apart, edges (pr, i, j) join in any order.

    Edges are sorted within partitions and walked as they stream by, many changes a batch; held is one number and the lenses for
    each finding of the change that is being walked.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parent, lenses, bits = None, {}, {}, {}
        out: tuple[list, list, list] = ([], [], [])

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def close() -> None:
            out[0].extend([now] * len(parent))
            out[1].extend(parent)
            out[2].extend(map(root, list(parent)))

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["pr", "idx", "cluster"])
            for x in out:
                x.clear()
            return batch

        for batch in batches:
            ends = [batch.column(k).to_pylist() for k in range(3)]
            either = [batch.column(k).to_pylist() for k in (3, 4)] if apart else ends[1:]
            for pr, i, j, lens_i, lens_j in zip(*ends, *either, strict=True):
                if pr != now:
                    close()
                    now, parent, lenses, bits = pr, {}, {}, {}
                for x, lens in ((i, lens_i), (j, lens_j)):
                    if x not in parent:
                        parent[x], lenses[x] = x, 1 << bits.setdefault(lens, len(bits)) if apart else 0
                a, b = root(i), root(j)
                if a != b and not lenses[a] & lenses[b]:
                    a, b = min(a, b), max(a, b)
                    parent[b] = a
                    lenses[a] |= lenses[b]
            yield given()
        close()
        yield given()

    ends = [F.col(c).cast("long") for c in ("pr", "i", "j")]
    if not apart:
        return e.select(*ends).repartition("pr").sortWithinPartitions("pr").mapInArrow(walk, JOINED)
    x = e.select(*ends, "lens_i", "lens_j", "total").repartition("pr").sortWithinPartitions("pr", F.desc("total"), "i", "j")
    return x.drop("total").mapInArrow(walk, JOINED)


def dominant(e: DataFrame) -> DataFrame:
    """What walked gives, by rounds over all changes at once, so that no change need fit into a task.

    An edge that is the strongest at both of its clusters comes before all others there, so walking it first changes nothing: all such
    edges join in one round. Edges within a cluster, and between clusters with a lens in common, which stays so, are dropped. The edges
    of a round are a matching, and the strongest edge of all is always in it; each round's state is written.
    """
    ends = [e.select("pr", F.col(k).cast("long").alias("idx"), F.col(f"lens_{k}").alias("lens")) for k in "ij"]
    member = materialise(ends[0].unionByName(ends[1]).distinct().select("pr", "idx", F.col("idx").alias("cluster"), F.array("lens").alias("lenses")), "members")
    live = e.select("pr", F.col("i").cast("long").alias("a"), F.col("j").cast("long").alias("b"), F.struct(F.col("total").alias("t"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j")).alias("rank"))
    while True:
        state = member.groupBy("pr", "cluster").agg(F.array_distinct(F.flatten(F.collect_list("lenses"))).alias("l"))
        la, lb = (state.select("pr", F.col("cluster").alias(k), F.col("l").alias(f"l{k}")) for k in "ab")
        open_ = live.join(la, ["pr", "a"]).join(lb, ["pr", "b"]).filter((F.col("a") != F.col("b")) & ~F.arrays_overlap("la", "lb"))
        live = materialise(open_.select("pr", "a", "b", "rank"), "live-edges")
        if live.isEmpty():
            return member.select(F.col("pr").cast("long").alias("pr"), "idx", "cluster")
        at = live.select("pr", F.col("a").alias("c"), "rank").unionByName(live.select("pr", F.col("b").alias("c"), "rank")).groupBy("pr", "c").agg(F.max("rank").alias("best"))
        ba, bb = (at.select("pr", F.col("c").alias(k), F.col("best").alias(f"best_{k}")) for k in "ab")
        first = live.join(ba, ["pr", "a"]).join(bb, ["pr", "b"]).filter((F.col("rank") == F.col("best_a")) & (F.col("rank") == F.col("best_b")))
        moved = checkpointed(first.select("pr", F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new")))
        to = lambda c: moved.select("pr", F.col("old").alias(c), F.col("new").alias(f"new_{c}"))
        member = materialise(member.join(to("cluster"), ["pr", "cluster"], "left").select("pr", "idx", F.coalesce("new_cluster", "cluster").alias("cluster"), "lenses"), "members")
        live = live.join(to("a"), ["pr", "a"], "left").join(to("b"), ["pr", "b"], "left").select("pr", F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"), "rank")


def clusters(findings: DataFrame, cfg: Merge = Merge(), most: int = 1 << 20, few: int = 64) -> DataFrame:
    """pr, idx, cluster (the least idx in it): pairs join strongest first, but never two findings of one lens.

    The order of joins matters. Changes of up to `most` edges are walked, many in a batch; the edges of larger ones join in rounds of
    locally strongest ones (see dominant). Both give what a walk of all edges in order gives. Findings without an edge stay alone.
    """
    e = materialise(edges(scored(findings, cfg, few), cfg).select("pr", "i", "j", "lens_i", "lens_j", "total"), "edges")
    large = checkpointed(e.groupBy("pr").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("pr"))
    if large.isEmpty():
        joined = walked(e)
    else:
        joined = walked(e.join(large, "pr", "left_anti")).unionByName(dominant(e.join(large, "pr", "left_semi")))
    own = findings.select("pr", "idx")
    return own.join(joined, ["pr", "idx"], "left").select("pr", F.col("idx").cast("long").alias("idx"), F.coalesce("cluster", F.col("idx").cast("long")).alias("cluster"))


def issues(findings: DataFrame, membership: DataFrame) -> DataFrame:
    """One row per cluster: the primary finding (worst severity, most identifiers, earliest), members, lenses, locations,
    other fixes, and a number within the change by severity, lenses, earliest."""
    f = with_identifiers(findings).join(membership, ["pr", "idx"])
    member = ranked_member("id", "severity", "lens", "location", "rule", F.lower(F.trim("fix")).alias("fix"))
    g = f.groupBy("pr", "cluster").agg(F.sort_array(F.collect_list(member)).alias("m"))
    m = lambda c: F.col(f"m.{c}").alias(c)
    g = g.withColumn("_p", F.sort_array(F.arrays_zip(m("idx"), m("lens"), m("location"))))
    out = g.select(
        "pr", "cluster", m("id")[0].alias("primary"), m("severity")[0].alias("severity"), m("rule")[0].alias("rule"), m("r")[0].alias("_r"),
        F.sort_array(F.arrays_zip(m("r"), m("severity")))["severity"].alias("spread"), F.array_distinct("_p.lens").alias("lenses"), F.array_distinct("_p.location").alias("locations"),
        m("id").alias("members"), (F.size(F.array_distinct("m.fix")) - 1).alias("other_fixes"), F.col("_p.idx")[0].alias("_first"),
    )
    w = W.partitionBy("pr").orderBy("_r", -F.size("lenses"), "_first")
    return out.withColumn("issue", F.concat(F.lit("issue-"), F.row_number().over(w).cast("string"))).drop("_r", "_first")


def issues_of(findings: DataFrame, stored: DataFrame, cfg: Merge = Merge()) -> DataFrame:
    """pr, issue, primary: the stored issues of a change, else those its findings make."""
    rest = findings.join(stored.select("pr").distinct(), "pr", "left_anti")
    return stored.select("pr", "issue", "primary").unionByName(issues(rest, clusters(rest, cfg)).select("pr", "issue", "primary"))


def connected(e: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(pr, idx, root) of unconstrained components: changes of up to `most` edges are walked, many in a batch; larger ones go by rounds
    over all their edges (see spread)."""
    e = materialise(e.select("pr", "i", "j"), "links")
    large = checkpointed(e.groupBy("pr").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("pr"))
    if large.isEmpty():
        return walked(e, apart=False).withColumnRenamed("cluster", "root")
    return walked(e.join(large, "pr", "left_anti"), apart=False).withColumnRenamed("cluster", "root").unionByName(spread(e.join(large, "pr", "left_semi")))


def spread(e: DataFrame) -> DataFrame:
    """(pr, idx, root): each round takes the least label around and then that label's own, so labels travel ever further, until none
    moves; checkpointed each round."""
    both = checkpointed(e.select("pr", "i", "j").unionByName(e.select("pr", F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    labels = both.select("pr", "i", F.col("i").alias("root")).distinct()
    while True:
        near = both.join(labels.select("pr", F.col("i").alias("j"), "root"), ["pr", "j"]).groupBy("pr", "i").agg(F.min("root").alias("near"))
        low = labels.join(near, ["pr", "i"]).select("pr", "i", "root", F.least("root", "near").alias("low"))
        jump = low.select("pr", F.col("i").alias("low"), F.col("low").alias("far"))
        new = checkpointed(low.join(jump, ["pr", "low"]).select("pr", "i", F.least("low", "far").alias("root"), (F.least("low", "far") < F.col("root")).alias("moved")))
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels.withColumnRenamed("i", "idx")


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def window_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k token hashes, from a running sum: each costs two look-ups, whatever k is."""
    n = len(tokens)
    if n < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up, dtype=np.uint64)])
        x = (total[k:] - total[:-k]) * down[: n - k + 1]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def tokens(text: str) -> F.Column:
    """The tokens of a text."""
    return F.split(F.trim(F.regexp_replace(text, BLANKS, " ")), " ")


def token_hashes(words: str | F.Column) -> F.Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def minimisers(tokens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): of each run of windows of k tokens that have one and the same minimiser, its hash and the places of its windows.
    The minimiser of a window is the least hash among its runs of k // 2 tokens, so equal windows have equal ones."""
    half = max(1, k // 2)
    g = window_hashes(tokens, half)
    span = k - half + 1
    at = np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)
    first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
    return g[at[first]], first, np.concatenate([first[1:], [len(at)]]) - 1


def earlier(h: np.ndarray) -> np.ndarray:
    """For each place the one before it with the same value, else -1."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.full(len(h), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def each_row(df: DataFrame, names: list[str], schema: str, make):
    """df's columns `names`, repeated for the rows that make(row's arrays) gives as a list of columns for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                more = make({c: one.column(i)[0] for i, c in enumerate(one.schema.names)})
                same = pa.array(np.zeros(len(more[0]), np.int32))
                yield pa.RecordBatch.from_arrays([one.column(one.schema.get_field_index(c)).take(same) for c in names] + [pa.array(m) for m in more], names=[*names, *[x.split()[0] for x in schema.split(", ")]])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)
    return df.mapInArrow(run, f"{kept}, {schema}")


def duplicate_blocks(docs: DataFrame, k: int = 100, group: str | None = None) -> DataFrame:
    """Runs of at least k equal tokens: doc_a, start_a, doc_b, start_b, tokens.

    Each place at which k tokens stand that stand earlier too is compared with one earlier place: the one before it in its own document,
    else the first in the first document that has them, never all with all; so a passage in many documents gives a row for each, and all
    of them name the same first holder (holders gives them together). A run is as long as the tokens of both agree, wherever other
    documents stop agreeing. With `group`, only places of one group are compared.

    Of each text only minimisers are shuffled, two for some 52 windows at k = 100. Windows are made where a minimiser is found twice, and
    meet by their hash; then the tokens themselves are compared outwards from there to both ends, so a chance collision gives no
    row. Texts move once for each two documents that share places, not for each place, and only those of such documents; tokens are never moved. Frequent passages need no pruning, as none is compared with more than one other.
    """
    by = [group] if group else []
    names = [*by, "doc_id"]
    docs = docs.select(*names, "text")
    t = docs.select(*names, tokens("text").alias("words")).filter(F.size("words") >= k).select(*names, token_hashes("words").alias("t"))
    marks = each_row(t, names, "m long, from int, to int", lambda r: [x.view(np.int64) if n == 0 else x.astype(np.int32) for n, x in enumerate(minimisers(r["t"].values.to_numpy().view(np.uint64), k))])
    marks = materialise(marks, "minimisers")
    twice = marks.groupBy("m", *by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    spans = marks.join(twice, ["m", *by], "left_semi").groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    held = docs.join(spans, names).select(*names, "spans", token_hashes(tokens("text")).alias("t"))  # the documents with anything twice

    def windows(r: dict) -> list:
        h = window_hashes(r["t"].values.to_numpy().view(np.uint64), k)
        spans = r["spans"].values.flatten()
        at = np.unique(np.concatenate([np.arange(a, z + 1) for a, z in zip(spans[0].to_pylist(), spans[1].to_pylist(), strict=True)]))
        at = at[at < len(h)]
        before = earlier(h[at])
        return [h[at].view(np.int64), at.astype(np.int32), np.where(before < 0, -1, at[before]).astype(np.int32)]

    w = materialise(each_row(held, names, "h long, pos int, before int", windows), "windows")
    first = w.filter("before < 0")
    heads = first.groupBy("h", *by).agg(F.min(F.struct("doc_id", "pos")).alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    across = first.join(heads, ["h", *by]).filter(F.col("doc_id") > F.col("a.doc_id")).select(*by, F.col("a.doc_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), (F.col("a.pos") - F.col("pos")).alias("shift"), "pos")
    within = w.filter("before >= 0").select(*by, F.col("doc_id").alias("doc_a"), F.col("doc_id").alias("doc_b"), (F.col("before") - F.col("pos")).alias("shift"), "pos")
    by_shift = W.partitionBy(*by, "doc_a", "doc_b", "shift").orderBy("pos")
    hits = across.unionByName(within).withColumn("run", F.col("pos") - F.row_number().over(by_shift))
    seeds = hits.groupBy(*by, "doc_a", "doc_b", "shift", "run").agg(F.min("pos").alias("lo"), (F.max("pos") + k).alias("hi"))
    pairs = seeds.groupBy(*by, "doc_a", "doc_b").agg(F.collect_list(F.struct("shift", "lo", "hi")).alias("seeds"))
    pairs = materialise(pairs, "pairs")  # read twice
    named = pairs.select(*by, F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    texts = docs.join(named, names, "left_semi")
    side = lambda c: texts.select(*by, F.col("doc_id").alias(f"doc_{c}"), F.col("text").alias(f"text_{c}"))
    met = pairs.join(side("b"), [*by, "doc_b"]).join(side("a"), [*by, "doc_a"])
    both = met.select("doc_a", "doc_b", "seeds", tokens("text_a").alias("words_a"), tokens("text_b").alias("words_b")).withColumn("s", F.explode("seeds")).select("doc_a", "doc_b", "words_a", "words_b", "s.*")

    # both sides from where the later text begins, or the earlier one, to where either ends: no longer than the later text
    start = F.greatest(F.lit(0), -F.col("shift"))
    long = F.least(F.size("words_b"), F.size("words_a") - F.col("shift")) - start
    cut = both.withColumn("start", start).withColumn("a", F.slice("words_a", start + F.col("shift") + 1, long)).withColumn("b", F.slice("words_b", start + 1, long)).drop("words_a", "words_b")
    unlike = F.filter(F.transform(F.zip_with("a", "b", lambda x, y: x == y), lambda same, i: F.when(~same, i)), lambda i: i.isNotNull())
    lo, hi = F.col("lo") - F.col("start"), F.col("hi") - F.col("start")
    left = F.coalesce(F.array_max(F.filter("unlike", lambda i: i < lo)) + 1, F.lit(0))
    right = F.coalesce(F.array_min(F.filter("unlike", lambda i: i >= lo)), F.size("b"))
    grown = cut.withColumn("unlike", unlike).filter(~F.exists("unlike", lambda i: (i >= lo) & (i < hi)))
    out = grown.select("doc_a", (left + F.col("start") + F.col("shift")).alias("start_a"), "doc_b", (left + F.col("start")).alias("start_b"), (right - left).alias("tokens"))
    return out.distinct()


def holders(blocks: DataFrame) -> DataFrame:
    """(doc_a, start_a, tokens, doc_id, start, copies): every place of each passage that blocks name, the first holder's too, and how many there are."""
    passage = ["doc_a", "start_a", "tokens"]
    copies = blocks.select(*passage, F.col("doc_b").alias("doc_id"), F.col("start_b").alias("start"))
    first = blocks.select(*passage).distinct().select(*passage, F.col("doc_a").alias("doc_id"), F.col("start_a").alias("start"))
    n = blocks.groupBy(*passage).agg((F.count(F.lit(1)) + 1).alias("copies"))
    return copies.unionByName(first).join(n, passage)
