"""Cross-entropy differences against plain counting, with and without hot contexts and pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_text_ops import ODD, plain_words

from reviewlake.llm import lm


def plain_scores(rows, alpha=0.1):
    """rows: (id, text, target). Each row against the counts of all others."""
    docs = []
    for i, t, on in rows:
        w = plain_words(t)
        docs.append((i, list(zip(["\0start", *w], w, strict=False)), bool(on)))
    both, ctx = [Counter(), Counter()], [Counter(), Counter()]
    for _, ps, on in docs:
        for k in range(1 + on):
            both[k].update(ps)
            ctx[k].update(v for v, _ in ps)
    size = len({w for _, ps, _ in docs for _, w in ps}) + 1
    scale = max(1, sum(ctx[1].values())) / max(1, sum(ctx[0].values()))
    out = []
    for i, ps, on in docs:
        own, own_ctx = Counter(ps), Counter(v for v, _ in ps)
        s = 0.0
        for v, w in ps:
            b = ((both[0][v, w] - own[v, w]) * scale + alpha) / ((ctx[0][v] - own_ctx[v]) * scale + alpha * size)
            t = (both[1][v, w] - own[v, w] * on + alpha) / (ctx[1][v] - own_ctx[v] * on + alpha * size)
            s += math.log(b) - math.log(t)
        out.append((i, len(ps), s / max(1, len(ps))))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 3))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("hot,part_events", [(2000, 1 << 20), (2000, 50), (20, 100)])
def test_scores_equal_plain_counting(spark, hot, part_events):
    rng = random.Random(hot)
    words = ["the", "The", "of", "é", "x1", *[f"w{k}" for k in range(60)]]
    rows = [(i, " ".join(rng.choices(words, [30, 5, 20, 3, 3] + [1] * 60, k=rng.randint(0, 90))), i % 3 == 0) for i in range(80)]
    rows += [(200 + i, "the of " * 40 + "the end", i % 2 == 0) for i in range(6)] + [(7, "same row", True), (7, "same row", True), (None, "no id", None), (300, None, True), (301, "", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(3)
    got = lm.score(docs, F.col("good"), hot=hot, part_events=part_events).collect()
    same(got, plain_scores(rows))


def test_hot_pairs_are_scored_before_the_shuffle(spark):
    rows = [(i, "alpha beta " * 30 + f"tail{i}", i < 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(2)
    slim = docs.select(F.col("doc_id"), F.col("good"), F.col("text").cast("binary"))
    assert lm.statistics(slim, 0.1).filter("kind = 1").count() == 2
    same(lm.score(docs, F.col("good"), hot=10, part_events=64).collect(), plain_scores(rows))


@pytest.mark.parametrize("other", ["", "gamma gamma " * 30])
def test_pairs_and_contexts_just_below_hot(spark, other):
    """`alpha beta` is counted 0.75 to 1 times the share that makes a pair hot, and `alpha` hardly more often."""
    rows = [(i, "alpha beta " * 9 + "alpha end " + " ".join(f"w{i}x{k}" for k in range(80)) + " " + other, i % 3 == 0) for i in range(40)]
    n = sum(len(t.split()) for _, t, _ in rows)
    hot = int(n / (40 * 9 / 0.88))
    assert 0.75 * n / hot < 40 * 9 < 40 * 10 < n / hot
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").coalesce(1)
    same(lm.score(docs, F.col("good"), hot=hot, part_events=64).collect(), plain_scores(rows))


def test_odd_rows(spark):
    rows = [(i, t, i == 5) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score boolean")
    same(lm.score(docs, F.col("score")).collect(), plain_scores(rows))
    assert lm.score(docs.limit(0), F.col("score")).count() == 0
    assert all(math.isfinite(r.score) for r in lm.score(docs, F.lit(False)).collect())


def test_target_like_documents_score_lower(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs, (F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0)).join(docs, "doc_id").filter("doc_id % 2 = 1 AND n_words > 20")
    mean = {r.fr: r.s for r in got.groupBy((F.col("lang") == "fr").alias("fr")).agg(F.avg("score").alias("s")).collect()}
    assert mean[True] < mean[False]
