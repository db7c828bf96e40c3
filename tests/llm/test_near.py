"""Near copies against brute force over shingle sets."""

import random

import corpus_pipeline
import pytest

from reviewlake.llm import near


def plain_set(text):
    w = (text or "").lower().split()
    return {" ".join(w)} - {""} if len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_groups(rows):
    """Lists of row numbers that chains of pairs of similarity 0.8 or more join."""
    sets = [plain_set(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 10 >= len(a | b) * 8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [[i for i, g in enumerate(group) if g == x] for x in set(group)]


def planted(rng):
    """Rows of 40 families: a text of 300 words, and copies of it with up to 9 words changed (similarity 0.74 to 1)."""
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for _ in range(40):
        base = [word() for _ in range(300)]
        for changes in (0, 1, 3, 5, 6, 7, 9):
            text = list(base)
            for at in rng.sample(range(300), changes):
                text[at] = word()
            rows.append((len(rows), " ".join(text)))
    return rows


def test_resemblance_counts_differing_minima(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    pairs = []
    for _ in range(60):
        a = rng.sample(words, 300)
        b = list(a)
        for at in rng.sample(range(300), rng.randint(0, 30)):
            b[at] = "x"
        pairs.append(tuple(near.minima(near.shingles(" ".join(t).encode())) for t in (a, b)))
    rows = [tuple(near.signature(m).view("int64").tolist() for m in p) for p in pairs]
    got = [r[0] for r in spark.createDataFrame(rows, "sig_u array<long>, sig_v array<long>").select(near.resembling(80)).collect()]
    differ = [int(((near.mixed(a) & near.U(15)) != (near.mixed(b) & near.U(15))).sum()) for a, b in pairs]
    n, p = 125, 0.2 * 15 / 16
    assert got == [d <= n * p + 4 * (n * p * (1 - p)) ** 0.5 for d in differ] and len(set(got)) == 2


@pytest.mark.parametrize("hot", [4, 64])
def test_planted_near_copies(spark, hot):
    rows = planted(random.Random(5)) + [(9000, None), (9001, ""), (9002, "two words"), (9003, "Two  words")]
    got = near.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
    assert sorted(r.doc_id for r in got.collect()) == sorted(rows[min(g)][0] for g in plain_groups(rows))


def test_rows_are_told_apart_by_id_and_text(spark):
    """Rows without an id or with a repeated one stay when they are unlike; a copy goes though its id has another row."""
    text = lambda x, n=30: " ".join(f"{x}{k}" for k in range(n))
    rows = [(None, text("a"), 1), (None, text("b"), 2), (5, text("c"), 3), (5, text("d"), 4), (5, text("d"), 4), (1, text("e"), 5), (6, text("e"), 6), (6, text("f"), 7), (None, text("e"), 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = corpus_pipeline.distinct(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.row for r in got.collect()) == [1, 2, 3, 4, 5, 7]
    assert near.keep_one(docs.limit(0)).count() == 0


def test_stage_drops_near_copies_beyond_two_bits(spark):
    rows = planted(random.Random(6))
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(rows[min(g)][0] for g in plain_groups(rows))


def test_pairs_in_a_hot_family(spark):
    """1,000 texts that share boilerplate and resemble each other by some 0.75; 60 of them have a partner by 0.82, which must be found."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    common = [word() for _ in range(257)]
    rows, partner = [], {}
    for i in range(1000):
        rows.append((i, " ".join(common + [word() for _ in range(43)])))
    for i in range(0, 960, 16):
        base = rows[i][1].split()
        for at in rng.sample(range(300), 6):
            base[at] = word()
        partner[i] = len(rows)
        rows.append((len(rows), " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in near.keep_one(docs).collect()}
    sets = [plain_set(t) for _, t in rows]
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.7 < similar(0, 1) < 0.8 and all(similar(a, b) >= 0.8 for a, b in partner.items())
    assert set(range(1000)) <= kept
    lost = [b for b in partner.values() if b in kept]
    assert len(lost) <= 0.1 * len(partner), f"recall {1 - len(lost) / len(partner)}"
    assert not lost, "prefix filtering is exact"


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_prefix_pairs_lose_nothing(spark, percent):
    rng = random.Random(percent)
    sets = []
    for _ in range(12):
        base = rng.sample(range(10**6), rng.randint(1, 60))
        for _ in range(12):
            sets.append(sorted({v for v in base if rng.random() > 0.12} | {rng.randrange(10**6) for _ in range(rng.randint(0, 6))} | set(range(7)) or {1}))
    rows = [(i, len(x), rng.choice([i, i, i // 12 * 12]), x) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, n int, root long, set array<long>")
    got = {(r.u, r.v) for r in near.prefix_pairs(df.drop("set"), df.select("node", "set"), percent).collect()}
    link = lambda a, b: len(set(a) & set(b)) * 100 >= percent * len(set(a) | set(b))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if rows[i][2] != rows[j][2] and link(sets[i], sets[j])}
    assert want and want <= got and len(got) < len(sets) ** 2 / 4
