"""Text operators against brute force, and on odd rows: nulls, empty and very long texts, ties, repeats, clashing names."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from reviewlake.llm import decontaminate, pieces, pii, quality, simhash

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h i j k l m n o p"), (6, "a b c d e f g h i j k l m n o p"), (6, "a b c d e f g h i j k l m n o p"),
    (7, "word " * 30_000), (8, "x" * 60_000), (9, "1" * 50_000), (10, "é à 日本 🎉▁  ▁"), (None, "null id"), (11, "mail a.b@c.de or +1 (743) 555-3824, 10.0.0.1 and 4465758382889437"), (12, "@" * 20_000),
]


def odd(spark, extra=()):
    rows = [(i, t, "x") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, keep string").select("*", *[F.lit(7).alias(c) for c in extra])


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# -- pieces


def test_encoder_equals_library(spark, sf):
    e, sp = pieces.encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(7)
    alphabet = "abcdefgh theTHE\n.,'!0123éüß日本語中한🎉▁   \t€\0"
    vocabulary = list(e.id_of)
    cases = [t or "" for _, t in ODD] + [t for _, t in texts(spark, sf)[:60]] + ["<s> </s> <unk> <0x0A>", "   the   ", "▁" * 37 + "a"]
    cases += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(2000)]
    cases += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8))).replace("▁", " ") for _ in range(3000)]
    cases += ["".join(rng.choice([" " * rng.randint(1, 40), "▁" * rng.randint(1, 9), "a", "the", " in", "日"]) for _ in range(rng.randint(1, 6))) for _ in range(3000)] + [" " * n for n in range(70)]
    for t in cases:
        ids = sp.encode(t)
        assert e.encode(t) == ids, t[:60]
        assert e.decode(ids) == sp.decode(ids), t[:60]
    for _ in range(3000):
        ids = [rng.randrange(rng.choice((300, 32000))) for _ in range(5)]
        assert e.decode(ids) == sp.decode(ids), ids


def test_piece_digests(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.digests(odd(spark, ["n_tokens"]), MODEL).collect()
    assert len(got) == len(ODD)
    for r in got:
        ids = sp.encode(r.text or "")
        assert (r.n_tokens, r.keep) == (len(ids), "x")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.digests(odd(spark).limit(0), MODEL).count() == 0
    back = pieces.decode(pieces.encode(odd(spark), MODEL), MODEL).collect()
    assert all(r.decoded == sp.decode(sp.encode(r.text or "")) for r in back)


# -- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_contamination(text, items, length=13):
    words, hit, ids = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        m = min(len(w), length)
        for a in range(len(w) - m + 1 if w else 0):
            for b in range(len(words) - m + 1):
                if words[b : b + m] == w[a : a + m]:
                    hit.update(range(b, b + m))
                    ids.update([] if item is None else [str(item)])
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "é", "Q", "7"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 2, 3, 5, 12, 13, 14, 20, 30])] + [(50, None), (51, ""), (52, "a-b!!c"), (52, "zz"), (None, "no id"), (None, "b a b a")]
    items[0] = (0, "lonely")
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), 1) for i in range(30)]
    docs += [(100 + i, f"start {t} END {t}", 1) for i, (_, t) in enumerate(items) if t] + [(5, "no id", 1), (5, "no id", 1)] + [(i, t, 1) for i, t in ODD if t is None or len(t) < 1000]
    rows = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(rows, bench, block_bytes=block_bytes).collect()
    assert sorted(str(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))) for r in got) == sorted(str((i, *plain_contamination(t, [x for x in items if x[1]]))) for i, t, _ in docs)


def test_tables_are_small():
    """A block of benchmark text makes tables of some ten times its size, not of hundreds of times."""
    rng = random.Random(4)
    texts = [(str(k), " ".join(f"w{rng.randrange(60_000)}" for _ in range(400)).encode()) for k in range(400)]
    made = decontaminate.WuManber(texts)
    assert made.nbytes() < 20 * sum(len(t) for _, t in texts)
    spans, items = made.search(decontaminate.words_of(b"x " + texts[7][1] + b" y " + texts[3][1][:300]))
    assert spans[0:2] == [1, 401] and len(spans) == 4 and items == {"7", "3"}


def test_many_windows_with_one_block():
    """All windows end and begin alike; the words between decide."""
    rng = random.Random(5)
    texts = [(str(k), b"a b " + " ".join(rng.choice("cd") for _ in range(9)).encode() + b" e f") for k in range(300)]
    made = decontaminate.WuManber(texts)
    for k in (0, 150, 299):
        spans, items = made.search(decontaminate.words_of(b"q " + texts[k][1] + b" q"))
        assert spans == [1, 14] and items == {i for i, t in texts if t == texts[k][1]}


def test_contamination_of_odd_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(odd(spark), none).collect()
    assert len(got) == len(ODD) and not any(r.contaminated or r.n_hit for r in got)
    assert next(r.n_words for r in got if r.doc_id == 7) == 30_000


def test_remembered_parts_are_bounded():
    e = pieces.encoder(MODEL)
    rng = random.Random(6)
    e.remember = 1000
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for n in range(300):
        t = " ".join("".join(rng.choice("abcdefgh+/XYZ0123456789") for _ in range(rng.choice([5, 10_000 if n % 30 == 0 else 50]))) for _ in range(20))
        assert e.encode(t) == sp.encode(t)
        assert len(e.found) <= 1000 and max(map(len, e.found), default=0) <= pieces.LONGEST and len(e.fits) <= 2001


def test_training_rows_of_an_id_with_many_texts_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(0, f"text number {k} of one id, with words.") for k in range(500)] + [(1, "x y z"), (7, "a " * 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (7, 0), (999, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    quality.train(docs, labels, sample=60)
    assert 20 <= seen[0] <= 120


# -- simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    s = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: (id, fingerprint); component by breadth-first search."""
    out = {}
    for i, f in sorted(fps, key=lambda x: (x[0] is None, x[0])):
        if f in out:
            continue
        reach, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for _, g in fps:
                if g not in reach and (x ^ g).bit_count() <= 2:
                    reach.add(g)
                    todo.append(g)
        for g in reach:
            out[g] = i
    return out


def test_simhash_equals_brute_force(spark, sf):
    rows = texts(spark, sf)[:120] + [(1000 + i if i is not None else None, t) for i, t in ODD if t is None or len(t) < 40_000]
    base = rows[3][1].split()
    rows += [(5000 + k, " ".join(base[: len(base) - k])) for k in range(1, 9)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components(fps)
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(str((i, f"{f:016x}", comp[f])) for i, f in fps)


def test_fingerprint_of_slices(monkeypatch):
    rng = random.Random(8)
    for n in (0, 1, 2, 3, 4, 9, 10, 11, 50):
        t = " ".join(rng.choice("abcdefg") for _ in range(n))
        for step in (1, 2, 7, 1 << 16):
            monkeypatch.setattr(simhash, "STEP", step)
            assert simhash.fingerprint(t.encode()) % (1 << 64) == plain_fingerprint(t)


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("hot", [1, 8])
def test_links_are_all_close_pairs(spark, hot, distance):
    """A ball around one fingerprint, so that its blocks are split again and again."""
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0}
    for _ in range(240):
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        fps.add(x)
    fps |= {x ^ 1 << rng.randrange(64) for x in list(fps)[:40]}
    as_long = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in as_long], "fp long"), distance, hot).collect()}
    assert got == {(u, v) for k, v in enumerate(as_long) for u in as_long[:k] if ((u ^ v) & (1 << 64) - 1).bit_count() <= distance}


@pytest.mark.parametrize("hot", [1, 4, 64])
def test_links_connect_what_brute_force_connects(spark, hot):
    rng = random.Random(hot)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(12):
            g = f
            for _ in range(rng.randint(0, 3)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot=hot)
    assert edges.filter("bit_count(u ^ v) > 2").count() == 0
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_components([(s, f) for f, s in zip(fps, signed, strict=True)])
    assert [root.get(s, s) for s in signed] == [want[f] for f in fps]


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("(id * 7919) % 10007 AS u", "((id + 1) * 7919) % 10007 AS v").selectExpr("least(u, v) u", "greatest(u, v) v")
    assert simhash.components(edges).select("root").distinct().count() == 1


# -- personal data

KIND = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def ok(kind, s):
        d = re.sub(r"[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            v = [int(c) for c in d[::-1]]
            return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(v)) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, rx in KIND.items() for m in re.finditer(rx, text) if ok(k, m[0])]


def test_base_spans_equal_brute_force(spark, sf):
    rng = random.Random(5)
    cases = [t for _, t in texts(spark, sf)] + [t for _, t in ODD if t and len(t) < 5000]
    cases += ["".join(rng.choice("ab.@-+%_ 0123456789().é") for _ in range(rng.randint(1, 80))) for _ in range(4000)]
    cases += ["".join(rng.choice(["1.2.3.4", ".", "a@b.c", "@", "4465758382889437", " ", "-", "+1 (743) 555-3824", "7"]) for _ in range(9)) for _ in range(2000)]
    for t in cases:
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == plain_spans(t), t


def test_pii_rows(spark):
    rows = odd(spark, ["spans"])
    got = pii.find(rows).collect()
    assert len(got) == len(ODD)
    for r in got:
        base = plain_spans(r.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in KIND]
        joined = [f"{k}:{s}:{e}" for k, s, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}
    assert pii.find(rows.limit(0)).count() == 0
    red = {r.doc_id: r.text for r in pii.redact(odd(spark)).collect()}
    assert red[11] == "mail [EMAIL] or [PHONE], [IP] and [CARD]" and red[1] is None


LONG = ["0" * 5000 + ".1.1.1", "1.2.3." + "9" * 6000, "7" * 5000 + ".0.0.1", "0" * 4999 + "255.1.1.1", "+" + "5" * 9000, ("12 " * 9000).strip(), "1." * 6000]


def test_long_runs_of_digits(spark):
    assert pii.base_spans(LONG[0]) == [(1, 0, 5006)] and pii.base_spans(LONG[3]) == [(1, 0, 5008)]
    assert [pii.octet(d) for d in ("0", "255", "256", "0256", "1000", "99", "00000")] == [True, True, False, False, False, True, True]
    rows = spark.createDataFrame(list(enumerate(LONG)), "doc_id long, text string")
    assert len(pii.find(rows).collect()) == len(LONG) and pii.redact(rows).filter("doc_id = 0").first().text == "[IP]"


def test_labels_and_clear_spans_equal_plain_search():
    rng = random.Random(11)
    for _ in range(400):
        spans = lambda n, most: [(rng.randrange(4), s, s + rng.randint(1, most)) for s in (rng.randrange(60) for _ in range(n))]  # noqa: B023, E731
        base, more = spans(rng.randint(0, 30), 25), spans(9, 12)
        assert pii.clear_of(base, more) == [x for x in more if not any(s < x[2] and e > x[1] for _, s, e in base)]
        tokens = [pii.Token(s, s + 3, "123") for s in range(0, 60, 4)]
        order = sorted(base, key=lambda x: (x[1], x[0]))
        assert pii.base_labels(tokens, base) == [next((k + 1 for k, s, e in order if s < t.end and e > t.start), 0) for t in tokens]


def test_pseudo_likelihood_gradient():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (12, 3)), rng.integers(0, 5, 12)
    edges = np.array([(t, a, a + d) for t, d in ((0, 1), (1, 3), (2, 5)) for a in range(12 - d) if rng.random() < 0.7])
    w, p = rng.normal(size=(6, 5)), rng.normal(size=(3, 5, 5))
    p[1:] = (p[1:] + p[1:].transpose(0, 2, 1)) / 2
    _, gw, gp = pii.pseudo_likelihood(w, p, x, y, edges)
    for at in np.ndindex(w.shape):
        d = np.zeros_like(w)
        d[at] = 1e-5
        slope = (pii.pseudo_likelihood(w + d, p, x, y, edges)[0] - pii.pseudo_likelihood(w - d, p, x, y, edges)[0]) / 2e-5
        assert abs(slope - gw[at]) < 1e-5
    for t, i, j in np.ndindex(p.shape):
        d = np.zeros_like(p)
        d[t, i, j] += 1e-5
        d[t, j, i] += 1e-5 * (t > 0)
        slope = (pii.pseudo_likelihood(w, p + d, x, y, edges)[0] - pii.pseudo_likelihood(w, p - d, x, y, edges)[0]) / 2e-5
        want = gp[t, i, j] if t == 0 else gp[t, i, j] + gp[t, j, i]
        assert abs(slope - want) < 1e-5


def crf_of_repeats():
    """A field trained on texts that name an address twice, and numbers between."""
    docs = []
    for k in range(60):
        t = f"host 10.{k}.0.1 runs job {k} on port 80{k} until 10.{k}.0.1 stops, mail a{k}@b.org or +1 (2{k:02d}) 555-01{k:02d} page {k} of 99, see a{k}@b.org"
        tokens = pii.tokens_of(t)
        docs.append((tokens, pii.base_labels(tokens, pii.base_spans(t))))
    return pii.SkipChain(docs), docs


def plain_marginals(model, tokens, seen):
    """Beliefs by summing over all labellings."""
    node, edges = model.nodes(tokens, seen), model.edge_table(tokens)
    out = np.zeros_like(node)
    for labels in itertools.product(range(5), repeat=len(tokens)):
        z = sum(node[i, v] for i, v in enumerate(labels)) + sum(model.potential[t][labels[a], labels[b]] for t, a, b in edges)
        for i, v in enumerate(labels):
            out[i, v] += np.exp(z)
    return out / out.sum(axis=1, keepdims=True)


def test_beliefs_equal_sums_over_all_labellings():
    model, _ = crf_of_repeats()
    model.rounds = 60
    for text, loops in (("one 10.2.3 far away from 10.2.3 and yet 17", False), ("ab 12 c345 6.7 8-9", False), ("x 999.1.2.3 then a@b near 999.1.2.3 or a@b", True)):
        tokens = pii.tokens_of(text)
        for seen in ([0] * len(tokens), [2] + [0] * (len(tokens) - 1)):
            got, want = model.marginals(tokens, seen), plain_marginals(model, tokens, seen)
            assert np.abs(got - want).max() < (0.15 if loops else 1e-6)


def test_skip_edges_carry_labels():
    """A token takes over the label that its repetition elsewhere is held at, by the skip edge alone."""
    model, docs = crf_of_repeats()
    tokens = pii.tokens_of("server 10.2.3 was seen long before the other words, then 10.2.3 again")
    assert len(tokens) == 2 and model.edge_table(tokens)[:, 0].tolist() == [1]
    free, held = model.marginals(tokens, [0, 0])[1], model.marginals(tokens, [2, 0])[1]
    assert np.log(held[2] / held[0]) > np.log(free[2] / free[0]) + 0.5
    model.potential[1:] = 0
    assert np.allclose(model.marginals(tokens, [2, 0])[1], model.marginals(tokens, [0, 0])[1])
    again, _ = crf_of_repeats()
    got = [model.marginals(ts, [0] * len(ts)).argmax(axis=1).tolist() for ts, _ in docs]
    with_edges = [again.marginals(ts, [0] * len(ts)).argmax(axis=1).tolist() for ts, _ in docs]
    right = lambda x: sum(a == b for p, (_, ls) in zip(x, docs, strict=True) for a, b in zip(p, ls, strict=True))
    assert right(with_edges) >= right(got) and right(with_edges) > 0.98 * sum(len(ls) for _, ls in docs)


def test_added_spans_are_sure_tokens_clear_of_base(spark, sf):
    """Added spans of the given documents, worked out again token by token."""
    model = pii.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    for _, t in texts(spark, sf)[:80]:
        base, spans = model.spans(t)
        tokens = pii.tokens_of(t)
        p = model.marginals(tokens, pii.base_labels(tokens, base)) if tokens else []
        more = [(int(q.argmax()) - 1, x.start, x.end) for x, q in zip(tokens, p, strict=True) if q.argmax() and q.max() > 0.9 and not any(s < x.end and e > x.start for _, s, e in base)]
        assert spans == sorted(base + more)


# -- quality


def test_scores_are_table_sums(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert model.pairs and len(model.single) == len(quality.FEATURES)
    got = quality.classify(docs.select("doc_id", "text"), model).collect()
    for r in got[:50]:
        x = quality.features(r.text.encode())
        b = [int((e <= v).sum()) for e, v in zip(model.edges, x, strict=True)]
        z = model.base + sum(t[k] for t, k in zip(model.single, b, strict=True)) + sum(t[b[i], b[j]] for i, j, t in model.pairs)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and r.predicted == int(r.score >= 0.5)


def test_quality_is_learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("crc32(cast(doc_id as string)) % 3 = 1")
    got = quality.classify(docs, quality.train(docs, labels)).join(held, "doc_id").select("predicted", "quality", "score").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.97


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, None, 0), (9, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = quality.train(odd(spark), some)
        got = quality.classify(odd(spark, ["score"]), model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(odd(spark).limit(0), labels).count() == 0
