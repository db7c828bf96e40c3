"""The pipeline and the registered queries on a small corpus, against brute force."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from test_near import plain_groups
from test_text_ops import plain_components, plain_contamination, plain_fingerprint, plain_spans

from reviewlake.llm import pii, quality, queries

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.MODEL_FILE))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of tables: 90 documents of the given ones, with copies, near copies, contaminated ones and odd rows."""
    sf = str(tmp_path_factory.mktemp("small"))
    given = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{given}/documents.parquet")
    bench = spark.read.parquet(f"{given}/benchmark.parquet")
    schema = docs.schema
    rows = [tuple(r) for r in docs.orderBy("doc_id").limit(90).collect()]
    items = [tuple(r) for r in bench.collect()]
    long = next(r for r in rows if len(r[1]) > 1500)
    extra = [(1000, long[1], "en", "src1", 0), (1001, long[1] + " tail", "en", "src1", 0), (1002, items[0][1] + " " + items[1][1], "en", "src2", 0), (1003, None, "en", "src2", 0), (1004, "", None, None, None), (1005, "Write to a.b@c.de or +1 (743) 555-3824 now and then, please. " * 3, "en", "src3", 0), (1000, long[1], "en", "src1", 0)]
    spark.createDataFrame(rows + extra, schema).repartition(3).write.parquet(f"{sf}/documents.parquet")
    bench.write.parquet(f"{sf}/benchmark.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("doc_id < 90").write.parquet(f"{sf}/labels.parquet")
    return sf, rows + extra, items


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_op1(spark, small):
    sf, rows, _ = small
    got = run(spark, sf, "op1_gam_quality")
    model = quality.train(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))
    want = []
    for i, t, *_ in rows:
        x = quality.features((t or "").encode())
        b = [int((e <= v).sum()) for e, v in zip(model.edges, x, strict=True)]
        z = model.base + sum(a[k] for a, k in zip(model.single, b, strict=True)) + sum(a[b[p], b[q]] for p, q, a in model.pairs)
        want.append((i, round(float(1 / (1 + np.exp(-z))), 9)))
    assert sorted((r.doc_id, round(r.score, 9)) for r in got) == sorted(want)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)


def test_op5(spark, small):
    sf, rows, _ = small
    want = sorted((i, len(ids := SP.encode(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(SP.decode(ids).encode()).hexdigest()) for i, t, *_ in rows)
    assert sorted(map(tuple, run(spark, sf, "op5_sentencepiece"))) == want


def test_op7(spark, small):
    sf, rows, items = small
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in run(spark, sf, "op7_wu_manber"))
    texts = {t for _, t, *_ in rows}
    plain = {t: plain_contamination(t, items) for t in texts}
    assert got == sorted((i, *plain[t]) for i, t, *_ in rows) and any(r[-1] for r in got)


def test_op8(spark, small):
    sf, rows, _ = small
    fps = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    comp = plain_components(fps)
    assert sorted(map(tuple, run(spark, sf, "op8_simhash"))) == sorted((i, f"{f:016x}", comp[f]) for i, f in fps)


def test_op9(spark, small):
    sf, rows, _ = small
    got = sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in run(spark, sf, "op9_skip_chain_crf"))
    want = []
    for i, t, *_ in rows:
        s = plain_spans(t or "")
        want.append((i, *(sum(k == kind for k, _, _ in s) for kind in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert got == sorted(want)


def test_pipeline(spark, small):
    sf, rows, items = small
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    kept = [r for r in rows if model.score(np.array([quality.features((r[1] or "").encode())]))[0] >= 0.5]
    one = [kept[min(g, key=lambda k: (kept[k][0] is None, kept[k][0]))] for g in plain_groups(kept)]
    clean = [r for r in one if not plain_contamination(r[1], items)[-1]]
    crf = pii.fit(spark.createDataFrame([(r[1],) for r in clean], "text string"))
    want = []
    for r in clean:
        t = None if r[1] is None else pii.redacted(r[1], crf.spans(r[1])[1])
        ids = SP.encode(t or "")
        want.append((r[0], len(ids), ids, hashlib.sha256(SP.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf)
    assert set(got.columns) == {"doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    assert sorted((r.doc_id, r.n_tokens, list(r.ids), r.decoded_sha256) for r in got.collect()) == sorted(want)
    assert len(clean) < len(one) <= len(kept)


def test_stages_keep_columns(spark, small):
    sf, _, _ = small
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
