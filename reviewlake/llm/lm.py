"""Cross-entropy difference: matched target and background bigram models over one vocabulary score each document."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .decontaminate import WORD_BYTES

U = np.uint64
P, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
START = U(1)  # the context of a document's first word
SLICE = 2 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix, so that all bits depend on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(v * U(P) + w)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, kept in the worker for slices of usual size."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        out = np.full(max(n, SLICE + (1 << 16)), base, U)
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
        known = out
        if n <= 2 * SLICE:
            _powers[base] = known
    return known[:n]


@dataclass
class Tokens:
    """Words of some documents: document index, hash, and the hash of the word before."""

    doc: np.ndarray
    v: np.ndarray
    w: np.ndarray


def tokens_of(texts: list[bytes | None]) -> Tokens:
    """Hashes of all words at once: a running polynomial sum gives each word's own by two look-ups."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    raw = np.frombuffer((b"\n".join(t or b"" for t in texts) + b"\n").translate(WORD_BYTES), np.uint8)
    n = len(raw)
    inside = np.concatenate([[False], raw != 32, [False]])
    edge = np.nonzero(inside[1:] != inside[:-1])[0]
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U), np.cumsum(raw * powers(P, n), dtype=U)])
        w = mixed((total[end] - total[start]) * powers(INVERSE, n)[start] + (end - start).astype(U))
    w = np.where(w == START, U(2), w)
    doc = np.searchsorted(np.cumsum(sizes), start, side="right")
    v = np.concatenate([np.full(1, START, U), w[:-1]]) if len(w) else w
    if len(w):
        v[np.concatenate([[True], doc[1:] != doc[:-1]])] = START
    return Tokens(doc, v, w)


@dataclass
class Model:
    """What every task needs: sizes, and the counts of the few contexts and pairs that are hot (bounded lists), and
    which of those contexts are dealt by pair."""

    scale: float
    alpha: float
    vocabulary: int
    parts: int
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    split: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    context_counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    pair_counts: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    def difference(self, n, own, target, both, context) -> np.ndarray:
        """n times (loss under target less loss under background) of a word after its context, the document's own
        counts (own, context's in n_v) left out. both, context: counts (background, target) of pair and context."""
        (c, o_v) = own
        av = self.alpha * self.vocabulary
        b = np.log((both[:, 0] - c) * self.scale + self.alpha) - np.log((context[:, 0] - o_v) * self.scale + av)
        t = np.log(both[:, 1] - c * target + self.alpha) - np.log(context[:, 1] - o_v * target + av)
        return n * (b - t)


def found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether there) of x in a sorted table."""
    at = np.searchsorted(table, x)
    at = np.minimum(at, max(0, len(table) - 1))
    return at, table[at] == x if len(table) else np.zeros(len(x), bool)


def counted(t: Tokens, target: np.ndarray):
    """One row for each (document, context, word): doc, v, w, count, and the context's count in the document."""
    with np.errstate(over="ignore"):
        key = mixed(pair(t.v, t.w) + t.doc.astype(U) * U(INVERSE))
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    doc, v, w = t.doc[first], t.v[first], t.w[first]
    with np.errstate(over="ignore"):
        inv = np.unique(mixed(v + doc.astype(U) * U(P)), return_inverse=True)[1]
    own = np.bincount(inv, n).astype(np.int64)[inv] if len(n) else n
    return doc, v, w, n.astype(np.int64), own, target[doc].astype(np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, list]]:
    """(ids, target flags, texts) of parts of a batch of about SLICE bytes."""
    ids, flags, texts = (batch.column(k) for k in range(3))
    ids, texts = ids.to_pylist(), texts.to_pylist()
    flags = np.array(flags.to_pylist(), bool)
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= SLICE or k == len(texts) - 1:
            yield ids[start : k + 1], flags[start : k + 1], texts[start : k + 1]
            start, size = k + 1, 0


def statistics(docs: DataFrame, share: float) -> DataFrame:
    """Counts over all documents. One pass gives two kinds of rows: (hash, words, contexts in background and target),
    and, with kind 1, pairs that are frequent in a slice, which are all that can be frequent overall."""
    schema = "kind int, hash long, words long, background long, target long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, flags, texts in slices(batch):
                t = tokens_of(texts)
                hashes, inv, words = np.unique(t.w, return_inverse=True, return_counts=True)
                contexts, cinv = np.unique(t.v, return_inverse=True)
                on = flags[t.doc].astype(np.int64) if len(t.doc) else np.zeros(0, np.int64)
                every = np.union1d(hashes, contexts)
                out = np.zeros((len(every), 3), np.int64)
                out[np.searchsorted(every, hashes), 0] = words
                at = np.searchsorted(every, contexts)
                out[at, 1] = np.bincount(cinv, minlength=len(contexts))
                out[at, 2] = np.bincount(cinv, on, len(contexts))
                ps, n = np.unique(pair(t.v, t.w), return_counts=True)
                keep = n >= share / 4 * len(t.w)  # a pair misses under a quarter of `share` of all words in the slices that leave it out
                rows = [(0, every, out[:, 0], out[:, 1], out[:, 2]), (1, ps[keep], n[keep], n[keep], n[keep])]
                for kind, h, *cols in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), *[pa.array(c.astype(np.int64)) for c in cols]], names=["kind", "hash", "words", "background", "target"])

    return docs.mapInArrow(run, schema).groupBy("kind", "hash").agg(*[F.sum(c).alias(c) for c in ("words", "background", "target")])


def exact_pairs(docs: DataFrame, pairs: np.ndarray) -> dict[int, tuple[int, int]]:
    """Counts over all documents of the given pairs (a bounded list)."""
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(it):
        table = shared.value
        total = np.zeros((len(table), 2), np.int64)
        for batch in it:
            for _, flags, texts in slices(batch):
                t = tokens_of(texts)
                at, hit = found(table, pair(t.v, t.w))
                total[:, 0] += np.bincount(at[hit], minlength=len(table))
                total[:, 1] += np.bincount(at[hit], flags[t.doc[hit]], len(table)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(table.view(np.int64)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["hash", "background", "target"])

    rows = docs.mapInArrow(run, "hash long, background long, target long").groupBy("hash").agg(F.sum("background").alias("b"), F.sum("target").alias("t"))
    return {r[0] % (1 << 64): (r[1], r[2]) for r in rows.collect()}


def counts(key: np.ndarray, n: np.ndarray, on: np.ndarray) -> np.ndarray:
    """For each row, the counts (background, target) of its key."""
    inv = np.unique(key, return_inverse=True)[1]
    return np.stack([np.bincount(inv, n)[inv], np.bincount(inv, n * on)[inv]], axis=1)


def pack(doc, v, w, n, own, on) -> bytes:
    """Rows of one part, sorted by context: each context once, 48 bits of each word, small integers for the rest."""
    order = np.argsort(v, kind="stable")
    doc, v, w, n, own, on = (a[order] for a in (doc, v, w, n, own, on))
    first = np.concatenate([[True], v[1:] != v[:-1]])
    vs = v[first]
    runs = np.diff(np.concatenate([np.nonzero(first)[0], [len(v)]])).astype(np.uint32)
    low = w.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    small = [a.astype(np.uint16 if a.max() < 1 << 16 else np.uint32) for a in (doc, n << 1 | on, own)]
    head = struct.pack("<II3B", len(vs), len(v), *[a.itemsize for a in small])
    return b"".join([head, vs.tobytes(), runs.tobytes(), np.ascontiguousarray(low).tobytes(), *[a.tobytes() for a in small]])


def unpack(blob: bytes):
    k, m, *sizes = struct.unpack_from("<II3B", blob)
    at = 11
    out = []
    for kind, size in (("<u8", k), ("<u4", k), ("u1", 6 * m), *[(f"<u{s}", m) for s in sizes]):
        out.append(np.frombuffer(blob, kind, size, at))
        at += out[-1].nbytes
    vs, runs, low, doc, n, own = out
    wide = np.zeros((m, 8), np.uint8)
    wide[:, :6] = low.reshape(-1, 6)
    return np.repeat(vs, runs), wide.view("<u8").ravel(), doc.astype(np.uint32), (n >> 1).astype(np.int32), own.astype(np.int32), (n & 1).astype(np.int8)


def score(docs: DataFrame, target: Column, id_col: str = "doc_id", text: str = "text", alpha: float = 0.1, hot: int = 10_000, part_events: int = 1 << 20, most_contexts: int = 200_000) -> DataFrame:
    """(id, n_words, score) for every row: the mean over words of the loss under the target model less that under the
    background model, in nats; the lower, the more like the target.

    The background is all of docs, the target the rows where `target` holds (null: not). Both are bigram models with
    additive smoothing over one vocabulary, all words of docs; background counts are scaled to the target's number of
    words, so that smoothing weighs alike in both. A document's own counts are left out of what scores it.
    Rows without words have score 0. Null ids, repeated ids and rows are scored row by row, repeats among each other's
    counts. An empty table gives an empty result; a target without words gives finite scores. Other columns are ignored.

    Pairs are counted where they meet: each task sends the pairs of its documents, packed, to parts by the hash of the
    context (of the pair, for contexts that would fill a good share of a part). A part counts its pairs, about part_events of
    them, and answers each slice with sums per document. Pairs that make up over 1/hot of all words, of which there are fewer
    than `hot`, are counted beforehand and scored at once, so a third of all words in one pair is no part's work. A context
    kept whole has at most a quarter of part_events, or one of most_contexts of all words if that is more; a pair that is not
    hot has at most 1/hot of all words. The lists of both are what is broadcast: 24 bytes an entry.
    """
    sc = docs.sparkSession.sparkContext
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(target, F.lit(False)).alias("target"), F.col(text).cast("binary").alias("text"))
    stats = checkpointed(statistics(slim, 1 / hot))
    words = stats.filter("kind = 0").agg(F.count(F.when(F.col("words") > 0, 1)), F.sum("background"), F.sum("target")).first()
    vocabulary, all_words, target_words = words[0], words[1] or 0, words[2] or 0
    least = all_words / hot
    # at most `most_contexts` contexts, and fewer than 4/3 `hot` pairs to count exactly, can be above these counts; a hot pair has a hot context
    whole = max(all_words / most_contexts, part_events / 4)
    contexts = sorted((r.hash % (1 << 64), r.background, r.target) for r in stats.filter((F.col("kind") == 0) & (F.col("background") > min(whole, least))).collect())
    maybe = sorted(r.hash % (1 << 64) for r in stats.filter((F.col("kind") == 1) & (F.col("words") > 0.75 * least)).select("hash").collect())
    exact = exact_pairs(slim, np.array(maybe, U)) if maybe else {}
    # sums over slices miss up to a quarter; a pair that is above `least` by its exact count has a context that is, too
    pairs = [p for p in maybe if exact[p][0] > least]
    model = Model(max(1, target_words) / max(1, all_words), alpha, vocabulary + 1, max(1, -(-all_words // part_events)))
    model.split = np.array([c[1] > whole for c in contexts], bool)
    model.contexts, model.context_counts = np.array([c[0] for c in contexts], U), np.array([c[1:] for c in contexts], float).reshape(-1, 2)
    model.pairs, model.pair_counts = np.array(pairs, U), np.array([exact[p] for p in pairs], float).reshape(-1, 2)
    shared = sc.broadcast(model)

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        part_id, k = TaskContext.get().partitionId(), 0
        for batch in it:
            for ids, flags, texts in slices(batch):
                here, k = part_id << 32 | k, k + 1
                t = tokens_of(texts)
                sizes = np.bincount(t.doc, minlength=len(ids))
                doc, v, w, n, own, on = counted(t, flags)
                ps = pair(v, w)
                at, hit = found(m.pairs, ps)
                ctx, hot_ctx = found(m.contexts, v)
                now = np.zeros(len(ids))
                if hit.any():  # a hot pair's context is hot too
                    d = m.difference(n[hit], (n[hit], own[hit]), on[hit], m.pair_counts[at[hit]], m.context_counts[ctx[hit]])
                    now = np.bincount(doc[hit], d, len(ids))
                apart = hot_ctx & m.split[ctx] if len(m.split) else hot_ctx
                part = (np.where(apart, ps, mixed(v)) % U(m.parts)).astype(np.int64)
                part[hit] = m.parts
                order = np.argsort(part, kind="stable")
                present, first = np.unique(part[order], return_index=True)
                parts, blobs, kinds = [], [], []
                for p, rows in zip(present.tolist(), np.split(order, first[1:]), strict=False):
                    if p < m.parts:
                        parts.append(p)
                        kinds.append(0)
                        blobs.append(pack(*(a[rows] for a in (doc, v, w, n, own, on))))
                head = np.array([x is None for x in ids], np.uint8).tobytes() + np.array([x or 0 for x in ids], np.int64).tobytes() + sizes.astype(np.int64).tobytes() + now.tobytes()
                parts.append(here % m.parts)
                kinds.append(1)
                blobs.append(struct.pack("<I", len(ids)) + head)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([here] * len(parts), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "slice", "kind", "blob"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        part = int(pdf["part"].iloc[0])
        own_rows = pdf[pdf["kind"] == 0].sort_values("slice")
        back = [(int(s), -1, b) for s, b, k in zip(pdf["slice"], pdf["blob"], pdf["kind"], strict=True) if k == 1]
        if not own_rows.empty:
            cols = [unpack(b) for b in own_rows["blob"]]
            where = np.repeat(np.arange(len(cols)), [len(c[0]) for c in cols])
            v, w, doc, n, own, on = (np.concatenate(x) for x in zip(*cols, strict=True))
            del cols
            both = counts(pair(v, w), n, on)
            del w
            context = counts(v, n, on)
            at, hit = found(m.contexts, v)
            context[hit] = m.context_counts[at[hit]]
            del v, at, hit
            d = m.difference(n, (n, own), on, both, context)
            del both, context
            key, inv = np.unique(where << 32 | doc, return_inverse=True)
            total = np.bincount(inv, d)
            cut = np.searchsorted(key >> 32, np.arange(len(own_rows) + 1))
            for s, a, b in zip(own_rows["slice"], cut, cut[1:], strict=False):
                back.append((int(s), part, (key[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes() + total[a:b].astype(np.float32).tobytes()))
        return pd.DataFrame(back, columns=["slice", "part", "blob"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        head = pdf["blob"].iloc[0]
        k = struct.unpack_from("<I", head)[0]
        null = np.frombuffer(head, np.uint8, k, 4).astype(bool)
        ids, sizes, total = (np.frombuffer(head, t, k, 4 + k + 8 * k * i) for i, t in enumerate((np.int64, np.int64, np.float64)))
        total = total.copy()
        for b in pdf["blob"].iloc[1:]:
            j = len(b) // 8
            total[np.frombuffer(b, np.uint32, j)] += np.frombuffer(b, np.float32, j, 4 * j)
        return pd.DataFrame({"id": pd.Series(ids).astype("Int64").mask(null), "n_words": sizes, "score": total / np.maximum(sizes, 1)})

    tasks = min(model.parts, 20_000)  # so a task's share of the parts doesn't grow with the input
    sent = slim.mapInArrow(send, "part long, slice long, kind int, blob binary").repartition(tasks, "part")
    back = sent.groupBy("part").applyInPandas(answer, "slice long, part long, blob binary")
    out = back.groupBy("slice").applyInPandas(finish, "id long, n_words long, score double")
    return out.withColumnRenamed("id", id_col)
