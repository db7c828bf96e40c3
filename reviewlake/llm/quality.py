"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, is_training_row, materialise, sampled, without

FEATURES = ("log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digits", "symbols", "marks", "stops", "commas", "pipes", "non_ascii", "distinct_words", "repeated_lines", "line_words", "top_word", "ends_in_stop")
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
SYMBOL = b"#$%&*@^~_=<>\\{}[]"
HIGH = bytes(range(128, 256))


def features(text: bytes | None) -> list[float]:
    """Numbers that describe a text; all zero but the lengths for one without words."""
    text = text or b""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [float(np.log1p(n)), *[0.0] * (len(FEATURES) - 1)]

    def share(chars: bytes) -> float:
        return (n - len(text.translate(None, chars))) / n

    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, m)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stripped = text.rstrip()
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(sizes.mean()), float((sizes > 12).mean()), float((sizes <= 3).mean()), share(UPPER), share(DIGIT), share(SYMBOL), share(b"!?"), share(b"."), share(b","), share(b"|"), share(HIGH),
        len(counts) / m, 1 - len(set(lines)) / len(lines), m / len(lines), max(counts.values()) / m, float(stripped[-1:] in (b".", b"!", b"?")),
    ]


@dataclass
class Gam:
    """score = sigmoid(base + table of each feature's bin + table of each pair's bins)."""

    edges: list[np.ndarray]
    base: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        total = np.full(len(b), self.base)
        for j, table in enumerate(self.single):
            total += table[b[:, j]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def two_cuts(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    """Newton values by bin of a tree with up to three leaves over ordered bins: the best cut, then the best cut of either side."""
    value = lambda gs, hs: gs * gs / (hs + l2)

    def best(lo: int, hi: int) -> tuple[float, int]:
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if hi - lo < 2:
            return 0.0, lo
        gain = value(cg[:-1], ch[:-1]) + value(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - value(cg[-1], ch[-1])
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    n = len(g)
    _, c = best(0, n)
    cuts = [0, c, n] if 0 < c < n else [0, n]
    if len(cuts) == 3:
        (a, ca), (b, cb) = best(0, c), best(c, n)
        extra = ca if a >= b else cb
        cuts = sorted({*cuts, extra})
    out = np.zeros(n)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + l2)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pairs: int = 6, rate: float = 0.15, l2: float = 2.0) -> Gam:
    """Cyclic boosting: in each round every feature in turn gets one shallow tree, added to its lookup table.

    The pairs whose two-way tables would gain most on what the single tables leave are boosted the same way, by trees
    of one cut in either feature. With no rows or one class only, the model is a constant.
    """
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
    model = Gam(edges)
    sizes = [len(e) + 1 for e in edges]
    model.single = [np.zeros(s) for s in sizes]
    if not len(y):
        return model
    rate0 = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(rate0 / (1 - rate0)))
    b = model.bins(x)
    margin = model.margin(b)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            step = rate * two_cuts(np.bincount(b[:, j], g, sizes[j]), np.bincount(b[:, j], h, sizes[j]), l2)
            model.single[j] += step
            margin += step[b[:, j]]
    g, h = slopes()

    def table(i, j, w):
        return np.bincount(b[:, i] * sizes[j] + b[:, j], w, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    def quarter(i, j, g, h):
        """Gain and values of the best tree with one cut in i and one in j."""
        gs, hs = (np.pad(table(i, j, w).cumsum(0).cumsum(1), ((1, 0), (1, 0))) for w in (g, h))
        if min(gs.shape) < 3:
            return 0.0, np.zeros((sizes[i], sizes[j]))
        parts = []
        for c in (gs, hs):
            ul, up, left, all_ = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
            parts.append((ul, up - ul, left - ul, all_ - up - left + ul))
        gain = sum(a * a / (d + l2) for a, d in zip(*parts, strict=True))
        r, c = np.unravel_index(int(gain.argmax()), gain.shape)
        v = [p[r, c] / (q[r, c] + l2) for p, q in zip(*parts, strict=True)]
        out = np.empty((sizes[i], sizes[j]))
        out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = v[0], v[1], v[2], v[3]
        return float(gain[r, c]), out

    ranked = sorted(((quarter(i, j, g, h)[0], i, j) for i in range(k) for j in range(i)), key=lambda t: (-t[0], t[1], t[2]))[:pairs]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked]
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = rate * quarter(i, j, g, h)[1]
            t += step
            margin += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 20_000) -> Gam:
    """The model, learnt from about `sample` labelled texts at most, those of the lowest hashes among the about `sample` ids of the lowest
    hashes, and only from rows whose crc32(id) modulo 3 is not 1. Of several labels of one id the smallest counts; null labels
    don't. Rows that repeat an id and text count once."""
    chosen = labels.filter(is_training_row(id_col) & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("_label"))
    chosen = sampled(chosen.withColumn("_i", F.xxhash64(id_col)), "_i", sample).drop("_i")
    rows = docs.select(id_col, text).join(F.broadcast(chosen), id_col)  # about `sample` ids
    # an id may have any number of texts: of all pairs of id and text those of the lowest hashes
    rows = rows.select(F.xxhash64(id_col, text).alias("_h"), F.col(text).alias("_text"), "_label")
    kept = sampled(materialise(rows.groupBy("_h").agg(F.min("_label").alias("_label")), "labelled"), "_h", sample)
    rows = rows.select("_h", "_text").join(F.broadcast(kept), "_h").groupBy("_h").agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))
    rows = add_columns(rows, "_text", [("_x", T.ArrayType(T.DoubleType()))], lambda: lambda texts: [[features(t) for t in texts]])
    got = sorted(rows.select("_h", "_x", "_label").collect())
    got = [(r[1], r[2]) for r in got]
    x = np.array([r[0] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r[1] > 0) for r in got]))


def classify(docs: DataFrame, model: Gam, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, likelier good) and predicted (1 from 0.5 on). Null is read as empty; every row gets a
    score from its whole text alone. Clashing column names give way; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(texts):
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            s = m.score(x)
            return [s.tolist(), (s >= 0.5).astype(int).tolist()]

        return work

    return add_columns(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts to be good, with their own columns. Null texts are judged as empty ones."""
    return without(classify(docs.select("*"), train(docs, labels)).filter("predicted = 1"), "score", "predicted").select(*docs.columns)
