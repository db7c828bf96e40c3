"""Personal data: base patterns, and a skip-chain conditional random field that labels further tokens."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, sampled

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits fails or matches as a whole, so only its first digit is tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: a token: white-space free, with a digit or an at sign; tried at its first character only
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
EDGE = "\"'()[]{}<>,;:!?.*#$%&|="


def emails(text: str):
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each at sign, so in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octet(digits: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    short = digits.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; a match that fails its check is dropped."""
    out = [(0, s, e) for s, e in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(octet(x) for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


class Token:
    __slots__ = ("start", "end", "text", "features", "key", "shape")

    def __init__(self, start: int, end: int, text: str):
        self.start, self.end, self.text = start, end, text
        d = digits_of(text)
        self.key = d if len(d) >= 7 else text.lower()
        self.shape = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]+", "0", text.lower()))[:24]
        n = len(d)
        dots = text.count(".")
        self.features = [f"digits={min(n, 20)}", f"share={10 * n // max(1, len(text))}", f"dots={min(dots, 4)}", f"at={min(text.count('@'), 2)}", f"first={kind_of(text[:1])}", f"plus={text[:1] == '+'}", f"hyphens={min(text.count('-'), 4)}", f"shape={self.shape}", f"luhn={n >= 13 and luhn(d)}", f"letters={any(c.isalpha() for c in text)}"]


def kind_of(c: str) -> str:
    return "digit" if c.isdigit() else "letter" if c.isalpha() else c


def tokens_of(text: str) -> list[Token]:
    """Tokens with a digit or an at sign, stripped of punctuation around them."""
    out = []
    for m in TOKEN.finditer(text):
        raw = m[0]
        left = len(raw) - len(raw.lstrip(EDGE))
        core = raw.strip(EDGE)
        if core:
            out.append(Token(m.start() + left, m.start() + left + len(core), core))
    return out


def base_labels(tokens: list[Token], spans) -> list[int]:
    """The kind + 1 of the base span that overlaps each token, the first of several; 0 without. One sweep over both."""
    spans = sorted(spans, key=lambda s: (s[1], s[0]))
    out, at = [], 0
    for t in tokens:
        while at < len(spans) and spans[at][2] <= t.start:
            at += 1
        out.append(spans[at][0] + 1 if at < len(spans) and spans[at][1] < t.end else 0)
    return out


def clear_of(base, spans) -> list:
    """Those of spans that overlap none of base."""
    base = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
    before = [(x, bisect_left(starts, x[2])) for x in spans]
    return [x for x, n in before if not n or reach[n - 1] <= x[1]]


class SkipChain:
    """A conditional random field over a document's tokens, trained by pseudo-likelihood on base labels.

    Chain edges join neighbours no more than `near` characters apart; skip edges join each token to the one before it
    with the same key (the same text or digits) and the one before it of the same shape, so the graph stays linear in the
    tokens. Node weights and the potentials of the three kinds of edges are learnt together: each token's label is
    predicted from its features and from the labels of its neighbours on all edges, chain and skip. Labelling runs a
    fixed number of rounds of loopy sum-product messages.
    """

    near = 12
    kinds = ("chain", "key", "shape")

    def __init__(self, documents: list[tuple[list[Token], list[int]]], rounds: int = 4, epochs: int = 60, step: float = 0.5, l2: float = 1e-3, bound: float = 3.0):
        self.rounds, k = rounds, len(LABELS)
        names = sorted({f for ts, _ in documents for t in ts for f in t.features})
        self.index = {f: k for k, f in enumerate(names)}
        self.weights = np.zeros((len(names) + 1, k))
        self.potential = np.zeros((len(self.kinds), k, k))
        y = np.array([v for _, ls in documents for v in ls], int)
        if not len(y):
            return
        x = np.array([[self.index[f] for f in t.features] + [len(names)] for ts, _ in documents for t in ts])
        first = np.cumsum([0, *[len(ts) for ts, _ in documents]])
        edges = np.concatenate([self.edge_table(ts) + np.array([0, at, at]) for (ts, _), at in zip(documents, first, strict=False)])
        uses = np.maximum(np.bincount(x.ravel(), minlength=len(self.weights)), 1)[:, None]
        pairs = np.stack([np.bincount(np.r_[y[e[:, 1]], y[e[:, 2]]], minlength=k) for e in (edges[edges[:, 0] == t] for t in range(len(self.kinds)))])
        pairs = np.maximum(pairs[:, :, None] + pairs[:, None, :], 1)
        for _ in range(epochs):
            _, gw, gp = pseudo_likelihood(self.weights, self.potential, x, y, edges)
            self.weights += step * (gw / uses - l2 * self.weights)
            self.potential = np.clip(self.potential + step * (gp / pairs - l2 * self.potential), -bound, bound)

    def edge_table(self, tokens: list[Token]) -> np.ndarray:
        """Rows (kind, earlier token, later token)."""
        keys: dict[str, int] = {}
        shapes: dict[str, int] = {}
        out = []
        for b, t in enumerate(tokens):
            if b and t.start - tokens[b - 1].end <= self.near:
                out.append((0, b - 1, b))
            if (a := keys.get(t.key)) is not None:
                out.append((1, a, b))
            if (c := shapes.get(t.shape)) is not None and c != a:
                out.append((2, c, b))
            keys[t.key] = shapes[t.shape] = b
        return np.array(out, np.int64).reshape(-1, 3)

    def nodes(self, tokens: list[Token], seen: list[int]) -> np.ndarray:
        """Log weights of each token's labels; tokens in base spans are held at theirs."""
        bias = len(self.weights) - 1
        node = np.array([self.weights[[self.index[f] for f in t.features if f in self.index] + [bias]].sum(axis=0) for t in tokens])
        node -= node.max(axis=1, keepdims=True)
        held = np.array(seen)
        node[held > 0] = np.where(np.arange(len(LABELS)) == held[held > 0][:, None], 0.0, -30.0)
        return node

    def marginals(self, tokens: list[Token], seen: list[int]) -> np.ndarray:
        """Beliefs of each token's label, exact where the graph has no loop and the rounds reach across it."""
        node, edges = self.nodes(tokens, seen), self.edge_table(tokens)
        m = len(edges)
        if not m:
            return softmax(node)
        kind, a, b = edges.T
        source, target = np.r_[a, b], np.r_[b, a]
        back = np.r_[np.arange(m) + m, np.arange(m)]
        groups = [(np.nonzero(kind == t)[0] + at, np.exp(p if at == 0 else p.T)) for t, p in enumerate(self.potential) for at in (0, m)]
        msg = np.zeros((2 * m, len(LABELS)))
        for _ in range(self.rounds):
            total = node.copy()
            np.add.at(total, target, msg)
            out = total[source] - msg[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            for rows, psi in groups:
                out[rows] = out[rows] @ psi
            out = np.log(out + 1e-30)
            msg = 0.5 * msg + 0.5 * (out - out.max(axis=1, keepdims=True))
        total = node.copy()
        np.add.at(total, target, msg)
        return softmax(total)

    def spans(self, text: str, sure: float = 0.9) -> tuple[list, list]:
        """Base spans, and base spans with those of tokens that overlap none and whose belief in a kind is over `sure`."""
        base = base_spans(text)
        tokens = tokens_of(text)
        if not tokens:
            return base, base
        seen = base_labels(tokens, base)
        if all(seen):
            return base, base
        p = self.marginals(tokens, seen)
        more = [(int(k) - 1, t.start, t.end) for t, s, k, b in zip(tokens, seen, p.argmax(axis=1), p.max(axis=1), strict=True) if not s and k and b > sure]
        return base, sorted(base + clear_of(base, more))


def pseudo_likelihood(weights: np.ndarray, potential: np.ndarray, x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The sum over tokens of the log probability of its label given its features x and its neighbours' labels, and the
    gradients for weights and potentials. potential[t, i, j] weighs an edge from label i to label j; those of skip edges are
    symmetric, as the earlier of two alike tokens is like the later."""
    score = weights[x].sum(axis=1)
    sides = [e[:, 1:].T for e in (edges[edges[:, 0] == t] for t in range(len(potential)))]
    for psi, (a, b) in zip(potential, sides, strict=True):
        np.add.at(score, b, psi[y[a]])
        np.add.at(score, a, psi[:, y[b]].T)
    p = softmax(score)
    rest = np.eye(p.shape[1])[y] - p
    gw, gp = np.zeros_like(weights), np.zeros_like(potential)
    for c in range(x.shape[1]):
        np.add.at(gw, x[:, c], rest)
    for t, (a, b) in enumerate(sides):
        np.add.at(gp[t], y[a], rest[b])
        np.add.at(gp[t].T, y[b], rest[a])
        if t:
            gp[t] = (gp[t] + gp[t].T) / 2
    return float(np.log(p[np.arange(len(y)), y]).sum()), gw, gp


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def text_of(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def fit(docs: DataFrame, text: str = "text", sample: int = 2000, max_chars: int = 1 << 15) -> SkipChain:
    """The model, fitted on base labels of a bounded sample: about `sample` documents, those of the lowest text hashes among
    those with a digit or at sign and at most max_chars characters; equal texts count once. Only the fit looks at a sample;
    labelling reads all."""
    some = docs.filter(F.col(text).rlike("[0-9@]") & (F.length(text) <= max_chars)).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    rows = sampled(some, "h", sample).groupBy("h").agg(F.min("t").alias("t")).collect()
    rows = sorted(rows, key=lambda r: (r.h, r.t))
    documents = []
    for r in rows:
        tokens = tokens_of(r.t)
        documents.append((tokens, base_labels(tokens, base_spans(r.t))))
    return SkipChain(documents)


def find(docs: DataFrame, text: str = "text", model: SkipChain | None = None, sample: int = 2000) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans (base and added ones).

    Spans are kind:start:end in code points, end exclusive, by kind, then start, comma-joined. Base spans always stay;
    added ones overlap none of them. Null is read as the empty text, which has no spans. An empty table gives a model
    without weights and an empty result. Repeated rows get equal values; clashing column names give way.
    """
    model = fit(docs, text, sample) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        crf = shared.value

        def work(texts):
            out = [[] for _ in range(6)]
            for t in texts:
                base, spans = crf.spans(text_of(t))
                counts = [0] * 4
                for k, _, _ in base:
                    counts[k] += 1
                for column, v in zip(out, (*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)), strict=True):
                    column.append(v)
            return out

        return work

    fields = [(f"n_{k}", T.LongType()) for k in KINDS] + [("base_sha256", T.StringType()), ("spans", T.StringType())]
    return add_columns(docs, text, fields, make)


def redacted(text: str, spans) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longer, names the whole."""
    out, at = [], 0
    merged: list[list[int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", model: SkipChain | None = None, sample: int = 2000) -> DataFrame:
    """docs, same columns and order, with every base and added span of `text` replaced; null stays null."""
    model = fit(docs, text, sample) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        crf = shared.value

        def work(texts):
            return [[None if t is None else redacted(s := text_of(t), crf.spans(s)[1]) for t in texts]]

        return work

    return add_columns(docs, text, [(text, T.StringType())], make).select(*docs.columns)
