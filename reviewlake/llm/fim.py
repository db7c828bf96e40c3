"""Fill-in-middle: documents cut at two token counts, found from memoised summaries of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, small_batches, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk: a cut falls where the rolling hash of the last 16 bytes has ten zero bits, but not before LEAST and not after MOST.
LEAST, MOST = 64, 8192
ROLL = np.random.default_rng(12).integers(0, 1 << 32, 256, np.uint32)
CUT_BITS = np.uint32(0x3FF << 16)
_b = np.arange(256, dtype=np.uint8)
LETTER = ((_b | 32) >= 97) & ((_b | 32) <= 122) & (_b < 128)
HEAD = (_b & 0xC0) != 0x80  # the first byte of a code point


def rolling(b: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes up to and with each place, by doubling: that of 2w bytes is made of two of w."""
    h = ROLL[b]
    for w in (1, 2, 4, 8):
        h[w:] += h[:-w] << np.uint32(w)
    return h


def chunk_ends(b: np.ndarray) -> list[int]:
    """Where the chunks of a text end. Inside a text a cut depends on the 16 bytes before it only, so texts that share a passage share
    its chunks; no chunk ends within a code point."""
    n = len(b)
    found = np.nonzero((rolling(b) & CUT_BITS) == 0)[0] + 1 if n > LEAST else np.zeros(0, np.int64)
    ends, last = [], 0
    for c in [*found.tolist(), n]:
        while c - last > MOST:
            last = whole(b, last + MOST)
            ends.append(last)
        if c == n or c - last >= LEAST and HEAD[b[c]]:
            if c > last:
                ends.append(c)
            last = c
    return ends


def whole(b: np.ndarray, at: int) -> int:
    """The end of the code point that has a byte at `at`, or `at` where one begins."""
    while at < len(b) and not HEAD[b[at]]:
        at += 1
    return at


@dataclass(slots=True)
class Summary:
    """What a chunk adds to the counts of a text, whatever its neighbours are."""

    tokens: int
    points: int
    first: bool  # begins with a letter
    last: bool  # ends with one


def token_starts(b: np.ndarray) -> np.ndarray:
    """Whether a token of `[A-Za-z]+|[^A-Za-z]` begins at each byte: a letter after none, or the head of another code point."""
    letter = LETTER[b]
    start = HEAD[b].copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    return start


def summary(b: np.ndarray) -> Summary:
    return Summary(int(np.count_nonzero(token_starts(b))), int(np.count_nonzero(HEAD[b])), bool(LETTER[b[0]]), bool(LETTER[b[-1]]))


@dataclass
class Memo:
    """Summaries by chunk: found by hash, taken only where the bytes are the same. Holds `room` bytes of chunks at most; the oldest go."""

    room: int = 16 << 20
    held: dict[int, tuple[bytes, Summary]] = field(default_factory=dict)
    used: int = 0
    hits: int = 0

    def of(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        known = self.held.get(key)
        if known is not None and known[0] == chunk:
            self.hits += 1
            return known[1]
        made = summary(np.frombuffer(chunk, np.uint8))
        if known is None:
            self.held[key] = (chunk, made)
            self.used += len(chunk) + 200
            while self.used > self.room:
                old = self.held.pop(next(iter(self.held)))
                self.used -= len(old[0]) + 200
        return made


class Counted:
    """A text as chunks with running counts, in which the end of the k-th token is found by search."""

    def __init__(self, text: bytes, memo: Memo):
        self.text, self.bytes = text, np.frombuffer(text, np.uint8)
        self.ends = chunk_ends(self.bytes)
        self.parts = [memo.of(text[a:z]) for a, z in zip([0, *self.ends], self.ends, strict=False)]
        # a letter run that goes on over a boundary was counted in both chunks
        self.joined = [False, *(a.last and b.first for a, b in zip(self.parts, self.parts[1:], strict=False))][: len(self.parts)]
        self.tokens = np.cumsum([0, *(p.tokens - j for p, j in zip(self.parts, self.joined, strict=True))])
        self.points = np.cumsum([0, *(p.points for p in self.parts)])
        self.n = int(self.tokens[-1])

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) at which the first k tokens end."""
        if k <= 0 or k >= self.n:
            return (0, 0) if k <= 0 else (len(self.text), int(self.points[-1]))
        at = int(np.searchsorted(self.tokens, k + 1)) - 1  # the chunk in which token k + 1 begins
        lo, hi = (self.ends[at - 1] if at else 0), self.ends[at]
        b = self.bytes[lo:hi]
        # its tokens by place; the first is a rest of one that began before where chunks are joined
        starts = np.nonzero(token_starts(b))[0]
        place = int(starts[k - int(self.tokens[at]) + self.joined[at]])
        return lo + place, int(self.points[at]) + int(np.count_nonzero(HEAD[b[:place]]))


def draws(key: str) -> list[int]:
    h = hashlib.sha256(key.encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]


def arranged(text: bytes, key: str, memo: Memo, share: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of prefix and of middle, output) of a text."""
    t = Counted(text, memo)
    h = draws(key)
    if not text or h[2] % 100 >= share or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return t.n, "plain", None, None, text
    (a, pa_), (z, pz) = (t.cut(k) for k in sorted(x % (t.n + 1) for x in h[:2]))
    p, s, m = (mark.encode() + part for mark, part in ((PREFIX, text[:a]), (SUFFIX, text[z:]), (MIDDLE, text[a:z])))
    spm_form = h[3] % 100 < spm
    return t.n, "spm" if spm_form else "psm", pa_, pz - pa_, s + p + m if spm_form else p + s + m


FIELDS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, share: int = 90, spm: int = 20, room: int = 16 << 20) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars and output.

    Tokens are runs of ASCII letters, or single other code points. Two cuts between tokens part a text in prefix, middle and
    suffix; `share` of 100 texts are put in another order for it, `spm` of 100 of those with the suffix first, all drawn from the
    SHA-256 of "seed:id". Texts that are empty or hold a marker stay plain, with null prefix_chars and middle_chars. A null text is
    read as empty, a null id as the empty id. Rows are worked on one by one, so repeated rows get equal values, and an empty table
    gives an empty result. Clashing column names give way.

    Chunks whose ends depend on content alone are counted once a task for all texts that share them: a memo of `room` bytes keeps
    the counts and the kind of both ends of each, which add up to a text's counts and tell in which chunk a cut lies.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, *[n for n, _ in FIELDS], "_key")
    keyed = docs.withColumn("_key", F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    out = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in FIELDS]])
    names, types = out.names, [to_arrow_type(t) for _, t in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(room)
        for whole_batch in batches:
            for batch in slices(whole_batch, text):
                texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
                keys = batch.column(batch.schema.get_field_index("_key")).to_pylist()
                rows = [arranged(t or b"", k, memo, share, spm) for t, k in zip(texts, keys, strict=True)]
                new = [pa.array([r[i] for r in rows], pa.binary() if i == 4 else t).cast(t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 1)] + new, names=names)

    return keyed.mapInArrow(run, out)


def restored(form: str = "form", output: str = "output") -> Column:
    """The text again, from its output and form alone: parts are what stands between the markers, which no text in another order holds."""
    o = F.col(output)

    def between(start: str, end: str | None) -> Column:
        at = F.locate(start, o) + len(start)
        return F.substring(o, at, (F.locate(end, o) if end else F.length(o) + 1) - at)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(o)


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    made = transform(docs.select(id_col, text), id_col, text)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents),
d AS (SELECT doc_id, text, t, len(t)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, text, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(p || m || s) AS restored_sha256 FROM p
"""
