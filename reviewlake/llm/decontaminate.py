"""Benchmark decontamination: Wu-Manber search for every window of benchmark words in whole documents."""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, add_columns, materialise, without

#: Digits, letters (lower-cased) and every byte of a non-ASCII character stay; what else there is parts words.
WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in ASCII_LOWER)
SPANS, ITEMS, WORDS, ROW, TEXT = "_hit_spans", "_hit_items", "_n_words", "_hit_row", "_hit_text"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Table:
    """Shifts and buckets of all windows of m words; a block is two words, or one in windows of one.

    A block's shift is how far the search may move when it ends at the current word: the least distance from where the block ends
    in a window to the window's end, and `most` for blocks of no window. Windows are in buckets by the hash of their last
    and first block. All are sorted arrays, of some 40 bytes a word.
    """

    def __init__(self, words: np.ndarray, mine: np.ndarray, begin: np.ndarray, m: int, size: int):
        self.m, self.b = m, min(2, m)
        self.most, self.size = m - self.b + 1, size
        at = np.nonzero(mine)[0]  # words of items with windows of m; `begin` is where a word's item begins
        ends = at[at - begin[at] + 1 >= self.b] + 1
        keys, shift = self.block(words, ends), np.maximum(0, m - (ends - begin[ends - 1]))
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.keys, self.shift = keys[first], shift[first].astype(np.int16)
        full = ends[ends - begin[ends - 1] >= m]
        hashes = mixed(self.block(words, full), self.block(words, full - m + self.b))
        order = np.argsort(hashes, kind="stable")
        self.buckets, self.ends = hashes[order], full[order].astype(np.int32)

    def block(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        last = words[ends - 1].astype(np.int64)
        return last if self.b == 1 else words[ends - 2].astype(np.int64) * self.size + last

    def found(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end in text, end in words) of every occurrence of a window."""
        none = np.zeros(0, np.int64)
        if len(text) < self.m or not len(self.keys):
            return none, none
        ends = np.arange(self.b, len(text) + 1)
        keys = self.block(text, ends)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        known &= (text[ends - 1] >= 0) & (text[ends - self.b] >= 0)
        shift = np.where(known, self.shift[at], self.most)
        if shift.min() > 0:
            return none, none
        shift = shift.tolist()
        stops, end, n = [], self.m, len(text)
        while end <= n:
            move = shift[end - self.b]
            if not move:
                stops.append(end)
                move = 1
            end += move
        stop = np.array(stops, np.int64)
        key = mixed(self.block(text, stop), self.block(text, stop - self.m + self.b))
        lo, hi = np.searchsorted(self.buckets, key), np.searchsorted(self.buckets, key, side="right")
        out = []
        for a, z in chunks(hi - lo):
            k = np.repeat(np.arange(a, z), (hi - lo)[a:z])
            mine = self.ends[lo[k] + np.arange(len(k)) - np.repeat(np.cumsum((hi - lo)[a:z]) - (hi - lo)[a:z], (hi - lo)[a:z])].astype(np.int64)
            here = stop[k]
            for j in range(1, self.m + 1):  # word by word, those that differ go
                same = text[here - j] == words[mine - j]
                here, mine = here[same], mine[same]
            out.append((here, mine))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none)


def chunks(counts: np.ndarray, limit: int = 1 << 20):
    """Slices of counts that add up to about `limit`; a larger count goes alone."""
    part = np.cumsum(counts) // limit
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), len(counts)]
    return [(a, z) for a, z in zip(cuts, cuts[1:], strict=False) if a < z]


class WuManber:
    """Search for windows of words: one table for each window length, so that a short window doesn't shorten all shifts.

    Words of the items are numbers, one after the other; words of no item are -1 in a text and fit no block.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], length: int = 13):
        self.number: dict[bytes, int] = {}
        numbers, begin, owner, sizes, names = [], [], [], [], []
        start = 0
        for k, (item, text) in enumerate(items):
            some = words_of(text)
            numbers.append(np.fromiter((self.number.setdefault(w, len(self.number)) for w in some), np.int32, len(some)))
            n = len(some)
            begin.append(np.full(n, start, np.int32))
            owner.append(np.full(n, k, np.int32))
            sizes.append(np.full(n, min(length, n), np.int16))
            names.append(item)
            start += n
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        self.words, self.owner, self.names = join(numbers, np.int32), join(owner, np.int32), names
        self.begin, size = join(begin, np.int32), join(sizes, np.int16)
        self.tables = [Table(self.words, size == m, self.begin, int(m), len(self.number) + 1) for m in np.unique(size)]

    def nbytes(self) -> int:
        """Memory of the arrays, and of the words by estimate."""
        arrays = [self.words, self.owner, self.begin, *[x for t in self.tables for x in (t.keys, t.shift, t.buckets, t.ends)]]
        return sum(x.nbytes for x in arrays) + sum(len(w) + 150 for w in self.number)

    def search(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Merged word spans [start, end, start, end, ...] and the items with an occurring window."""
        text = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for t in self.tables:
            here, there = t.found(self.words, text)
            spans += [(e - t.m, e) for e in np.unique(here).tolist()]
            items.update(np.unique(self.owner[there - 1]).tolist())
        return merge(sorted(spans)), {self.names[k] for k in items if self.names[k] is not None}


def merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in spans:
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text: str, block_bytes: int):
    """(number of parts, the parts one at a time) of about block_bytes: what is on the driver and in a broadcast is bounded."""
    items = benchmark.filter(F.col(text).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))

    def part(k: int) -> list:
        some = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        return [(r.item, bytes(r.text)) for r in some.toLocalIterator()]

    return n, map(part, range(n))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 13, share: int = 20, block_bytes: int = 8 << 20) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. Windows are `length`
    consecutive words of an item, or the whole of a shorter one. A word inside an occurrence of a window is hit; a
    document is contaminated when at least 1/share of its words are, and one at least.
    Null texts and texts without words have no words and no hits. Items without a text are ignored; the windows of an item
    without an id hit words, but the item isn't named or counted; items of the same text count each. Rows are judged one by
    one, so repeated rows get equal values. Clashing column names give way.

    A benchmark of at most block_bytes is searched for in one pass; its tables take some ten times that in each worker. A larger one goes round in such blocks, one in memory at a
    time: rows are numbered in a written copy, each block's pass writes the hits of the rows that have any, and these meet
    the rows by number.
    """
    docs = without(docs, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", SPANS, ITEMS, WORDS, ROW)
    sc = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns]
    spans_t, items_t = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())

    def scan(tables):
        def work(texts):
            out = [[], [], []]
            for t in texts:
                words = words_of(t)
                spans, items = tables().search(words)
                for column, v in zip(out, (len(words), spans, sorted(items)), strict=True):
                    column.append(v)
            return out

        return lambda: work

    fields = [(WORDS, T.LongType()), (SPANS, spans_t), (ITEMS, items_t)]
    n, parts = blocks_of(benchmark, item_id, item_text, block_bytes)
    if n == 1:
        shared = sc.broadcast(WuManber(next(parts), length))
        docs = add_columns(docs, text, fields, scan(lambda: shared.value)).withColumn(SPANS, F.array(SPANS))
    else:
        rows = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
        hits = []
        for block in parts:
            shared = sc.broadcast(WuManber(block, length))
            found = add_columns(rows.select(ROW, F.col(text).alias(TEXT)), TEXT, fields, scan(lambda shared=shared: shared.value)).drop(TEXT)
            hits.append(materialise(found if not hits else found.filter(F.size(SPANS) > 0), "hits"))
            shared.destroy()
        each = reduce(DataFrame.unionByName, hits).groupBy(ROW).agg(F.max(WORDS).alias(WORDS), F.collect_list(SPANS).alias(SPANS), F.flatten(F.collect_list(ITEMS)).alias(ITEMS))
        docs = rows.join(each, ROW)
    docs = docs.withColumn(ITEMS, F.array_sort(F.array_distinct(ITEMS)))
    out = docs.select(*kept, F.col(WORDS).alias("n_words"), covered(SPANS).alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ITEMS).cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def covered(spans: str) -> F.Column:
    """Words in the union of the span lists of all blocks; each list is [start, end, start, end, ...]."""

    def paired(s):
        starts, ends = F.filter(s, lambda _, i: i % 2 == 0), F.filter(s, lambda _, i: i % 2 == 1)
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("s"), b.alias("e")))

    pairs = F.array_sort(F.flatten(F.transform(spans, paired)))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("n"), zero.alias("to"))
    step = lambda acc, p: F.struct((acc["n"] + F.greatest(zero, p["e"] - F.greatest(p["s"], acc["to"]))).alias("n"), F.greatest(acc["to"], p["e"]).alias("to"))
    return F.aggregate(pairs, start, step, lambda acc: acc["n"])
