"""How far the sources of a language use its terms differently: exact sums over joint tables of count levels."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, small_batches

#: Letters become small ones and bytes of other characters stay; what else there is parts terms.
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNIT = 1_000_000_000
COUNTED = "lang string, source string, term string, docs bigint, n bigint"


def counted(docs: DataFrame, room: int = 400_000) -> DataFrame:
    """(lang, source, term, docs, n): documents with a term and its occurrences, summed within each task before they are moved; a task
    holds `room` sums, then hands them on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (docs_of, n_of) in held.items():
                k = len(n_of)
                terms = pa.array(list(n_of), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), terms, pa.array([docs_of[t] for t in n_of], pa.int64()), pa.array(list(n_of.values()), pa.int64())], names=COUNTED_NAMES)
            held.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                lang, source, text = (batch.column(i) for i in range(3))
                for g, s, t in zip(lang.to_pylist(), source.to_pylist(), text.cast(pa.binary()).to_pylist(), strict=True):
                    found = Counter(t.translate(TERM_BYTES).split())
                    docs_of, n_of = held[g, s]
                    docs_of.update(found.keys())
                    n_of.update(found)
                if sum(len(n) for _, n in held.values()) > room:
                    yield from given()
        yield from given()

    return docs.mapInArrow(run, COUNTED)


COUNTED_NAMES = ["lang", "source", "term", "docs", "n"]


def priced(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)); decimals, as the product may be above 64 bits."""
    return F.expr("bigint(1)") + F.call_function("div", (count.cast("decimal(20,0)") + 2) * F.lit(UNIT).cast("decimal(10,0)"), (total + 2 * terms).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)² / (p + q)); prices are at most UNIT + 1, so the square has less than 63 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


#: A block has at most so many indicator columns and terms; a term with cells in more groups is a block of its own.
COLUMNS, ROWS = 1024, 8192


def joint(row: np.ndarray, column: np.ndarray, rows: int, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, count) for columns i < j: in how many rows both indicators are set, from the product of the indicator matrix and its
    transpose, in tiles. Single precision is exact below 2^24 rows."""
    for a in range(0, columns, COLUMNS):
        for b in range(a, columns, COLUMNS):
            tiles = []
            for lo in (a, b):
                inside = (column >= lo) & (column < lo + COLUMNS)
                x = np.zeros((rows, min(COLUMNS, columns - lo)), np.float32)
                x[row[inside], column[inside] - lo] = 1
                tiles.append(x)
            product = tiles[0].T @ tiles[1]
            i, j = np.nonzero(np.triu(product, 1) if a == b else product)
            yield i + a, j + b, product[i, j].astype(np.int64)


def fall(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def block_sums(starts: np.ndarray, source: np.ndarray, n: np.ndarray, p: np.ndarray, zero: np.ndarray, add) -> None:
    """Adds what the joint tables of some terms are worth for each pair of groups. starts: where each term's cells begin, and their end.

    A column is a group and a count level above none. For terms that both groups have at levels (l, m), a pair's value holds
    f(l, m); the rest of the sum is worked out from margins as if one of both had none, so f(l, 0) and f(0, m) are taken off
    and f(0, 0), which that takes off twice, is put back.
    """
    at, end = int(starts[0]), int(starts[-1])
    _, level = np.unique(n[at:end], return_inverse=True)
    _, first, column = np.unique(source[at:end] * np.int64(end - at + 1) + level, return_index=True, return_inverse=True)
    rows = len(starts) - 1
    if rows > 1 and (len(first) > COLUMNS or rows > ROWS):
        half = rows // 2
        block_sums(starts[: half + 1], source, n, p, zero, add)
        block_sums(starts[half:], source, n, p, zero, add)
        return
    g, price, none = (x[at:end][first] for x in (source, p, zero))
    row = np.repeat(np.arange(rows), np.diff(starts))
    for i, j, count in joint(row, column, rows, len(first)):
        a, b, za, zb = price[i], price[j], none[i], none[j]
        add(g[i], g[j], count * (fall(a, b) - fall(a, zb) - fall(za, b) + fall(za, zb)))


def pair_sums(cells: DataFrame) -> DataFrame:
    """(lang, g, h, value), g < h: sums over the terms that both have, of cells (lang, cells: source, n, p, zero), one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def given() -> pa.RecordBatch:
            k = list(held)
            out = [pa.array([x[i] for x in k], pa.string()) for i in range(3)] + [pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["lang", "g", "h", "value"])

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            flat = lists.flatten()
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            names = flat.field("source").dictionary_encode()
            order = np.argsort(np.array(names.dictionary.cast(pa.binary()).to_pylist(), object))  # numbers in the order of names
            of = np.empty(len(order), np.int64)
            of[order] = np.arange(len(order))
            ranked = names.dictionary.take(pa.array(order)).to_pylist()
            source = of[names.indices.to_numpy(zero_copy_only=False)]
            n, p, zero = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("n", "p", "zero"))
            cuts = [0, *(np.nonzero(np.diff(lang))[0] + 1).tolist(), len(lang)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                width = len(ranked)
                sums: dict[int, int] = defaultdict(int)

                def add(g, h, v, width=width, sums=sums):
                    u, back = np.unique(np.minimum(g, h) * width + np.maximum(g, h), return_inverse=True)
                    total = np.zeros(len(u), np.int64)
                    np.add.at(total, back, v)
                    for k, t in zip(u.tolist(), total.tolist(), strict=True):
                        sums[k] += t

                block_sums(offsets[lo : hi + 1], source, n, p, zero, add)
                name = langs.dictionary[lang[lo]].as_py()
                for k, t in sums.items():
                    held[name, ranked[k // width], ranked[k % width]] += t
                if len(held) > 200_000:
                    yield given()
        yield given()

    return cells.mapInArrow(run, "lang string, g string, h string, value bigint").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, how far each other source of the language is off, and part `term`, the
    `top` terms that a source has above its language.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps those that at least `least` of its
    documents have. Price of a term in a group: 1 + floor(1e9 (count + 2) / (all counts + 2 kept terms)). Distance of prices p and q:
    floor((p - q)² / (p + q)), summed over kept terms, 0 without any. Ties go by item, in UTF-8 order. Null text, language and source
    are read as ''; a group without terms still has its pairs; repeated rows count each; other columns are ignored; an empty
    table gives an empty result. Counts are exact at any size: prices are made in decimals.

    Counts are summed in tasks, then moved once, by language and term. Kept terms are one row with the priced cells of their groups. Blocks
    of terms with near totals, and so with few different counts, give the joint tables of all pairs of groups as products of
    indicator matrices (see block_sums); levels of no occurrences come from margins, so the work follows the cells there are.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    moved = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    kept = moved.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells")).filter(F.col("docs") >= least)
    kept = materialise(kept.drop("docs"), "audit-kept")
    flat = kept.select("lang", "term", "total", F.inline("cells"))
    # one row a language, and one a group: what the output has of each
    langs = kept.groupBy("lang").agg(F.sum("total").alias("all"), F.count(F.lit(1)).alias("terms"))
    used = flat.groupBy("lang", "source").agg(F.sum("n").alias("mine"), F.count(F.lit(1)).alias("have"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(used, ["lang", "source"], "left").na.fill(0, ["all", "terms", "mine", "have"])
    stats = materialise(groups.withColumn("zero", F.when(F.col("terms") > 0, priced(F.lit(0), F.col("mine"), F.col("terms")))), "audit-groups")
    cells = flat.join(stats, ["lang", "source"]).withColumn("p", priced(F.col("n"), F.col("mine"), F.col("terms")))
    q = priced(F.col("total"), F.col("all"), F.col("terms"))
    cells = cells.select("lang", "term", "total", q.alias("q"), F.struct("source", "n", "p", "zero").alias("cell")).groupBy("lang", "term").agg(F.first("total").alias("total"), F.first("q").alias("q"), F.collect_list("cell").alias("cells"))
    cells = materialise(cells.sortWithinPartitions("lang", "total"), "audit-cells")
    flat = cells.select("lang", "term", "q", F.inline("cells"))

    above = flat.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    levels = flat.groupBy("lang", "source", "n", "p").agg(F.count(F.lit(1)).alias("k"))
    other = stats.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_other"), F.col("have").alias("have_other"))
    alone = levels.join(other, "lang").filter("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("k") * gap(F.col("p"), F.col("zero_other"))).alias("alone"))
    ends = F.least("source", "other").alias("g"), F.greatest("source", "other").alias("h")
    alone = alone.select("lang", *ends, "alone").groupBy("lang", "g", "h").agg(F.sum("alone").alias("alone"))
    both = pair_sums(cells.select("lang", "cells"))
    g = stats.select("lang", F.col("source").alias("g"), F.col("zero").alias("zg"), F.col("have").alias("kg"), "terms")
    h = other.select("lang", F.col("other").alias("h"), F.col("zero_other").alias("zh"), F.col("have_other").alias("kh"))
    pairs = g.join(h, "lang").filter("g < h").join(both, ["lang", "g", "h"], "left").join(alone, ["lang", "g", "h"], "left")
    neither = (F.col("terms") - F.col("kg") - F.col("kh")) * gap(F.col("zg"), F.col("zh"))
    value = F.coalesce(neither, F.lit(0)) + F.coalesce("value", F.lit(0)) + F.coalesce("alone", F.lit(0))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("g").alias("source"), F.col("h").alias("item")), F.struct(F.col("h").alias("source"), F.col("g").alias("item")))).alias("e"), value.alias("value"))
    pairs = pairs.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
o AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM o GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT lang, source, sum(o.n) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS count, (1 + 1000000000 * (coalesce(o.n, 0) + 2)::HUGEINT // (coalesce(m.n, 0) + 2 * l.v)::HUGEINT) AS p, (1 + 1000000000 * (k.total + 2)::HUGEINT // (l.n + 2 * l.v)::HUGEINT) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term LEFT JOIN m ON m.lang = g.lang AND m.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM c a JOIN c b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM c WHERE count > 0 AND p > q),
f AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e)
SELECT * FROM f WHERE part = 'pair' OR rank <= 10
"""
