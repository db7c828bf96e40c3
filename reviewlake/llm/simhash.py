"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, add_columns, checkpointed, materialise


#: shingles hashed at a time
STEP = 1 << 16


def fingerprint(text: bytes | None, k: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the k-word shingles, repeats included; 0 when there are no words. Signed, as Spark's long."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(words) - k + 1)
    for at in range(0, n, STEP):
        some = words[at : min(at + STEP, n) + k - 1]
        runs = (b" ".join(s) for s in zip(*(some[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
        total += bit_counts(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in runs), np.uint64))
    return majority(total, n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(total: np.ndarray, n: int) -> int:
    """The number whose bits are those set in over half of n hashes, as a signed long."""
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def add_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", k: int = 3) -> DataFrame:
    """docs with the long column `out`. Null and empty texts have fingerprint 0."""

    def make():
        return lambda texts: [[fingerprint(t, k) for t in texts]]

    return add_columns(docs, text, [(out, T.LongType())], make)


#: A block is not split on when its members can differ in so few bits only: it then has 2^LAST of them at most.
LAST = 8


def choices(fixed: int, distance: int) -> list[int]:
    """Masks of the bits that blocks within a block are equal in, its own being `fixed`.

    The other bits are cut in distance + 2 parts; two of those at least are equal in a close pair, so every choice of two
    parts, with what is fixed, makes a mask.
    """
    rest = [b for b in range(64) if not fixed >> b & 1]
    n = distance + 2
    edges = [round(len(rest) * i / n) for i in range(n + 1)]
    part = [sum(1 << b for b in rest[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [fixed | x | y for x, y in combinations(part, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, distance: int = 2, hot: int = 64) -> DataFrame:
    """All pairs (u, v), u < v, of distinct fingerprints at most `distance` (up to 3) bits apart. fps has one row for each distinct `fp`.

    Fingerprints that agree in two of distance + 2 parts are a block, and pairs within a block are verified. A block of over `hot`
    members is split the same way by its other bits, and so on: each close pair of it shares one of the smaller blocks. The last
    ones leave LAST bits open and so have 256 members at most.
    """
    if distance > 3:
        raise ValueError("blocks of more than five parts would be split into too many kinds")
    live, masks, found = fps.select("fp", F.lit(0).cast("long").alias("mask")), [0], []
    while True:
        into = {m: choices(m, distance) for m in masks}
        masks = sorted({x for some in into.values() for x in some})
        last = [m for m in masks if 64 - m.bit_count() <= LAST]
        finer = F.create_map(*[x for m, some in into.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(y)) for y in some]))])
        blocked = live.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct().withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = blocked.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        blocked = materialise(blocked.join(sizes, ["mask", "key"]), "simhash-blocks")
        done = (F.col("members") <= hot) | F.col("mask").isin([signed(m) for m in last])
        few = blocked.filter(done)
        met = few.select("mask", "key", F.col("fp").alias("u")).join(few.select("mask", "key", F.col("fp").alias("v")), ["mask", "key"])
        found.append(met.filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v"))
        live = blocked.filter(~done).select("fp", "mask").distinct()
        masks = [m for m in masks if m not in last]
        if not masks or live.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the smallest node reachable.

    Alternating large and small stars: each round links every node's neighbours to its smallest neighbour, so paths
    shrink geometrically, until a round changes nothing. Each round's edges are checkpointed in the shared folder. No group meets in one task: minima are
    combined before the shuffle, and joins with a hot node are ones that Spark may split.
    """
    edges = checkpointed(edges.select("u", "v").filter("u <> v"))
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("u"), "v").filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        edges = checkpointed(small.unionByName(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct())
        # the sum of mixed edges tells whether the set changed; it is one row
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    tree = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return tree.unionByName(tree.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 hex digits; component_id: the smallest id of the rows that a chain of links reaches, links being
    fingerprints at most `distance` bits apart. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows each get their row; a null id keeps its row but never becomes a component_id (null if alone).
    An empty table gives an empty result. Other columns of docs are ignored.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    rows = materialise(add_fingerprint(slim, "text").select("id", "fp"), "simhash")
    fps = rows.groupBy("fp").agg(F.min("id").alias("rep"))
    edges = links(fps.select("fp"), distance)
    comp = components(edges)
    rooted = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    mapping = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(mapping, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

