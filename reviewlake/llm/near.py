"""Near copies by shingles: SimHash blocks and bands of minima find candidates, the exact Jaccard similarity decides.

SimHash fingerprints within two bits find the closest copies. Texts of similarity 0.8 lie some ten of 64 bits apart, where
blocks of a pigeonhole search would be three or four bits wide, so bands of minima find the rest.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, add_columns, checkpointed, materialise
from .lm import U, mixed
from .simhash import bit_counts, components, links, majority

#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99995.
BANDS, ROWS = 25, 5
_rng = np.random.default_rng(42)
FACTORS = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | U(1)
MIX = _rng.integers(0, 1 << 64, ROWS, np.uint64) | U(1)


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of k words, A-Z as a-z; a shorter text is one run, no words none."""
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, U)
    digest = xxhash.xxh64_intdigest
    runs = [b" ".join(words)] if len(words) < k else (b" ".join(s) for s in zip(*(words[i:] for i in range(k)), strict=False))
    return np.unique(np.fromiter((digest(s) for s in runs), U))


def minima(h: np.ndarray) -> np.ndarray:
    """The least of a set that isn't empty under each of the hash functions."""
    low = np.full(BANDS * ROWS, ~U(0), U)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1 << 10):
            np.minimum(low, (FACTORS * h[None, at : at + (1 << 10)]).min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One key per band; sets that share a key agree in all minima of its band."""
    with np.errstate(over="ignore"):
        return mixed((low.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=U) + np.arange(BANDS, dtype=U))


def signature(low: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, sixteen minima in a number."""
    bits = np.zeros(-(-len(low) // 16) * 16, U)
    bits[: len(low)] = mixed(low) & U(15)
    return (bits.reshape(-1, 16) << (U(4) * np.arange(16, dtype=U))).sum(axis=1, dtype=U)


#: Minima in which sets of similarity s differ are about (1 - s) * 15 / 16 of all; pairs further off than this many standard
#: deviations are no candidates, which loses a pair that just has the similarity with probability 0.00003.
DEVIATIONS = 4.0


def resembling(percent: int, u: str = "sig_u", v: str = "sig_v") -> F.Column:
    """Whether two signatures may be those of sets with the similarity: the number of differing minima, by bit arithmetic."""
    differ = F.lit(0)
    for k in range(-(-BANDS * ROWS // 16)):
        x = F.col(u)[k].bitwiseXOR(F.col(v)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    n, p = BANDS * ROWS, (1 - percent / 100) * 15 / 16
    return differ <= n * p + DEVIATIONS * (n * p * (1 - p)) ** 0.5


def add_sketch(docs: DataFrame, text: str, k: int) -> DataFrame:
    """docs with node (hash of the shingle set), n (its size), fp (SimHash of the set), bands and sig (its signature)."""

    def work(texts):
        sets = [shingles(t, k) for t in texts]
        nodes = [xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63) if len(h) else 0 for h in sets]
        fps = [majority(bit_counts(h), len(h)) if len(h) else 0 for h in sets]
        low = [minima(h) if len(h) else None for h in sets]
        keys, sigs = ([f(m).view(np.int64) if m is not None else [] for m in low] for f in (bands, signature))
        return [nodes, [len(h) for h in sets], fps, keys, sigs]

    longs = T.ArrayType(T.LongType())
    return add_columns(docs, text, [("node", T.LongType()), ("n", T.IntegerType()), ("fp", T.LongType()), ("bands", longs), ("sig", longs)], lambda: work)


def add_set(docs: DataFrame, text: str, k: int) -> DataFrame:
    return add_columns(docs, text, [("set", T.ArrayType(T.LongType()))], lambda: lambda texts: [[shingles(t, k).view(np.int64) for t in texts]])


def alike(percent: int) -> F.Column:
    """Whether sizes n_u and n_v allow the similarity."""
    return F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent


def sets_of(named: DataFrame, slim: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, set) of the named nodes, worked out for one row of each and written."""
    row = materialise(nodes.join(named, "node").select("node", F.col("row.id").alias("id_"), F.col("row.th").alias("th_")), "near-named")
    texts = slim.join(row, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")))
    return materialise(add_set(texts.select("node", "text"), "text", k).groupBy("node").agg(F.first("set").alias("set")), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity. Sets join the spread side of the stars first, so that a hot centre meets large
    rows, which Spark splits."""
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v").join(sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u")
    same = F.size(F.array_intersect("set_u", "set_v"))
    return both.filter(same * (100 + percent) >= (F.size("set_u") + F.size("set_v")) * percent).select("u", "v")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()


def close_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) by SimHash: nodes of one fingerprint with the smallest of it, and the smallest of linked fingerprints."""
    heads = nodes.filter("n > 0").groupBy("fp").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("members"))
    ends = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"h_{x}")) for x in "uv"]
    apart = links(heads.select("fp")).join(ends[0], "u").join(ends[1], "v").select(F.array_sort(F.array("h_u", "h_v")).alias("p"))
    same = nodes.select("node", "n", "fp").join(heads.filter("members > 1"), "fp").select(F.array(F.col("head"), F.struct("node", "n")).alias("p"))
    both = apart.unionByName(same).select(*[F.col("p")[k][f].alias(f"{g}{x}") for k, x in enumerate("uv") for f, g in (("node", ""), ("n", "n_"))])
    return both.filter(F.col("u") < F.col("v")).filter(alike(percent)).select("u", "v")


def pairs_within(blocks: DataFrame, percent: int) -> DataFrame:
    """The pairs of one block (key, node, n, root, sig) that no chain of links joins so far and that resemble each other."""
    u, v = (blocks.select("key", F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "root", "sig")]) for x in "uv")
    return u.join(v, "key").filter((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & alike(percent) & resembling(percent)).select("u", "v")


def prefix_pairs(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of a crowd (node, n, root), across components, that may have the similarity: all that exact prefix filtering leaves.
    Where the crowd has signatures too (sig), pairs that these rule out are left out at once.

    In any one order of all shingles, two sets of the similarity share one among the first of each: of a set of n as large as the
    other or larger the first n - ceil(t n) + 1, of the smaller only n - ceil(2 t n / (1 + t)) + 1. The order is: shingles that lie in one
    component alone and so can join no two, then the rarest in the crowd. From the first shared one on both must have as many left as the
    similarity takes; later ones have fewer, so this can be asked of each. What a crowd has in common comes last; members that
    share no more than that have no such shingle in common and never meet. Where the holders of a shingle are mostly of one
    component, these meet the others, not each other.
    """
    signed = "sig" in crowd.columns
    held = crowd.drop("sig").join(sets, "node").select("node", "n", "root", F.explode("set").alias("s"))
    joining = held.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("s", "df")
    useful = held.join(joining, "s").groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("some"))
    free = F.col("n") - F.size("some")  # shingles before these
    ahead = lambda num, den: F.greatest(F.lit(0), F.col("n") - F.expr(f"({num} * n + {den - 1}) div {den}").cast("int") + 1 - free)
    first = useful.withColumn("probe", ahead(percent, 100)).withColumn("index", ahead(2 * percent, 100 + percent))
    first = first.select("node", "n", "root", "index", free.alias("free"), F.posexplode(F.slice("some", F.lit(1), F.col("probe"))).alias("at", "x"))
    first = materialise(first.select(F.col("x.s").alias("s"), "node", "n", "root", (F.col("n") - F.col("free") - F.col("at")).alias("left"), (F.col("at") < F.col("index")).alias("indexed")), "near-prefixes")
    major = first.groupBy("s", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    first = first.join(major.drop("roots"), "s").withColumn("main", F.col("root") == F.col("major"))
    if signed:
        first = first.join(crowd.select("node", "sig"), "node")
    sig = lambda k: [F.col("sig").alias(f"sig_{k}")] if signed else []
    x = first.filter("indexed").select("s", F.col("node").alias("x"), F.col("n").alias("n_u"), F.col("root").alias("root_x"), F.col("left").alias("left_x"), "main", *sig("u"))
    y = first.select("s", F.col("node").alias("y"), F.col("n").alias("n_v"), F.col("root").alias("root_y"), F.col("left").alias("left_y"), F.col("main").alias("main_y"), *sig("v"))
    enough = F.least("left_x", "left_y") * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent
    fits = (F.col("n_u") <= F.col("n_v")) & (F.col("root_x") != F.col("root_y")) & alike(percent) & enough
    if signed:
        fits &= resembling(percent)
    met = [x.filter("NOT main").join(y, "s").filter(fits), x.filter("main").join(y.filter("NOT main_y"), "s").filter(fits)]
    return reduce(DataFrame.unionByName, [m.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")) for m in met]).distinct()


def split_blocks(blocks: DataFrame, links_so_far: DataFrame, name: str) -> DataFrame:
    """The blocks (key, node, n, members) that lie in several components of the links, with each node's root."""
    rooted = blocks.drop("root").join(components(links_so_far), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    return materialise(rooted.join(split, "key"), name)


def central_stars(large: DataFrame, percent: int, heads: int = 3) -> DataFrame:
    """Pairs (u, v) of each member of a large block with some of its members that are in most large blocks, and so in the middle of
    a group. Only a help: what a group's middle links needs no comparing of its members with each other."""
    x = large.join(large.groupBy("node").agg(F.count(F.lit(1)).alias("w")), "node")
    top = x.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(heads)).alias("_h")).agg(F.max(F.struct("w", "node", "n", "root")).alias("h"))
    top = top.select("key", F.col("h.node").alias("u"), F.col("h.n").alias("n_u"), F.col("h.root").alias("root_u"))
    member = large.select("key", F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("root").alias("root_v"))
    met = member.join(top, "key").filter((F.col("root_u") != F.col("root_v")) & alike(percent))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def edges(slim: DataFrame, nodes: DataFrame, k: int, percent: int, hot: int) -> DataFrame:
    """Links (u, v) between nodes; their closure is that of all candidates that have the similarity.

    First each member of a block is compared with the block's smallest, and pairs by SimHash are. Where that leaves a block in several
    components, its pairs across them are compared: all of a block of up to `hot` members. Members of larger ones are compared with
    central ones; of those in blocks that are still split, the crowd, the pairs meet that exact prefix filtering leaves.
    """
    blocked = nodes.select("node", "n", F.explode("bands").alias("key"))
    firsts = blocked.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = materialise(blocked.join(firsts, "key").select("key", "node", "n", "head", "members"), "near-blocks")
    stars = blocks.select(F.col("head.node").alias("u"), F.col("node").alias("v"), F.col("head.n").alias("n_u"), F.col("n").alias("n_v")).filter(F.col("u") < F.col("v")).filter(alike(percent))
    sigs = nodes.select("node", "sig")
    like = lambda pairs: pairs.join(sigs.toDF("u", "sig_u"), "u").join(sigs.toDF("v", "sig_v"), "v").filter(resembling(percent)).select("u", "v")
    tried = materialise(like(stars.select("u", "v").unionByName(close_pairs(nodes, percent)).distinct()), "near-stars")
    found = checkpointed(verified(tried, sets_of(ends_of(tried), slim, nodes, k), percent))

    rest = split_blocks(blocks.drop("head"), found, "near-rest")
    pairs = pairs_within(materialise(rest.filter(F.col("members") <= hot).join(sigs, "node"), "near-small"), percent)
    large = rest.filter(F.col("members") > hot)
    if not large.isEmpty():
        sets = sets_of(large.select("node").distinct(), slim, nodes, k)
        central = materialise(like(central_stars(large, percent)), "near-central")
        found = checkpointed(found.unionByName(verified(central, sets, percent)))
        crowd = split_blocks(large, found, "near-crowd").select("node", "n", "root").distinct()
        pairs = pairs.unionByName(prefix_pairs(crowd.join(sigs, "node"), sets, percent))
        tried = tried.unionByName(central)
    more = materialise(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "near-more")
    if more.isEmpty():
        return found
    return found.unionByName(verified(more, sets_of(ends_of(more), slim, nodes, k), percent))


def sketched(docs: DataFrame, id_col: str, text: str, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows: id, text and hash th of the text; nodes: one row for each distinct shingle set, `row` being its first row: smallest id,
    nulls last, then smallest th, with the number of rows that are equal in both)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    rows = materialise(add_sketch(slim, "text", k).select("id", "th", "node", "n", "fp", "bands", "sig"), "near")
    once = rows.groupBy("node", "id", "th").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bands", "sig")], F.count(F.lit(1)).alias("copies"))
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "copies")
    nodes = once.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bands", "sig")], F.min(row).alias("row"))
    return slim, materialise(nodes, "near-nodes")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, hot: int = 64) -> DataFrame:
    """docs with one row of each group of near copies: texts whose sets of k-word shingles have a Jaccard similarity of `percent`
    or more, or that a chain of such pairs joins. Texts without words are one group.

    The row of the smallest id stays, rows without an id last, then the smallest hash of the text. Ids need not be unique or
    there: rows are told apart by id and text, and of rows equal in both the smallest by the other columns stays.
    An empty table gives an empty result.
    """
    slim, nodes = sketched(docs, id_col, text, k)
    tree = components(edges(slim, nodes, k, percent, hot))
    rooted = nodes.select("node", "row").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.id").alias("_id"), F.col("row.th").alias("_th"), F.col("row.copies").alias("_copies"))
    kept = materialise(kept, "near-kept")
    mine = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th"))
    out = docs.join(kept.filter("_copies = 1").hint("shuffle_hash"), mine, "left_semi").select(*docs.columns)
    again = kept.filter("_copies > 1")
    if again.isEmpty():
        return out
    one = docs.join(again, mine).groupBy("_id", "_th").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return out.unionByName(one.select("row.*"))
