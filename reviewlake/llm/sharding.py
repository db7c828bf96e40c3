"""Sharding by extendible hashing: only oversized buckets split on another bit. DataFrame functions throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, without

BITS = 60


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; a null key hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: str, depth: Column | int) -> Column:
    return F.expr(f"shiftright({h}, {BITS} - {depth})") if isinstance(depth, int) else F.expr(f"shiftright({h}, cast({BITS} - depth as int))")


def directory(cells: DataFrame, base: int, depth: int, limit: int, top: int = 10) -> DataFrame:
    """cell -> depth of its bucket, null where even a single cell is too large and can still split.

    cells: (cell, bytes, low, high), one row for each `depth`-bit prefix in use with the least and greatest hash. A
    cell's bucket is its shortest prefix, longer than base bits, that holds limit bytes at most, or one hash only.
    """
    up = cells.select("*", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"))
    up = up.withColumn("node", F.expr(f"shiftright(cell, cast({depth} - depth as int))"))
    nodes = up.groupBy("depth", "node").agg(F.sum("bytes").alias("total"), F.min("low").alias("l"), F.max("high").alias("h"))
    nodes = nodes.filter((F.col("total") <= limit) | (F.col("l") == F.col("h"))).select("depth", "node")
    # nodes of few bits are few by construction (2^(top + 1) at most), and each has many cells: these go round
    few = up.filter(F.col("depth") <= top).join(F.broadcast(nodes.filter(F.col("depth") <= top)), ["depth", "node"])
    many = up.filter(F.col("depth") > top).join(nodes.filter(F.col("depth") > top), ["depth", "node"])
    found = few.select("cell", "depth").unionByName(many.select("cell", "depth")).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(found, "cell", "left")


def shards(rows: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 64 << 20, spare: int = 4, step: int = 12) -> DataFrame:
    """rows' key with shard (the bits of its bucket, '' for the only one), depth, n_bytes, and fits.

    Every shard holds limit bytes of text at most (fits), but for one with a single hash: one oversized row, or rows
    that repeat a key, which stay together. Null texts have 0 bytes; null keys share one hash; an empty table gives an
    empty result. Other columns are ignored.

    The hash is of the key, so copies of a text spread. Bytes are summed per prefix of about `spare` more bits than an
    even split needs, before the shuffle; rows then look up their prefix. Only rows of prefixes that are still too
    large go another round with `step` more bits.
    """
    sized = rows.select(F.col(key), hash60(F.col(key)).alias("_h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total) / limit))) + spare)
    base, out, left = 0, None, sized
    while True:
        cell = prefix("_h", depth).alias("cell")
        cells = left.groupBy(cell).agg(F.sum("n_bytes").alias("bytes"), F.min("_h").alias("low"), F.max("_h").alias("high"))
        book = checkpointed(directory(cells, base, depth, limit))
        placed = left.withColumn("cell", prefix("_h", depth)).join(book, "cell").drop("cell")
        done = placed.filter("depth IS NOT NULL")
        out = done if out is None else out.unionByName(done)
        if depth == BITS or book.filter("depth IS NULL").isEmpty():
            break
        left = placed.filter("depth IS NULL").drop("depth")
        base, depth = depth + 1, min(BITS, depth + step)
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"lpad(bin(shiftright(_h, cast({BITS} - depth as int))), cast(depth as int), '0')"))
    named = out.select(key, "_h", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "n_bytes")
    over = named.groupBy("shard").agg(F.sum("n_bytes").alias("total")).filter(F.col("total") > limit)  # single hashes only
    return named.join(over, "shard", "left").select(key, "shard", "depth", "n_bytes", F.col("total").isNull().alias("fits"))


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> None:
    """Write rows as Parquet, one folder for each shard. Rows that repeat a key are in the same shard."""
    placed = shards(rows, key, text, limit).select(F.col(key).alias("_key"), F.col("shard").alias("_shard")).distinct()
    joined = without(rows, "shard").join(placed, F.col(key).eqNullSafe(F.col("_key"))).drop("_key").withColumnRenamed("_shard", "shard")
    joined.repartition("shard").write.partitionBy("shard").parquet(path)


SQL = """
WITH s AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
u AS (SELECT *, unnest(range(0, 25)) AS depth FROM s),
n AS (SELECT depth, h >> (60 - depth) AS node, sum(n_bytes) AS total, min(h) = max(h) AS one FROM u GROUP BY ALL),
b AS (SELECT u.doc_id, u.h, u.n_bytes, u.depth, n.total, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.depth) AS k
  FROM u JOIN n ON u.depth = n.depth AND u.h >> (60 - u.depth) = n.node WHERE n.total <= 67108864 OR n.one)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth::INT, '0') END AS shard, depth::INT AS depth, n_bytes, total <= 67108864 AS fits
FROM b WHERE k = 1
"""
