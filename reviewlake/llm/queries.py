"""Queries of this package over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontaminate, divergence, fim, jpeg, lm, pieces, pii, quality, rules, sharding, simhash, urls, warc
from .common import is_training_row, read_table

MODEL_FILE = "piece_bpe_32k.model"


def op1_gam_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.classify(docs.select("doc_id", "text"), model)
    held = F.coalesce(~is_training_row("doc_id"), F.lit(False)) & F.col("doc_id").isNotNull()
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_url_reputation(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return urls.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), labels).drop("url")


def op3_progressive_jpeg(spark, sf_dir):
    return jpeg.round_trip(read_table(spark, sf_dir, "documents"))


def op4_warc_revisits(spark, sf_dir):
    return warc.archived(read_table(spark, sf_dir, "pages"))


def op6_extendible_hashing(spark, sf_dir):
    return sharding.shards(read_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, public_tokenizers.path(MODEL_FILE)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_wu_manber(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")).drop("text")


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_skip_chain_crf(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs).drop("text")


#: the sources taken for the target domain
TARGET_SOURCES = ("src1", "src2", "src3")


def op10_cross_entropy_difference(spark, sf_dir):
    return lm.score(read_table(spark, sf_dir, "documents"), F.col("source").isin(*TARGET_SOURCES))


def op11_line_rules(spark, sf_dir):
    return rules.measures(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op12_fill_in_middle(spark, sf_dir):
    return fim.digests(read_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark, sf_dir):
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_gam_quality, op2_url_reputation, op3_progressive_jpeg, op4_warc_revisits, op5_sentencepiece, op6_extendible_hashing, op7_wu_manber, op8_simhash, op9_skip_chain_crf, op10_cross_entropy_difference, op11_line_rules, op12_fill_in_middle, op13_source_divergence)}
ORACLE_SQL = {"op2_url_reputation": urls.SQL, "op4_warc_revisits": warc.SQL, "op6_extendible_hashing": sharding.SQL, "op11_line_rules": rules.SQL, "op12_fill_in_middle": fim.SQL, "op13_source_divergence": divergence.SQL}
