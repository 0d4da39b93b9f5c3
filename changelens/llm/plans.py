"""The registered corpus queries: thin bindings of the operators to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import best_fit, exact_dedup, jaccard_join, merkle, mixing, packing, passages, pii, quality_model, quality_rules, sharding, spelling, url_filter
from .common import table


def op1_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_packing(spark, sf_dir):
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_jaccard_join(spark, sf_dir):
    groups = jaccard_join.linked_groups(table(spark, sf_dir, "documents"), k=4, percent=85)
    return groups.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op4_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_passages(spark, sf_dir):
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "doc_id", F.col("_keep_id").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op10_quality_model(spark, sf_dir):
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return merkle.manifest(docs, tampered, altered={"text": lowered}).withColumnRenamed("id", "doc_id")


def op12_best_fit(spark, sf_dir):
    import public_tokenizers
    return best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling(spark, sf_dir):
    words = spelling.count_words(table(spark, sf_dir, "documents"), typo_every=97)
    return spelling.group_variants(words)


QUERIES = {f.__name__: f for f in (op1_pii, op2_packing, op3_jaccard_join, op4_url_filter, op5_mixing, op6_sharding, op7_passages,
                                op8_exact_dedup, op9_quality_rules, op10_quality_model, op11_merkle, op12_best_fit, op13_spelling)}

ORACLE = {
    "op11_merkle": merkle.ORACLE,
    "op13_spelling": spelling.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op8_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                   FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g USING (t)""",
}
