"""The thin queries of the training-data operators: each reads a whole table and derives its contract's columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language, licenses, neardup, negatives, packing, pii, repetition, search, secret_scan, substrings, urlblock, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; LOOM_TOKENIZER names another file."""
    if own := os.environ.get("LOOM_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language.fold(F.col("doc_id")) == 1
    learned = language.fit(docs.where(~held).select("doc_id", "lang", "text"))
    out = language.predict(docs.select("doc_id", "text"), learned, reject=False)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repetition.repetition_coverage(table(spark, sf_dir, "documents"))
    return out.drop("gram_shares", "line_share")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_main_text(table(spark, sf_dir, "pages")).drop("n_template")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["o"] < len(secret_scan.BASE))
    return found.select(
        "doc_id",
        *(count(r.kind) for r in secret_scan.BASE),
        F.sha2(secret_scan.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("found")).alias("spans"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlblock.judge_urls(table(spark, sf_dir, "pages")).drop("alias_blocked")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", decontam.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_private(docs, pii.fit(docs))
    count = lambda k: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(count(k) for k in pii.BASE),
        F.sha2(secret_scan.spans_text(F.filter("found", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("found")).alias("spans"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")
    rows = negatives.clean_vectors(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return negatives.mine_hard_negatives(rows, F.expr("vec_id % 50 = 0"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_language, op3_licenses, op4_repetition, op5_main_text,
        op6_near_duplicates, op7_secrets, op8_url_filter, op9_substrings, op10_decontamination,
        op11_personal_data, op12_ranked_search, op13_hard_negatives,
    )
}
