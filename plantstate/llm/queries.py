"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantstate.llm import fim, html, licenses, mixing, negatives, omh, pieces, pii, quality, repeats, secrets, topk, urls
from plantstate.llm.oracles import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.0, most=3)
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = licenses.scanned(table(spark, sf_dir, "documents"))
    return s.select(F.col("key").alias("doc_id"), "digest", "license", F.size("notices").cast("long").alias("n_notices"), F.array_join("notices", ", ").alias("notices"))


#: The rules that op3 is asked to apply.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = urls.judged(table(spark, sf_dir, "pages"), URL_RULES)
    return j.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages")).select(F.col("key").alias("page_id"), "url", "text", F.col("n_chars").cast("long").alias("n_chars"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = omh.classes(table(spark, sf_dir, "documents"))
    return c.select(F.col("key").alias("doc_id"), "class_id", "class_size")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secrets.scanned(table(spark, sf_dir, "documents"))
    kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return s.select(F.col("c0").alias("doc_id"), kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"), F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search_table(table(spark, sf_dir, "embeddings"), every=20, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pii.replaced(table(spark, sf_dir, "documents"), key="plantstate")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), (x["start"] + F.length(x["value"])).cast("string"))), ",")
    return r.select(F.col("key").alias("doc_id"), "text", "n_entities", spans.alias("spans"))


def model_path() -> str:
    """The vocabulary file is installed on every machine; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pieces.encoded(table(spark, sf_dir, "documents"), model_path())
    return e.select(F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality.judged(table(spark, sf_dir, "documents"))
    return j.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fim.transformed(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return t.select(F.col("key").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op12_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repeats.without_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return r.select(F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(rows.withColumn("label", moved))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_license_scan, op3_url_filter, op4_main_text, op5_near_duplicates, op6_secret_scan, op7_top_k, op8_surrogates, op9_pieces, op10_quality_rules, op11_fill_in_middle, op12_without_repeats, op13_hard_negatives)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
