"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ball_codes, classify, decontaminate, html_text, mixing, mixing_lm, near_dedup, oracles, pii, signature_tree, turn_repair, url_filter
from .shared import fold_of

#: Which urls are listed: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Target weights of the mix; sources without one have the smallest.
MIX_WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", *(F.col(f"url_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return classify.classify(docs, labels, "quality", "linear", 0.3, held_out=fold_of("doc_id") == 0)


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.language_scores(_table(spark, sf_dir, "documents"), held_out=fold_of("doc_id") == 1)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"), "contaminated")


def op6_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    base, terms = pii.span_text(F.col("base")), pii.span_text(F.col("terms"), kind="term")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return classify.classify(docs, labels, "toxic", "factors", 0.5, held_out=fold_of("doc_id") == 0)


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4, similarity=0.8)


def op10_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.audits(turn_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.jaccard_join(_table(spark, sf_dir, "documents"), words=4, similarity=0.85)


def op13_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pfair_mix, op2_url_rules, op3_quality, op4_context_mixing, op5_decontaminate, op6_pruned_graph, op7_personal_data, op8_toxicity, op9_minhash_forest, op10_dom_model, op11_turn_repair, op12_signature_tree, op13_ball_codes)
}

#: The learned, approximate and parsing operators have none: tests hold them against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op2_url_rules": oracles.url_rules(URL_RULES),
    "op5_decontaminate": oracles.DECONTAMINATION,
    "op9_minhash_forest": oracles.near_duplicates(80, ", d.doc_id = component_id AS kept"),
    "op11_turn_repair": oracles.TURN_REPAIR,
    "op12_signature_tree": oracles.near_duplicates(85, ""),
    "op13_ball_codes": oracles.ball_codes(),
}
