"""Registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, ctw, fim, fingerprints, line_dedup, mixing, ngram_join, ogg, packing, secrets, superminhash, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.near_clusters(table(spark, sf_dir, "documents"))
    return packing.best_fit(rows, cluster=F.col("cluster"), tokens=F.col("n_tokens"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(table(spark, sf_dir, "documents"))


def op6_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


_TRIGRAMS = ngram_join.Join(n=3, num=90, den=100)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), _TRIGRAMS).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.capture_history(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "key_range", "place")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.report(rows, conversations.damage(rows))


_BIGRAMS = ngram_join.Join(n=2, num=80, den=100)


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), _BIGRAMS)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_syncmers": op2_syncmers,
    "op3_best_fit": op3_best_fit,
    "op4_mixing": op4_mixing,
    "op5_ogg": op5_ogg,
    "op6_ctw": op6_ctw,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_secrets": op10_secrets,
    "op11_conversations": op11_conversations,
    "op12_superminhash": op12_superminhash,
    "op13_fim": op13_fim,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.oracle(),
    "op4_mixing": mixing.oracle(),
    "op7_jaccard_join": ngram_join.oracle(_TRIGRAMS),
    "op11_conversations": conversations.oracle(),
    "op12_superminhash": superminhash.oracle(_BIGRAMS),
    "op13_fim": fim.oracle(),
}
