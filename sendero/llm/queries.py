"""Registered queries over whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import scratch
from . import (
    compression,
    decontamination,
    jaccard_join,
    line_dedup,
    merkle_log,
    periodic_runs,
    piece_sampling,
    pseudonyms,
    secrets,
    token_counts,
    toxicity,
    url_rules,
    warc,
)
from .oracles import ORACLES as ORACLES
from .tables import read

PSEUDONYM_KEY = "change me: the key decides the permutation"
TOKEN_LIMIT = 512
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    automata = decontamination.build(read(spark, sf_dir, "benchmark"))
    rows = decontamination.measured(read(spark, sf_dir, "documents").select("doc_id", "text"), automata)
    names = F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string")))
    return rows.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = read(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "ledger")
    secrets.scan(docs, ledger)
    rows = secrets.findings(docs, ledger)
    told = F.array_join(
        F.transform("secret_spans", lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[of(rule.kind) for rule in secrets.RULES], F.sha2(told.cast("binary"), 256).alias("base_sha256"), told.alias("spans")
    )


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = piece_sampling.load()
    encoded = piece_sampling.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = piece_sampling.decode(encoded, vocabulary)
    return decoded.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = merkle_log.manifest(
        read(spark, sf_dir, "documents"),
        ["doc_id", "source", "lang", "n_chars", "text"],
        "lang",
        changed={"text": F.translate("text", upper, upper.lower())},
        where=check % 3 == 0,
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return periodic_runs.digest(periodic_runs.find_runs(docs, periodic_runs.test_pattern("doc_id")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.count(read(spark, sf_dir, "documents"), token_counts.load())
    return rows.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_benchmark_decontamination,
        op3_toxicity,
        op4_compression_bands,
        op5_line_dedup,
        op6_url_filters,
        op7_warc,
        op8_secret_scans,
        op9_pii_pseudonyms,
        op10_piece_sampling,
        op11_merkle_manifest,
        op12_periodic_runs,
        op13_token_counts,
        pipeline,
    )
}
