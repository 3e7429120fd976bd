"""The operators over whole tables, one query each, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import lines, merkle, mixing, packing, phrases, pii, quality, repeats, sharding, simhash, tokenfiles, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its SQL twin if there is one."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Files of the public byte-level vocabulary: for ``tokenizers``, and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(documents, table(spark, sf_dir, "labels")).select(
        "doc_id", *quality.COUNTS, "score", "base_failed", "kept"
    )


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("dropped").cast("long").alias("n_dropped"),
        F.array_join(F.array_sort("dropped"), ",").alias("dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )


@query("op2_suffix_repeats")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = "aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"
    return cut.select(
        "doc_id",
        "n_bytes",
        F.expr(removed).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    text = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = "cast(size(filter(spans, s -> s.base and s.kind = '{0}')) as long) AS n_{0}"
    return found.selectExpr(
        "doc_id",
        *[count.format(kind) for kind in pii.KINDS],
        f"sha2({text.format('filter(spans, s -> s.base)')}, 256) AS base_sha256",
        f"{text.format('spans')} AS spans",
    )


@query("op4_extendible_sharding", sharding.shards_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query("op5_pfair_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(documents).select("doc_id", "source", "start_byte", "block", "slot")


@query("op6_url_filter")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op8_vector_near_dedup", vectors.CLASSES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_classes(table(spark, sf_dir, "embeddings"))


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary())


@query("op13_merkle_manifest", merkle.REPORT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_report(table(spark, sf_dir, "documents"))


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), *vocabulary())


@query("op11_phrase_collocations", phrases.COLLOCATIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
