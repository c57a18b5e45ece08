"""The registered queries over the operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontamination import find_contamination
from .filter_audit import audit, cells
from .license_scan import scan_licences
from .line_dedup import drop_boilerplate
from .mixing import mix
from .oracles import DECONTAMINATION, FILTER_AUDIT, LINE_DEDUP, PERIODIC_RUNS, SHARDING, SUFFIX_DEDUP
from .periodic_runs import find_runs
from .quality_classifier import classify_quality
from .quality_rules import apply_rules, fit_rules
from .secret_scan import scan_secrets
from .sharding import place
from .simhash_dedup import near_duplicates
from .suffix_dedup import repeated_strings
from .token_files import token_index


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_boilerplate(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(table(spark, sf_dir, "documents")).drop("spans").withColumnRenamed("id", "doc_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans").withColumnRenamed("id", "doc_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which a tenth of the texts end in a repetition, by the contract's rule; null ids are left alone."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    a, p = F.col("a"), F.col("p")

    def planted(i):
        return F.get("words", F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), planted), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "longest.*",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_secret_scan": op2_secret_scan,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_token_files": op7_token_files,
        "op8_quality_rules": op8_quality_rules,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_filter_audit": op11_filter_audit,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    """The others rest on trained models, tokenizers, XXH64 or random draws, which SQL has not."""
    return {
        "op4_line_dedup": LINE_DEDUP,
        "op9_suffix_dedup": SUFFIX_DEDUP,
        "op10_decontamination": DECONTAMINATION,
        "op11_filter_audit": FILTER_AUDIT,
        "op12_periodic_runs": PERIODIC_RUNS,
        "op13_sharding": SHARDING,
    }
