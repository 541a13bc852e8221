"""The registered queries of this package: each operator over its whole table.

A query takes its rows from its operator and derives counts and digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata.llm import (
    conversation_repair,
    decontaminate,
    html_text,
    lattice_lm,
    near_duplicates,
    packing,
    prefix_free,
    quality,
    secrets,
    substring_dedup,
    toxicity,
    url_filter,
    whitening,
)
from tracestrata.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"))


def op2_lattice_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lattice_lm.score(_table(spark, folder, "documents"))


def op3_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def span_digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def _equals(value: str):
    return lambda x: x == value


def op4_secret_battery(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    counts = [
        F.size(F.filter(F.col("spans")["kind"], _equals(kind))).cast("long").alias(f"n_{kind}")
        for kind in ("assign", "access", "hex")
    ]
    fixed = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *counts, F.sha2(span_digest(fixed), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"),
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(_table(spark, folder, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "window", "step_group",
    )


def _item_columns() -> list:
    return [
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    ]


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(*_item_columns())


def op6_near_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The same columns, and what is within some words of a passage."""
    documents, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    found = decontaminate.decontaminate(documents, benchmark, slack=decontaminate.SLACK)
    return found.select(*_item_columns(), "n_near", F.array_join("near_items", ",").alias("near_items"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op8_html_crf(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"))


def op10_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(_table(spark, folder, "pages"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_prefix_free_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = prefix_free.remove_repeats(_table(spark, folder, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", n_spans, "kept_sha256")


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    damaged = conversation_repair.damaged(_table(spark, folder, "conversations"))
    return conversation_repair.report(conversation_repair.repair(damaged))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_lattice_lm, op3_toxicity_grammar, op4_secret_battery, op5_packing,
        op6_decontaminate, op6_near_passages, op7_suffix_dedup, op8_html_crf, op9_near_duplicates, op10_url_templates,
        op11_embedding_whitening, op12_prefix_free_dedup, op13_conversation_repair,
    )
}
