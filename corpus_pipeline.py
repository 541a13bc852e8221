"""The corpus pipeline: stages over `documents`, each stored before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracestrata import materialize, scratch_dir
from tracestrata.llm import decontaminate, near_duplicates, packing, secrets, toxicity
from tracestrata.llm.joins import sized


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Rows without an id are given one by their text, from here on; ids of documents lie below.
_UNNAMED = 1 << 62


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a key column: the id, or for a row without one a number made from its text."""
    key = "_key"
    while key in docs.columns:
        key = "_" + key
    made = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(_UNNAMED - 1) + F.lit(_UNNAMED)
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), made)), key


def _without(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """`docs` without the rejected keys, and without the key."""
    gone = materialize(rejected.select(F.col("doc_id").alias(key)).distinct())
    return docs.join(sized(gone), key, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar rejects go."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Rows without an id come last in this order, and of equal ones one stays.
    """
    keyed, key = _keyed(docs)
    found = near_duplicates.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    kept = _without(keyed, key, found.where("not kept"))
    unnamed = kept.where(F.col("doc_id").isNull()).dropDuplicates([key])
    return kept.where(F.col("doc_id").isNotNull()).union(unnamed.select(kept.columns)).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go, those without an id as well."""
    keyed, key = _keyed(docs)
    texts = keyed.select(F.col(key).alias("doc_id"), "text")
    found = decontaminate.decontaminate(texts, _table(spark, sf_dir, "benchmark"))
    return _without(keyed, key, found.where("contaminated")).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; every secret in a text is replaced by a mark."""
    spans, key = "_spans", "_key"
    while spans in docs.columns or key in docs.columns:
        spans, key = "_" + spans, "_" + key
    # Spans follow from the text alone, so each row is masked by those of its own text, with or without an id.
    keyed = docs.withColumn(key, F.sha2(F.col("text").cast("binary"), 256))
    found = secrets.find_secrets(keyed, key=key).where("size(spans) > 0").dropDuplicates([key])
    joined = keyed.join(sized(materialize(found.withColumnRenamed("spans", spans))), key, "left")
    # A column of its own first: beside a new `text`, a length of the old one would be taken from the new one.
    masked = joined.withColumn(key, secrets.redact(F.col("text"), F.col(spans)))
    columns = {"text": F.col(key)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(key).cast("long"))
    return masked.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "window", "step_group",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]

# Scores of a fitted model and a tokenizer are beyond SQL; tests check that ids shrink,
# that hex secrets are masked and that packing keeps the ids; no test compares kept ids or run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; every stage's rows are stored before the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        where = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
