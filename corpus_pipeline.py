"""A training corpus from raw documents, in five stages.

Each stage takes what the one before kept and, but for the last, returns the columns of documents. run() writes the
result of each as Parquet in the shared folder and rereads it, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, lines, neardup, packing, quality
from palisade.llm.scratch import bounded_broadcast, discard, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids that are broadcast rather than joined by a shuffle: 8 MB at most.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those ids, whose table is written so that it is computed once."""
    ids = materialise(ids.distinct(), "dropped")
    return docs.join(F.broadcast(ids) if bounded_broadcast(ids, BROADCAST_IDS) else ids, "doc_id", "left_anti").select(*COLUMNS)


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.judged(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("accepted").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier; those of which nothing is left go."""
    out = lines.dedup(docs.select(*COLUMNS)).where("_removed <= 0 or trim(replace(text, '\n', ' ')) <> ''")
    return out.withColumn("n_chars", F.when(F.col("_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies."""
    return _without(docs, neardup.near_duplicates(docs).where("not kept").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where(F.size("spans") > 0).select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_text),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Language model, candidate search and tokenizer are beyond SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
