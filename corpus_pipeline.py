"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
scratch folder and read again as the next stage's docs. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogmap.llm import decontaminate, line_align, packing, simhash, toxicity
from catalogmap.llm.names import free_names
from catalogmap.llm.queries import public_encoder, toxic_labels
from catalogmap.plans.registry import table
from catalogmap.session import scratch_dir

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC_FROM. A null text is scored as an empty one."""
    model = toxicity.train(toxic_labels(docs, table(spark, sf_dir, "labels")))
    return docs.where(model.score(F.col("text")) < TOXIC_FROM)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks of lines that an earlier one holds; those of which nothing is left go.

    n_chars is counted anew where lines went. Documents that were empty before stay.
    """
    cleaned = line_align.delete_copied_lines(docs)
    left = cleaned.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash group.

    Rows that share a doc_id are one document and stay once. A row without doc_id cannot stand for a group
    or be told from one, so it stays.
    """
    groups = simhash.near_duplicates(docs, shingle=4, max_bits=4).where("doc_id is not null")
    of_id = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    kept = docs.join(of_id.where("not stays").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    if of_id.where("stays and n > 1").isEmpty():
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. A row is judged by its own text, also where ids repeat or are null."""
    found = decontaminate.contaminated_texts(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct()
    own_id, own_key = free_names(docs, "leak_id", "leak_key")
    found = found.withColumnsRenamed({"doc_id": own_id, "text_key": own_key})
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    return docs.join(found, same, "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of training sequences."""
    return packing.pack(docs, public_encoder())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_copied_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A trained scorer, XXH64 fingerprints, alignments and a tokenizer have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of ``sf_dir``."""
    folder = f"{scratch_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
