"""The corpus pipeline: toxic documents out, one of each near-duplicate group kept, benchmark leaks out, personal data
replaced, and what is left packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Decisions are made row by row: stages that compare documents
number the rows first, so that rows that repeat a doc_id, or have none, are each judged by their own text. Every stage
keeps rows that it has nothing against, null texts and null ids included. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import decontaminate, ngram_join, packing, pii, toxicity
from postloom.llm.common import stored
from postloom.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model learned from their labels does not predict to be toxic."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, stored so that it does not change, and the number's column."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def _texts(numbered: DataFrame, name: str) -> DataFrame:
    return numbered.select(F.col(name).alias("doc_id"), "text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by 5-word shingles at a similarity of 0.8 or more, directly or by others, the one with the smallest
    doc_id (a row without one only where none has any; of equal ones, one). Rows without words link with nothing."""
    numbered, row = _numbered(docs)
    linked = ngram_join.jaccard_components(_texts(numbered, row)).select(F.col("doc_id").alias("r"), F.col("component_id").alias("c"))
    linked = stored(linked)
    groups = linked.where("r <> c").select("c").distinct()
    ids = numbered.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("id"))
    members = stored(linked.join(groups, "c", "left_semi").join(ids, "r"))
    first = members.groupBy("c").agg(F.min_by("r", F.struct(F.col("id").isNull(), "id", "r")).alias("stays"))
    gone = members.join(first, "c").where("r <> stays").select(F.col("r").alias(row))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item."""
    numbered, row = _numbered(docs)
    leaks = decontaminate.contaminated(_texts(numbered, row), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return numbered.join(leaks.select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs, pii.train(docs))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.packed(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("decontaminate", drop_leaks),
    ("pii", redact),
    ("packing", pack),
]

#: Models, an edit distance and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage gives for documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs)
    return docs
