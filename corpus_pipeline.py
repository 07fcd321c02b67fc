"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, SentencePiece ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm import decontaminate, lines, neardup, sentencepieces, toxicity
from tablescope.llm.queries import MODEL_FILE
from tablescope.session import shared_folder
from tablescope.sources.tables import read_table

TOXIC = 0.3  # documents with this score or more go
MOST_BOILERPLATE = 0.5  # a copy of another row with a larger share of common lines is left to near-dedup


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels of rows that are gone are not needed."""
    labels = read_table(spark, f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    index = toxicity.fit(docs, labels)
    return toxicity.score(docs, index).where(F.col("score") < TOXIC).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur on many sites are cut out of the texts; all documents stay."""
    found = lines.remove_boilerplate(docs, most=MOST_BOILERPLATE)
    clean = found.withColumns({"text": F.col("clean"), "n_chars": chars("clean", "text")})
    return clean.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return neardup.near_duplicates(docs).where("kept").select(*docs.columns)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    benchmark = read_table(spark, f"{sf_dir}/benchmark.parquet")
    clean = decontaminate.remove_contamination(docs.withColumn("__before", F.col("text")), benchmark)
    return clean.withColumn("n_chars", chars("text", "__before")).select(*docs.columns)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and ``round_trip``: whether the ids decode to the text."""
    model = spark.conf.get("tablescope.sentencepiece.model", MODEL_FILE)
    coded = sentencepieces.decode(sentencepieces.encode(docs, model), model)
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return coded.select(*docs.columns, "ids", F.size("ids").cast("bigint").alias("n_tokens"), same.alias("round_trip"))


def chars(new: str, old: str):
    """``n_chars`` of the new text; as it was where the text did not change."""
    return F.when(F.col(new).eqNullSafe(F.col(old)), F.col("n_chars")).otherwise(F.char_length(new).cast("bigint"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate_documents),
    ("sentencepiece", encode_documents),
]
#: Models, signatures and pieces cannot be stated in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
