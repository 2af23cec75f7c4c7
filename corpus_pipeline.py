"""A corpus pipeline of five stages over documents: toxicity, line deduplication,
near duplicates, benchmark decontamination, mixture.

Each stage is (name, function of spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's docs. All but the last keep the columns
of documents.

* toxicity: documents with a predicted score of 0.5 or more go. The model learns
  from labelled rows as query op5 does, of the documents at hand.
* lines: near-duplicate lines after their first occurrence go; a document that
  loses all its words this way goes too; documents without words stay.
* near_duplicates: of each connected group of documents whose 5-word shingle sets
  have a similarity of 0.75 or more, the smallest doc_id stays. Documents without
  words or without id stay.
* decontamination: documents that contain a window of 10 words of a benchmark item
  (or a whole shorter item) go.
* mixture: how many words the mix takes from each document.

n_chars follows the text. Extra columns of docs are kept but for the last stage.
Repeated rows with one doc_id are one document to the near-duplicate stage: they
all stay or go. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderquill.llm.common import materialize
from tenderquill.llm.cube_mix import mix
from tenderquill.llm.decontaminate import decontaminate
from tenderquill.llm.line_dedup import dedup_lines
from tenderquill.llm.ngram_join import link_components
from tenderquill.llm.toxicity import score_texts, toxicity_model

HAS_WORD = r"[^\x20\x09-\x0D]"


def shielded(docs: DataFrame) -> DataFrame:
    """docs whose extra columns can't clash with those an operator adds."""
    return docs.withColumnsRenamed({c: f"kept_{c}" for c in docs.columns if c not in ("doc_id", "text")})


def restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(c if c in ("doc_id", "text") else f"kept_{c}").alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restored(score_texts(shielded(docs), model).where("toxicity < 0.5"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(shielded(docs))
    out = restored(out.where((F.col("n_removed") == 0) | F.col("text").rlike(HAS_WORD)), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    members = link_components(docs.select("doc_id", "text"))
    gone = members.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate(shielded(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restored(out.where(F.size("hits") == 0), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Toxicity is a trained model and the mixture a random draw: SQL can't express them.
ORACLE_SQL = None
