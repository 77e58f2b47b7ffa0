"""The corpus pipeline: from documents to token ids in five stages.

1. toxicity: documents that the class-conditional models reject go.
2. near_duplicates: of each group of documents whose five-word shingles have Jaccard 0.8 or more, the one
   with the smallest doc_id stays.
3. decontamination: documents contaminated by benchmark items go.
4. secrets: every secret in a text is replaced by its kind in brackets; n_chars follows.
5. sentencepiece: texts become ids: doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip, ids.

A stage takes (spark, docs, sf_dir) and returns the documents that stay with the columns of docs, the last
one its ids. Null texts count as empty and stay; an empty table gives an empty one; extra columns pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontam, jaccard_join, pieces, secret_scan, toxicity
from riskloom.llm.frames import only, saved, written

ORACLE_SQL = None  # trained models decide in the first stage


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs, k=5, num=4, den=5)
    gone = saved(groups.filter("doc_id <> component_id").select("doc_id").distinct())
    return only(docs, gone, "doc_id", anti=True).select(docs.columns)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=13, share=20)
    gone = saved(found.filter("contaminated").select("doc_id").distinct())
    return only(docs, gone, "doc_id", anti=True).select(docs.columns)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, pieces.load(pieces.MODEL), ids=True, decode=False)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("benchmark_decontamination", contaminated_out),
    ("secret_scans", secrets_out),
    ("sentencepiece", to_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
