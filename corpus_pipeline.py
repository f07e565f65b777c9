"""The corpus pipeline: five stages from raw documents to packed training sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import languages, quality, simhash, templates
from tillscope.llm.queries import language_model, pack_documents
from tillscope.llm.shared import shared_folder

#: A document that resembles no language by at least this cosine is rejected.
LEAST_COSINE = 0.05


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and the others as one column `_row`, which no operator replaces."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(F.lit(0).alias("_"), *rest).alias("_row"))


def _restored(docs: DataFrame, *needed: str) -> list:
    """The columns of docs, in their order."""
    return [
        F.col(c) if c in needed else F.col("_row").getField(c).alias(c) for c in docs.columns
    ]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that resemble no language of the corpus.

    So null and empty texts go; repeated rows stay; an empty table gives an empty one.
    """
    judged = languages.predict(_carried(docs, "text"), language_model(spark, sf_dir))
    known = (F.col("lang_pred") != languages.UNDETERMINED) & (F.col("score") >= LEAST_COSINE)
    return judged.where(known).select(*_restored(docs, "text"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are outliers of their language and source.

    Null and empty texts fail the base rules; a null language or source is a group like others;
    repeated rows stay; an empty table gives an empty one.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    judged = quality.judge(docs.select("text", "lang", "source", whole), carried=["_row"])
    return judged.where("kept").select("_row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of templates that recur across documents; n_chars follows the text.

    Every row stays, also with a null, empty or emptied text or without doc_id; an empty table
    gives an empty one. Other columns stay as they are, whatever they are called.
    """
    left = templates.drop_recurring(_carried(docs, "doc_id", "text"))
    left = left.select(*_restored(docs, "doc_id", "text"))
    if "n_chars" not in docs.columns:
        return left
    return left.withColumn("n_chars", F.length("text").cast("bigint"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest doc_id.

    A document without doc_id comes after all others, so it stays only if it is the group's choice.
    Rows of a group with the same doc_id and the same text are one; rows of different groups that
    happen to share a doc_id all stay.
    """
    place = F.struct(
        F.col("doc_id").isNull().alias("unnamed"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("digest"),
    ).alias("place")
    groups = simhash.near_duplicates(docs, shingle=3, distance=3, carried=[place])
    first = groups.groupBy("component").agg(F.min("place").alias("place")).select("place").distinct()
    names = [f"`{c}`" for c in docs.columns]
    placed = docs.select(place, F.struct(*names).alias("row")).join(first, "place", "left_semi")
    return placed.dropDuplicates(["place"]).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; null and empty texts are their end token.

    The last stage returns op5's columns and none of the input's; an empty table gives an empty one.
    """
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", keep_quality),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: No stage but the base rules can be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the directory's documents; each stage's result is a Parquet table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
