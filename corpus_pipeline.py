"""A training corpus from raw documents: language ID, line dedup, near-duplicate documents, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

Edge cases, in every stage: columns other than those of documents are dropped; an empty table stays empty. A null text or
one without a letter goes in the first stage; a null lang is filled in there. A null source is a source of its own. Rows
alike in doc_id and text, null ids included, keep the same lines and are one document to the Jaccard stage, which
keeps one row of them; rows that share a doc_id but not the text are two documents. Very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.staging import staged
from granary.llm import langid, lines, mixture, packing, partenum
from granary.llm.queries import digest_pieces, remainder, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose best language scores below LEAST_SCORE; lang becomes the
    predicted language where it was null."""
    train = ~F.coalesce(remainder(4) == 2, F.lit(False))
    told = langid.predict(docs, langid.fit(docs, train), COLUMNS)
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one occurrence of each group of similar lines; a document that loses all its words goes."""
    kept = lines.dedup(docs.select(*COLUMNS)).where((F.col("lines_removed") == 0) | F.col("kept_text").rlike(mixture.WORD))
    size = F.when(F.col("lines_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group with similar sets of five-word shingles (0.8 or more)."""
    # Ids may be null or repeat, so documents are told apart by id and text.
    docs = docs.select(*COLUMNS, F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("uid"))
    ids = docs.groupBy("uid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("id"), F.count("*").alias("n"))
    groups = partenum.similar(docs.select(F.col("uid").alias("doc_id"), "text"), percent=80, n=5)
    groups = groups.select(F.col("doc_id").alias("uid"), F.col("component_id").alias("c")).distinct()
    groups = staged(groups.join(ids, "uid"), "groups", release=True)
    keep = groups.groupBy("c").agg(F.min("id").alias("keep"), F.count("*").alias("members")).where("members > 1")
    others = staged(groups.join(keep, "c").where(F.col("id") != F.col("keep")).select("uid"), "others")
    again = staged(groups.where("n > 1").select("uid"), "again")
    kept = docs.join(others, "uid", "left_anti")
    single = kept.join(again, "uid", "left_semi").dropDuplicates(["uid", "doc_id"])
    return kept.join(again, "uid", "left_anti").union(single).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: sources weigh 5, 2, 1, repeating, and share 150% of the words."""
    mixed = mixture.mix(docs.select(*COLUMNS)).where("mix_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces in sequences of at most 2048 tokens."""
    return digest_pieces(packing.pack(docs, tokenizer_path()))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("n-gram Jaccard join", near_documents), ("mixing", mixing), ("packing", pack)]
#: Language ID, differencing and tokenisation have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), release=True)
    return STAGES[-1][1](spark, docs, sf_dir)
