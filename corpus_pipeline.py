"""From raw documents to sampled pieces: quality, lines, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
but for the last returns the columns of documents.

Every stage takes whole texts of any length, judges rows one by one whatever their ids,
treats repeated rows by the rules below, passes other columns on, and gives an empty
table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelab.llm import bktree, lattice, line_minhash, phrase_index, resample
from gatelab.llm.runtime import read_parquet, write_scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps.  Null and empty texts have weight zero and are sampled like any other;
    rows of equal id and text stay or go together, and so do rows tied at the end of the sample."""
    return resample.keep_sampled(docs, read_parquet(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier line exactly or nearly.  Null texts stay null, rows of null id
    stay as they are, rows of equal id and text are changed alike."""
    found = line_minhash.dedup_lines(docs)
    n_chars = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, null last, ties by hashes of the texts.  Texts without words
    (null, empty, blank) are copies of one another; of repeated rows one stays."""
    return bktree.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate.  Null texts have no words and stay; rows of null id are judged
    like any other."""
    return phrase_index.drop_contaminated(docs, read_parquet(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces: a sampled segmentation of each text, null for null, empty for empty; rows of equal id and
    text get equal pieces."""
    found = lattice.encode(docs.select("doc_id", "text"))
    return found.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), "pieces")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("decontaminate", decontaminate), ("pieces", pieces)]

#: Hashed models, MinHash, SimHash and sampling are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_parquet(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_scratch(docs, name)
    return docs
