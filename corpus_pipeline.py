"""Cleaning pipeline over `documents`: quality, repeated lines, near copies, benchmark passages, then tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it to the shared folder and rereads it
as the next stage's documents. The last stage returns one row of token counts and digests per document left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.llm.fm_index import find_contamination, verdict
from visitframe.llm.line_spread import dedup_lines
from visitframe.llm.piece_codec import encode_decode
from visitframe.llm.pu_quality import keep_good
from visitframe.llm.queries import table, tokenizer
from visitframe.llm.setsketch import ID_ROWS, NearDuplicates
from visitframe.scaling import broadcast_if_small
from visitframe.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines cut out; a document that loses all its lines goes. `n_chars` follows the text."""
    cut = dedup_lines(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles: that with the smallest id."""
    gone = stage(NearDuplicates(docs, k=5, num=80, den=100).classes().where(~F.col("kept")).select("doc_id"), "near-copies")
    return docs.join(broadcast_if_small(gone, ID_ROWS), "doc_id", "left_anti").select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in benchmark passages."""
    return verdict(find_contamination(docs, table(spark, sf_dir, "benchmark"))).where(~F.col("contaminated")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return encode_decode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", contamination), ("pieces", tokens)]

#: stages with hashes, models and a tokenizer have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
