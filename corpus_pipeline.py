"""documents, made ready for training: language ID, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the next
stage's docs. All but the last return the columns of documents; the last returns the pieces of packed sequences.
Null texts and texts without a letter have no language and go in the first stage; an empty table stays empty. Repeated rows are copies, of
which one stays; rows with a null id all stay; texts of any length are judged, scanned and packed whole; further columns pass through whatever
their names are, until the last stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltlog.llm.jaccard_join import keep_one
from siltlog.llm.language_id import held_out, keep_identified, learn
from siltlog.llm.packing import pack
from siltlog.llm.queries import tokenizer_path
from siltlog.llm.secrets_scan import redact_secrets, with_lengths
from siltlog.llm.shared import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected. The dictionaries come from labelled documents that aren't held out."""
    return keep_identified(docs, learn(docs.where(~held_out("doc_id")), "doc_id", "text", "lang"), "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies."""
    return keep_one(docs, "doc_id", "text", Scratch(spark, "dedupe"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put [SECRET] in the place of every secret."""
    return with_lengths(redact_secrets(docs, "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 4096-token sequences along the Hilbert curve."""
    return pack(docs, "doc_id", "text", tokenizer_path(), Scratch(spark, "packing")).drop("width", "ids")


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
