"""Corpus pipeline over ``documents``: toxic documents go, repeated lines go, one document of each group of near copies stays,
documents that hold benchmark passages go, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.

Nulls in any column, empty and very long texts, ties, repeated rows and empty tables go through every stage; more columns are kept as they
are. What becomes of each case is told in the stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, lines, packing, simhash, toxicity
from ledgerloom.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the network learns from the labelled ones among docs. Null and empty texts have the score of an
    empty window; rows without an id and repeated rows are scored like any other; very long texts by all their windows."""
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds; one that loses all keeps an empty text. A null text becomes an empty
    one; a row without an id loses no line and takes none from others; repeated rows are treated alike."""
    return lines.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group alike in at least 0.8 of their five-word shingles. Texts without words, null
    ones among them, are one group; unlike texts of one id all stay, repeated rows once; rows without an id all stay."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay, and so do all documents if the benchmark is empty; rows
    without an id and repeated rows are searched like any other, very long texts whole."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. Null and empty texts are one piece, the end id; rows without an id and
    repeated rows are packed like any other; long texts are cut into pieces."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]
#: The network and the fingerprints are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table documents; what a stage keeps is written to the shared folder. An empty table gives no
    pieces."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
