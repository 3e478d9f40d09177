"""What the training-data operators share: tables, checkpoints and skew-safe lookups."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most this many keys can each hold one such part of all rows; lists of hot keys are broadcast under that bound.
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder; set here only where a local session has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            place = tempfile.mkdtemp(prefix="ledgerloom-")
        sc.setCheckpointDir(place)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; Spark's cleaner drops the files with the last reference."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Whole texts go to Python workers in batches of so many rows at most: what a worker holds is bounded by a few texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, rows)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def parts_for(rows: int, per_part: int) -> int:
    return max(1, -(-int(rows) // per_part))


def long_ids(values: Iterable) -> pd.api.extensions.ExtensionArray:
    """Ids (None, or a number or its digits) as nullable longs; pandas alone would turn them into doubles where one is null."""
    return pd.array([None if x is None else int(x) for x in values], "Int64")


def frame(rows: list[tuple], schema: str, ids: int = 1) -> pd.DataFrame:
    """Rows of a schema "name type, ..." as pandas; the first `ids` columns are nullable longs."""
    names = [x.split(" ")[0] for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pd.DataFrame({n: long_ids(c) if k < ids else list(c) for k, (n, c) in enumerate(zip(names, columns, strict=True))})
