"""The sequence ratio (Ratcliff-Obershelp, which is asymmetric): the one place that needs Python. Pairs go over in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerloom.functions.text import common_bound


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sequence_ratio(a: Column, b: Column, needed: Column | None = None) -> Column:
    """Ratio of each pair; null where it isn't needed. A condition around a UDF doesn't keep it from running, so nulls go in."""
    if needed is not None:
        a, b = F.when(needed, a), F.when(needed, b)
    # Called non-deterministic so that no filter on it moves into a join's condition, where a UDF can't be evaluated.
    return F.pandas_udf(_ratios, DoubleType()).asNondeterministic()(a, b)


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the ratio of two texts, from their char_bits()."""
    return F.when(a["n"] + b["n"] == 0, F.lit(1.0)).otherwise(2.0 * common_bound(a, b, 4) / (a["n"] + b["n"]))
