"""Audit entries: what each phase logs, as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ["phase1_ocr", "phase2_interpretation", "phase3_product_matching", "phase4_customer_matching", "phase5_draft", "phase6_user_action", "phase9_api"]


def ocr_entry(raw_text: Column, regions: Column) -> Column:
    """The first 500 characters, and of the first 20 regions the first 50."""
    return F.struct(F.substring(raw_text, 1, 500).alias("raw_text"), F.transform(F.slice(regions, 1, 20), lambda r: F.substring(r["text"], 1, 50)).alias("regions"), F.size(regions).alias("region_count"))


def interpretation_entry(items: Column) -> Column:
    return F.transform(items, lambda i: F.struct(F.substring(i["detected_text"], 1, 50).alias("text"), i["quantity"].alias("quantity"), i["price"].alias("price")))


def entries(rows: DataFrame, trace_id: str, phase: Column, data: Column, at: Column) -> DataFrame:
    """(timestamp, trace_id, phase, data) rows ready to append; data is JSON text."""
    return rows.select(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.col(trace_id).cast("string").alias("trace_id"), phase.alias("phase"), F.to_json(data).alias("data"))


def trace(log: DataFrame, trace_id: str) -> DataFrame:
    return log.where(F.col("trace_id") == trace_id).orderBy("timestamp")
