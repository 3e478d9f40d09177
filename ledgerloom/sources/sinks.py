"""Sinks: JSON files. Nothing is sent over a network; a dry run is the payload as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_report(rows: DataFrame, folder: str, engine: str, stamp: str) -> None:
    """The report under its time, and again as the engine's latest."""
    write_json(rows, f"{folder}/{stamp}_{engine}")
    write_json(rows, f"{folder}/latest_{engine}", "overwrite")


def append_audit(entries: DataFrame, path: str, enabled: bool = True) -> None:
    if enabled:
        entries.write.mode("append").json(path)


def transaction_body(payloads: DataFrame) -> DataFrame:
    """What goes out for a confirmed draft: header fields and items without product names; a missing subtotal is price times quantity."""
    item = lambda i: F.struct(i["product_id"].alias("product_id"), i["description"].alias("description"), i["quantity"].alias("quantity"), i["unit"].alias("unit"), i["unit_price"].alias("unit_price"), F.coalesce(i["subtotal"], i["unit_price"] * i["quantity"]).alias("subtotal"))
    return payloads.select("draft_id", F.to_json(F.struct(F.col("transaction.customer_id").alias("customer_id"), F.col("transaction.transaction_date").alias("date"), F.transform("items", item).alias("items"), "total_amount")).alias("body"))


def response_id(body: str = "body"):
    """The id in an answer: at id, data.id or data.transaction.id."""
    at = lambda p: F.get_json_object(F.col(body), p)
    return F.coalesce(at("$.id"), at("$.data.id"), at("$.data.transaction.id")).cast("long")


def scan_json(scans: DataFrame) -> DataFrame:
    """(scan_id, json) of scans: confidences to four places, and a layout's defaults where there is none."""
    layout = F.struct(
        F.coalesce("layout.page_width", F.lit(0)).alias("page_width"), F.coalesce("layout.page_height", F.lit(0)).alias("page_height"), F.coalesce("layout.orientation", F.lit("portrait")).alias("orientation"),
        F.coalesce("layout.columns", F.lit(1)).alias("columns"), F.coalesce("layout.writing_direction", F.lit("ltr")).alias("writing_direction"),
    )
    each = F.transform("regions", lambda r: F.struct(r["text"].alias("text"), r["bbox"].alias("bbox"), F.bround(r["confidence"], 4).alias("confidence"), r["type"].alias("type"), r["engine"].alias("engine")))
    return scans.select("scan_id", F.to_json(F.struct("status", "model", F.bround("confidence", 4).alias("confidence"), "raw_text", each.alias("regions"), layout.alias("layout"), "warnings")).alias("json"))


def draft_json(payloads: DataFrame) -> DataFrame:
    """(draft_id, json) of confirmed payloads."""
    return payloads.select("draft_id", F.to_json(F.struct(*[c for c in payloads.columns if c != "draft_id"])).alias("json"))
