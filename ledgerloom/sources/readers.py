"""Readers. Recognition engines and services are outside: what they have recorded is read as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOL = "struct<text:string,bbox:array<array<int>>,confidence:double>"
ANNOTATION = f"struct<has_circle:boolean,circle_bbox:array<array<int>>,has_arrow:boolean,arrow_direction:string,has_strikethrough:boolean,strikethrough_start:array<int>,strikethrough_end:array<int>,symbols:array<{SYMBOL}>>"
REGION = f"struct<text:string,bbox:array<array<int>>,confidence:double,type:string,engine:string,annotation:{ANNOTATION},symbol_boxes:array<map<string,string>>>"
LAYOUT = "struct<page_width:int,page_height:int,orientation:string,columns:int,writing_direction:string,line_height_px:int,margins:struct<left:int,right:int,top:int,bottom:int>>"
SCAN = f"scan_id string, status string, model string, confidence double, raw_text string, regions array<{REGION}>, layout {LAYOUT}, preprocessing struct<operations:array<string>,original_dimensions:array<int>,processed_dimensions:array<int>>, warnings array<string>"
ITEM = "struct<product:string,quantity:bigint,unit_price:bigint,raw_line:string,bbox:array<double>,struck_through:boolean>"
SECTIONS = f"image string, date string, currency string, status string, width int, height int, customer string, lines array<string>, items array<{ITEM}>, sections array<struct<customer:string,items:array<{ITEM}>>>, error string, _processing_time double, _model string, _image string, _total_items bigint"
CATALOG_ROW = "id long, name string, default_price double, price double, unit string"
AUDIT = "timestamp string, trace_id string, phase string, data variant"
REGION_TYPES = ["unknown", "date", "customer_name", "product_name", "quantity", "unit_price", "subtotal", "total", "discount", "note"]
# Catalogs for when none can be read.
DEFAULT_CUSTOMERS = [(9, "Kris"), (10, "Bang Lee"), (14, "Rama"), (32, "Marco"), (20, "Mama Sasa")]


def scans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCAN).json(path, multiLine=True)


def images(spark: SparkSession, path: str, pattern: str = "[!_]*.{jpg,jpeg,png}", start: int = 0, limit: int | None = None) -> DataFrame:
    """Image files by path: from the start-th on, at most limit."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime").orderBy("path").offset(start)
    return found if limit is None else found.limit(limit)


def regions(scan_rows: DataFrame) -> DataFrame:
    """Scans to the region rows that interpretation takes; a box is four corners."""
    each = scan_rows.select("scan_id", F.posexplode("regions").alias("pos", "r"))
    corner = lambda k, axis: F.get(F.get(F.col("r.bbox"), F.lit(k)), F.lit(axis))
    return each.select(
        "scan_id", F.col("pos").cast("long").alias("pos"), F.coalesce("r.text", F.lit("")).alias("text"), ((corner(0, 1) + corner(2, 1)) / 2).alias("yc"), corner(0, 0).cast("double").alias("x0"),
        ((corner(0, 0) + corner(2, 0)) / 2).alias("xc"), F.coalesce("r.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("r.annotation.has_circle", F.lit(False)).alias("circled"), F.coalesce("r.annotation.has_strikethrough", F.lit(False)).alias("struck"),
        F.when(F.col("r.type").isin(REGION_TYPES), F.col("r.type")).otherwise("unknown").alias("type"),
    )


def sections(spark: SparkSession, path: str) -> DataFrame:
    """Section results or ground truth, one object or many in a file; flat ground truth becomes one section. Later files replace
    earlier ones of the same image."""
    rows = spark.read.schema(SECTIONS).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    flat = F.array(F.struct("customer", F.coalesce("items", F.array().cast(f"array<{ITEM}>")).alias("items")))
    rows = rows.withColumns({"image": F.coalesce("image", "_image"), "sections": F.coalesce("sections", F.when(F.col("customer").isNotNull() | F.col("items").isNotNull(), flat))}).drop("customer", "items")
    last = rows.groupBy("image").agg(F.max("file").alias("__last"))
    return rows.join(last, rows["image"].eqNullSafe(last["image"])).where(F.col("file") == F.col("__last")).select(rows["*"])


def latest(rows: DataFrame) -> DataFrame:
    """The rows of the file whose name comes last."""
    return rows.join(F.broadcast(rows.agg(F.max("file").alias("file"))), "file")


def without_errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("error", F.lit("")) == "")


def catalog(spark: SparkSession, path: str | None, default: list[tuple[int, str]], envelope: str = "products") -> DataFrame:
    """A catalog from JSON: a list, or an object with the list at data or at the envelope; where there is none, the default."""
    out = spark.createDataFrame([(i, n, None, None, None, k) for k, (i, n) in enumerate(default)], f"{CATALOG_ROW}, cat_pos long")
    if path is None:
        return out
    kind = "array<struct<id:bigint,name:string,default_price:double,price:double,unit:string>>"
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", kind, {"mode": "PERMISSIVE"})
    held = F.from_json("value", f"struct<data:{kind},{envelope}:{kind}>")
    rows = text.select(F.posexplode(F.when(F.trim("value").startswith("["), listed).otherwise(F.coalesce(held["data"], held[envelope]))).alias("cat_pos", "c")).select("c.*", F.col("cat_pos").cast("long").alias("cat_pos"))
    rows = rows.withColumn("default_price", F.coalesce(F.nullif("default_price", F.lit(0.0)), "price"))
    return rows if not rows.isEmpty() else out


def search(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(F.contains(F.lower("name"), F.lit(text.lower())))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)
