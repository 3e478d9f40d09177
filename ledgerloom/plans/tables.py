"""The driver's tables in the engine's shapes: parts and customers as catalogs, line items as scanned items and as text regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import match

AS_OF_YEAR, AS_OF_DATE = 2026, "2026-10-09"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.catalog(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_retailprice", "p_brand")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.catalog(table(spark, sf_dir, "customer"), "c_custkey", "c_name")


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with pos, their place in the order: all columns decide, as order and number alone don't; row is their place in the table."""
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.withColumn("row", F.struct("_metadata.file_path", "_metadata.row_index"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return rows.withColumn("pos", F.row_number().over(w).cast("long"))


#: The same place in SQL.
POS = "CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT)"


def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scanned item for each line item; every third has no price, every seventh no product but a raw line."""
    lines = placed_lines(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_retailprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = lines.join(parts, "l_partkey").join(orders.join(named, "o_custkey"), "l_orderkey")
    return rows.select(
        F.col("l_orderkey").alias("image"), (F.col("l_linenumber") % 2).cast("int").alias("section_pos"), F.col("pos").alias("item_pos"), F.col("c_name").alias("customer"), "o_custkey", "o_orderdate",
        F.when(F.col("l_partkey") % 7 != 0, F.col("p_name")).alias("product"), F.concat("p_name", F.lit(" x"), F.col("l_quantity").cast("int")).alias("raw_line"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity").cast("int")).alias("quantity"), F.when(F.col("l_partkey") % 3 != 0, F.col("p_retailprice")).alias("unit_price"),
    )


SECTION_ITEMS = f"""
SELECT l_orderkey AS image, CAST(l_linenumber % 2 AS INT) AS section_pos, pos AS item_pos, c_name AS customer, o_custkey, o_orderdate,
       CASE WHEN l_partkey % 7 <> 0 THEN p_name END AS product, p_name || ' x' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS raw_line,
       CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_quantity AS INT) END AS quantity, CASE WHEN l_partkey % 3 <> 0 THEN p_retailprice END AS unit_price
FROM (SELECT *, {POS} AS pos FROM lineitem) l JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text region for each line item; an order is a page; row is the region's place in the table."""
    lines = placed_lines(spark, sf_dir)
    kind = F.pmod(F.col("l_suppkey") + F.col("l_linenumber"), F.lit(11))
    text = (
        F.when(kind == 0, "Kopi").when(kind == 1, "es teh").when(kind == 2, F.col("l_quantity").cast("int").cast("string")).when(kind == 3, (F.col("l_partkey") * 250).cast("string")).when(kind == 4, "@")
        .when(kind == 5, "Mbak Tami").when(kind == 6, "08/10/2026").when(kind == 7, F.concat(F.lit("part"), F.col("l_partkey").cast("string"))).when(kind == 8, "||").when(kind == 9, "12 Okt 2025").otherwise("-")
    )
    return lines.select(
        F.col("l_orderkey").alias("scan_id"), "pos", "row", text.alias("text"), (F.col("l_quantity") * 7.5).cast("double").alias("yc"), (F.col("l_partkey") % 400).cast("double").alias("x0"), ((F.col("l_partkey") * 3) % 500).cast("double").alias("xc"),
        (F.col("l_partkey") % 100 / 100.0).cast("double").alias("confidence"), (F.col("l_returnflag") == "R").alias("circled"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 0)).alias("struck"),
    )


REGIONS = f"""
SELECT l_orderkey AS scan_id, pos, CASE (l_suppkey + l_linenumber) % 11 WHEN 0 THEN 'Kopi' WHEN 1 THEN 'es teh' WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR)
         WHEN 3 THEN CAST(l_partkey * 250 AS VARCHAR) WHEN 4 THEN '@' WHEN 5 THEN 'Mbak Tami' WHEN 6 THEN '08/10/2026' WHEN 7 THEN 'part' || CAST(l_partkey AS VARCHAR)
         WHEN 8 THEN '||' WHEN 9 THEN '12 Okt 2025' ELSE '-' END AS text,
       CAST(l_quantity * 7.5 AS DOUBLE) AS yc, CAST(l_partkey % 400 AS DOUBLE) AS x0, CAST((l_partkey * 3) % 500 AS DOUBLE) AS xc, CAST((l_partkey % 100) / 100.0 AS DOUBLE) AS confidence,
       l_returnflag = 'R' AS circled, l_linestatus = 'F' AND l_linenumber % 3 = 0 AS struck
FROM (SELECT *, {POS} AS pos FROM lineitem)
"""
