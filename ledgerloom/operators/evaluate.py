"""Evaluation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.metrics import rounded, share
from ledgerloom.functions.text import normalize_text, strip
from ledgerloom.operators import match


def flatten_sections(images: DataFrame) -> DataFrame:
    """images (image, sections) to items with their places; images and sections without items keep a row."""
    sections = images.select("image", F.posexplode_outer("sections").alias("section_pos", "s"))
    items = sections.select("image", "section_pos", F.col("s.customer").alias("customer"), F.posexplode_outer("s.items").alias("item_pos", "i"))
    return items.select("image", "section_pos", "customer", "item_pos", "i.*")


def dedup_items(items: DataFrame) -> DataFrame:
    """The first of an image's items with equal product and first 50 characters of the raw line, across its sections."""
    low = lambda c: strip(F.lower(F.coalesce(c, F.lit(""))))
    w = Window.partitionBy("image", low(F.col("product")), F.substring(low(F.col("raw_line")), 1, 50)).orderBy("section_pos", "item_pos")
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def held_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct (image, name) of products that a line holds or that hold the line, of lines with over two characters."""
    low = lines.select("image", normalize_text(F.col("text")).alias("line")).where(F.length("line") > 2).distinct()
    texts = low.select(F.col("line").alias("text")).distinct()
    held = match.against(texts, products).withColumn("own", normalize_text(F.col("name"))).where(F.contains("text", "own") | F.contains("own", "text"))
    return low.join(held.select(F.col("text").alias("line"), "name"), "line").select("image", "name").distinct()


def customer_seen(lines: DataFrame, customers: DataFrame) -> DataFrame:
    """(image, detected): whether a line of the image holds one of the image's customers."""
    low = lines.select("image", normalize_text(F.col("text")).alias("line"))
    names = customers.select("image", normalize_text(F.col("customer")).alias("own"))
    seen = names.select("image").distinct().join(low.join(names, (low["image"] == names["image"]) & F.contains("line", "own")).select(low["image"]).distinct().withColumn("detected", F.lit(True)), "image", "left")
    return seen.select("image", F.coalesce("detected", F.lit(False)).alias("detected"))


def precision_recall(found: DataFrame, truth: DataFrame, by: list[str], key: str) -> DataFrame:
    """Precision and recall of sets of keys, each over at least 1."""
    both = found.select(*by, key, F.lit(1).alias("f")).distinct().join(truth.select(*by, key, F.lit(1).alias("t")).distinct(), [*by, key], "full")
    sums = both.groupBy(*by) if by else both.groupBy()
    told = sums.agg(F.count("t").alias("gt_count"), F.count("f").alias("detected_count"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("both"))
    return told.select(*by, "gt_count", "detected_count", share(F.col("both"), F.col("detected_count")).alias("precision"), share(F.col("both"), F.col("gt_count")).alias("recall"))


def metric_averages(results: DataFrame, by: list[str]) -> DataFrame:
    """results: cer, wer, date_detected."""
    return results.groupBy(*by).agg(rounded(F.avg("cer")).alias("avg_cer"), rounded(F.avg("wer")).alias("avg_wer"), rounded(F.avg(F.col("date_detected").cast("double"))).alias("date_accuracy"))


def method_ranking(results: DataFrame) -> DataFrame:
    """results: method, confidence, regions, seconds. Means of each method, ranked by confidence; equal ones by name."""
    means = results.groupBy("method").agg(F.avg("confidence").alias("confidence"), F.avg("regions").alias("regions"), F.avg("seconds").alias("seconds"), F.count(F.lit(1)).alias("images"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "method")))


def verdict(ranking: DataFrame, plain: str = "none") -> DataFrame:
    """Whether the plain method is as good as the best, and by how many percent the best is better."""
    best = ranking.agg(F.max_by("method", F.struct("confidence", -F.col("rank"))).alias("best"), F.max("confidence").alias("top"), F.max(F.when(F.col("method") == plain, F.col("confidence"))).alias("own"))
    return best.select("best", (F.col("own") >= F.col("top")).alias("plain_is_best"), rounded((F.col("top") - F.col("own")) / F.nullif("own", F.lit(0.0)) * 100).alias("improvement_percent"))


def batch_summary(images: DataFrame) -> DataFrame:
    """images: total_items, seconds, error."""
    return images.agg(F.count(F.lit(1)).alias("images"), F.count_if(F.coalesce("error", F.lit("")) == "").alias("succeeded"), F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_items"), rounded(F.avg(F.when(F.coalesce("error", F.lit("")) == "", F.col("seconds")))).alias("avg_seconds"))


def first_success(attempts: DataFrame) -> DataFrame:
    """attempts (image, attempt, model, total_items, error): the first with items; an image without one keeps its last as an error."""
    good = (F.coalesce("error", F.lit("")) == "") & (F.col("total_items") > 0)
    told = attempts.groupBy("image").agg(F.min_by(F.struct("attempt", "model", "total_items"), F.when(good, F.col("attempt"))).alias("hit"), F.max("attempt").alias("tried"))
    return told.select("image", F.coalesce("hit.attempt", "tried").alias("attempt"), "hit.model", F.coalesce("hit.total_items", F.lit(0)).alias("total_items"), F.col("hit").isNull().alias("failed"))


def best_configuration(runs: DataFrame, regions_enough: int = 15, confidence_enough: float = 0.20) -> DataFrame:
    """runs (image, cfg_pos, confidence, n_regions): tried in order until one is good enough; of those the most confident, the first of equals."""
    stop = F.min(F.when((F.col("n_regions") >= regions_enough) & (F.col("confidence") >= confidence_enough), F.col("cfg_pos"))).over(Window.partitionBy("image"))
    tried = runs.withColumn("stop", stop).where("stop is null or cfg_pos <= stop")
    return tried.groupBy("image").agg(F.max_by(F.struct("cfg_pos", "confidence"), F.struct("confidence", (-F.col("cfg_pos")).alias("p"))).alias("b"), F.count(F.lit(1)).alias("tried")).select("image", "b.*", "tried")


def method_counts(regions: DataFrame) -> DataFrame:
    """regions (image, method, text, confidence): sure regions, mean confidence and non-blank texts of each image and method."""
    return regions.groupBy("image", "method").agg(F.count_if(F.col("confidence") > 0.35).alias("sure"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.count_if(F.length(strip(F.col("text"))) > 0).alias("non_blank"))


def labelled(truth: DataFrame) -> DataFrame:
    """Ground truth pages that count as labelled: a date and any customer or item."""
    has: Column = F.exists("sections", lambda s: (F.length(F.coalesce(s["customer"], F.lit(""))) > 0) | (F.size(s["items"]) > 0))
    return truth.select("image", ((F.length(F.coalesce("date", F.lit(""))) > 0) & F.coalesce(has, F.lit(False))).alias("labelled"))


def with_truth(scans: DataFrame, truth: DataFrame) -> DataFrame:
    """Scans with the ground truth of their image, and a note where there is none."""
    rows = scans.join(truth.withColumn("__there", F.lit(True)), "image", "left")
    return rows.withColumn("note", F.when(F.col("__there").isNull(), "No ground truth available for this image")).drop("__there")


def sure_sample(regions: DataFrame, least: float = 0.5, top: int = 15) -> DataFrame:
    """(scan_id, sample): of each page the first texts of which the recognition is sure."""
    own = F.collect_list(F.when((F.col("confidence") > least) & (F.length(strip(F.col("text"))) > 0), F.struct("pos", strip(F.col("text")).alias("text"))))
    return regions.groupBy("scan_id").agg(F.transform(F.slice(F.array_sort(own), 1, top), lambda s: s["text"]).alias("sample"))


def export_summary(rows: DataFrame) -> DataFrame:
    """Transactions, items and amount of an export."""
    return rows.agg(F.count_distinct("image", "section_pos").alias("transactions"), F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("subtotal"), F.lit(0)).alias("total_amount"))


def detected_lines(regions: DataFrame, least: float = 0.1) -> DataFrame:
    """Regions (scan_id, pos, text, confidence) with a text and a confidence over `least`: the stripped text and the rounded confidence."""
    text = strip(F.col("text"))
    return regions.where((F.length(text) > 0) & (F.col("confidence") > least)).select("scan_id", "pos", text.alias("text"), rounded(F.col("confidence")).alias("confidence"))


def known_customers(sections: DataFrame) -> DataFrame:
    """Sections whose customer is given and known."""
    return sections.where((F.length("customer") > 0) & (F.col("customer") != "Unknown"))


def image_summary(images: DataFrame) -> DataFrame:
    """images (status, items, confidence): how many, how many are ok, the items of those, and the mean confidence of all."""
    ok = F.col("status") == "ok"
    return images.agg(F.count(F.lit(1)).alias("images"), F.count_if(ok).alias("succeeded"), F.coalesce(F.sum(F.when(ok, F.col("items"))), F.lit(0)).alias("total_items"), rounded(F.avg(F.coalesce("confidence", F.lit(0.0))), 3).alias("avg_confidence"))


def item_totals(items: DataFrame) -> DataFrame:
    """(image, before, after, failed): items of each image before and after dedup_items(); an image without items is a failure. items:
    image, section_pos, item_pos, product, raw_line, the last three null where a section is empty."""
    there = F.col("item_pos").isNotNull()
    kept = dedup_items(items.where(there)).groupBy("image").agg(F.count(F.lit(1)).alias("after"))
    before = items.groupBy("image").agg(F.count_if(there).alias("before"))
    return before.join(kept, "image", "left").select("image", "before", F.coalesce("after", F.lit(0)).alias("after"), (F.col("before") == 0).alias("failed"))
