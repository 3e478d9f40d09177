"""Pages of text regions to lines, and lines to dates, customers and items. One shuffle by page; arrays hold a page's regions.

regions: scan_id, pos (order of arrival), text, yc (centre), x0 (left), confidence, circled, struck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.metrics import rounded
from ledgerloom.functions.parse import interpreter_date, is_date_text, number
from ledgerloom.functions.text import customer_name, has_product_word, strip, strip_fence
from ledgerloom.functions.words import DAYS, MONTHS, SYMBOLS

TOLERANCE = 60.0
REGION = "struct<yc:double,x0:double,pos:long,text:string,confidence:double,circled:boolean,struck:boolean>"


def _one_sign(text: Column) -> Column:
    return (F.length(text) == 1) & ~text.rlike(r"^\p{L}$")


def _date_part(text: Column) -> Column:
    return F.lower(text).rlike("|".join([*DAYS, *MONTHS]))


def keeps_region(text: Column, confidence: Column) -> Column:
    """The live noise filter."""
    t = strip(text)
    wanted = (confidence > 0.35) | t.rlike(r"^[0-9]+$") | has_product_word(t) | _date_part(t) | t.isin(SYMBOLS)
    noise = t.rlike(r"^[—–−|]+$") | t.rlike(r"^[.,;:!?]+$") | t.rlike(r"^[+*★※]+$")
    return wanted & (~noise | has_product_word(t)) & ~(_one_sign(t) & (confidence < 0.5))


def is_noise(text: Column, confidence: Column) -> Column:
    t = strip(text)
    return (F.length(t) == 0) | t.rlike(r"^[—–−|]+$") | t.rlike(r"^[.,;:!?]+$") | (_one_sign(t) & (confidence < 0.5))


def should_keep(text: Column, confidence: Column) -> Column:
    """The other policy: noise only with a product word, the rest by kind or a confidence over 0.4."""
    t = strip(text)
    kind = t.rlike(r"^[0-9]+$") | has_product_word(t) | _date_part(t) | t.isin(SYMBOLS) | (confidence > 0.4) | t.rlike(r"^\p{L}{2,}$")
    return F.when(is_noise(text, confidence), has_product_word(t)).otherwise(kind)


def cluster_lines(regions: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(scan_id, line_idx, line): regions by height, then left edge; one joins the line while it is nearer than the tolerance
    to the line's mean height; each line is sorted by left edge."""
    own = F.struct(F.col("yc").cast("double").alias("yc"), F.col("x0").cast("double").alias("x0"), F.col("pos").cast("long").alias("pos"), "text", F.col("confidence").cast("double").alias("confidence"), "circled", "struck")
    pages = regions.groupBy("scan_id").agg(F.array_sort(F.collect_list(own)).alias("regions"))
    none = F.array().cast(f"array<{REGION}>")
    start = F.struct(F.array().cast(f"array<array<{REGION}>>").alias("lines"), none.alias("line"), F.lit(0.0).alias("sum"))

    def step(acc: Column, r: Column) -> Column:
        same = (F.size(acc["line"]) == 0) | (F.abs(r["yc"] - acc["sum"] / F.greatest(F.size(acc["line"]), F.lit(1))) < tolerance)
        return F.when(same, F.struct(acc["lines"].alias("lines"), F.concat(acc["line"], F.array(r)).alias("line"), (acc["sum"] + r["yc"]).alias("sum"))).otherwise(
            F.struct(F.concat(acc["lines"], F.array(acc["line"])).alias("lines"), F.array(r).alias("line"), r["yc"].alias("sum"))
        )

    lines = F.aggregate("regions", start, step, lambda acc: F.concat(acc["lines"], F.array(acc["line"])))
    by_x = F.transform(lines, lambda line: F.transform(F.array_sort(F.transform(line, lambda r: F.struct(r["x0"].alias("x"), r["yc"].alias("y"), r["pos"].alias("p"), r.alias("r")))), lambda s: s["r"]))
    return pages.select("scan_id", F.posexplode(by_x).alias("line_idx", "line"))


def line_features(lines: DataFrame) -> DataFrame:
    mean = F.aggregate("line", F.lit(0.0), lambda s, r: s + r["yc"]) / F.size("line")
    return lines.withColumns({
        "line_text": F.array_join(F.transform("line", lambda r: r["text"]), " "),
        "line_y": mean.cast("int"),
        "line_x": F.array_min(F.transform("line", lambda r: r["x0"])),
        "struck_through": F.exists("line", lambda r: r["struck"]),
    })


def classify(text: Column, line_idx: Column) -> Column:
    low = strip(F.lower(text))
    digit, words = text.rlike(r"(?U)\d"), F.size(F.filter(F.split(low, r"(?U)\s+"), lambda w: F.length(w) > 0))
    header = (line_idx <= 2) & ~digit & ~has_product_word(low) & ~low.rlike("tanggal|date|tgl") & (F.length(low) < 30) & words.between(1, 4)
    return F.when(is_date_text(text), "date").when(header, "customer").when(has_product_word(low) | (digit & (line_idx > 0)), "item").otherwise("unknown")


def item_line(line: Column, text: Column, struck: Column) -> Column:
    """struct of an item: detected_text, quantity, price, unit, confidence, struck_through, uncertain_fields."""
    texts = F.transform(line, lambda r: strip(r["text"]))
    numbers = F.transform(F.filter(texts, lambda t: t.rlike(r"^[0-9]+$")), lambda t: number(t, "long"))
    circled, few = F.exists(line, lambda r: r["circled"]), F.size(numbers) == 1
    is_quantity = lambda n: (n <= 99) & (circled | (few & has_product_word(text)))
    marked = F.get(F.filter(numbers, is_quantity), F.lit(0))
    lone = F.when(few & (F.get(numbers, F.lit(0)) <= 99), F.get(numbers, F.lit(0)))
    price = F.get(F.filter(numbers, lambda n: n >= 100), F.lit(0)).cast("double")
    named = F.filter(texts, lambda t: (F.length(t) > 0) & ~t.rlike(r"^[0-9]+$") & ~t.isin(SYMBOLS) & ~_one_sign(t) & ~F.lower(t).isin([*DAYS, *MONTHS]))
    name = F.array_join(named, " ")
    # Doubles are added in the order in which the regions joined the line (height, left edge, pos), not in that of the text: at a confidence
    # of just 0.1 the last bit decides between an item and an uncertain line.
    mean = F.aggregate(F.array_sort(line), F.lit(0.0), lambda s, r: s + r["confidence"]) / F.size(line)
    confidence = F.least(F.lit(1.0), mean + F.when(has_product_word(name), 0.3).otherwise(0.0) - F.when(struck, 0.3).otherwise(0.0))
    flag = F.when(marked.isNull(), F.when(lone.isNotNull(), "quantity_assumed_no_explicit_marker").when(F.size(numbers) == 0, "no_quantity_detected").otherwise("quantity_missing"))
    return F.struct(
        name.alias("detected_text"),
        F.coalesce(marked, lone).cast("int").alias("quantity"),
        price.alias("price"),
        F.lit("pcs").alias("unit"),
        confidence.alias("confidence"),
        struck.alias("struck_through"),
        F.array_compact(F.array(flag, F.when(struck, F.lit("struck_through_excluded")))).alias("uncertain_fields"),
    )


def interpreted_lines(regions: DataFrame, as_of_year: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The lines of each page with their kind and what they hold; what becomes of items: keep or uncertain."""
    kept = regions.where(keeps_region(F.col("text"), F.col("confidence")))
    lines = line_features(cluster_lines(kept, tolerance)).withColumn("kind", classify(F.col("line_text"), F.col("line_idx")))
    # Each kind reads what it holds, and nothing else; the arrays hold each struct, which would else be made anew for every field that is read.
    is_item = F.col("kind").isin("item", "unknown")
    of = lambda kind, value: F.get(F.when(kind, F.array(value)), F.lit(0))
    lines = lines.withColumns({
        "date": of(F.col("kind") == "date", interpreter_date(F.col("line_text"), as_of_year)),
        "customer": of(F.col("kind") == "customer", customer_name(F.col("line_text"))),
        "item": of(is_item, item_line(F.col("line"), F.col("line_text"), F.col("struck_through"))),
    })
    keep = (F.col("item.confidence") > 0.1) | has_product_word(F.col("item.detected_text"))
    return lines.withColumn("fate", F.when(is_item & keep, "item").when(is_item, "uncertain").otherwise(F.col("kind")))


def interpret(regions: DataFrame, as_of_year: int, tolerance: float = TOLERANCE, scans: DataFrame | None = None) -> DataFrame:
    """One row a page: the last date line and customer line count, even where they hold nothing; items in order of lines. scans (scan_id):
    all pages; those without any region say so."""
    lines = interpreted_lines(regions, as_of_year, tolerance)
    of = lambda fate, value: F.when(F.col("fate") == fate, value)
    pages = lines.groupBy("scan_id").agg(
        F.max_by("date", of("date", F.col("line_idx"))).alias("date"),
        F.max_by("customer", of("customer", F.col("line_idx"))).alias("customer"),
        F.transform(F.array_sort(F.collect_list(of("item", F.struct("line_idx", "item")))), lambda s: s["item"]).alias("items"),
        F.transform(F.array_sort(F.collect_list(of("uncertain", F.struct("line_idx", F.substring("line_text", 1, 30).alias("t"))))), lambda s: F.format_string("Line %d: '%s...' — unrecognized content", s["line_idx"], s["t"])).alias("uncertain"),
    )
    date_confidence = F.coalesce("date.confidence", F.lit(0.0))
    total = date_confidence + F.coalesce("customer.confidence", F.lit(0.0)) + F.aggregate("items", F.lit(0.0), lambda s, i: s + i["confidence"])
    count = 1 + F.col("customer").isNotNull().cast("int") + F.size("items")
    told = pages.select("scan_id", F.col("date.date").alias("date"), date_confidence.alias("date_confidence"), "customer", "items", "uncertain", (total / count).alias("total_confidence"))
    told = told.withColumn("high_uncertainty", F.size("uncertain") > 0.4 * F.size("items") + 1)
    # Pages whose regions are all noise have no line but are pages still.
    blank = regions.select("scan_id").distinct()
    empty = None if scans is None else scans.select("scan_id").distinct().join(blank, "scan_id", "left_anti").withColumn("__empty", F.lit(True))
    blank = blank.withColumn("__empty", F.lit(False))
    blank = blank if empty is None else blank.unionByName(empty)
    return blank.join(told, "scan_id", "left").withColumns({
        "date_confidence": F.coalesce("date_confidence", F.lit(0.0)),
        "items": F.coalesce("items", F.array().cast(told.schema["items"].dataType)),
        "uncertain": F.when(F.col("__empty"), F.array(F.lit("No regions to interpret"))).otherwise(F.coalesce("uncertain", F.array().cast("array<string>"))),
        "total_confidence": F.coalesce("total_confidence", F.lit(0.0)),
        "high_uncertainty": F.coalesce("high_uncertainty", F.lit(False)),
    }).drop("__empty")


def layout(regions: DataFrame, width: int, height: int) -> DataFrame:
    """(scan_id, orientation, columns, line_height_px) from region centres xc, yc: one pass over each page's array."""
    pages = regions.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("yc", "pos", "xc"))).alias("r"))
    pages = pages.withColumns({"low": F.array_min(F.transform("r", lambda r: r["xc"])), "high": F.array_max(F.transform("r", lambda r: r["xc"])), "n": F.size("r")})
    left = F.size(F.filter("r", lambda r: r["xc"] < (F.col("low") + F.col("high")) / 2))
    gaps = F.array_sort(F.zip_with(F.slice("r", 2, F.col("n")), F.slice("r", 1, F.col("n") - 1), lambda b, a: b["yc"] - a["yc"]))
    middle = F.floor((F.size(gaps) - 1) / 2).cast("int")
    gap = F.get(F.transform(F.array(gaps), lambda g: (F.get(g, middle) + F.get(g, F.floor(F.size(gaps) / 2).cast("int"))) / 2), F.lit(0))
    two = (F.col("high") - F.col("low") > width * 0.6) & (left > 3) & (F.col("n") - left > 3)
    return pages.select(
        "scan_id",
        F.lit("portrait" if height > width else "landscape").alias("orientation"),
        F.when(two, 2).otherwise(1).alias("columns"),
        F.when(F.col("n") > 2, gap.cast("int")).otherwise(40).alias("line_height_px"),
    )


def scan_status(engine_status: Column, mean_confidence: Column, n_regions: Column) -> Column:
    """Status of a scan: no text, uncertain, or what the engine says."""
    return F.when((n_regions == 0) | (mean_confidence < 0.1), "no_text_detected").when(mean_confidence < 0.5, "uncertain").otherwise(engine_status)


def scan_summary(regions: DataFrame, digits: int = 4, order: str = "pos") -> DataFrame:
    """(scan_id, n_regions, confidence, status). Doubles are added in the order of that column, whatever the tasks: where the mean is just
    0.1 or 0.5, the last bit decides the status."""
    known = F.when(F.col("confidence").isNotNull(), F.struct(order, F.col("confidence").cast("double").alias("confidence")))
    scans = regions.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_regions"), F.array_sort(F.collect_list(known)).alias("known"))
    total = F.aggregate("known", F.lit(0.0), lambda s, r: s + r["confidence"])
    scans = scans.withColumn("mean", F.when(F.size("known") > 0, total / F.size("known")).otherwise(0.0))
    return scans.select("scan_id", "n_regions", rounded(F.col("mean"), digits).alias("confidence"), scan_status(F.lit("ok"), F.col("mean"), F.col("n_regions")).alias("status"))


def tagged_symbols(text: Column) -> Column:
    """Symbols that a recognised text stands for: a short text with a sign, and any text with a price word."""
    low = F.lower(text)
    sign = (F.length(text) <= 3) & text.rlike("[@=×x+★→]")
    return F.array_compact(F.array(F.when(sign, text), F.when(low.rlike("rp|k|rb|ribu"), text)))


def vision_reply(text: Column) -> Column:
    """struct(status, confidence, raw_text) of a reply: what its JSON says, or, where it is no JSON object, the reply itself at 0.3, uncertain."""
    body = F.try_parse_json(strip_fence(text))
    is_object = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    confidence = F.coalesce(F.try_variant_get(body, "$.confidence", "double"), F.lit(0.0))
    said = F.struct(vision_status(confidence).alias("status"), confidence.alias("confidence"), F.coalesce(F.try_variant_get(body, "$.raw_text", "string"), F.lit("")).alias("raw_text"))
    return F.when(is_object, said).otherwise(F.struct(F.lit("uncertain").alias("status"), F.lit(0.3).alias("confidence"), text.alias("raw_text")))


def vision_status(confidence: Column) -> Column:
    return F.when(confidence > 0.3, "ok").otherwise("uncertain")
