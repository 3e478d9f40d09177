"""Draft transactions: from interpretations to items, edits and confirmed payloads.

Items are rows (draft_id, item_id, pos, description, product_id, quantity, unit_price, unit, subtotal, confidence, is_manual, notes,
warnings); edits are rows (draft_id, item_id, seq, action, ...) that apply in the order of seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.metrics import money
from ledgerloom.functions.parse import export_name, export_price, export_quantity
from ledgerloom.functions.words import OTHER_CUSTOMER
from ledgerloom.operators import match

NO_PRODUCT, NO_QUANTITY, NO_PRICE, STRUCK = "produk_tidak_ditemukan — pilih manual", "quantity_tidak_terdeteksi", "harga_tidak_terdeteksi", "coretan — periksa ulang"


def warnings(product_id: Column, quantity: Column, price: Column, struck: Column, uncertain: Column) -> Column:
    """Warnings in their fixed order."""
    missing = F.coalesce(product_id, F.lit(0)) == 0
    own = F.array_compact(F.array(F.when(missing, F.lit(NO_PRODUCT)), F.when(quantity.isNull(), F.lit(NO_QUANTITY)), F.when(price.isNull(), F.lit(NO_PRICE)), F.when(struck, F.lit(STRUCK))))
    return F.concat(own, F.transform(F.coalesce(uncertain, F.array().cast("array<string>")), lambda u: F.concat(F.lit("uncertain_"), u)))


def draft_items(items: DataFrame) -> DataFrame:
    """items: draft_id, item_id, pos, detected_text, quantity, price, confidence, struck_through, uncertain_fields, matched_product_id,
    matched_product_name."""
    matched = F.coalesce("matched_product_id", F.lit(0)) != 0
    quantity, price = F.coalesce("quantity", F.lit(1)), F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    return items.select(
        "draft_id", "item_id", "pos",
        F.when(matched, F.col("matched_product_name")).otherwise(F.col("detected_text")).alias("description"),
        F.when(matched, F.col("matched_product_id")).alias("product_id"),
        quantity.cast("int").alias("quantity"), price.alias("unit_price"), F.lit("pcs").alias("unit"), (quantity * price).alias("subtotal"),
        "confidence", F.lit(False).alias("is_manual"), F.lit("").alias("notes"),
        warnings(F.col("matched_product_id"), F.col("quantity"), F.col("price"), F.col("struck_through"), F.col("uncertain_fields")).alias("warnings"),
    )


def apply_product_defaults(items: DataFrame, products: DataFrame) -> DataFrame:
    """Prices of exactly 0 and units come from the product, the last of equal ids; subtotals of known products are made anew."""
    known = products.groupBy(F.col("id").alias("__id")).agg(F.max_by(F.struct("default_price", "unit"), "cat_pos").alias("__p"))
    rows = items.join(known, (F.col("product_id") == F.col("__id")) & (F.col("product_id") != 0), "left")
    hit = F.col("__id").isNotNull()
    price = F.when(hit & (F.col("unit_price") == 0), F.coalesce("__p.default_price", F.lit(0.0))).otherwise(F.col("unit_price"))
    unit = F.when(hit & (F.length("__p.unit") > 0), F.col("__p.unit")).otherwise(F.col("unit"))
    rows = rows.withColumns({"unit_price": price, "unit": unit})
    return rows.withColumn("subtotal", F.when(hit, F.col("quantity") * F.col("unit_price")).otherwise(F.col("subtotal"))).select(*items.columns)


def resolved_customer(name: Column, matched_id: Column, top_score: Column) -> Column:
    """struct(customer_id, customer_name): the match, else the name, marked where the best candidate scores under 0.7."""
    has = F.coalesce(matched_id, F.lit(0)) != 0
    shown = F.when(~has & (top_score < 0.7), F.concat(name, F.lit(" (belum dipastikan)"))).otherwise(F.coalesce(name, F.lit("")))
    return F.struct(F.when(has, matched_id).alias("customer_id"), shown.alias("customer_name"))


def unresolved(confidence: Column, warned: Column) -> Column:
    return (confidence < 0.5) | (F.size(warned) > 0)


def draft_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("draft_id").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("long").alias("total_quantity"),
        F.coalesce(F.sum("subtotal"), F.lit(0.0)).alias("total_amount"),
        F.count_if(unresolved(F.col("confidence"), F.col("warnings"))).alias("unresolved_count"),
    )


def apply_edits(items: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: draft_id, item_id, seq, action (quantity, price, product, add, remove), quantity, unit_price, product_id, product_name, unit.

    For each item the last edit of a kind counts; a quantity is 1 at least, a product edit takes the missing-product warning away and
    leaves the price, and a removal drops the item unless it was added later.
    """
    last = lambda action, value: F.max_by(value, F.when(F.col("action") == action, F.col("seq")))
    per = edits.groupBy("draft_id", "item_id").agg(
        last("quantity", F.greatest(F.lit(1), F.col("quantity"))).alias("e_quantity"),
        last("price", F.col("unit_price")).alias("e_price"),
        last("product", F.struct("product_id", "product_name")).alias("e_product"),
        last("add", F.struct("quantity", "unit_price", "product_id", "product_name", "unit", "seq")).alias("e_add"),
        F.max(F.when(F.col("action") == "remove", F.col("seq"))).alias("removed"),
    )
    added = per.where("e_add is not null").select(
        "draft_id", "item_id", F.col("e_add.seq").cast("long").alias("pos"), F.col("e_add.product_name").alias("description"), F.col("e_add.product_id").alias("product_id"),
        F.coalesce("e_add.quantity", F.lit(1)).cast("int").alias("quantity"), F.coalesce("e_add.unit_price", F.lit(0.0)).alias("unit_price"), F.coalesce("e_add.unit", F.lit("pcs")).alias("unit"),
        (F.coalesce("e_add.quantity", F.lit(1)) * F.coalesce("e_add.unit_price", F.lit(0.0))).alias("subtotal"), F.lit(1.0).alias("confidence"), F.lit(True).alias("is_manual"), F.lit("").alias("notes"), F.array().cast("array<string>").alias("warnings"),
    )
    rows = items.unionByName(added).join(per, ["draft_id", "item_id"], "left").where("removed is null or coalesce(e_add.seq, -1) > removed")
    touched = F.coalesce(F.col("e_quantity").isNotNull() | F.col("e_price").isNotNull() | F.col("e_product").isNotNull(), F.lit(False))
    priced = F.col("e_quantity").isNotNull() | F.col("e_price").isNotNull()
    rows = rows.withColumns({
        "quantity": F.coalesce("e_quantity", "quantity").cast("int"),
        "unit_price": F.coalesce("e_price", "unit_price"),
        "product_id": F.coalesce("e_product.product_id", "product_id"),
        "description": F.coalesce("e_product.product_name", "description"),
        "is_manual": F.col("is_manual") | touched,
        "warnings": F.when(F.col("e_product").isNotNull(), F.filter("warnings", lambda w: ~F.contains(w, F.lit("produk_tidak_ditemukan")))).otherwise(F.col("warnings")),
    })
    return rows.withColumn("subtotal", F.when(priced, F.col("quantity") * F.col("unit_price")).otherwise(F.col("subtotal"))).select(*items.columns)


def create_drafts(pages: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Drafts of interpreted pages (see interpret.interpret): the header, the customer's id or an unsure name, and what is kept for the audit.
    customers: scan_id, matched_id, and the score of the first candidate."""
    name = F.coalesce("customer.detected_name", F.lit(""))
    rows = pages if customers is None else pages.join(customers, "scan_id", "left")
    matched, score = (F.lit(None).cast("long"), F.lit(None).cast("double")) if customers is None else (F.col("matched_id"), F.col("score"))
    who = resolved_customer(name, matched, score)
    log = F.struct("date_confidence", F.struct("customer.detected_name", F.coalesce("customer.confidence", F.lit(0.0)).alias("confidence"), matched.alias("matched_id")).alias("customer"), "total_confidence", "uncertain", F.size("items").alias("items_before_matching"))
    there = F.col("customer").isNotNull()
    return rows.select(F.col("scan_id").alias("draft_id"), F.lit("draft").alias("status"), "date", F.when(there, who["customer_id"]).alias("customer_id"), F.when(there, who["customer_name"]).otherwise(F.lit("")).alias("customer_name"), F.lit("").alias("notes"), log.alias("interpretation_log"))


def change_customer(drafts: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: draft_id, seq, customer_id, customer_name; the last counts."""
    last = edits.groupBy("draft_id").agg(F.max_by(F.struct("customer_id", "customer_name"), "seq").alias("e"))
    rows = drafts.join(last, "draft_id", "left")
    return rows.withColumns({k: F.when(F.col("e").isNotNull(), F.col(f"e.{k}")).otherwise(F.col(k)) for k in ("customer_id", "customer_name")}).drop("e")


def confirm(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """Payloads: drafts (draft_id, date, customer_id, customer_name, notes) with their items; whole amounts, halves to even. The
    total is that of the unrounded subtotals."""
    unit_price, quantity = money(F.col("unit_price")), F.greatest(F.lit(1), F.col("quantity"))
    item = F.struct("pos", "item_id", F.struct(
        "product_id", F.col("description").alias("product_name"), F.nullif("notes", F.lit("")).alias("description"), quantity.alias("quantity"), "unit",
        unit_price.alias("unit_price"), (quantity * unit_price).alias("subtotal")).alias("item"))
    per = items.groupBy("draft_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda s: s["item"]).alias("items"),
        money(F.sum("subtotal")).alias("total_amount"),
        F.count_if(unresolved(F.col("confidence"), F.col("warnings"))).alias("unresolved_count"),
    )
    rows = drafts.join(per, "draft_id", "left")
    return rows.select(
        "draft_id", F.lit("confirmed").alias("status"),
        F.struct("customer_id", F.col("date").alias("transaction_date"), "notes").alias("transaction"), F.coalesce("items", F.array().cast(per.schema["items"].dataType)).alias("items"),
        F.coalesce("total_amount", F.lit(0)).alias("total_amount"), "customer_name",
        (F.coalesce("unresolved_count", F.lit(0)) > 0).alias("has_unresolved_warnings"), F.coalesce("unresolved_count", F.lit(0)).alias("unresolved_count"),
    )


def export_items(items: DataFrame) -> DataFrame:
    """Section items (image, customer, product, raw_line, quantity, unit_price, ...) with the exporter's name, quantity, price and subtotal."""
    name = export_name(F.col("product"), F.col("raw_line"))
    rows = items.withColumns({"name": name, "qty": export_quantity(F.col("quantity"))}).withColumn("price", export_price(F.col("unit_price"), F.col("name")))
    return rows.withColumns({"subtotal": F.col("qty") * F.col("price"), "description": F.concat(F.lit("OCR text: '"), F.coalesce("raw_line", "name"), F.lit("'"))})


def exported(items: DataFrame, products: DataFrame) -> DataFrame:
    """export_items with the catalog's name and id where the best match scores 0.60 or more."""
    rows = export_items(items)
    best = match.best_match(rows.select(F.col("name").alias("text"), "price"), products, match.BEST, True).where(F.col("score") >= match.EXPORT_PRODUCT)
    ids = match.first_id(products).select(F.col("name").alias("__low"), F.col("id").alias("product_id"))
    best = best.select(F.col("text").alias("__t"), F.col("price").alias("__p"), F.col("name").alias("__n")).join(ids, F.lower("__n") == F.col("__low"), "left")
    rows = rows.join(best, (F.col("name") == F.col("__t")) & (F.col("price") == F.col("__p")), "left")
    return rows.withColumn("product_name", F.coalesce("__n", "name")).drop("__t", "__p", "__n", "__low")


def export_header(customer: Column, image: Column) -> Column:
    """Notes of an exported transaction; a customer that isn't given at all is OTHER_CUSTOMER."""
    return F.concat(F.lit("Bon OCR: "), F.trim(F.coalesce(customer, F.lit(OTHER_CUSTOMER))), F.lit(" | Foto: "), image)


def customer_ids(names: DataFrame, customers: DataFrame, unknown: int = 999) -> DataFrame:
    """(text, customer_id): the best match from 0.70, else the first catalog name that equals the name or holds it, else unknown."""
    best = match.best_match(names, customers).where(F.col("score") >= match.EXPORT_CUSTOMER)
    ids = match.first_id(customers).select(F.col("name").alias("__low"), "id")
    one = best.join(ids, F.lower(best["name"]) == F.col("__low")).select("text", F.col("id").alias("by_match"))
    rest = names.select("text").distinct().join(one, "text", "left_anti")
    held = match.against(rest, customers, F.contains(F.lower("name"), F.lower("text"))).groupBy("text").agg(F.min_by("name", "cat_pos").alias("name"))
    firsts = customers.groupBy("name").agg(F.min_by("id", F.struct("cat_pos", "id")).alias("by_name"))
    held = held.join(firsts, "name").select("text", "by_name")
    return names.select("text").distinct().join(one, "text", "left").join(held, "text", "left").select("text", F.coalesce("by_match", "by_name", F.lit(unknown)).alias("customer_id"))
