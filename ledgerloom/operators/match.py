"""Matching of texts against catalogs. A catalog is a dimension with columns id, name, default_price and cat_pos, its order.

Distinct texts are scored, not rows. The catalog is broadcast only behind a check of its size. Where the texts are fewer bytes, they are
broadcast instead, and the catalog stays where it is; where neither fits, the catalog is cut into blocks of positions, and the best
candidates of the blocks meet at the end.

A sequence ratio as low as these thresholds proves no common trigram, not even a common pair of letters, so no index on parts of
texts finds every candidate. Pairs are met by bounds on bits instead: a few operations on longs, inside generated code, leave out what can't
reach the threshold by trigrams, substring or sound; and what can't pass, by its ratio, the best that a text has found without one.
Only the few pairs left are scored, and only those whose ratio counts go to Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.metrics import price_is_near, rounded
from ledgerloom.functions.ratio import ratio_bound, sequence_ratio
from ledgerloom.functions.text import char_bits, common_bound, gram_bits, grams, grams_similarity, normalize_alias, normalize_text, once, skeleton, subsequence_score, token_share, tokens, unconfuse

#: Bytes of a catalog's names, prepared, that are broadcast at once: about NAME for each and CHAR for each character of it.
BLOCK, NAME, CHAR = 64 << 20, 400, 40
#: Names from which on it pays to ask which side is smaller.
MANY = 1000
RANK_PRODUCT, RANK_CUSTOMER, BEST = 0.30, 0.35, 0.55
ACCEPT_PRODUCT, ACCEPT_CUSTOMER, EXPORT_PRODUCT, EXPORT_CUSTOMER = 0.85, 0.80, 0.60, 0.70


def catalog(rows: DataFrame, key: str, name: str, price: str | None = None, unit: str | None = None) -> DataFrame:
    """The dimension: its order is that of the key, and repeated names keep it."""
    out = rows.select(F.col(key).cast("long").alias("id"), F.col(name).alias("name"), (F.col(price) if price else F.lit(None)).cast("double").alias("default_price"), (F.col(unit) if unit else F.lit(None)).cast("string").alias("unit"))
    return out.withColumn("cat_pos", F.col("id"))


def measured(rows: DataFrame, column: str, *more: Column) -> tuple:
    """How many rows, and the bytes that they take prepared."""
    return rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(column) * CHAR + NAME), F.lit(0)), *more).first()


def blocks(rows: DataFrame, of: tuple | None = None) -> list[DataFrame]:
    """The catalog's names (name, cat_pos), or their blocks by position where they are larger than BLOCK."""
    n, size, low, high = of or measured(rows, "name", F.min("cat_pos"), F.max("cat_pos"))
    if size <= BLOCK:
        return [rows]
    many = min(n, -(-size // BLOCK))
    cuts = rows.approxQuantile("cat_pos", [k / many for k in range(1, many)], 0.1 / many)
    edges = [low, *sorted({int(c) for c in cuts if low < c <= high}), high + 1]
    return [rows.where((F.col("cat_pos") >= a) & (F.col("cat_pos") < b)) for a, b in zip(edges, edges[1:], strict=False)]


def spread(rows: DataFrame, column: str = "text") -> DataFrame:
    """Scoring is all CPU: distinct texts are few bytes, which would else be coalesced into a task or two. By a hash of the column, as a
    repartition by what the rows are grouped by already is left out of the plan."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), F.xxhash64(column))


def shared(rows: DataFrame, column: str = "text") -> DataFrame:
    """What is made of each text or name goes through an exchange, which all its readers share: each would else make it anew."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism), column)


class Sides:
    """Distinct texts (text) and names (name, cat_pos), and which of them is broadcast to meet the other."""

    def __init__(self, texts: DataFrame, names: DataFrame) -> None:
        distinct, of = texts.select("text").distinct(), measured(names, "name", F.min("cat_pos"), F.max("cat_pos"))
        self.many = of[0] > MANY
        self.by_text = self.many and measured(distinct, "text")[1] <= min(BLOCK, of[1])
        self.texts = distinct if self.by_text else spread(distinct)
        self.names = [spread(names, "name")] if self.by_text else blocks(names, of)

    def with_names(self, f: Callable[[DataFrame], DataFrame]) -> Sides:
        self.names = [shared(f(b), "name") if self.by_text else f(b) for b in self.names]
        return self

    def with_texts(self, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return f(self.texts) if self.by_text else shared(f(self.texts))

    def met(self, texts: DataFrame, on: Column) -> DataFrame:
        """texts, which may hold more columns than self.texts, with the names for which `on` holds."""
        if self.by_text:
            return self.names[0].join(F.broadcast(texts), on)
        return reduce(DataFrame.unionByName, [texts.join(F.broadcast(b), on) for b in self.names])


def distinct_names(rows: DataFrame) -> DataFrame:
    """(name, cat_pos) of the catalog: of equal names the first place."""
    return rows.where(F.length("name") > 0).groupBy("name").agg(F.min("cat_pos").alias("cat_pos"))


def against(texts: DataFrame, names: DataFrame, on: Column | None = None) -> DataFrame:
    """(text, name, cat_pos): distinct texts with the distinct names for which `on` holds."""
    sides = Sides(texts, distinct_names(names))
    return sides.met(sides.texts, F.length("name") > 0 if on is None else on).select("text", "name", "cat_pos")


def by_ratio(texts: DataFrame, names: DataFrame, form: Callable[[Column], Column], least: float) -> DataFrame:
    """(text, name, cat_pos, t, c, ratio): pairs whose forms t and c have a ratio of `least`, or where t holds c. No other pair goes to Python."""
    sides = Sides(texts, distinct_names(names)).with_names(lambda b: b.withColumn("c", form(F.col("name"))).withColumn("cb", char_bits(F.col("c"))))
    distinct = sides.texts.withColumn("t", form(F.col("text"))).withColumn("tb", char_bits(F.col("t")))
    near = sides.met(distinct, (ratio_bound(F.col("tb"), F.col("cb")) >= least - 1e-9) | F.contains("t", "c"))
    return near.select("text", "name", "cat_pos", "t", "c").withColumn("ratio", sequence_ratio(F.col("t"), F.col("c")))


def prepared(c: Column) -> Column:
    """What scoring needs of a text or a name; made once on each side, before they meet."""
    made = once(normalize_alias(c), lambda norm: F.struct(norm.alias("norm"), grams(norm).alias("grams"), skeleton(norm).alias("skeleton")))
    told = lambda m: F.struct(
        m["norm"].alias("norm"), m["grams"].alias("grams"), m["skeleton"].alias("skeleton"), char_bits(m["norm"]).alias("chars"), gram_bits(m["grams"]["grams"]).alias("parts"), F.xxhash64(m["skeleton"]).alias("sound"), F.length(m["skeleton"]).alias("letters")
    )
    return once(made, told)


def _long_skeletons(a: Column, b: Column) -> Column:
    """Skeletons that differ pass 0.90 only with over ten letters, and lengths that are near."""
    return (a["letters"] > 10) & (b["letters"] > 10) & (F.least(a["letters"], b["letters"]) > 0.90 * F.greatest(a["letters"], b["letters"]))


def may_score(least: float) -> Column:
    """Whether prepared a and b can score at least `least` without the ratio of their texts: by bounds on bits alone."""
    a, b = F.col("a"), F.col("b")
    common, chars = common_bound(a["parts"], b["parts"], 2), common_bound(a["chars"], b["chars"], 4)
    need = F.when(b["chars"]["n"] <= 5, F.lit(min(least, 0.4))).otherwise(F.lit(least))
    by_grams = common * (1 + need) >= need * (a["parts"]["n"] + b["parts"]["n"]) - 1e-9
    shorter = F.least(a["chars"]["n"], b["chars"]["n"])
    inside = F.when(shorter >= 3, common >= F.least(a["parts"]["n"], b["parts"]["n"])).otherwise(chars >= shorter)
    return (shorter > 0) & (by_grams | inside | (a["sound"] == b["sound"]) | _long_skeletons(a, b))


def own_scores(pairs: DataFrame) -> DataFrame:
    """pairs of prepared columns a (text) and b (candidate) with score and method: exact, then substring, trigram and phonetic."""
    t, c, st, sc = F.col("a.norm"), F.col("b.norm"), F.col("a.skeleton"), F.col("b.skeleton")
    none = (F.length(t) == 0) | (F.length(c) == 0)
    exact = ~none & (t == c)
    inside = F.when(F.length(c) >= 2, F.when(F.contains(t, c), 0.90).when(F.contains(c, t), 0.85).otherwise(0.0)).otherwise(0.0)
    # What is read more than once: a filter on the score would else hold it again for each reading.
    tri = once(grams_similarity(F.col("a.grams"), F.col("b.grams")), lambda x: F.when((F.length(c) <= 5) & (x > 0.4), F.least(F.lit(1.0), x + 0.2)).otherwise(x))
    lengths = F.least(F.length(st), F.length(sc)) / F.nullif(F.greatest(F.length(st), F.length(sc)), F.lit(0))
    pairs = pairs.withColumn("__sound", sequence_ratio(st, sc, ~none & ~exact & (st != sc) & _long_skeletons(F.col("a"), F.col("b"))))
    alike = F.when(st == sc, F.lit(1.0)).otherwise(F.col("__sound") * lengths)
    phonetic = F.when(alike > 0.90, alike * 0.90).otherwise(0.0)

    def told(m: Column) -> Column:
        by_text, by_sound = F.greatest(m["inside"], m["tri"]), m["phonetic"]
        score = F.when(none, 0.0).when(exact, 1.0).otherwise(F.greatest(by_text, by_sound))
        method = F.when(none, "no_match").when(exact, "exact").when(by_sound > by_text, "phonetic").when(m["tri"] > m["inside"], "trigram").when(m["inside"] > 0, "substring").otherwise("no_match")
        return F.struct(score.alias("score"), method.alias("method"))

    pairs = pairs.withColumn("__s", once(F.struct(inside.alias("inside"), tri.alias("tri"), phonetic.alias("phonetic")), told))
    return pairs.withColumns({"score": F.col("__s.score"), "method": F.col("__s.method")}).drop("__s", "__sound")


def with_scores(pairs: DataFrame, least: Column | float = 0.0) -> DataFrame:
    """own_scores, and the sequence ratio for what scores under 0.5: those pairs that score at least `least`. Pairs that no ratio can lift to
    it are left out before any goes to Python."""
    least = F.lit(least) if isinstance(least, float) else least
    pairs = own_scores(pairs)
    open_ = (F.col("score") < 0.5) & (F.length("a.norm") > 0) & (F.length("b.norm") > 0) & (ratio_bound(F.col("a.chars"), F.col("b.chars")) >= least - 1e-9)
    pairs = pairs.withColumn("__open", open_).where((F.col("score") >= least) | F.col("__open"))
    pairs = pairs.withColumn("__seq", F.coalesce(sequence_ratio(F.col("a.norm"), F.col("b.norm"), F.col("__open")), F.lit(0.0)))
    better = F.col("__seq") > F.col("score")
    pairs = pairs.withColumns({"method": F.when(better, "levenshtein").otherwise(F.col("method")), "score": F.greatest("__seq", "score")})
    return pairs.where(F.col("score") >= least).drop("__open", "__seq")


#: What a price adds to a score at most, and a rounding that can make two scores equal.
BOOST, ROUNDED = 0.15, 0.0002


def scored_pairs(texts: DataFrame, rows: DataFrame, least: float, with_price: bool = False, top: int | None = None) -> DataFrame:
    """Pairs of distinct (text[, price]) and catalog rows that score at least `least`; top: those that can be among a text's so many best.

    Distinct texts meet distinct names, first without the ratio; then, for the ratio, only names that it can lift to what the text's top
    best have reached. Ids, and prices with their boost, are joined to what comes near; with top, of equal names only the first so many, as the rest come after them.
    """
    rows = rows.where(F.length("name") > 0)
    slack = (BOOST if with_price else 0.0) + ROUNDED
    base = least - (BOOST if with_price else 0.0)
    sides = Sides(texts, distinct_names(rows)).with_names(lambda b: b.select("name", prepared(F.col("name")).alias("b")))
    distinct = sides.with_texts(lambda t: t.withColumn("a", prepared(F.col("text"))))
    near = own_scores(sides.met(distinct, may_score(base))).where(F.col("score") >= base).select("text", "name", "score", "method")
    need = F.lit(base)
    if top is not None:
        place = Window.partitionBy("text").orderBy(F.desc("score"))
        near = near.withColumn("__place", F.row_number().over(place))
        reached = near.where(F.col("__place") == top).select("text", (F.col("score") - slack).alias("__need"))
        distinct = distinct.join(reached, "text", "left")
        near = near.drop("__place")
        need = F.greatest(F.coalesce("__need", F.lit(base)), F.lit(base))
    # One condition on both sides: what tells of the texts alone would be pushed below their distinct, to each row they come from.
    may = (F.least("a.chars.n", "b.chars.n") > 0) & (ratio_bound(F.col("a.chars"), F.col("b.chars")) >= need - 1e-9)
    lifted = with_scores(sides.met(distinct, may), need).where("method = 'levenshtein'").select("text", "name", "score", "method")
    pairs = near.unionByName(lifted).groupBy("text", "name").agg(F.max(F.struct("score", "method")).alias("s")).select("text", "name", "s.*")
    if with_price:
        pairs = pairs.join(price_map(rows).select(F.col("name").alias("__low"), F.col("price").alias("expected")), F.lower("name") == F.col("__low"), "left")
        pairs = texts.select("text", "price").distinct().join(pairs, "text")
        boost = price_is_near(F.col("price"), F.col("expected")) & (F.col("method") != "exact") & (F.length(normalize_alias(F.col("text"))) > 0)
        pairs = pairs.withColumn("method", F.when(boost, F.concat("method", F.lit("+price"))).otherwise(F.col("method")))
        pairs = pairs.withColumn("score", F.when(F.endswith("method", F.lit("+price")), F.least(F.lit(1.0), F.col("score") + BOOST)).otherwise(F.col("score"))).where(F.col("score") >= least)
    keys = ["text", *(["price"] if with_price else [])]
    return pairs.select(*keys, "name", "score", "method").join((rows if top is None else first_rows(rows, top)).select("id", "name", "default_price", "cat_pos"), "name")


def first_rows(rows: DataFrame, top: int) -> DataFrame:
    """Of equal names the first `top` rows: they score alike, and no later one can be among so many best."""
    place = Window.partitionBy("name").orderBy("cat_pos", "id")
    return rows.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= top).drop("__place")


def rank(texts: DataFrame, rows: DataFrame, least: float, top: int, with_price: bool = False) -> DataFrame:
    """The top candidates of each distinct text by rounded score, then catalog order."""
    keys = ["text", *(["price"] if with_price else [])]
    pairs = scored_pairs(texts, rows, least, with_price, top).withColumn("score", rounded(F.col("score")))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "cat_pos", "id", "name")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def best_match(texts: DataFrame, rows: DataFrame, least: float = BEST, with_price: bool = False) -> DataFrame:
    """Each distinct text with name, score and method of its best candidate (the first of equals), or "", 0 and no_match."""
    keys = ["text", *(["price"] if with_price else [])]
    # Of equal names only the first can be the best.
    firsts = rows.groupBy("name").agg(F.min_by(F.struct("id", "default_price", "cat_pos"), F.struct("cat_pos", "id")).alias("f")).select("name", "f.*")
    if with_price:
        last = price_map(rows).select(F.col("name").alias("__low"), F.col("price").alias("__price"))
        firsts = firsts.join(last, F.lower("name") == F.col("__low"), "left").select("name", "id", F.col("__price").cast("double").alias("default_price"), "cat_pos")
    pairs = scored_pairs(texts, firsts, least, with_price, 1)
    best = pairs.groupBy(*keys).agg(F.max_by(F.struct("name", "score", "method"), F.struct("score", (-F.col("cat_pos")).alias("p"))).alias("best"))
    distinct = texts.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, [distinct[k].eqNullSafe(best[k]) for k in keys])
    return distinct.join(best, same, "left").select(*[distinct[k] for k in keys], F.coalesce("best.name", F.lit("")).alias("name"), rounded(F.coalesce("best.score", F.lit(0.0))).alias("score"), F.coalesce("best.method", F.lit("no_match")).alias("method"))


def corrections(best: DataFrame, kind: str) -> DataFrame:
    """What matching has changed: matches that aren't exact."""
    return best.where("name <> '' and method <> 'exact'").select(F.lit(kind).alias("type"), F.col("text").alias("original"), F.col("name").alias("matched"), F.col("score").alias("confidence"), "method")


def price_map(rows: DataFrame) -> DataFrame:
    """(name, price): lower-cased names, the last of equal ones; a price of 0 or none, or one that is no number, is left out."""
    priced = rows.withColumn("price", F.nullif(F.col("default_price"), F.lit(0.0)).try_cast("long")).where("price is not null")
    return priced.groupBy(F.lower("name").alias("name")).agg(F.max_by("price", F.struct("cat_pos", "id")).alias("price"))


def first_id(rows: DataFrame) -> DataFrame:
    """(name, id): lower-cased names with the id of the first."""
    return rows.groupBy(F.lower("name").alias("name")).agg(F.min_by("id", F.struct("cat_pos", "id")).alias("id"))


def accept(candidates: Column, least: float) -> Column:
    """The first candidate's id if its score is high enough."""
    top = F.get(candidates, F.lit(0))
    return F.when(top["score"] >= least, top["id"])


def fallback_candidates(texts: DataFrame, rows: DataFrame, top: int = 5) -> DataFrame:
    """Candidates by other rules: subsequence, 0.8 of the ratio, 0.7 of the token share, over 0.35."""
    low, name = F.trim(F.lower("text")), F.lower("name")
    told = lambda t: F.struct(char_bits(t).alias("chars"), gram_bits(F.array_distinct(tokens(t))).alias("words"))
    sides = Sides(texts, distinct_names(rows)).with_names(lambda b: b.select("name", once(name, told).alias("b")))
    distinct = sides.texts.select("text", once(low, told).alias("a"), F.length(F.replace(low, F.lit(" "), F.lit(""))).alias("tight"))
    # Each score by its bound on bits: the ratio's; a name that the text runs through holds all its characters; words in common.
    bound = ratio_bound(F.col("a.chars"), F.col("b.chars"))
    through = common_bound(F.col("a.chars"), F.col("b.chars"), 4) >= F.greatest(F.col("tight"), F.lit(1))
    shared = 0.7 * common_bound(F.col("a.words"), F.col("b.words"), 2) > 0.35 * F.col("b.words.n") - 1e-9
    pairs = sides.met(distinct, (0.8 * bound > 0.35 - 1e-9) | through | shared).select("text", "name", bound.alias("__bound"))
    pairs = pairs.withColumn("__own", F.greatest(subsequence_score(low, name), 0.7 * token_share(low, name)))
    open_ = 0.8 * F.col("__bound") > F.greatest(F.lit(0.35), F.col("__own")) - 1e-9
    # The ratio stands before the filter, which so can't move into the join and be asked of every pair.
    pairs = pairs.withColumn("score", F.greatest("__own", F.coalesce(0.8 * sequence_ratio(low, name, open_), F.lit(0.0)))).drop("__own", "__bound")
    pairs = pairs.where("score > 0.35").withColumn("score", rounded(F.col("score")))
    pairs = pairs.join(first_rows(rows, top).select("id", "name", "cat_pos"), "name")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "cat_pos", "id", "name"))).where(F.col("rank") <= top)


def product_candidates(texts: DataFrame, rows: DataFrame, top: int = 5) -> DataFrame:
    """The candidates of rank(); for texts that it finds none for, fallback_candidates(), which have neither method nor price."""
    ranked = rank(texts, rows, RANK_PRODUCT, top)
    # Both readers take all columns of the same rows, so that these are ranked once: what they exchange is shared.
    packed = ranked.groupBy("text").agg(F.collect_list(F.struct(*[c for c in ranked.columns if c != "text"])).alias("c"))
    every = texts.select("text").distinct().join(packed, "text", "left")
    found = every.where("c is not null").select("text", F.inline("c")).select(*ranked.columns)
    return found.unionByName(fallback_candidates(every.where("c is null").select("text"), rows, top), allowMissingColumns=True)


def fuzzy_match(texts: DataFrame, rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(text, name, score): the highest ratio of lower-cased texts, at least 0.85 for a candidate that the text holds, the first of equals."""
    pairs = by_ratio(texts, rows, F.lower, threshold)
    score = F.when(F.contains("t", "c"), F.greatest(F.col("ratio"), F.lit(0.85))).otherwise(F.col("ratio"))
    return pairs.withColumn("score", score).where(F.col("score") >= threshold).groupBy("text").agg(F.max_by(F.struct("name", "score"), F.struct("score", (-F.col("cat_pos")).alias("p"))).alias("b")).select("text", "b.*")


def corrected_names(texts: DataFrame, rows: DataFrame, customers: bool = False) -> DataFrame:
    """(text, name, confidence, method): the first name that equals the text or that it holds; then, for products, equality after
    the change of confused characters; then the fuzzy match from 0.55."""
    distinct = texts.select(F.trim("text").alias("text")).distinct()
    same, holds = F.lower("text") == F.lower("name"), F.contains(F.lower("text"), F.lower("name"))
    first = against(distinct, rows, holds).groupBy("text").agg(F.min_by(F.struct("name", F.when(same, 1.0).otherwise(0.95).alias("confidence"), F.lit("catalog").alias("method")), "cat_pos").alias("hit"))
    changed = unconfuse(F.col("text"), "product")
    second = distinct.withColumn("__low", F.lower(changed)).where(changed != F.col("text")).join(distinct_names(rows), F.col("__low") == F.lower("name")).groupBy("text").agg(F.min_by(F.struct("name", F.lit(0.9).alias("confidence"), F.lit("character_confusion").alias("method")), "cat_pos").alias("hit"))
    done = first if customers else first.unionByName(second.join(first, "text", "left_anti"))
    rest = distinct.join(done, "text", "left_anti")
    third = fuzzy_match(rest if customers else rest.where(F.length("text") > 0), rows, 0.55).select("text", F.struct("name", F.col("score").alias("confidence"), F.lit("fuzzy_match").alias("method")).alias("hit"))
    every = done.unionByName(third)
    return distinct.join(every, "text", "left").select("text", F.coalesce("hit.name", F.lit("")).alias("name"), F.coalesce("hit.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("hit.method", F.lit("none")).alias("method"))


def evaluated_match(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(text, name): the evaluation's match, by the ratio of normalised texts; over 0.6, else null."""
    pairs = by_ratio(texts, rows, normalize_text, 0.6)
    score = F.when(F.contains("t", "c") & (F.col("ratio") > 0.3), F.greatest(F.col("ratio"), F.lit(0.85))).otherwise(F.col("ratio"))
    best = pairs.withColumn("score", score).where(F.col("score") > 0.6).groupBy("text").agg(F.max_by("name", F.struct("score", (-F.col("cat_pos")).alias("p"))).alias("name"))
    return texts.select("text").distinct().join(best, "text", "left").select("text", "name")
