"""Secret scans in DataFrame functions alone.

Three patterns give the base spans. The method adds spans: long runs of token characters are scored by two first-order Markov
models over characters, one of random strings and one of ordinary identifiers, and a run whose log-likelihood ratio
per step is high is a span of its own. Both models are counted, with DataFrame functions, from labelled samples that a rule makes; the
ratio from which a run counts as random is fitted on other samples, made of other words.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_or_empty

# The base patterns and the least lengths of what they must hold.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "random")
#: Runs the models score, of so many characters at least.
RUN_LEAST = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % RUN_LEAST
#: Characters of the models; any other is the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Labelled samples of each kind, and the constant added to each count.
SAMPLES, SMOOTH = 4_000, 0.5
#: The cut lies midway between these shares of the ordinary and the random scores.
ORDINARY_UNDER, RANDOM_FROM = 0.999, 0.005
#: Matches of a text that are placed in one fold.
CHUNK = 256
#: Words from which the rule makes ordinary identifiers. Each part of the samples takes its own: the fourth and fifth of five words go to
#: the parts that fit the cut and that hold models to account, the others to the one that is counted.
WORDS = (
    "user name count index value token key list map file path data item node type size total page line text word state error "
    "result option config cache query table column field record message event stream buffer offset length number order price "
    "customer account session request response server client handler manager factory service context parser reader writer "
    "image video audio sound color width height margin border shadow button label input output source target parent child window "
    "thread process worker schedule policy metric report summary history version release branch commit merge review project module "
    "package import export public private static final abstract virtual default override return yield async await promise future "
    "the and with from this that which have will into over under between through during before after above below again further "
    "der die und nicht eine einen haben werden können durch über gegen les des une dans pour avec être nous vous el los las para con sin sobre"
).split()
PARTS = ("count", "fit", "hold")


def labelled(spark: SparkSession, part: str = "count") -> DataFrame:
    """(random, text): SAMPLES rows of each label, the same at each call. Random strings are digests in hex, base64, upper-case base 36
    style, letters and digits of both cases, or lower-case letters and digits. Ordinary strings join words by case, underscores, hyphens,
    slashes, dots or nothing, some with a short number, or are one sign or a pair of signs again and again, a stretch of the alphabet or
    of the digits, or a date and time."""
    n, salt = F.col("id"), PARTS.index(part) * 1_000_003
    draw = lambda name, of: F.pmod(F.xxhash64(n + salt, F.lit(name)), F.lit(of)).cast("int")
    digest = F.sha2(F.concat(F.lit("sample"), (n + salt).cast("string")), 256)
    packed = F.base64(F.unhex(digest))
    letters, kind = F.regexp_replace(packed, "[^A-Za-z0-9]", ""), draw("kind", 5)
    strings = F.when(kind == 0, digest).when(kind == 1, packed).when(kind == 2, F.upper(letters)).when(kind == 3, letters).otherwise(F.lower(letters))
    strings = F.substring(strings, F.lit(1), draw("length", 21) + 20)
    own = [w for k, w in enumerate(WORDS) if max(0, k % 5 - 2) == PARTS.index(part)]
    words = F.array(*[F.lit(w) for w in own])
    chosen = F.transform(F.sequence(F.lit(1), draw("many", 4) + 2), lambda i: F.get(words, F.pmod(F.xxhash64(n + salt, i), F.lit(len(own))).cast("int")))
    camel = F.array_join(F.transform(chosen, lambda w: F.initcap(w)), "")
    sign = lambda name: F.substring(F.lit(ALPHABET), draw(name, len(ALPHABET)) + 1, F.lit(1))
    number = lambda name, least, of: F.lpad((draw(name, of) + least).cast("string"), 2, "0")
    moment = F.concat(F.lit("20"), number("year", 0, 40), sign_of("-", "_", "/", pick=draw("d", 3)), number("month", 1, 12), sign_of("-", "_", "/", pick=draw("d", 3)), number("day", 1, 28), F.lit("T"), number("hour", 0, 24), number("minute", 0, 60), number("second", 0, 60), F.lit("000000"))
    style = draw("style", 12)
    joined = F.when(style == 0, camel).when(style == 1, F.array_join(chosen, "_")).when(style == 2, F.array_join(chosen, "-")).when(style == 3, F.array_join(chosen, "/"))
    joined = joined.when(style == 4, F.upper(F.array_join(chosen, "_"))).when(style == 5, F.concat(F.array_join(chosen, "_"), draw("number", 100).cast("string"))).when(style == 6, F.array_join(chosen, ".")).when(style == 7, F.array_join(chosen, ""))
    joined = joined.when(style == 8, F.repeat(sign("sign"), draw("length", 40) + 20)).when(style == 9, F.repeat(F.concat(sign("sign"), sign("other")), draw("length", 20) + 10))
    joined = joined.when(style == 10, F.substring(F.concat(F.repeat(F.lit("0123456789"), 4), F.lit(ALPHABET[:26] * 2), F.lit(ALPHABET[26:52])), draw("place", 98) + 1, draw("length", 30) + 20)).otherwise(moment)
    rows = spark.range(SAMPLES)
    return rows.select(F.lit(True).alias("random"), strings.alias("text")).unionByName(rows.select(F.lit(False).alias("random"), joined.alias("text")))


def sign_of(*signs: str, pick: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in signs]), pick)


def _codes(text: Column) -> Column:
    """Place of each character in the alphabet, from 0; its size for any other."""
    return F.transform(F.split(text, ""), lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(len(ALPHABET) + 1)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each step from one character to the next, random over ordinary; row by row, (size + 1) squared."""
    n = len(ALPHABET) + 1
    codes = samples.where("text is not null").select("random", _codes(F.col("text")).alias("codes"))
    steps = codes.select("random", F.explode(F.filter(_steps(F.col("codes")), lambda k: k.isNotNull())).alias("step"))
    counts = {True: [SMOOTH] * (n * n), False: [SMOOTH] * (n * n)}
    for random, step, many in steps.groupBy("random", "step").count().collect():  # at most 2 n * n rows
        counts[random][step] += many
    logs = {}
    for kind, c in counts.items():
        rows = [sum(c[a * n : a * n + n]) for a in range(n)]
        logs[kind] = [math.log(c[i] / rows[i // n]) for i in range(n * n)]
    return [round(a - b, 4) for a, b in zip(logs[True], logs[False], strict=True)]


def _steps(codes: Column) -> Column:
    """Each step from one character to the next, as a place in the table of ratios."""
    return F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: (a * (len(ALPHABET) + 1) + b).cast("int"))


def score(run: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of the run's steps over their number; a step that comes again counts once, so that no period adds up."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    steps = F.array_distinct(F.get(F.transform(F.array(_codes(run)), _steps), F.lit(0)))
    return F.aggregate(steps, F.lit(0.0), lambda n, k: n + F.coalesce(F.get(table, k), F.lit(0.0))) / F.greatest(F.length(run) - 1, F.lit(1))


def fitted_cut(samples: DataFrame, ratios: list[float]) -> float:
    """Midway between the score that all but a thousandth of the ordinary samples lie under and the one that nearly all random ones reach."""
    told = samples.where(F.length("text") >= RUN_LEAST).withColumn("score", score(F.col("text"), ratios)).agg(
        F.expr(f"percentile(if(random, null, score), {ORDINARY_UNDER})").alias("low"), F.expr(f"percentile(if(random, score, null), {RANDOM_FROM})").alias("high")
    ).first()
    return (told["low"] + told["high"]) / 2


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column]) -> Column:
    """(start, kind, end) of each match that keep(match) takes: what is between the matches tells where they are. Matches are placed in
    folds of CHUNK, so that a text of many costs no square of their number."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    pairs = F.zip_with(whole, between, lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(keep(pair["match"]), F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def placed(held: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int"))
        part = lambda c: F.slice(held, c * CHUNK + 1, CHUNK)
        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        size = lambda c: F.aggregate(part(c), F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["match"]))
        starts = F.aggregate(chunks, begun, lambda acc, c: F.struct((acc["at"] + size(c)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: acc["starts"])
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.aggregate(part(c), F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"])))

    # The outer lambda holds the matches, which would else be searched for again in each chunk. No pass over the text but one where
    # nothing matches.
    return F.when(F.regexp_like(text, F.lit(pattern)), F.get(F.transform(F.array(pairs), placed), F.lit(0))).otherwise(none)


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, cut: float | None = None) -> DataFrame:
    """docs (doc_id, text and any more columns, which are ignored) with the spans of secrets: kind:start:end in code points.

    Base kinds: assign (a name, a sign, a value of 6 or more characters), access (AKIA..., 20 or more) and hex (24 or more), leftmost
    and non-overlapping for each kind. The kind random: runs of 20 or more token characters whose score is at least cut (if not given:
    fitted) and that no base span touches. Null or empty text: no span. Null doc_id and repeated rows: kept. Very long texts are scanned whole. An
    empty table gives an empty result.
    """
    ratios = train(labelled(docs.sparkSession))
    cut = fitted_cut(labelled(docs.sparkSession, "fit"), ratios) if cut is None else cut
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2))
    rows = rows.select(
        "doc_id",
        spans(F.col("text"), ASSIGN, 0, lambda m: value(m) >= LEAST["assign"]).alias("assign"),
        spans(F.col("text"), ACCESS, 1, lambda m: F.length(m) >= LEAST["access"]).alias("access"),
        spans(F.col("text"), HEX.replace("+", "{%d,}" % LEAST["hex"]), 2, lambda m: F.lit(True)).alias("hex"),
        spans(F.col("text"), RUN, 3, lambda m: score(m, ratios) >= cut).alias("runs"),
    )
    base = F.concat("assign", "access", "hex")
    free = F.filter("runs", lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        joined(base).alias("base"),
        joined(F.concat(base, free)).alias("spans"),
    )
