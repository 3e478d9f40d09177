"""Column functions on text. All are null in, null out unless they say otherwise; regular expressions are Unicode-aware."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.words import ALIASES, CONFUSED, PRODUCT_WORDS, SOUNDS

#: Letters, digits and underscore of any script.
WORD = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return squeeze(F.regexp_replace(F.lower(c), rf"(?U)[^{WORD}\s]", " "))


def normalize_alias(c: Column) -> Column:
    """normalize_text, then each alias in turn to its canonical form."""
    out = normalize_text(c)
    for alias, canonical in ALIASES:
        out = F.regexp_replace(out, rf"(?<![{WORD}]){alias}(?![{WORD}])", canonical)
    return squeeze(out)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: an expression that is read more than once would else be computed for each reading, and one
    that a lambda reads for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _grams(c: Column) -> Column:
    padded = F.when(F.length(c) < 3, F.rpad(c, 3, " ")).otherwise(c)
    return once(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda k: F.substring(p, k, F.lit(3))))


def grams(c: Column) -> Column:
    """struct(text, grams, plain): the lower-cased text, its trigrams, and whether no trigram comes twice."""
    told = lambda m: F.struct(m["low"].alias("text"), m["own"].alias("grams"), (F.size(F.array_distinct(m["own"])) == F.size(m["own"])).alias("plain"))
    return once(strip(F.lower(c)), lambda low: once(F.struct(low.alias("low"), _grams(low).alias("own")), told))


def grams_similarity(a: Column, b: Column) -> Column:
    """Jaccard likeness of the multisets of trigrams of two grams() columns."""
    held = lambda g, x: F.size(F.filter(g, lambda y: y == x))
    ga, gb = a["grams"], b["grams"]
    # Where one side holds no trigram twice, the set of common ones is the common multiset.
    repeats = F.aggregate(F.array_distinct(ga), F.lit(0), lambda n, x: n + F.least(held(ga, x), held(gb, x)))
    common = F.when(a["plain"] | b["plain"], F.size(F.array_intersect(ga, gb))).otherwise(repeats)
    return F.when(a["text"] == b["text"], F.lit(1.0)).when((F.length(a["text"]) == 0) | (F.length(b["text"]) == 0), F.lit(0.0)).otherwise(F.get(F.transform(F.array(common), lambda n: n / (F.size(ga) + F.size(gb) - n)), F.lit(0)))


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.get(F.transform(F.array(F.struct(grams(a).alias("a"), grams(b).alias("b"))), lambda g: grams_similarity(g["a"], g["b"])), F.lit(0))


#: Characters that char_bits counts, and how often each.
COUNTED, OFTEN = "abcdefghijklmnopqrstuvwxyz0123456789 ", 6


def char_bits(c: Column) -> Column:
    """struct(b0.., extra, n): a bit for each of the first OFTEN places of each counted character, how many characters have no bit, and how
    many there are. Its overlap bounds what two texts can have in common, by bit operations alone."""
    per = 60 // OFTEN
    # Few expressions, made by lambdas: one for each character would take seconds to plan.
    counts = lambda t: F.transform(F.split(F.lit(COUNTED), ""), lambda ch: F.least(F.length(t) - F.length(F.replace(t, ch, F.lit(""))), F.lit(OFTEN)))
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))

    def told(m: Column) -> Column:
        longs = [F.aggregate(F.slice(m["unary"], k + 1, per), F.lit(0).cast("long"), lambda x, y: x + y).alias(f"b{k // per}") for k in range(0, len(COUNTED), per)]
        return F.struct(*longs, (F.length(m["t"]) - F.aggregate(m["n"], F.lit(0), lambda x, y: x + y)).alias("extra"), F.length(m["t"]).alias("n"))

    unary = lambda n: F.transform(n, lambda x, i: one(x + OFTEN * (i % per)) - one(OFTEN * (i % per)))
    return once(c, lambda t: once(counts(t), lambda n: once(F.struct(t.alias("t"), n.alias("n"), unary(n).alias("unary")), told)))


def gram_bits(g: Column) -> Column:
    """The same of an array of trigrams, each with a bit of its hash."""
    at = lambda half: F.aggregate(
        F.filter(F.transform(g, lambda x: F.pmod(F.xxhash64(x), F.lit(128))), lambda b: (b >= 64 * half) & (b < 64 * half + 64)), F.lit(0).cast("long"), lambda n, b: n.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b - 64 * half).cast("int")))
    )
    pair = F.struct(at(0).alias("b0"), at(1).alias("b1"))
    return F.get(F.transform(F.array(pair), lambda p: F.struct(p["b0"].alias("b0"), p["b1"].alias("b1"), (F.size(g) - F.bit_count(p["b0"]) - F.bit_count(p["b1"])).alias("extra"), F.size(g).alias("n"))), F.lit(0))


def common_bound(a: Column, b: Column, longs: int) -> Column:
    """At least as many as two char_bits() (4 longs) or gram_bits() (2) have in common."""
    return sum((F.bit_count(a[f"b{k}"].bitwiseAND(b[f"b{k}"])) for k in range(1, longs)), F.bit_count(a["b0"].bitwiseAND(b["b0"]))) + F.least(a["extra"], b["extra"])


def skeleton(c: Column) -> Column:
    """The first letter and the later consonants, sounds unified, a-z only."""
    out = strip(F.lower(c))
    for pair, sound in SOUNDS:
        out = F.replace(out, F.lit(pair), F.lit(sound))
    out = F.regexp_replace(out, "[^a-z]", "")
    return F.concat(F.substring(out, 1, 1), F.regexp_replace(F.substring(out, 2, 1 << 30), "[aeiou]", ""))


def has_product_word(c: Column) -> Column:
    return F.lower(c).rlike("|".join(PRODUCT_WORDS))


def unconfuse(c: Column, context: str = "mixed") -> Column:
    """Characters that scans mix up, changed as the context (product, price, mixed) suggests."""
    return F.translate(c, *CONFUSED[context])


def subsequence_score(detected: Column, target: Column) -> Column:
    """Share of the target that the detected text covers as a subsequence, with 0.2 more for a prefix, at most 1; else 0."""
    d, t = F.lower(F.replace(detected, F.lit(" "), F.lit(""))), F.lower(F.replace(target, F.lit(" "), F.lit("")))
    at = F.aggregate(F.split(d, ""), F.lit(0), lambda p, c: F.when(p < 0, F.lit(-1)).otherwise(F.coalesce(F.nullif(F.position(c, t, p + 1), F.lit(0)), F.lit(-1))))
    share = F.length(d) / F.length(t) + F.when(F.startswith(t, d), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.when((F.length(d) > 0) & (F.length(t) > 0) & (at > 0), F.least(F.lit(1.0), share)).otherwise(F.lit(0.0))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: F.length(w) > 0)


def token_share(detected: Column, target: Column) -> Column:
    """Share of the target's distinct tokens that the detected text has."""
    own = F.array_distinct(tokens(target))
    return F.coalesce(F.size(F.array_intersect(tokens(detected), own)) / F.nullif(F.size(own), F.lit(0)), F.lit(0.0))


def customer_name(c: Column) -> Column:
    """struct(detected_name, confidence): alphabetic words of two letters and more; words for customer raise the confidence and go."""
    words = ["plg", "pelanggan", "nama", "customer"]
    plain = F.array_join(F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w.rlike(r"^\p{L}{2,}$")), " ")
    marked = F.lower(c).rlike("|".join(words))
    cleaned = plain
    for w in words:
        cleaned = strip(F.replace(cleaned, F.lit(w), F.lit("")))
    name = F.when(marked, cleaned).otherwise(plain)
    return F.struct(F.coalesce(F.nullif(name, F.lit("")), strip(c)).alias("detected_name"), F.when(marked, F.lit(0.85)).otherwise(F.lit(0.7)).alias("confidence"))


def filter_noise_lines(c: Column) -> Column:
    """The lines that hold a letter or digit of ASCII and two characters at least, as they are."""
    keep = lambda line: line.rlike("[a-zA-Z0-9]") & (F.length(strip(line)) >= 2)
    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


def unfence(c: Column) -> Column:
    """JSON text of a reply: without the marks of a code block."""
    fence, out = "```", strip(c)
    opened = F.when(F.contains(out, F.lit(fence + "json")), F.replace(F.replace(out, F.lit(fence + "json"), F.lit("")), F.lit(fence), F.lit(""))).when(
        F.startswith(out, F.lit(fence)), F.regexp_replace(F.substring(out, 4, 1 << 30), fence + "$", "")
    )
    return strip(F.substring_index(F.coalesce(opened, out), fence, 1))


def strip_fence(c: Column) -> Column:
    """Without one mark of a code block at each end (the engines' rule)."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?", ""), r"```$", ""))


def engine_matches(name: Column, wanted: str) -> Column:
    return (name == wanted) | F.startswith(name, F.lit(wanted))
