"""Parsers of dates, prices and quantities. Three parsers of dates differ on purpose; what "now" is, is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import filter_noise_lines, strip
from ledgerloom.functions.words import CORRECTOR_MONTHS, DAYS, EXPORT_MONTHS, FALLBACK_PRICES, MONTHS, OTHER_ITEM, OTHER_PRICE


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null where there is no match or the group took no part."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def number(c: Column, kind: str = "int") -> Column:
    return c.try_cast(kind)


def iso(year: Column, month: Column, day: Column) -> Column:
    """Text, never a date: no calendar is asked."""
    return F.format_string("%04d-%02d-%02d", year, month, day)


def full_year(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def _month(c: Column, months: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])
    return F.try_element_at(table, c)


_INTERPRETER = "jan|feb|mar|apr|may|jun|jul|aug|sep|okt|nov|dec|januari|februari|maret|april|mei|juni|juli|agustus|september|oktober|november|desember"


def interpreter_date(c: Column, as_of_year: int) -> Column:
    """struct(date, confidence): a day and a month's name (with a year anywhere 0.85, else this year 0.70), numbers with a
    year (0.80), a day and a full month's name (0.65); else (null, 0)."""
    low, known = strip(F.lower(c)), {k: v for k, v in MONTHS.items() if k != "des"}
    named = rf"(?U)(\d{{1,2}})\s+({_INTERPRETER})"
    day, month, year = number(found(low, named, 1)), _month(found(low, named, 2), known), number(found(c, r"(?U)(\d{4})", 1))
    # A year of 0 is none.
    year = F.nullif(year, F.lit(0))
    numbers = r"(?U)(\d{1,2})[/\-](\d{1,2})[/\-](\d{2,4})"
    d, m, y = (number(found(c, numbers, k)) for k in (1, 2, 3))
    full = r"(?U)(\d{1,2})\s+(januari|februari|maret|april|mei|juni|juli|agustus|september|oktober|november|desember)"
    fd, fm = number(found(low, full, 1)), _month(found(low, full, 2), MONTHS)
    out = lambda date, conf: F.struct(date.alias("date"), F.lit(conf).alias("confidence"))
    return (
        F.when(month.isNotNull() & year.isNotNull(), out(iso(year, month, day), 0.85))
        .when(month.isNotNull(), out(iso(F.lit(as_of_year), month, day), 0.70))
        .when(d.isNotNull(), out(iso(full_year(y), m, d), 0.80))
        .when(fm.isNotNull(), out(iso(F.lit(as_of_year), fm, fd), 0.65))
        .otherwise(out(F.lit(None).cast("string"), 0.0))
    )


def corrector_date(c: Column, as_of_year: int) -> Column:
    """Numbers first, if day and month can be, then a day and a month's name, always of this year; else null."""
    numbers = r"(?U)(\d{1,2})[/.\-](\d{1,2})(?:[/.\-](\d{2,4}))?"
    d, m, y = (number(found(c, numbers, k)) for k in (1, 2, 3))
    names = "jan|feb|mar|apr|mei|jun|jul|ags|sep|okt|nov|des|januari|februari|maret|april|agustus|september|oktober|november|desember"
    named = rf"(?Ui)(\d{{1,2}})[,\s]+({names})"
    day, month = number(found(c, named, 1)), _month(F.lower(found(c, named, 2)), CORRECTOR_MONTHS)
    return F.when(m.between(1, 12) & d.between(1, 31), iso(F.coalesce(full_year(y), F.lit(as_of_year)), m, d)).when(month.isNotNull() & day.between(1, 31), iso(F.lit(as_of_year), month, day))


def export_date(c: Column, as_of_date: str) -> Column:
    """A day and a month by its first three letters, at the start, or numbers with a year, at the start; else as_of_date."""
    s = strip(c)
    named = r"(?U)^(\d{1,2})\s+([A-Za-z]+)"
    day, month = number(found(s, named, 1)), _month(F.substring(F.lower(found(s, named, 2)), 1, 3), EXPORT_MONTHS)
    year = F.coalesce(number(found(s, r"(?U)(\d{4})", 1)), F.lit(int(as_of_date[:4])))
    numbers = r"(?U)^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})"
    d, m, y = (number(found(s, numbers, k)) for k in (1, 2, 3))
    return F.coalesce(F.when(month.isNotNull(), iso(year, month, day)).when(d.isNotNull(), iso(full_year(y), m, d)), F.lit(as_of_date))


def is_date_line(c: Column) -> Column:
    """Whether the evaluation takes a line for a date."""
    return c.rlike(r"\d{1,2}[/.\-]\d{1,2}([/.\-]\d{2,4})?") | c.rlike(r"(?i)\d{1,2}\s+(jan|feb|mar|apr|mei|jun|jul|ags|sep|okt|nov|des|oktober)")


def is_date_text(c: Column) -> Column:
    """Whether the classifier takes a line for a date."""
    low = strip(F.lower(c))
    names = "|".join(MONTHS)
    return low.rlike(rf"\b\d{{1,2}}\s+({names})\s+\d{{4}}") | low.rlike(r"\b\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}") | low.rlike(rf"\b({'|'.join(DAYS)})\s+")


def price(c: Column) -> Column:
    """Thousands with a separator, decimals with a unit, whole numbers with a unit, else the first number."""
    grouped = r"(\d{1,3})[.,](\d{3})"
    decimal = r"(?i)(\d+)[.,](\d+)\s*(?:rb|ribu)"
    unit = r"(?i)(\d+)\s*(?:rb|ribu|k)\b"
    thousands = (F.concat(found(c, decimal, 1), F.lit("."), found(c, decimal, 2)).try_cast("double") * 1000).cast("long")
    return F.coalesce(number(F.concat(found(c, grouped, 1), found(c, grouped, 2)), "long"), thousands, number(found(c, unit, 1), "long") * 1000, number(found(c, r"(\d+)", 1), "long"))


def quantity(c: Column) -> Column:
    """A number with an x (under 100), a number in parentheses, else the first number if it is 1 to 50."""
    times = r"(\d+)\s*[xX]|\s*[xX]\s*(\d+)"
    first = number(F.coalesce(found(c, times, 1), found(c, times, 2)), "long")
    return F.coalesce(F.when(first < 100, first), number(found(c, r"\((\d+)\)", 1), "long"), F.when(number(found(c, r"(\d+)", 1), "long").between(1, 50), number(found(c, r"(\d+)", 1), "long")))


def prices_in(c: Column) -> Column:
    """Distinct plausible prices (500 to 500000), ascending. The captures leave the units out, so "35rb" is 35 and goes."""
    patterns = [r"(?i)Rp\s*(\d{1,3}(?:[.,]\d{3})+)", r"(\d{1,3}(?:[.,]\d{3})+)", r"(?i)(\d+)(?:rb|ribu)", r"(?i)(\d+)k\b", r"(\d{3,6})(?=\s*(?:,-|$)|\s*(?=\d{3}(?:\D|$)))"]
    every = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns])
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, price), lambda p: p.between(500, 500_000))))


def quantities_in(c: Column) -> Column:
    """Distinct plausible quantities (1 to 99), ascending."""
    every = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (r"(\d+)x\b", r"\bx(\d+)", r"\((\d+)\)")])
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda x: number(x, "long")), lambda q: q.between(1, 99))))


def line_prices(c: Column) -> Column:
    """Prices that the evaluation sees in a line."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?:Rp\s*)?(\d{3,6})(?:\.\d{3})?"), F.lit(1)), lambda x: number(x, "long")), lambda p: p.between(500, 500_000))))


def line_quantities(c: Column) -> Column:
    """Quantities that the evaluation sees in a line: under 100, with an x on either side or in parentheses after a word."""
    pattern = F.lit(r"\bx(\d+)|\b(\d+)x\b|\b[\(](\d+)[\)]")
    every = F.concat(*[F.regexp_extract_all(c, pattern, F.lit(k)) for k in (1, 2, 3)])
    return F.array_sort(F.array_distinct(F.filter(F.transform(every, lambda x: number(x, "long")), lambda q: q < 100)))


def fallback_price(name: Column) -> Column:
    """The price of the first known word that the lower-cased name holds, else OTHER_PRICE."""
    out, low = F.lit(OTHER_PRICE), F.lower(name)
    for word, value in reversed(FALLBACK_PRICES):
        out = F.when(F.contains(low, F.lit(word)), F.lit(value)).otherwise(out)
    return out.cast("long")


def export_price(given: Column, name: Column) -> Column:
    """A positive price, halves to even, else the fallback."""
    return F.when(given.cast("long") > 0, F.bround(given.cast("double"), 0).cast("long")).otherwise(fallback_price(name))


def export_quantity(given: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.nullif(given.cast("int"), F.lit(0)), F.lit(1)))


def export_name(product: Column, raw_line: Column) -> Column:
    return strip(F.coalesce(F.nullif(product, F.lit("")), F.nullif(raw_line, F.lit("")), F.lit(OTHER_ITEM)))


def corrected_text(c: Column, as_of_year: int) -> Column:
    """struct(corrected_text, date, corrections): noise lines go, the date of the rest is read, and both are logged."""
    clean = filter_noise_lines(c)
    date = corrector_date(clean, as_of_year)
    log = F.array_compact(F.array(F.when(F.length(clean) != F.length(c), F.lit("noise_filter")), F.when(date.isNotNull(), F.lit("date_extraction"))))
    return F.struct(clean.alias("corrected_text"), date.alias("date"), log.alias("corrections"))
