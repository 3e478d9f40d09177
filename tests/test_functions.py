import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import metrics, parse, ratio, text


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def pairs(spark, values, f):
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, a string, b string").select("i", f(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


@pytest.fixture(scope="module")
def random_pairs():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choices("abcdeiknosty 12é—", k=rnd.randint(0, 14)))
    return [(word(), word()) for _ in range(400)] + [(x, x) for x in ("kopi", "")] + [("tide", "diet"), ("diet", "tide"), ("aaaa", "aaa"), ("aaab", "aaaa")]


def test_corrector_dates(spark):
    texts = ["08/10", "08-10-26", "08.10.2026", "8 Okt", "8 Oktober 2026", "08-10-2026", "Kamis 8 Okt", "08, OKT"]
    assert column(spark, texts, lambda c: parse.corrector_date(c, 2026)) == ["2026-10-08"] * 8
    assert column(spark, ["45/13", "none", "8 Okt 2020", "5/6/020", ""], lambda c: parse.corrector_date(c, 2026)) == [None, None, "2026-10-08", "0020-06-05".replace("0020", "2020"), None]


def test_interpreter_dates(spark):
    got = column(spark, ["02 Sep 2025", "28 okt kamis", "45/13/2026", "12 des 2026", "12 dec 2026", "8 agustus", "1-2-26", "none", "08.10.2026"], lambda c: parse.interpreter_date(c, 2026))
    assert [(r["date"], r["confidence"]) for r in got] == [("2025-09-02", 0.85), ("2026-10-28", 0.70), ("2026-13-45", 0.80), (None, 0.0), (None, 0.0), ("2026-08-08", 0.70), ("2026-02-01", 0.80), (None, 0.0), (None, 0.0)]


def test_export_dates(spark):
    texts = ["8 Okt 2025", "8 oktober", "8 agustus 2026", "8/1/26", "on 8 Okt", "", None, "08.10.2026"]
    assert column(spark, texts, lambda c: parse.export_date(c, "2026-10-09")) == ["2025-10-08", "2026-10-08", "2026-10-09", "2026-01-08", "2026-10-09", "2026-10-09", "2026-10-09", "2026-10-08"]


def test_prices(spark):
    texts = ["Rp3.500", "3.500", "3500", "3rb", "3,5rb", "3k", "5000,-", "15000", "1.234.567", "3.500rb", "gratis"]
    assert column(spark, texts, parse.price) == [3500, 3500, 3500, 3000, 3500, 3000, 5000, 15000, 1234, 3500, None]


def test_quantities(spark):
    assert column(spark, ["2x", "x2", "(3)", "10", "51", "0x", "200x (7)", "none"], parse.quantity) == [2, 2, 3, 10, None, 0, 7, None]


def test_extractions(spark):
    assert column(spark, ["35rb", "Rp3.500 2x", "kopi 3500", "12k"], parse.prices_in) == [[], [3500], [3500], []]
    assert column(spark, ["2x (3) x4", "2X", "100x"], parse.quantities_in) == [[2, 3, 4], [], []]


def test_noise_lines(spark):
    raw = "08 OKT Kamis\n||\n\n—\nMadu 5000\n___"
    got = column(spark, [raw, "Madu 5000", ""], lambda c: parse.corrected_text(c, 2026))
    assert (got[0]["corrected_text"], got[0]["date"], got[0]["corrections"]) == ("08 OKT Kamis\nMadu 5000", "2026-10-08", ["noise_filter", "date_extraction"])
    assert got[1]["corrections"] == [] and got[2]["corrected_text"] == ""


def test_normal_forms(spark):
    assert column(spark, ["Indomi, Goreng!", "Gls Aqua", "KOPI SUSU", "mie goreng", "\tes  t \n", "MIE—instan"], text.normalize_alias) == ["indomie goreng", "aqua gelas aqua", "kopi susu", "indomie goreng", "es teh", "indomie"]


def gram_likeness(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    ga, gb = (Counter(s[i : i + 3] for i in range(len(s) - 2)) for s in (a.ljust(3), b.ljust(3)))
    return sum((ga & gb).values()) / sum((ga | gb).values())


def test_trigrams_against_a_plain_version(spark, random_pairs):
    assert pairs(spark, random_pairs, text.trigram_similarity) == pytest.approx([gram_likeness(a, b) for a, b in random_pairs])


def test_ratio_is_that_of_the_library(spark, random_pairs):
    long = [("ab" * 150, "ba" * 140), ("x" * 250, "y" + "x" * 249)]
    every = random_pairs + long
    assert pairs(spark, every, ratio.sequence_ratio) == [SequenceMatcher(None, a, b).ratio() for a, b in every]
    every += [("aaaaaaaaaaaa", "aaaaaaaa"), ("élan ß", "ß élan"), ("", ""), ("", "a")]
    bounds = pairs(spark, every, lambda a, b: ratio.ratio_bound(text.char_bits(a), text.char_bits(b)))
    assert all(q >= SequenceMatcher(None, a, b).ratio() - 1e-9 for (a, b), q in zip(every, bounds))


def test_common_trigrams_are_bounded(spark, random_pairs):
    every = random_pairs + [("abcabcabcabc", "bcabcabc"), ("aaaaaaaaa", "aaaa"), ("x" * 200, "x" * 150)]
    parts = lambda c: text.gram_bits(text.grams(c)["grams"])
    bounds = pairs(spark, every, lambda a, b: text.common_bound(parts(a), parts(b), 2))
    for (a, b), most in zip(every, bounds):
        ga, gb = (Counter(s[i : i + 3] for i in range(len(s) - 2)) for s in (a.strip().lower().ljust(3), b.strip().lower().ljust(3)))
        assert most >= (ga & gb).total()


def test_subsequence_and_tokens(spark, random_pairs):
    def plain(d, t):
        d, t = d.replace(" ", "").lower(), t.replace(" ", "").lower()
        it = iter(t)
        if not d or not all(c in it for c in d):
            return 0.0
        return min(1.0, len(d) / len(t) + (0.2 if t.startswith(d) else 0))

    every = random_pairs + [("kp", "kopi"), ("ko", "kopi susu"), ("", "a")]
    assert pairs(spark, every, text.subsequence_score) == pytest.approx([plain(a, b) for a, b in every])
    assert pairs(spark, [("es kopi", "kopi susu"), ("", "a"), ("a", "")], text.token_share) == [0.5, 0.0, 0.0]


def test_skeletons(spark):
    assert column(spark, ["Kupi", "khas nyanyi", "123", "", "aeiou"], text.skeleton) == ["kp", "ksnn", "", "", "a"]


def test_error_rates(spark):
    got = pairs(spark, [("abc", ""), ("", ""), ("abcd", "a"), ("A  b", "a b")], lambda a, b: F.array(metrics.character_error_rate(a, b), metrics.word_error_rate(a, b)))
    assert got == [[1.0, 1.0], [0.0, 0.0], [3.0, 3.0], [pytest.approx(2 / 3), 0.0]]


def test_fences(spark):
    f = "```"
    assert column(spark, [f"{f}json\n{{}}\n{f}", f"{f}{{}}{f}", f"{{}}\n{f} more", " {} "], text.unfence) == ["{}", "{}", "{}", "{}"]


def test_customer_names(spark):
    got = column(spark, ["Mbak Tami", "plg Budi 2", "7", "Nama ani"], text.customer_name)
    assert [(r["detected_name"], r["confidence"]) for r in got] == [("Mbak Tami", 0.7), ("Budi", 0.85), ("7", 0.7), ("Nama ani", 0.85)]


def test_exporter_defaults(spark):
    assert column(spark, ["es kopi", "pop mie", "aqua galon", "kue"], parse.fallback_price) == [5000, 8000, 3000, 5000]
    rows = spark.createDataFrame([(None, 0), (2.5, 3), (3.5, None), (-1.0, -4)], "p double, q int").select(parse.export_price(F.col("p"), F.lit("kue")).alias("p"), parse.export_quantity(F.col("q")).alias("q")).collect()
    assert [(r["p"], r["q"]) for r in rows] == [(5000, 1), (2, 3), (4, 1), (5000, 1)]
    assert not re.search("x", "".join(column(spark, ["x"], lambda c: F.replace(c, F.lit("x"), F.lit("")))))
