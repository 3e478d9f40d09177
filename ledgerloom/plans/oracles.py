"""The queries of this package as DuckDB SQL, written on its own: what a query computes, not how."""

from __future__ import annotations

from ledgerloom.functions.words import ALIASES, CONFUSED, DAYS, FALLBACK_PRICES, MONTHS, PRODUCT_WORDS, SOUNDS, SYMBOLS
from ledgerloom.plans.tables import AS_OF_DATE, AS_OF_YEAR, POS, REGIONS, SECTION_ITEMS

WORDS = "|".join(PRODUCT_WORDS)
DATE_PARTS = "|".join([*DAYS, *MONTHS])
NAMES = "|".join(MONTHS)


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def any_of(xs: list[str]) -> str:
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def plain(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def alias(x: str) -> str:
    out = plain(x)
    for a, b in ALIASES:
        out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def grams(x: str) -> str:
    return f"list_transform(range(1, greatest(length({x}), 3) - 1), lambda i: substr(rpad({x}, CAST(greatest(length({x}), 3) AS INT), ' '), i, 3))"


def likeness(a: str, b: str, ga: str, gb: str) -> str:
    common = f"coalesce(list_sum(list_transform(list_distinct({ga}), lambda g: least(len(list_filter({ga}, lambda y: y = g)), len(list_filter({gb}, lambda z: z = g))))), 0)"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE CAST({common} AS DOUBLE) / (len({ga}) + len({gb}) - {common}) END"


def sound(x: str) -> str:
    out = f"trim(lower({x}))"
    for a, b in SOUNDS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, '[^a-z]', '', 'g')"
    return f"(substr({out}, 1, 1) || regexp_replace(substr({out}, 2), '[aeiou]', '', 'g'))"


PAIRS = """names AS (SELECT DISTINCT p_name FROM part),
texts AS (SELECT DISTINCT unnest([p_name, upper(p_name), substr(p_name, 1, length(p_name) - 2), 'es ' || p_name, reverse(p_name), p_name || ', mie!']) AS text FROM names),
pairs AS (SELECT text, p_name AS cand FROM texts CROSS JOIN names)"""

def ratio_of(source: str, name: str) -> str:
    """CTE `name` (a, b, ratio): the sequence ratio of each pair (a, b) of the source. The longest common part, the first in a and then in b,
    splits both into what is before it and what is after; for WITH RECURSIVE."""
    return f"""
{name}_part AS (SELECT a, b, CAST(0 AS BIGINT) AS alo, length(a) AS ahi, CAST(0 AS BIGINT) AS blo, length(b) AS bhi, CAST(0 AS BIGINT) AS hit FROM (SELECT DISTINCT a, b FROM ({source}))
  UNION ALL SELECT a, b, p.alo, p.ahi, p.blo, p.bhi, p.hit FROM (
    SELECT a, b, unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j, 'hit': n}}, {{'alo': i + n, 'ahi': ahi, 'blo': j + n, 'bhi': bhi, 'hit': CAST(0 AS BIGINT)}}]) AS p FROM (
      SELECT *, m.n AS n, -m.i AS i, blo + strpos(substr(b, blo + 1, bhi - blo), substr(a, 1 - m.i, m.n)) - 1 AS j FROM (
        SELECT *, list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(1, least(ahi - i, bhi - blo) + 1),
          lambda n: CASE WHEN contains(substr(b, blo + 1, bhi - blo), substr(a, i + 1, n)) THEN {{'n': n, 'i': -i}} END)))) AS m
        FROM {name}_part WHERE alo < ahi AND blo < bhi) WHERE m IS NOT NULL))),
{name} AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE CAST(2.0 * sum(hit) / (length(a) + length(b)) AS DOUBLE) END AS ratio FROM {name}_part GROUP BY a, b)"""


def scores(texts: str, names: str) -> str:
    """CTE scored (text, name, score, method) of texts (text) against names (name); for WITH RECURSIVE."""
    near = "least(length(ts), length(cs)) / greatest(length(ts), length(cs))"
    return f"""
t AS (SELECT text, n, {grams("n")} AS g, {sound("n")} AS s FROM (SELECT text, {alias("text")} AS n FROM ({texts}))),
c AS (SELECT name, n, {grams("n")} AS g, {sound("n")} AS s FROM (SELECT name, {alias("name")} AS n FROM ({names}))),
raw AS (SELECT text, name, t.n AS tn, c.n AS cn, t.s AS ts, c.s AS cs,
         CASE WHEN length(c.n) >= 2 AND contains(t.n, c.n) THEN 0.90 WHEN length(c.n) >= 2 AND contains(c.n, t.n) THEN 0.85 ELSE 0.0 END AS inside,
         {likeness("t.n", "c.n", "t.g", "c.g")} AS tri0 FROM t CROSS JOIN c WHERE length(t.n) > 0 AND length(c.n) > 0),
{ratio_of(f"SELECT ts AS a, cs AS b FROM raw WHERE ts <> cs AND length(ts) > 0 AND length(cs) > 0 AND {near} > 0.9", "sounds")},
tri AS (SELECT raw.*, CASE WHEN length(cn) <= 5 AND tri0 > 0.4 THEN least(1.0, tri0 + 0.2) ELSE tri0 END AS tri,
         CASE WHEN ts = cs THEN 0.9 WHEN sounds.ratio * {near} > 0.9 THEN sounds.ratio * {near} * 0.9 ELSE 0.0 END AS phon FROM raw LEFT JOIN sounds ON sounds.a = ts AND sounds.b = cs),
own AS (SELECT text, name, tn, cn, CAST(CASE WHEN tn = cn THEN 1.0 ELSE greatest(inside, tri, phon) END AS DOUBLE) AS score,
         CASE WHEN tn = cn THEN 'exact' WHEN phon > greatest(inside, tri) THEN 'phonetic' WHEN tri > inside THEN 'trigram' WHEN inside > 0 THEN 'substring' ELSE 'no_match' END AS method FROM tri),
{ratio_of("SELECT tn AS a, cn AS b FROM own WHERE score < 0.5", "seqs")},
scored AS (SELECT text, name, CASE WHEN score < 0.5 AND ratio > score THEN ratio ELSE score END AS score, CASE WHEN score < 0.5 AND ratio > score THEN 'levenshtein' ELSE method END AS method
         FROM own LEFT JOIN seqs ON seqs.a = tn AND seqs.b = cn)"""


PRODUCTS = "SELECT p_name AS name FROM names"
#: The best of each text: ties go to the catalog's first.
FIRST = "f AS (SELECT p_name, min(p_partkey) AS pos FROM part GROUP BY 1)"
BEST = f"""WITH RECURSIVE {PAIRS}, {scores('SELECT text FROM texts', PRODUCTS)}, {FIRST},
      b AS (SELECT text, name, round_even(score, 4) AS score, method FROM scored JOIN f ON p_name = name WHERE scored.score >= 0.55 QUALIFY row_number() OVER (PARTITION BY text ORDER BY scored.score DESC, pos) = 1)"""


def ranked(texts: str) -> str:
    return f"""WITH RECURSIVE {PAIRS}, {scores(texts, PRODUCTS)},
      r AS (SELECT text, p_partkey AS product_id, name, round_even(score, 4) AS score, method FROM scored JOIN part ON p_name = name WHERE score >= 0.3)
      SELECT text, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, product_id) AS INT) AS rank, product_id, name, score, method FROM r QUALIFY rank <= 5"""


def fallback(texts: str) -> str:
    """CTEs up to r: candidates by subsequence, ratio and token share."""
    words = lambda x: rf"list_filter(list_distinct(regexp_split_to_array({x}, '\s+')), lambda w: w <> '')"
    tight = lambda x: f"replace({x}, ' ', '')"
    covered = rf"regexp_matches({tight('n')}, '^.*' || array_to_string(list_transform(string_split({tight('t')}, ''), lambda ch: regexp_escape(ch)), '.*') || '.*$')"
    return f"""o AS (SELECT text, p_name, trim(lower(text)) AS t, lower(p_name) AS n FROM ({texts}) CROSS JOIN names), {ratio_of("SELECT t AS a, n AS b FROM o", "seq")},
      e AS (SELECT text, p_name, greatest(CASE WHEN length({tight('t')}) > 0 AND {covered} THEN least(1.0, length({tight('t')}) / length({tight('n')}) + CASE WHEN starts_with({tight('n')}, {tight('t')}) THEN 0.2 ELSE 0.0 END) ELSE 0.0 END,
        0.8 * ratio, 0.7 * len(list_intersect({words('t')}, {words('n')})) / len({words('n')})) AS score FROM o JOIN seq ON a = t AND b = n),
      r AS (SELECT text, p_partkey AS product_id, p_name AS name, round_even(score, 4) AS score FROM e JOIN part USING (p_name) WHERE score > 0.35)"""


def fuzzy(texts: str, least: float) -> str:
    """CTEs up to m (text, name, score): the best by the ratio of lower-cased texts."""
    return f"""o AS (SELECT text, p_name AS name, lower(text) AS t, lower(p_name) AS n FROM ({texts}) CROSS JOIN names), {ratio_of("SELECT t AS a, n AS b FROM o", "seq")}, {FIRST},
      m AS (SELECT text, name, CASE WHEN contains(t, n) THEN greatest(ratio, 0.85) ELSE ratio END AS score, pos FROM o JOIN seq ON a = t AND b = n JOIN f ON p_name = name WHERE CASE WHEN contains(t, n) THEN greatest(ratio, 0.85) ELSE ratio END >= {least}
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, pos) = 1)"""


def corrected(customers: bool) -> str:
    """SELECT of the corrector's names; for WITH RECURSIVE."""
    low, high = CONFUSED["product"]
    second = "" if customers else f"""UNION ALL SELECT text, name, 0.9, 'character_confusion' FROM (SELECT text, p_name AS name, pos FROM x JOIN f ON lower(translate(text, {lit(low)}, {lit(high)})) = lower(p_name)
        WHERE translate(text, {lit(low)}, {lit(high)}) <> text AND text NOT IN (SELECT text FROM one) QUALIFY row_number() OVER (PARTITION BY text ORDER BY pos) = 1)"""
    return f"""(WITH RECURSIVE x AS (SELECT DISTINCT trim(text) AS text FROM texts), {fuzzy('SELECT text FROM x' + ('' if customers else ' WHERE length(text) > 0'), 0.55)},
      one AS (SELECT text, p_name AS name, CAST(CASE WHEN lower(text) = lower(p_name) THEN 1.0 ELSE 0.95 END AS DOUBLE) AS confidence, 'catalog' AS method FROM x JOIN f ON contains(lower(text), lower(p_name)) QUALIFY row_number() OVER (PARTITION BY text ORDER BY pos) = 1),
      two AS (SELECT * FROM one {second}), three AS (SELECT * FROM two UNION ALL SELECT text, name, score, 'fuzzy_match' FROM m WHERE text NOT IN (SELECT text FROM two))
      SELECT x.text, coalesce(name, '') AS name, CAST(coalesce(confidence, 0.0) AS DOUBLE) AS confidence, coalesce(method, 'none') AS method, '{"customer" if customers else "product"}' AS kind FROM x LEFT JOIN three ON three.text = x.text)"""


DRAFTED = f"""
items AS (SELECT l_orderkey AS draft_id, l_orderkey || '-' || pos AS item_id, pos, l_partkey AS k,
   CASE WHEN l_suppkey % 4 <> 0 AND l_partkey <> 0 THEN 'Part ' || l_partkey ELSE 'item ' || l_partkey END AS description, CASE WHEN l_suppkey % 4 <> 0 AND l_partkey <> 0 THEN l_partkey END AS product_id,
   CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_quantity AS INT) ELSE 1 END AS quantity, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey * 0.5::DOUBLE ELSE 0.0::DOUBLE END AS unit_price,
   CAST((l_partkey % 100) / 100.0 AS DOUBLE) AS confidence,
   list_filter([CASE WHEN NOT (l_suppkey % 4 <> 0 AND l_partkey <> 0) THEN 'produk_tidak_ditemukan — pilih manual' END, CASE WHEN l_partkey % 5 = 0 THEN 'quantity_tidak_terdeteksi' END, CASE WHEN l_partkey % 3 = 0 THEN 'harga_tidak_terdeteksi' END,
     CASE WHEN l_linestatus = 'F' THEN 'coretan — periksa ulang' END, CASE WHEN l_linenumber % 2 = 0 THEN 'uncertain_quantity_missing' END], lambda x: x IS NOT NULL) AS warnings
   FROM (SELECT *, {POS} AS pos FROM lineitem))"""

NOISE = r"(regexp_matches(t, '^[—–−|]+$') OR regexp_matches(t, '^[.,;:!?]+$'))"
ONE_SIGN = r"(length(t) = 1 AND NOT regexp_matches(t, '^\p{L}$'))"
KEEP = rf"""((confidence > 0.35 OR regexp_matches(t, '^[0-9]+$') OR regexp_matches(lower(t), '{WORDS}') OR regexp_matches(lower(t), '{DATE_PARTS}') OR t IN {any_of(SYMBOLS)})
   AND (NOT ({NOISE} OR regexp_matches(t, '^[+*★※]+$')) OR regexp_matches(lower(t), '{WORDS}')) AND NOT ({ONE_SIGN} AND confidence < 0.5))"""
IS_NOISE = f"(length(t) = 0 OR {NOISE} OR ({ONE_SIGN} AND confidence < 0.5))"
OTHER = rf"""(CASE WHEN {IS_NOISE} THEN regexp_matches(lower(t), '{WORDS}') ELSE regexp_matches(t, '^[0-9]+$') OR regexp_matches(lower(t), '{WORDS}') OR regexp_matches(lower(t), '{DATE_PARTS}')
   OR t IN {any_of(SYMBOLS)} OR confidence > 0.4 OR regexp_matches(t, '^\p{{L}}{{2,}}$') END)"""


def clustered(source: str) -> str:
    """Lines of regions, one region after the other."""
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY yc, x0, pos) AS i FROM {source}),
walk AS (SELECT scan_id, i, pos, text, yc, x0, confidence, circled, struck, 0 AS line_idx, yc AS total, 1 AS many FROM ordered WHERE i = 1
  UNION ALL SELECT o.scan_id, o.i, o.pos, o.text, o.yc, o.x0, o.confidence, o.circled, o.struck, CASE WHEN abs(o.yc - w.total / w.many) < 60 THEN w.line_idx ELSE w.line_idx + 1 END,
    CASE WHEN abs(o.yc - w.total / w.many) < 60 THEN w.total + o.yc ELSE o.yc END, CASE WHEN abs(o.yc - w.total / w.many) < 60 THEN w.many + 1 ELSE 1 END
  FROM walk w JOIN ordered o ON o.scan_id = w.scan_id AND o.i = w.i + 1),
lines AS (SELECT scan_id, line_idx, string_agg(text, ' ' ORDER BY x0, yc, pos) AS line_text, CAST(trunc(avg(yc)) AS INT) AS line_y, min(x0) AS line_x, bool_or(struck) AS struck_through, count(*) AS n_regions,
    avg(confidence) AS conf, bool_or(circled) AS circled, list(trim(text) ORDER BY x0, yc, pos) AS texts FROM walk GROUP BY ALL)"""


def kind(t: str, idx: str) -> str:
    low = f"trim(lower({t}))"
    date = rf"(regexp_matches({low}, '\b\d{{1,2}}\s+({NAMES})\s+\d{{4}}') OR regexp_matches({low}, '\b\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}') OR regexp_matches({low}, '\b({'|'.join(DAYS)})\s+'))"
    words = rf"len(list_filter(regexp_split_to_array({low}, '\s+'), lambda w: length(w) > 0))"
    return rf"""CASE WHEN {date} THEN 'date'
      WHEN {idx} <= 2 AND NOT regexp_matches({t}, '\d') AND NOT regexp_matches({low}, '{WORDS}') AND NOT regexp_matches({low}, 'tanggal|date|tgl') AND length({low}) < 30 AND {words} BETWEEN 1 AND 4 THEN 'customer'
      WHEN regexp_matches({low}, '{WORDS}') OR (regexp_matches({t}, '\d') AND {idx} > 0) THEN 'item' ELSE 'unknown' END"""


def customer(t: str) -> str:
    words = rf"array_to_string(list_filter(regexp_split_to_array(trim({t}), '\s+'), lambda w: regexp_matches(w, '^\p{{L}}{{2,}}$')), ' ')"
    cleaned = words
    for w in ("plg", "pelanggan", "nama", "customer"):
        cleaned = f"trim(replace({cleaned}, '{w}', ''))"
    marked = f"regexp_matches(lower({t}), 'plg|pelanggan|nama|customer')"
    return f"coalesce(nullif(CASE WHEN {marked} THEN {cleaned} ELSE {words} END, ''), trim({t}))"


# Lines with what they hold. Their dates are 08/10/2026 (0.80) or 12 Okt 2025 (0.85), the named month first.
INTERPRETED = rf"""
kept AS (SELECT * FROM (SELECT *, trim(text) AS t FROM regions) WHERE {KEEP}), {clustered("kept")},
n AS (SELECT *, {kind("line_text", "line_idx")} AS kind, list_transform(list_filter(texts, lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: CAST(x AS BIGINT)) AS nums,
   array_to_string(list_filter(texts, lambda x: length(x) > 0 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN {any_of(SYMBOLS)} AND NOT (length(x) = 1 AND NOT regexp_matches(x, '^\p{{L}}$')) AND lower(x) NOT IN {any_of([*DAYS, *MONTHS])}), ' ') AS detected_text FROM lines),
q AS (SELECT *, list_filter(nums, lambda v: v <= 99 AND (circled OR (len(nums) = 1 AND regexp_matches(lower(line_text), '{WORDS}'))))[1] AS marked, CASE WHEN len(nums) = 1 AND nums[1] <= 99 THEN nums[1] END AS lone,
   CAST(list_filter(nums, lambda v: v >= 100)[1] AS DOUBLE) AS price, least(1.0, conf + CASE WHEN regexp_matches(lower(detected_text), '{WORDS}') THEN 0.3 ELSE 0 END - CASE WHEN struck_through THEN 0.3 ELSE 0 END) AS confidence FROM n),
f AS (SELECT *, CAST(coalesce(marked, lone) AS INT) AS quantity, array_to_string(list_filter([CASE WHEN marked IS NULL THEN CASE WHEN lone IS NOT NULL THEN 'quantity_assumed_no_explicit_marker' WHEN len(nums) = 0 THEN 'no_quantity_detected' ELSE 'quantity_missing' END END,
     CASE WHEN struck_through THEN 'struck_through_excluded' END], lambda x: x IS NOT NULL), ',') AS uncertain_fields,
   CASE WHEN kind IN ('date', 'customer') THEN kind WHEN confidence > 0.1 OR regexp_matches(lower(detected_text), '{WORDS}') THEN 'item' ELSE 'uncertain' END AS fate FROM q)"""

FALLBACK = "CASE " + " ".join(f"WHEN contains(lower(name), {lit(k)}) THEN {v}" for k, v in FALLBACK_PRICES) + " ELSE 5000 END"
EXPORTED = f"""
raw AS ({SECTION_ITEMS}), named AS (SELECT *, trim(coalesce(nullif(product, ''), nullif(raw_line, ''), 'Item Lainnya')) AS name, greatest(1, coalesce(nullif(quantity, 0), 1)) AS qty FROM raw),
priced AS (SELECT *, CAST(CASE WHEN trunc(unit_price) > 0 THEN round_even(unit_price, 0) ELSE {FALLBACK} END AS BIGINT) AS price FROM named)"""

BENCH = """b AS (SELECT item_id, regexp_replace(text, '[^\\x20-\\x7E]', '', 'g') AS a FROM benchmark),
p AS (SELECT item_id, a, 0 AS kind, replace(upper(a), 'TH', 't') || '  end' AS b FROM b UNION ALL SELECT item_id, a, 1, coalesce(lead(a) OVER (ORDER BY item_id), '') FROM b)"""


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def rate(a: str, b: str) -> str:
    return f"CASE WHEN length({b}) = 0 THEN CASE WHEN length({a}) > 0 THEN 1.0 ELSE 0.0 END ELSE CAST(levenshtein({a}, {b}) AS DOUBLE) / length({b}) END"


WRITTEN_DATES = """
d AS (SELECT o_orderkey, o_orderkey % 8 AS k, CASE WHEN o_orderkey % 8 = 1 THEN 2000 + year(o_orderdate) % 100 ELSE year(o_orderdate) END AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)"""
WRITTEN_AMOUNTS = f"""
w AS (SELECT l_orderkey, pos, CAST(l_quantity AS INT) AS q, l_linenumber % 7 AS k, l_partkey AS p FROM (SELECT *, {POS} AS pos FROM lineitem))"""
METHODS = "m AS (SELECT event_type AS method, (event_id % 97) / 100.0::DOUBLE AS confidence, user_id % 50 AS regions, (event_id % 13) / 2.0::DOUBLE AS seconds FROM events)"

CASCADES = "SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(i // 4 AS VARCHAR) AS image, CAST(i % 4 + 1 AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"

QUANTITY = r"'\bx(\d+)|\b(\d+)x\b|\b[\(](\d+)[\)]'"

ORACLES: dict[str, str] = {
    # Names that hold the text or that it holds: an exact one scores 1, others 0.90 or 0.85, and a near price adds 0.15; the first of equals.
    "export_transactions": f"""WITH {EXPORTED}, f AS (SELECT p_name, min(p_partkey) AS id, trunc(arg_max(p_retailprice, p_partkey)) AS expected FROM part GROUP BY 1),
      n AS (SELECT DISTINCT name, price, {alias("name")} AS t FROM priced),
      c AS (SELECT name, price, id, p_name = t AS same, (CASE WHEN contains(t, p_name) THEN 0.90 ELSE 0.85 END) + CASE WHEN abs(price - expected) / expected < 0.15 THEN 0.15 ELSE 0 END AS s FROM n JOIN f ON contains(t, p_name) OR contains(p_name, t)),
      h AS (SELECT name, price, id FROM c QUALIFY row_number() OVER (PARTITION BY name, price ORDER BY CASE WHEN same THEN 1.0 ELSE least(1.0, s) END DESC, id) = 1)
      SELECT image, o_custkey AS customer_id, 'Bon OCR: ' || trim(customer) || ' | Foto: IMG_' || image || '.jpg' AS notes, strftime(o_orderdate, '%Y-%m-%d') AS transaction_date, count(*) AS items,
        CAST(sum(qty * p.price) AS BIGINT) AS total_amount, count(id) AS matched, CAST(sum(id) AS BIGINT) AS product_ids, CAST(sum(qty) AS BIGINT) AS quantity
      FROM priced p LEFT JOIN h ON h.name = p.name AND h.price = p.price GROUP BY ALL""",
    "scan_filter_limit": "SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS chars FROM documents WHERE lang IN ('en', 'de') ORDER BY doc_id LIMIT 20 OFFSET 5",
    "noise_filter_lines": r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[a-zA-Z0-9]') AND length(trim(x, chr(32)||chr(9)||chr(13)||chr(11)||chr(12))) >= 2), chr(10))) AS kept FROM documents",
    "region_noise_filter": f"WITH r AS ({REGIONS}), s AS (SELECT *, trim(text) AS t FROM r) SELECT text, count(*) FILTER ({KEEP}) AS live, count(*) FILTER ({IS_NOISE}) AS noise, count(*) FILTER ({OTHER}) AS other, count(*) AS n FROM s GROUP BY text",
    "normalize_alias": f"""WITH r AS (SELECT p_partkey, p_name || ' ' || ['Indomi, Goreng!', 'Gls Aqua', 'mie instan', 'es t jus', 'KOPI  hitam.', 'aqua glas mie'][p_partkey % 6 + 1] AS raw FROM part)
      SELECT p_partkey, {alias("raw")} AS alias, {plain("raw")} AS plain FROM r""",
    "trigram_similarity": f"WITH {PAIRS}, g AS (SELECT text, cand, trim(lower(text)) AS a, trim(lower(cand)) AS b FROM pairs), h AS (SELECT *, {grams('a')} AS ga, {grams('b')} AS gb FROM g) SELECT text, cand, round({likeness('a', 'b', 'ga', 'gb')}, 9) AS score FROM h",
    "phonetic_skeleton": f"WITH n AS (SELECT c_name AS name FROM customer UNION SELECT p_type || ' khsy ngany ' || p_name FROM part) SELECT name, {sound('name')} AS skeleton FROM n",
    "char_confusion": "WITH r AS (SELECT item_id, text || ' O0D1lI/5S2Z6Gbg9q8B3E4A7TUVd' AS t FROM benchmark) SELECT item_id, " + ", ".join(f"translate(t, '{a}', '{b}') AS {c}" for c, (a, b) in CONFUSED.items()) + " FROM r",
    "error_rates": f"WITH {BENCH} SELECT item_id, kind, CAST(levenshtein(a, b) AS BIGINT) AS distance, round({rate('a', 'b')}, 9) AS cer, round({rate(squeezed('a'), squeezed('b'))}, 9) AS wer FROM p",
    "subsequence_score": """WITH names AS (SELECT DISTINCT p_name FROM part), s AS (SELECT DISTINCT unnest([substr(p_name, 1, 3), regexp_replace(p_name, '[aeiou]', '', 'g'), p_name, ' ']) AS text FROM names),
      p AS (SELECT text, p_name, replace(lower(text), ' ', '') AS d, replace(lower(p_name), ' ', '') AS t FROM s CROSS JOIN names)
      SELECT text, p_name, round(CASE WHEN length(d) > 0 AND regexp_matches(t, '^.*' || array_to_string(string_split(d, ''), '.*') || '.*$') THEN least(1.0, CAST(length(d) AS DOUBLE) / length(t) + CASE WHEN starts_with(t, d) THEN 0.2 ELSE 0.0 END) ELSE 0.0 END, 9) AS score FROM p""",
    "token_share": rf"WITH {PAIRS}, t AS (SELECT text, cand, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda x: x <> '') AS a, list_filter(list_distinct(regexp_split_to_array(lower(cand), '\s+')), lambda x: x <> '') AS b FROM pairs) SELECT text, cand, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(b), 9) AS score FROM t",
    "score_candidate": f"WITH RECURSIVE {PAIRS}, {scores('SELECT text FROM texts', PRODUCTS)} SELECT text, name AS cand, round(score, 9) AS score, method FROM scored WHERE score >= 0.3",
    "rank_products_top5": ranked("SELECT DISTINCT upper(p_name) AS text FROM part"),
    "rank_customers_top3": f"""WITH RECURSIVE {scores("SELECT 'customer#' || lpad(CAST(n_nationkey * 5 + 2 AS VARCHAR), 9, '0') || ' jr' AS text FROM nation", "SELECT c_name AS name FROM customer")},
      r AS (SELECT text, c_custkey AS customer_id, name, round_even(score, 4) AS score FROM scored JOIN customer ON c_name = name WHERE score >= 0.35)
      SELECT text, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, customer_id) AS INT) AS rank, customer_id, name, score FROM r QUALIFY rank <= 3""",
    "best_match": f"{BEST} SELECT texts.text, coalesce(name, '') AS name, coalesce(score, 0.0) AS score, coalesce(method, 'no_match') AS method FROM texts LEFT JOIN b ON b.text = texts.text",
    "price_map_lookup": "SELECT lower(p_name) AS name, CAST(trunc(arg_max(p_retailprice, p_partkey)) AS BIGINT) AS price FROM part WHERE p_retailprice <> 0 GROUP BY 1",
    "draft_items": f"WITH {DRAFTED} SELECT item_id, description, product_id, quantity, unit_price, quantity * unit_price AS subtotal, array_to_string(warnings, ';') AS warnings FROM items",
    "apply_product_defaults": f"""WITH {DRAFTED}, p AS (SELECT i.*, CASE WHEN p_partkey IS NOT NULL AND unit_price = 0 THEN p_retailprice ELSE unit_price END AS up, CASE WHEN length(p_brand) > 0 THEN p_brand ELSE 'pcs' END AS unit FROM items i LEFT JOIN part ON p_partkey = product_id)
      SELECT item_id, product_id, quantity, up AS unit_price, unit, round_even(quantity * up, 6) AS subtotal FROM p""",
    "draft_totals": f"WITH {DRAFTED} SELECT draft_id, CAST(sum(quantity) AS BIGINT) AS total_quantity, round_even(sum(quantity * unit_price), 4) AS total_amount, count(*) FILTER (confidence < 0.5 OR len(warnings) > 0) AS unresolved_count FROM items GROUP BY 1",
    "unresolved_items": f"WITH {DRAFTED} SELECT item_id, confidence, CAST(len(warnings) AS INT) AS n_warnings FROM items WHERE confidence < 0.5 OR len(warnings) > 0",
    "draft_edits": f"""WITH {DRAFTED}, e AS (SELECT *, CASE WHEN k % 4 = 0 THEN 3 WHEN k % 2 = 0 THEN greatest(1, k % 7 - 2) END AS eq, CASE WHEN k % 3 = 0 THEN k / 4.0::DOUBLE END AS ep FROM items WHERE k % 7 <> 0),
      r AS (SELECT item_id, CASE WHEN k % 5 = 0 THEN 'Chosen ' || k ELSE description END AS description, CASE WHEN k % 5 = 0 THEN k + 1 ELSE product_id END AS product_id, CAST(coalesce(eq, quantity) AS INT) AS quantity, coalesce(ep, unit_price) AS unit_price,
        k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0 AS is_manual, CAST(len(CASE WHEN k % 5 = 0 THEN list_filter(warnings, lambda w: NOT contains(w, 'produk_tidak_ditemukan')) ELSE warnings END) AS INT) AS n_warnings FROM e)
      SELECT item_id, description, product_id, quantity, round_even(unit_price, 6) AS unit_price, round_even(quantity * unit_price, 6) AS subtotal, is_manual, n_warnings FROM r
      UNION ALL SELECT item_id || '-new', 'by hand', NULL, 2, 1500.0, 3000.0, true, 0 FROM items WHERE draft_id % 11 = 0 AND pos = 1""",
    "confirm_payload": f"""WITH {DRAFTED}, i AS (SELECT draft_id, CAST(round_even(sum(quantity * unit_price), 0) AS BIGINT) AS total_amount, count(*) AS n_items, CAST(sum(greatest(1, quantity) * CAST(round_even(unit_price, 0) AS BIGINT)) AS BIGINT) AS item_sum,
        string_agg(CAST(CAST(round_even(unit_price, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS unit_prices, count(*) FILTER (confidence < 0.5 OR len(warnings) > 0) AS unresolved_count FROM items GROUP BY 1)
      SELECT o_orderkey AS draft_id, 'confirmed' AS status, o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m-%d') AS transaction_date, coalesce(total_amount, 0) AS total_amount, coalesce(n_items, 0) AS n_items, coalesce(item_sum, 0) AS item_sum,
        coalesce(unit_prices, '') AS unit_prices, coalesce(unresolved_count, 0) > 0 AS has_unresolved_warnings, coalesce(unresolved_count, 0) AS unresolved_count FROM orders LEFT JOIN i ON draft_id = o_orderkey""",
    "customer_resolution": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey <> 0 THEN c_custkey END AS customer_id, c_name || CASE WHEN NOT (c_custkey % 3 = 0 AND c_custkey <> 0) AND c_custkey % 2 = 0 AND c_custkey % 10 < 7 THEN ' (belum dipastikan)' ELSE '' END AS customer_name FROM customer",
    "customer_lookup": "SELECT upper(c_name) AS text, c_custkey AS customer_id FROM customer JOIN nation ON c_custkey = n_nationkey * 5 + 2 UNION ALL SELECT 'zzz qqq', 999",
    "fallback_price_first_hit": f"""WITH r AS (SELECT p_partkey, p_name || ' ' || ['es kopi', 'pop mie', 'Aqua Galon', 'kue', 'ROTI', 'es batu', 'aqua'][p_partkey % 7 + 1] AS name FROM part)
      SELECT p_partkey, CAST({FALLBACK} AS BIGINT) AS price, CAST(CASE WHEN p_partkey % 2 = 0 AND p_partkey >= 4 THEN round_even(p_partkey / 4.0, 0) ELSE {FALLBACK} END AS BIGINT) AS export_price FROM r""",
    # What each written form means, straight from the date that was written.
    "parse_dates": f"""WITH {WRITTEN_DATES}, s AS (SELECT *, printf('%04d-%02d-%02d', y, m, d) AS iso, printf('%04d-%02d-%02d', {AS_OF_YEAR}, m, d) AS this_year, m = 8 AS august, m = 12 AS december FROM d)
      SELECT o_orderkey, CASE WHEN k IN (0, 1) THEN iso WHEN k = 2 AND NOT december THEN iso WHEN k = 3 AND NOT december THEN this_year END AS interpreted,
        CAST(CASE WHEN k IN (0, 1) THEN 0.80 WHEN k = 2 AND NOT december THEN 0.85 WHEN k = 3 AND NOT december THEN 0.70 ELSE 0.0 END AS DOUBLE) AS confidence,
        CASE WHEN k IN (0, 1, 4) THEN iso WHEN k IN (2, 3, 5, 6) THEN this_year END AS corrected,
        CASE WHEN k IN (0, 1, 4) THEN iso WHEN k = 2 AND NOT august THEN iso ELSE '{AS_OF_DATE}' END AS exported,
        k IN (0, 1, 4, 6) OR (k IN (2, 3) AND NOT august) AS date_line FROM s""",
    "parse_amounts": f"""WITH {WRITTEN_AMOUNTS} SELECT l_orderkey, pos, CAST(CASE k WHEN 0 THEN q * 1000 WHEN 1 THEN q * 1000 + p % 1000 WHEN 2 THEN q * 1000 + 500 WHEN 3 THEN q WHEN 4 THEN q WHEN 5 THEN p * 3000 END AS BIGINT) AS price,
        CAST(CASE k WHEN 0 THEN q WHEN 1 THEN q WHEN 2 THEN q WHEN 3 THEN q WHEN 4 THEN q WHEN 5 THEN CASE WHEN p * 3 BETWEEN 1 AND 50 THEN p * 3 END END AS BIGINT) AS quantity FROM w""",
    "extract_amounts": f"""WITH {WRITTEN_AMOUNTS} SELECT l_orderkey, pos, CASE WHEN k = 1 AND q * 1000 + p % 1000 BETWEEN 500 AND 500000 THEN CASE WHEN p % 1000 >= 500 THEN p % 1000 || ',' ELSE '' END || (q * 1000 + p % 1000)
          WHEN k = 3 AND p + 500 BETWEEN 500 AND 500000 THEN CAST(p + 500 AS VARCHAR) WHEN k = 5 AND p * 3 BETWEEN 500 AND 500000 THEN CAST(p * 3 AS VARCHAR) ELSE '' END AS prices,
        CASE k WHEN 3 THEN CAST(q AS VARCHAR) WHEN 4 THEN q || ',' || (q + 1) ELSE '' END AS quantities,
        CASE WHEN k = 1 AND p % 1000 BETWEEN 500 AND 999 THEN CAST(p % 1000 AS VARCHAR) WHEN k = 3 AND p + 500 BETWEEN 500 AND 500000 THEN CAST(p + 500 AS VARCHAR) WHEN k = 5 AND p * 3 BETWEEN 500 AND 500000 THEN CAST(p * 3 AS VARCHAR) ELSE '' END AS line_prices FROM w""",
    "corrected_text": rf"""WITH c AS (SELECT doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[a-zA-Z0-9]') AND length(trim(x, chr(32)||chr(9)||chr(13)||chr(11)||chr(12))) >= 2), chr(10)) AS t FROM documents),
      n AS (SELECT *, regexp_extract(t, '(\d{{1,2}})[/.\-](\d{{1,2}})(?:[/.\-](\d{{2,4}}))?', ['d', 'm', 'y']) AS a, regexp_extract(t, '(?i)(\d{{1,2}})[,\s]+(jan|feb|mar|apr|mei|jun|jul|ags|sep|okt|nov|des|januari|februari|maret|april|agustus|september|oktober|november|desember)', ['d', 'm']) AS b FROM c),
      v AS (SELECT *, try_cast(a.d AS INT) AS ad, try_cast(a.m AS INT) AS am, try_cast(a.y AS INT) AS ay, try_cast(b.d AS INT) AS bd, list_position(['jan', 'feb', 'mar', 'apr', 'mei', 'jun', 'jul', 'ags', 'sep', 'okt', 'nov', 'des'], replace(substr(lower(b.m), 1, 3), 'agu', 'ags')) AS bm FROM n),
      d AS (SELECT *, CASE WHEN am BETWEEN 1 AND 12 AND ad BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', coalesce(CASE WHEN ay < 100 THEN ay + 2000 ELSE ay END, {AS_OF_YEAR}), am, ad) WHEN bm > 0 AND bd BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', {AS_OF_YEAR}, bm, bd) END AS date FROM v)
      SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, date, array_to_string(list_filter([CASE WHEN length(t) <> length(text) THEN 'noise_filter' END, CASE WHEN date IS NOT NULL THEN 'date_extraction' END], lambda x: x IS NOT NULL), ',') AS corrections FROM d""",
    "line_clustering": f"WITH RECURSIVE regions AS ({REGIONS}), {clustered('regions')} SELECT scan_id, line_idx, line_text, line_y, line_x, struck_through, n_regions FROM lines",
    "classify_lines": f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN string_split(text, ' ')[1] ELSE text END AS t FROM conversations)
      SELECT conv_id, turn, {kind("t", "turn")} AS kind, {customer("t")} AS detected_name, CAST(CASE WHEN regexp_matches(lower(t), 'plg|pelanggan|nama|customer') THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence FROM r""",
    "parse_item_line": f"WITH RECURSIVE regions AS ({REGIONS}), {INTERPRETED} SELECT scan_id, line_idx, fate, detected_text, quantity, price, round_even(confidence, 6) AS confidence, uncertain_fields FROM f WHERE fate IN ('item', 'uncertain')",
    "page_interpretation": rf"""WITH RECURSIVE regions AS ({REGIONS}), {INTERPRETED},
      d AS (SELECT *, {customer("line_text")} AS cname, CASE WHEN kind = 'date' THEN CASE WHEN contains(lower(line_text), '12 okt') THEN coalesce(nullif(regexp_extract(line_text, '(\d{{4}})', 1), ''), '{AS_OF_YEAR}') || '-10-12' WHEN contains(line_text, '08/10/2026') THEN '2026-10-08' END END AS dt,
        CASE WHEN kind = 'date' THEN CASE WHEN contains(lower(line_text), '12 okt') THEN 0.85 ELSE 0.80 END END AS dc FROM f),
      g AS (SELECT scan_id, arg_max(dt, line_idx) FILTER (fate = 'date') AS date, arg_max(dc, line_idx) FILTER (fate = 'date') AS dconf, arg_max(cname, line_idx) FILTER (fate = 'customer') AS customer,
        arg_max(CASE WHEN regexp_matches(lower(line_text), 'plg|pelanggan|nama|customer') THEN 0.85 ELSE 0.7 END, line_idx) FILTER (fate = 'customer') AS cconf,
        count(*) FILTER (fate = 'item') AS n_items, count(*) FILTER (fate = 'uncertain') AS n_uncertain, coalesce(sum(confidence) FILTER (fate = 'item'), 0) AS csum FROM d GROUP BY 1)
      SELECT p.scan_id, date, CAST(coalesce(dconf, 0) AS DOUBLE) AS date_confidence, customer, coalesce(n_items, 0) AS n_items, coalesce(n_uncertain, 0) AS n_uncertain,
        round_even(CAST((coalesce(dconf, 0) + coalesce(cconf, 0) + coalesce(csum, 0)) AS DOUBLE) / (1 + CASE WHEN customer IS NULL THEN 0 ELSE 1 END + coalesce(n_items, 0)), 6) AS total_confidence, coalesce(n_uncertain > 0.4 * n_items + 1, false) AS high_uncertainty
      FROM (SELECT DISTINCT scan_id FROM regions) p LEFT JOIN g ON g.scan_id = p.scan_id""",
    "layout_analysis": f"""WITH r AS ({REGIONS}), g AS (SELECT *, yc - lag(yc) OVER (PARTITION BY scan_id ORDER BY yc, pos) AS gap, min(xc) OVER (PARTITION BY scan_id) AS lo, max(xc) OVER (PARTITION BY scan_id) AS hi FROM r)
      SELECT scan_id, 'portrait' AS orientation, CASE WHEN max(hi) - min(lo) > 360 AND count(*) FILTER (xc < (lo + hi) / 2) > 3 AND count(*) FILTER (xc >= (lo + hi) / 2) > 3 THEN 2 ELSE 1 END AS columns, CAST(CASE WHEN count(*) > 2 THEN trunc(median(gap)) ELSE 40 END AS INT) AS line_height_px FROM g GROUP BY 1""",
    "scan_status": f"WITH r AS ({REGIONS}), s AS (SELECT scan_id, count(*) AS n_regions, avg(confidence) AS m FROM r GROUP BY 1) SELECT scan_id, n_regions, round_even(m, 6) AS confidence, CASE WHEN m < 0.1 THEN 'no_text_detected' WHEN m < 0.5 THEN 'uncertain' ELSE 'ok' END AS status FROM s",
    "dedup_items": f"""WITH r AS ({SECTION_ITEMS}), k AS (SELECT o_custkey AS image, section_pos, lower(coalesce(product, '')) AS p, substr(lower(regexp_replace(raw_line, ' x.*$', '')), 1, 50) AS l FROM r),
      f AS (SELECT image, p, l, min(section_pos) AS section_pos FROM k GROUP BY ALL) SELECT image, count(*) AS kept, CAST(sum(section_pos) AS BIGINT) AS sections FROM f GROUP BY 1""",
    "containment_join": f"WITH l AS (SELECT p_partkey AS image, {plain(chr(39) + '2 x ' + chr(39) + ' || p_name || ' + chr(39) + '!' + chr(39))} AS line FROM part), n AS (SELECT DISTINCT p_name FROM part) SELECT DISTINCT image, p_name AS name FROM l JOIN n ON contains(line, p_name) OR contains(p_name, line)",
    "customer_detected": "SELECT c_custkey AS image, c_acctbal >= 0 AS detected FROM customer",
    "precision_recall": """WITH r AS (SELECT lang, n_chars > 1500 AS f, quality = 1 AS t FROM labels JOIN documents USING (doc_id)), s AS (SELECT lang, count(*) FILTER (t) AS gt_count, count(*) FILTER (f) AS detected_count, count(*) FILTER (f AND t) AS b FROM r WHERE f OR t GROUP BY 1)
      SELECT lang, gt_count, detected_count, round_even(CAST(b AS DOUBLE) / greatest(detected_count, 1), 4) AS precision, round_even(CAST(b AS DOUBLE) / greatest(gt_count, 1), 4) AS recall FROM s""",
    "metric_averages": "SELECT event_type, round_even(avg((event_id % 200) / 100.0::DOUBLE), 4) AS avg_cer, round_even(avg((user_id % 300) / 100.0::DOUBLE), 4) AS avg_wer, round_even(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 4) AS date_accuracy FROM events GROUP BY 1",
    "method_ranking": f"WITH {METHODS}, a AS (SELECT method, avg(confidence) AS c, avg(regions) AS r, avg(seconds) AS s, count(*) AS images FROM m GROUP BY 1) SELECT method, CAST(row_number() OVER (ORDER BY c DESC, method) AS INT) AS rank, images, round_even(c, 6) AS confidence, round_even(r, 6) AS regions, round_even(s, 6) AS seconds FROM a",
    "method_verdict": f"WITH {METHODS}, a AS (SELECT method, avg(confidence) AS c FROM m GROUP BY 1), b AS (SELECT arg_max(method, c) AS best, max(c) AS top, max(c) FILTER (method = 'view') AS own FROM a) SELECT best, own >= top AS plain_is_best, round_even((top - own) / own * 100, 4) AS improvement_percent FROM b",
    "batch_summary": "SELECT count(*) AS images, count(*) FILTER (event_type <> 'error') AS succeeded, CAST(sum(event_id % 30) AS BIGINT) AS total_items, round_even(avg((event_id % 8) / 2.0::DOUBLE) FILTER (event_type <> 'error'), 4) AS avg_seconds FROM events",
    "first_success": f"""WITH t AS (SELECT image, k AS attempt, event_type, event_id % 4 AS n FROM ({CASCADES})),
      g AS (SELECT image, min(attempt) FILTER (event_type <> 'error' AND n > 0) AS hit, max(attempt) AS tried FROM t GROUP BY 1)
      SELECT g.image, coalesce(hit, tried) AS attempt, CASE WHEN hit IS NOT NULL THEN event_type END AS model, CASE WHEN hit IS NOT NULL THEN n ELSE 0 END AS total_items, hit IS NULL AS failed FROM g LEFT JOIN t ON t.image = g.image AND t.attempt = hit""",
    "best_configuration": f"""WITH e AS (SELECT image, k AS cfg_pos, (event_id % 31) / 100.0::DOUBLE AS confidence, event_id % 23 AS n FROM ({CASCADES})),
      t AS (SELECT *, min(cfg_pos) FILTER (n >= 15 AND confidence >= 0.20) OVER (PARTITION BY image) AS stop FROM e), u AS (SELECT *, count(*) OVER (PARTITION BY image) AS tried FROM t WHERE stop IS NULL OR cfg_pos <= stop)
      SELECT image, cfg_pos, confidence, tried FROM u QUALIFY row_number() OVER (PARTITION BY image ORDER BY confidence DESC, cfg_pos) = 1""",
    "vision_json_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN value / 100 > 0.3 THEN 'ok' ELSE 'uncertain' END AS status FROM events",
    "section_flatten": f"""WITH r AS ({SECTION_ITEMS}), s AS (SELECT *, dense_rank() OVER (PARTITION BY image ORDER BY section_pos) - 1 AS sp, row_number() OVER (PARTITION BY image, section_pos ORDER BY item_pos) - 1 AS ip FROM r)
      SELECT image, CAST(sp AS INT) AS section_pos, CAST(ip AS INT) AS item_pos, customer, product, raw_line, quantity FROM s""",
    "audit_projection": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, ['phase1_ocr', 'phase2_interpretation', 'phase3_product_matching', 'phase4_customer_matching', 'phase5_draft', 'phase6_user_action', 'phase9_api'][event_id % 7 + 1] AS phase,
        '{"text":' || CAST(to_json(substr(props, 1, 50)) AS VARCHAR) || '}' AS data, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS written FROM events)
      SELECT trace_id, phase, count(*) AS n, min(data) AS first_data, max(written) AS last_at FROM e GROUP BY ALL""",
    "audit_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
      s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT user_id, min(ts) AS started, count(*) AS entries FROM s GROUP BY user_id, n""",
    "symbol_tagging": f"""WITH r AS ({REGIONS}) SELECT scan_id, pos, array_to_string(list_filter([CASE WHEN length(text) <= 3 AND regexp_matches(text, '[@=×x+★→]') THEN text END, CASE WHEN regexp_matches(lower(text), 'rp|k|rb|ribu') THEN text END], lambda x: x IS NOT NULL), ',') AS symbols FROM r""",
    "truth_join": "SELECT d.doc_id AS image, lang, quality, CASE WHEN l.doc_id IS NULL THEN 'No ground truth available for this image' END AS note FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "sure_sample": f"WITH r AS ({REGIONS}), k AS (SELECT scan_id, list(trim(text) ORDER BY pos) FILTER (confidence > 0.5 AND length(trim(text)) > 0) AS t FROM r GROUP BY 1) SELECT scan_id, array_to_string(coalesce(t[1:15], []), '|') AS sample FROM k",
    "export_summary": f"WITH {EXPORTED} SELECT count(DISTINCT (image, section_pos)) AS transactions, count(*) AS items, CAST(sum(qty * price) AS BIGINT) AS total_amount FROM priced",
    "method_counts": f"WITH r AS ({REGIONS}) SELECT scan_id AS image, CASE WHEN circled THEN 'circled' ELSE 'plain' END AS method, count(*) FILTER (confidence > 0.35) AS sure, round_even(avg(confidence), 6) AS mean_confidence, count(*) FILTER (length(trim(text)) > 0) AS non_blank FROM r GROUP BY ALL",
    "candidate_acceptance": f"""WITH RECURSIVE {PAIRS}, {scores('SELECT text FROM texts', PRODUCTS)},
      b AS (SELECT text, p_partkey, round_even(score, 4) AS score FROM scored JOIN part ON p_name = name WHERE scored.score >= 0.3 QUALIFY row_number() OVER (PARTITION BY text ORDER BY round_even(scored.score, 4) DESC, p_partkey) = 1)
      SELECT text, CASE WHEN score >= 0.85 THEN p_partkey END AS product_id, CASE WHEN score < 0.85 THEN 'low_confidence_product_match' END AS flag FROM b""",
    "seqmatch_ratio": f"WITH RECURSIVE {PAIRS}, {ratio_of('SELECT text AS a, cand AS b FROM pairs', 'seq')} SELECT a AS text, b AS cand, ratio FROM seq",
    "rank_products_full": ranked("SELECT text FROM texts"),
    "match_corrections": f"{BEST} SELECT 'product' AS type, text AS original, name AS matched, score AS confidence, method FROM b WHERE method <> 'exact'",
    "fallback_candidates": f"""WITH RECURSIVE {PAIRS}, {fallback('SELECT text FROM texts')}
      SELECT text, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, product_id) AS INT) AS rank, product_id, name, score FROM r QUALIFY rank <= 5""",
    "product_candidates": f"""WITH RECURSIVE {PAIRS}, asked AS (SELECT text FROM texts UNION SELECT 'zq' || p_partkey || ' 99887766554433221100 ' || substr(p_name, 1, 2) FROM part), {scores('SELECT text FROM asked', PRODUCTS)},
      first_rule AS (SELECT text, p_partkey AS product_id, name, round_even(score, 4) AS score, method FROM scored JOIN part ON p_name = name WHERE score >= 0.3),
      {fallback('SELECT text FROM asked WHERE text NOT IN (SELECT text FROM first_rule)')}
      SELECT text, CAST(row_number() OVER (PARTITION BY text ORDER BY score DESC, product_id) AS INT) AS rank, product_id, name, score, method
      FROM (SELECT * FROM first_rule UNION ALL SELECT text, product_id, name, score, NULL FROM r) QUALIFY rank <= 5""",
    "fuzzy_match": f"WITH RECURSIVE {PAIRS}, {fuzzy('SELECT text FROM texts', 0.6)} SELECT text, name, score FROM m",
    "corrected_names": f"WITH {PAIRS} SELECT * FROM {corrected(False)} UNION ALL SELECT * FROM {corrected(True)}",
    "evaluated_match": f"""WITH RECURSIVE {PAIRS}, o AS (SELECT text, cand AS name, {plain('text')} AS t, {plain('cand')} AS n FROM pairs), {ratio_of("SELECT t AS a, n AS b FROM o", "seq")}, {FIRST},
      m AS (SELECT text, name, CASE WHEN contains(t, n) AND ratio > 0.3 THEN greatest(ratio, 0.85) ELSE ratio END AS score, pos FROM o JOIN seq ON a = t AND b = n JOIN f ON p_name = name QUALIFY row_number() OVER (PARTITION BY text ORDER BY score DESC, pos) = 1)
      SELECT text, CASE WHEN score > 0.6 THEN name END AS name FROM m""",
    "detected_lines": f"WITH r AS ({REGIONS}) SELECT scan_id, pos, trim(text) AS text, round_even(confidence, 4) AS confidence FROM r WHERE length(trim(text)) > 0 AND confidence > 0.1",
    "known_customers": "SELECT c_custkey, c_name AS customer FROM customer WHERE c_custkey % 4 = 2",
    "line_quantities": rf"""WITH {WRITTEN_AMOUNTS}, t AS (SELECT l_orderkey, pos, CASE k WHEN 0 THEN q || 'rb' WHEN 1 THEN 'Rp' || q || '.' || lpad(CAST(p % 1000 AS VARCHAR), 3, '0') WHEN 2 THEN q || ',5 ribu' WHEN 3 THEN q || 'x kopi ' || (p + 500)
        WHEN 4 THEN 'x' || q || ' teh (' || (q + 1) || ')' WHEN 5 THEN (p * 3) || 'k' ELSE 'gratis' END || ' x12 7x es(3) (4) 250x' AS t FROM w),
      q AS (SELECT *, list_transform(list_filter(regexp_extract_all(t, {QUANTITY}, 1) || regexp_extract_all(t, {QUANTITY}, 2) || regexp_extract_all(t, {QUANTITY}, 3), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)) AS found FROM t)
      SELECT l_orderkey, pos, array_to_string(list_sort(list_distinct(list_filter(found, lambda x: x < 100))), ',') AS quantities FROM q""",
    "image_summary": "SELECT count(*) AS images, count(*) FILTER (event_type <> 'error') AS succeeded, CAST(sum(event_id % 30) FILTER (event_type <> 'error') AS BIGINT) AS total_items, round_even(avg((event_id % 97) / 100.0::DOUBLE), 3) AS avg_confidence FROM events",
    "item_totals": f"""WITH r AS ({SECTION_ITEMS}), k AS (SELECT image, lower(trim(coalesce(product, ''))) AS p, lower(trim(split_part(raw_line, ' x', 1))) AS l FROM r)
      SELECT image, count(*) AS before, count(DISTINCT (p, l)) AS after, false AS failed FROM k GROUP BY 1 UNION ALL SELECT -1 - o_orderkey, 0, 0, true FROM orders WHERE o_orderkey % 5 = 0""",
    "change_customer": f"""WITH e AS (SELECT l_orderkey, arg_max(l_suppkey, pos) AS s FROM (SELECT *, {POS} AS pos FROM lineitem) WHERE l_partkey % 3 = 0 GROUP BY 1)
      SELECT o_orderkey AS draft_id, coalesce(s, o_custkey) AS customer_id, coalesce('chosen ' || s, o_orderpriority) AS customer_name FROM orders LEFT JOIN e ON l_orderkey = o_orderkey""",
    "vision_reply": """SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) AND event_id % 8 > 3 THEN 'ok' ELSE 'uncertain' END AS status,
      CAST(CASE event_id % 5 WHEN 0 THEN (event_id % 8) / 10.0 WHEN 1 THEN (event_id % 8) / 10.0 WHEN 3 THEN 0.0 ELSE 0.3 END AS DOUBLE) AS confidence,
      CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN 'I see ' || event_type WHEN 3 THEN '' ELSE '{broken' END AS raw_text FROM events""",
}

ORACLES["create_drafts"] = f"""WITH RECURSIVE regions AS ({REGIONS}), {INTERPRETED},
      u AS (SELECT scan_id, string_agg('Line ' || line_idx || ': ''' || substr(line_text, 1, 30) || '...'' — unrecognized content', ';' ORDER BY line_idx) AS told FROM f WHERE fate = 'uncertain' GROUP BY 1)
      SELECT p.scan_id AS draft_id, date, CASE WHEN customer IS NOT NULL AND p.scan_id % 3 = 0 THEN p.scan_id END AS customer_id,
        CASE WHEN customer IS NULL THEN '' ELSE customer || CASE WHEN p.scan_id % 3 <> 0 AND p.scan_id % 2 = 0 AND p.scan_id % 10 < 7 THEN ' (belum dipastikan)' ELSE '' END END AS customer_name,
        total_confidence, n_items, coalesce(told, '') AS uncertain FROM ({ORACLES["page_interpretation"]}) p LEFT JOIN u ON u.scan_id = p.scan_id
      UNION ALL SELECT id, NULL, NULL, '', 0.0, 0, 'No regions to interpret' FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT -1 - o_orderkey FROM orders WHERE o_orderkey % 7 = 0) WHERE id NOT IN (SELECT scan_id FROM regions)"""
