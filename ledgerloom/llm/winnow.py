"""Document fingerprints by winnowing.

The rolling hash of each k-gram of code points is a polynomial of its code points (mod 2**64), built by doubling: the hash of 2m
code points is that of the first m times base**m plus that of the last m. k - 1 marks that are no code point stand before each text, so
that each of its code points ends a gram. From each window of w hashes the smallest is kept, the rightmost of equal ones, with its
position. One k and w hold for texts of all lengths. So any match of at least w + k - 1 code points shares a fingerprint, and so does any
match of w code points at both texts' starts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import frame, parts_for, small_batches, text_or_empty

K, WINDOW = 12, 16
#: Documents of a range that one task walks, the most cuts by quantiles of ids (what is between two cuts is divided on, evenly), and
#: the most ranges: more documents than DOCS_PER_RANGE times that make larger ranges.
DOCS_PER_RANGE, CUTS, MOST_RANGES = 1_000, 4_096, 1 << 20
#: Stands before a text.
MARK = 0x110000
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of the k-grams of code points, one that ends at each; an empty text gives none."""
    if not len(points):
        return np.empty(0, np.uint64)
    points = np.concatenate([np.full(k - 1, MARK, np.uint64), points.astype(np.uint64)])
    have, done, base = points, 1, _BASE
    made, length = None, 0  # the hash of the first `length` code points of each gram
    width = k
    while True:
        if width & 1:
            if made is None:
                made, length = have, done
            else:
                n = min(len(made) - done, len(have))
                made = have[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + made[done : done + n]
                length += done
        width >>= 1
        if not width:
            break
        have = have[:-done] * np.uint64(base) + have[done:]
        done, base = 2 * done, base * base % (1 << 64)
    made = made[: len(points) - k + 1]
    made = (made ^ (made >> np.uint64(32))) * _MIX
    return made >> np.uint64(32)


def winnow(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that winnowing keeps."""
    n = len(hashes)
    if not n:
        return hashes, np.empty(0, np.int64)
    top = np.uint64(0xFFFFFFFF)
    least = (hashes << np.uint64(32)) | (top - np.arange(n, dtype=np.uint64))  # of equal hashes the rightmost is smallest
    w, width, done = min(window, n), min(window, n), 1
    # Minima of w neighbours: double the span, then let two spans overlap.
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < w:
        least = np.minimum(least[: len(least) - (w - done)], least[w - done :])
    kept = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return kept >> np.uint64(32), (top - (kept & top)).astype(np.int64)


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[str, np.ndarray]:
    """The fingerprint as text (base64 of all hashes as 32-bit numbers, then all positions' steps), and its distinct hashes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    hashes, at = winnow(gram_hashes(points, k), window)
    raw = hashes.astype("<u4").tobytes() + np.diff(at, prepend=0).astype("u1" if window < 256 else "<u4").tobytes()
    return base64.b64encode(raw).decode(), np.unique(hashes)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _lookup(values: list[int], at: Column) -> Column:
    return F.get(F.from_json(F.lit(str(values)), "array<bigint>"), at.cast("int"))


def _cut_by(cuts: list[int], of: Column) -> Column:
    """How many of the sorted cuts are at or below the value: binary search, from the largest step down."""
    if not cuts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (_lookup(cuts, at + step - 1) <= of), at + step).otherwise(at))


def spans_of(rows: DataFrame, per_range: int = DOCS_PER_RANGE) -> Column:
    """The range of each row (doc, mix), counted from 0 in order of ids and then, where ids are null, of mix.

    Ids are cut at quantiles; what lies between two cuts is divided evenly into as many ranges as its count asks for, and so are the
    rows without an id by their hash. The counts between cuts, at most CUTS rows, are all that the driver sees.
    """
    count = rows.count()
    per_range = max(per_range, -(-count // MOST_RANGES))
    known = rows.where("doc is not null")
    tops = min(parts_for(count, per_range), CUTS)
    cuts = sorted({int(x) for x in known.approxQuantile("doc", [i / tops for i in range(1, tops)], 0.25 / tops)}) if tops > 1 else []
    top = F.when(F.col("doc").isNull(), F.lit(len(cuts) + 1)).otherwise(_cut_by(cuts, F.col("doc")))
    told = {r["top"]: r for r in rows.groupBy(top.alias("top")).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).collect()}
    before, lows, steps, many, at = [], [], [], [], 0
    for k in range(len(cuts) + 2):
        r = told.get(k)
        low, high = (r["low"], r["high"]) if r and r["low"] is not None else (-(1 << 63), (1 << 63) - 1)
        parts = max(1, min(parts_for(r["n"], per_range), high - low + 1)) if r else 1
        before.append(at)
        lows.append(low)
        steps.append(-(-(high - low + 1) // parts))
        many.append(parts)
        at += parts
    value = F.coalesce("doc", "mix").cast("decimal(38,0)")
    inner = F.floor((value - _lookup(lows, top)) / F.greatest(F.lit(1), _wide(steps, top)))
    return (_lookup(before, top) + F.least(inner, _lookup(many, top) - 1)).cast("int")


def _wide(values: list[int], at: Column) -> Column:
    """As _lookup, of values that may pass a long."""
    return F.get(F.from_json(F.lit(str(values)), "array<decimal(38,0)>"), at.cast("int"))


def in_ranges(docs: DataFrame, per_range: int = DOCS_PER_RANGE) -> DataFrame:
    """(span, tail, doc, text), dealt and sorted so that the rows of a span follow each other by id, those of one id (null: after all
    others) by a hash of the text and the text.

    The last rows of a span, those with tail 1, are copies of the first rows of the next one (after the last: of the first).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text")).withColumn("mix", F.xxhash64("text"))
    span = spans_of(rows.select("doc", "mix"), per_range)
    rows = rows.withColumn("span", span)
    # The first row of each span: one small row a span, to join with.
    firsts = rows.groupBy("span").agg(F.min(F.struct(F.coalesce("doc", "mix").alias("first"), "mix")).alias("f")).select("span", "f.*").collect()
    firsts = sorted((r["span"], r["first"], r["mix"]) for r in firsts)
    ends = [(firsts[i - 1][0], own, first, mix) for i, (own, first, mix) in enumerate(firsts)]
    ends = docs.sparkSession.createDataFrame(ends, "to int, span int, first long, mix long")
    tails = rows.join(F.broadcast(ends), ["span", "mix"]).where(F.coalesce("doc", "mix") == F.col("first")).select("doc", "text", "mix", F.col("to").alias("span"), F.lit(1).alias("tail"))
    both = rows.withColumn("tail", F.lit(0)).unionByName(tails)
    return both.repartition("span").sortWithinPartitions("span", "tail", F.col("doc").asc_nulls_last(), "mix", "text").select("span", "tail", "doc", "text")


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by the first code points, as many, of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprint each row of docs (doc_id, text; more columns are ignored), its edited text, and their likeness.

    Null text: empty, with an empty fingerprint; two empty fingerprints are alike (1), an empty one and another not at all (0). Null
    doc_id: after all others. Repeated rows and equal ids: each row counts, in order of a hash of their texts, and the rows of one
    id go to one task. One row is its own next. Very long texts are fingerprinted whole. An empty table gives an empty result.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row before: span, doc, text, its fingerprint
        for rows in batches:
            out = []
            for span, tail, doc, text in zip(rows["span"].tolist(), rows["tail"].tolist(), rows["doc"], rows["text"], strict=True):
                own = None
                if held and held[0] == span:
                    own = fingerprint(text, k, window)
                    _, prior, before, (mark, hashes) = held
                    changed = edited(before, text)
                    other, others = fingerprint(changed, k, window)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((prior, len(before), digest, mark, other, likeness(hashes, others), likeness(hashes, own[1])))
                held = None if tail else (span, doc, text, own or fingerprint(text, k, window))
            yield frame(out, RESULT)

    small_batches(docs.sparkSession)
    rows = in_ranges(docs).withColumn("doc", F.col("doc").cast("string"))
    return rows.mapInPandas(walk, RESULT)
