"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space is squeezed. A test item, or each of the overlapping segments of a
longer one, long ones and short ones at a fine step for excerpts, is cut into error-budget-plus-one pieces; a passage within the
budget of edits holds one piece unchanged. An Aho-Corasick automaton finds all piece hits in a text, and Myers' bit-parallel edit
distance verifies around each.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpoint, frame, parts_for, small_batches

#: Characters of a segment, how far the next one starts, and the characters for which one edit is allowed.
SEGMENT, STEP, CHARS_PER_EDIT = 96, 48, 14
#: Characters of the shorter segments that stand for excerpts, how far the next one starts, and the edits allowed in one. Any excerpt
#: of EXCERPT + EXCERPT_STEP - 1 characters holds one whole. What must be verbatim is found by so many of its first characters.
EXCERPT, EXCERPT_STEP, EXCERPT_ERRORS, OPENING = 48, 12, 0, 24
#: Characters of the segments that go to every task at once: a worker holds about 40 bytes for each of them. A larger benchmark goes in
#: blocks, one after the other.
BLOCK_CHARS = 4 << 20
_SPACE = re.compile(r"[\x20\t-\r]+")

HITS = "doc_id long, item_id long, text_key long, segment int, start long, stop long, distance int"
PARTS = "item long, text_key long, segment int, part string, errors int"


def normal(text: str | None) -> str:
    """Lower-cased text with its ASCII white space squeezed and none at its ends."""
    return _SPACE.sub(" ", (text or "").lower()).strip(" ")


def segments(text: str, size: int = SEGMENT, step: int = STEP) -> list[str]:
    """The text, or the overlapping segments of a longer one; the last ends with it."""
    if len(text) <= size + step // 2:
        return [text] if text else []
    starts = list(range(0, len(text) - size, step))
    return [text[s : s + size] for s in starts] + [text[-size:]]


def excerpts(text: str, size: int = EXCERPT, step: int = EXCERPT_STEP) -> list[str]:
    """Short segments at a fine step of a text that an excerpt can be cut from; none of a shorter one, which counts as a whole."""
    return segments(text, size, step) if len(text) >= size + step - 1 else []


def budget(length: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return length // chars_per_edit


def pieces(segment: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal lengths."""
    cuts = [len(segment) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, segment[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """A segment with the bit masks of Myers' algorithm, made when first needed."""

    __slots__ = ("text", "errors", "_masks", "_back")

    def __init__(self, text: str, errors: int | None = None) -> None:
        self.text, self.errors = text, budget(len(text)) if errors is None else errors
        self._masks: dict[str, int] | None = None
        self._back: Pattern | None = None

    @property
    def masks(self) -> dict[str, int]:
        if self._masks is None:
            out: dict[str, int] = defaultdict(int)
            for i, c in enumerate(self.text):
                out[c] |= 1 << i
            self._masks = dict(out)
        return self._masks

    @property
    def backwards(self) -> Pattern:
        if self._back is None:
            self._back = Pattern(self.text[::-1], self.errors)
        return self._back

    def best_in(self, window: str) -> tuple[int, int]:
        """(distance, end) of the substring of window nearest to the text, the first such end."""
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, distance = full, 0, m
        best, end, masks = m, 0, self.masks
        for j, c in enumerate(window):
            eq = masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | ~(xh | plus) & full
            mh = plus & xh
            if ph & top:
                distance += 1
            elif mh & top:
                distance -= 1
            ph = (ph << 1) & full
            plus = (mh << 1 | ~(xv | ph)) & full
            minus = ph & xv
            if distance < best:
                best, end = distance, j + 1
        return best, end


class Matcher:
    """Segments of a benchmark: (item, segment number, text, and the edits allowed where it has a budget of its own)."""

    def __init__(self, parts: Iterable[tuple]) -> None:
        import ahocorasick

        self.parts = [(item, k, Pattern(text, *errors)) for item, k, text, *errors in parts]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, _, p) in enumerate(self.parts):
            for offset, piece in pieces(p.text, p.errors) if p.errors else [(0, p.text[:OPENING])]:
                where[piece].append((n, offset))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple]:
        """(item, segment, start, stop, distance) of passages of the normalised text within each segment's budget: for each
        segment, one in each stretch of the text where piece hits place it."""
        if not self.parts:
            return []
        stretches: dict[int, list[list[int]]] = {}
        for at, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                p = self.parts[n][2]
                begin = at - length + 1 - offset
                low, high = max(0, begin - p.errors), min(len(text), begin + len(p.text) + p.errors)
                held = stretches.setdefault(n, [])
                # Hits that place the segment at the same spot, give or take the budget, share one window.
                if held and low <= held[-1][0] + 2 * p.errors + 1 and low >= held[-1][0] - p.errors:
                    held[-1][1] = max(held[-1][1], high)
                else:
                    held.append([low, high])
        out = []
        for n, windows in stretches.items():
            item, k, p = self.parts[n]
            for low, high in windows:
                distance, end = p.best_in(text[low:high])
                if distance <= p.errors:
                    # The start: the same search backwards from the end.
                    _, back = p.backwards.best_in(text[low : low + end][::-1])
                    out.append((item, k, low + end - back, low + end, distance))
        return out


def benchmark_parts(benchmark: DataFrame) -> DataFrame:
    """PARTS: the segments of each distinct normalised text of an item; text_key tells an item's texts apart."""

    def normalised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(text=[normal(t) for t in rows["text"]])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for item, key, text in zip(rows["item"].tolist(), rows["text_key"].tolist(), rows["text"], strict=True):
                every = [(s, budget(len(s))) for s in segments(text)] + [(s, EXCERPT_ERRORS) for s in excerpts(text)]
                out += [(item, key, k, s, errors) for k, (s, errors) in enumerate(every)]
            yield frame(out, PARTS)

    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    rows = rows.mapInPandas(normalised, "item long, text string").distinct()
    return rows.select("item", F.xxhash64("text").alias("text_key"), "text").mapInPandas(cut, PARTS)


def matchers(benchmark: DataFrame, block_chars: int | None = None) -> Iterator[Callable[[], Matcher]]:
    """A matcher for each block of the benchmark's segments, built once in each worker from the segments that are broadcast. The driver
    holds one block at a time."""
    sc, parts = benchmark.sparkSession.sparkContext, checkpoint(benchmark_parts(benchmark))
    blocks = parts_for(parts.agg(F.coalesce(F.sum(F.length("part")), F.lit(0))).first()[0], block_chars or BLOCK_CHARS)
    block = F.pmod(F.xxhash64("item", "text_key", "segment"), F.lit(blocks))
    for b in range(blocks):
        rows = sorted(tuple(r) for r in parts.where(block == b).collect())
        shared = sc.broadcast(pickle.dumps([((item, key), k, part, errors) for item, key, k, part, errors in rows]))
        yield _built_once(shared)


def _built_once(shared: Broadcast) -> Callable[[], Matcher]:
    made: list[Matcher] = []

    def get() -> Matcher:
        if not made:
            made.append(Matcher(pickle.loads(shared.value)))
        return made[0]

    return get


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_chars: int | None = None) -> DataFrame:
    """Passages of docs (doc_id, text) within the edit budget (one edit for CHARS_PER_EDIT characters) of benchmark items
    (item_id, text) or of segments of longer items: any excerpt of EXCERPT + EXCERPT_STEP - 1 (59) characters holds a short
    segment, which must be verbatim. More columns are ignored.

    Returns doc_id, item_id, text_key (of the item's text), segment (of that text), start and stop (in the normalised text), distance;
    a row for each match. Null or empty texts and items: no match. Null item_id: ignored. Several texts of one item_id: each is searched
    for; repeated ones count once. Null doc_id and repeated rows: matched like any other. Very long texts are searched whole. A
    benchmark of more than block_chars characters is searched for block by block. Empty tables give an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc"), F.col("text").cast("string").alias("text"))

    def searched(matcher: Callable[[], Matcher]) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = matcher().find
            for rows in batches:
                yield frame([(doc, *item, *hit) for doc, text in zip(rows["doc"], rows["text"], strict=True) for item, *hit in find(normal(text))], HITS)

        return rows.mapInPandas(search, HITS)

    return reduce(DataFrame.unionByName, map(searched, matchers(benchmark, block_chars)))


def clean_documents(docs: DataFrame, benchmark: DataFrame, block_chars: int | None = None) -> DataFrame:
    """The rows of docs without a match (see find_leaks), as they are. Between the blocks of a large benchmark what is left is written."""
    small_batches(docs.sparkSession)
    kept = docs
    for n, matcher in enumerate(matchers(benchmark, block_chars)):
        kept = (checkpoint(kept) if n else kept).where(~_leaks(matcher)(F.col("text").cast("string")))
    return kept


def _leaks(matcher: Callable[[], Matcher]) -> Callable:
    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = matcher().find
        for texts in batches:
            yield pd.Series([bool(find(normal(t))) for t in texts])

    return leaks
