"""Bound-certified best-fit packing of token pieces into sequences.

Documents become pieces of at most ``capacity`` tokens; a longer one is cut so that only its first piece may be shorter. Whole
pieces are sequences of their own. The rest is dealt into partitions by a hash, each packed by best-fit decreasing and held
against a lower bound from dual feasible functions (Martello-Toth thresholds and the Fekete-Schepers staircase). Where all
partitions together need more sequences than the bound over all lengths (one count per length, so at most ``capacity`` numbers),
the partitions with gaps exchange what is in their unfilled sequences: it is dealt anew, into fewer partitions, and packed again; the
new packing is taken where it needs fewer sequences. Rounds end at the bound or when an exchange gains nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpoint, frame, parts_for, small_batches, text_or_empty

CAPACITY, END_ID = 1024, 2
ITEMS_PER_PART, ROUNDS = 20_000, 6
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def _byte_values() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids of the byte-level BPE vocabulary at path, as Tokenizer.encode(text, add_special_tokens=False) gives them: the
    string of a special token in a text is that token.

    The ranks come from the vocabulary file and are applied by tiktoken, which gives the same ids several times faster than
    tokenizers (a test compares them); a text it can't take goes to tokenizers itself.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        value = _byte_values()
        special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        ranks = {bytes(value[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        slow: list[Tokenizer] = []

        def encode(text: str) -> np.ndarray:
            try:
                ids = fast.encode(text, allowed_special="all") if any(x in text for x in special) else fast.encode_ordinary(text)
                return np.asarray(ids, "<u4")
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # the native code's panics are no Exceptions
                if not slow:
                    slow.append(Tokenizer.from_file(path))
                return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of one document's ids."""
    start, n = 0, len(ids)
    stop = n if n <= capacity else n % capacity or capacity
    piece = 0
    while start < n:
        yield piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())
        piece, start, stop = piece + 1, stop, stop + capacity


def token_pieces(docs: DataFrame, path: str | None, capacity: int = CAPACITY) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path or vocabulary_path()), np.array([END_ID], "<u4")
        for rows in batches:
            yield frame([(doc, *p) for doc, text in zip(rows["doc"], rows["text"], strict=True) for p in pieces_of(np.concatenate([encode(text), end]), capacity)], PIECES)

    # The id as text: a null among long ids would turn them into doubles in pandas.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc"), text_or_empty().alias("text"))
    return rows.mapInPandas(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin has left. Bins by their gap: a bit set tells which gaps exist."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    there = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = there >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                there ^= 1 << gap
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap = gap - n
        if gap:
            by_gap[gap].append(b)
            there |= 1 << gap
    return bins, offsets, np.asarray(gaps, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[n] items have length n, for n up to capacity. The best of the dual feasible functions."""
    n = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * n).sum()) // capacity)
    many, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * n)])
    for t in range(1, capacity // 2 + 1):  # over capacity - t: a bin; from t on: as long as it is; under t: nothing
        large = int(many[-1] - many[capacity - t + 1])
        best = max(best, large + -(-int(total[capacity - t + 1] - total[t]) // capacity))
    for k in range(1, 101):  # the staircase: (k + 1) n / capacity rounded down, over k, but exact where it is whole
        steps, rest = np.divmod((k + 1) * n, capacity)
        best = max(best, -(-int((counts * np.where(rest == 0, steps * k, steps * (k + 1))).sum()) // (k * (k + 1))))
    return best


def _packed(items: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """items (uid, length) with part, bin, offset, gap of the bin, and whether the part's bin count meets its own bound."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid")
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, gaps = best_fit_decreasing(lengths, capacity)
        sure = len(gaps) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return pd.DataFrame({"uid": rows["uid"], "length": lengths, "turn": turn, "part": key[0], "bin": bins, "offset": offsets, "gap": gaps[bins], "certified": sure})

    dealt = items.select("uid", "length", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(pack, "uid long, length long, turn int, part long, bin long, offset long, gap long, certified boolean")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, per_part: int = ITEMS_PER_PART, rounds: int = ROUNDS) -> DataFrame:
    """Pack docs (doc_id, text; more columns are ignored) into few sequences of at most capacity tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified (its partition's count is proven
    least). Null or empty text: one piece, the end id. Null doc_id: packed like any other. Repeated rows: each is packed. Very long
    texts: as many pieces as they need. An empty table gives an empty result. The vocabulary file must be at path on each executor.
    """
    small_batches(docs.sparkSession)
    pieces = checkpoint(token_pieces(docs, path, capacity)).withColumn("uid", F.monotonically_increasing_id())
    items = pieces.where(F.col("length") < capacity).select("uid", "length")
    counts = np.zeros(capacity + 1, np.int64)
    for n, many in items.groupBy("length").count().collect():  # one row a length: at most capacity rows
        counts[n] = many
    bound, left = lower_bound(counts, capacity), int(counts.sum())
    bins = lambda df: df.select("part", "bin").distinct().count()
    open_, settled = checkpoint(_packed(items, parts_for(left, per_part), 0, capacity)), []
    used = bins(open_)
    for turn in range(1, rounds + 1):
        if used <= bound:
            break
        pool = open_.where("gap > 0")
        parts = parts_for(pool.count(), 4 * per_part)  # fewer and larger than before
        again = checkpoint(_packed(pool, parts, turn, capacity))
        saved = bins(pool) - bins(again)
        if saved <= 0:
            break
        used -= saved
        settled.append(open_.where("gap = 0"))
        open_ = again
    for done in settled:
        open_ = open_.unionByName(done)
    # The fewest bits that hold part and bin: rounds in the top bits, then the part, then the bin.
    number = F.shiftleft((F.col("turn") + 1).cast("long"), 56) + F.shiftleft("part", 24) + F.col("bin")
    placed = open_.select("uid", number.alias("sequence_id"), "offset", "certified")
    whole = pieces.where(F.col("length") == capacity).select(*[f.split(" ")[0] for f in PIECES.split(", ")], F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = pieces.where(F.col("length") < capacity).join(placed, "uid")
    return rest.select(*whole.columns).unionByName(whole)
