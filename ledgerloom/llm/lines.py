"""Line dedup over sharded minimal perfect hashes.

Keys (normalised lines) that at least two documents hold are hashed to 128 bits. Each shard of those hashes becomes one row:
a minimal perfect hash (levels of bit arrays; a key sits at the first level where it is alone) that indexes three arrays, the
fingerprints, the counts and the first documents. Documents send (hash, document, line number) to the shard and probe its
arrays; lines are never joined to lines. Keys with a large share of all lines are answered from a broadcast list instead;
by the pigeonhole rule that list has at most HOT_KEYS entries at any input size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import HOT_KEYS, SPACES, checkpoint, lower_ascii, parts_for, text_or_empty

MIN_CHARS = 10
KEYS_PER_SHARD = 25_000
LINES_PER_SHARD = 60_000
#: Bits of a level for each key that is left.
ROOM = 2.0
_A, _B, _C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)

ARRAYS = "shard long, keys long, sizes array<long>, bits array<binary>, fingerprints binary, counts binary, firsts binary"
HITS = "doc long, tid long, pos int, first long, n long"


def _slots(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = k1 + (k2 | np.uint64(1)) * (np.uint64(level) * _C + np.uint64(1))
        x ^= x >> np.uint64(33)
        x *= _A
        x ^= x >> np.uint64(29)
        x *= _B
        x ^= x >> np.uint64(32)
    return (x % np.uint64(size)).astype(np.int64)


def build_hash(k1: np.ndarray, k2: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Level sizes and bit arrays of a minimal perfect hash over distinct (k1, k2) pairs."""
    sizes, bits, level = [], [], 0
    while len(k1):
        size = max(64, int(ROOM * len(k1)))
        at = _slots(k1, k2, level, size)
        held = np.bincount(at, minlength=size)
        sizes.append(size)
        bits.append(np.packbits(held == 1).tobytes())
        left = held[at] > 1
        k1, k2, level = k1[left], k2[left], level + 1
    return sizes, bits


def find(k1: np.ndarray, k2: np.ndarray, sizes: list[int], bits: list[bytes]) -> np.ndarray:
    """Index of each pair in the arrays, from 0; -1 where no level has its bit. A pair outside the set may get any index."""
    out = np.full(len(k1), -1, np.int64)
    left, before = np.arange(len(k1)), 0
    for level, (size, raw) in enumerate(zip(sizes, bits, strict=True)):
        on = np.unpackbits(np.frombuffer(raw, np.uint8), count=size)
        rank = np.cumsum(on, dtype=np.int64) - 1 + before
        at = _slots(k1[left], k2[left], level, size)
        here = on[at] == 1
        out[left[here]] = rank[at[here]]
        left, before = left[~here], before + int(on.sum())
    return out


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    k1, k2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("k1", "k2"))
    sizes, bits = build_hash(k1, k2)
    at = find(k1, k2, sizes, bits)
    prints, counts, firsts = np.empty(len(k1), np.uint64), np.empty(len(k1), np.int64), np.empty(len(k1), np.int64)
    prints[at], counts[at], firsts[at] = k2, rows["n"].to_numpy(), rows["first"].to_numpy()
    return pd.DataFrame({"shard": [key[0]], "keys": [len(k1)], "sizes": [sizes], "bits": [bits], "fingerprints": [prints.tobytes()], "counts": [counts.tobytes()], "firsts": [firsts.tobytes()]})


def _probe_shard(lines: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
    hits = lines[["doc", "tid", "pos"]]
    if not len(lines) or not len(arrays):
        return hits.iloc[:0].assign(first=0, n=0)
    a = arrays.iloc[0]
    k1, k2 = (lines[c].to_numpy(np.int64).view(np.uint64) for c in ("k1", "k2"))
    at = find(k1, k2, list(a["sizes"]), list(a["bits"]))
    prints, counts, firsts = np.frombuffer(a["fingerprints"], np.uint64), np.frombuffer(a["counts"], np.int64), np.frombuffer(a["firsts"], np.int64)
    hit = (at >= 0) & (prints[at] == k2)
    return hits[hit].assign(first=firsts[at[hit]], n=counts[at[hit]])


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, tid, pos, k1, k2) of each line whose key is long enough; tid tells rows with one id and other texts apart."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_or_empty()).alias("tid"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"))
    keys = keys.withColumn("line", lower_ascii(F.btrim("line", F.lit(SPACES)))).where(F.length("line") >= min_chars)
    return keys.select("doc", "tid", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Drop each repeated line outside the first document that holds it.

    docs: doc_id, text and any more columns. A key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased. Keys of
    at least min_chars code points that documents with different ids hold go from all documents but the one with the smallest id,
    which keeps all its lines. Returns docs' columns and n_lines (before), n_dropped, kept_text.
    Null or empty text: one empty line. Null doc_id: the row loses no line and counts for no other. Repeated rows: each is
    treated alike. Columns of docs named like a result are replaced. An empty table gives an empty result.
    """
    lines = checkpoint(line_rows(docs, min_chars))
    total = lines.count()
    keys = lines.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    keys = checkpoint(keys.where("first < last").select("k1", "k2", "first", "n"))
    n_keys, held = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = keys.where(F.col("n") >= max(64, held // HOT_KEYS + 1))
    shards = parts_for(max(total * KEYS_PER_SHARD // LINES_PER_SHARD, n_keys), KEYS_PER_SHARD)
    shard = F.pmod("k1", F.lit(shards)).alias("shard")
    arrays = checkpoint(keys.where(F.col("n") < max(64, held // HOT_KEYS + 1)).select("*", shard).groupBy("shard").applyInPandas(_build_shard, ARRAYS))
    marked = lines.join(F.broadcast(hot), ["k1", "k2"], "left")
    of_hot = marked.where("first is not null").select("doc", "tid", "pos", "first", "n")
    cold = marked.where("first is null").select("doc", "tid", "pos", "k1", "k2", shard)
    of_cold = cold.groupBy("shard").cogroup(arrays.groupBy("shard")).applyInPandas(_probe_shard, HITS)
    drops = of_hot.unionByName(of_cold).where("first < doc").groupBy(F.col("doc").alias("__doc"), F.col("tid").alias("__tid")).agg(F.collect_set("pos").alias("__drop"))
    out = docs.select("*", F.xxhash64(text_or_empty()).alias("__own"))
    out = out.join(drops, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.col("__own") == F.col("__tid")), "left")
    each = F.split(text_or_empty(), "\n")
    out = out.withColumn("n_lines", F.size(each).cast("long")).withColumn("n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
    left = F.array_except(F.sequence(F.lit(0), F.size(each) - 1), F.col("__drop"))
    # The outer lambda holds the lines, which would else be split again for each position.
    joined = F.get(F.transform(F.array(each), lambda held: F.array_join(F.transform(left, lambda i: F.get(held, i)), "\n")), F.lit(0))
    kept = F.when(F.col("__drop").isNull(), text_or_empty()).otherwise(joined)
    return out.withColumn("kept_text", kept).drop("__own", "__doc", "__tid", "__drop")


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs with the kept text in place of the text, and n_chars, where it is there, to match."""
    out = dedup_lines(docs.select("*")).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
