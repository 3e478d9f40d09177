"""SimHash near-dedup with BK-trees over pigeonhole shards.

Fingerprints that differ in at most r of b bits agree exactly on one of r + 1 blocks of those bits (and on m - r of m blocks), so each
fingerprint goes to one shard for each choice of blocks, and every linked pair meets in a shard. A shard holds BK-trees: the
children of a node are keyed by their Hamming distance to it, and a search follows only the edges within the radius of its own
distance. Fingerprints that crowd on one choice of blocks are dealt once more, by blocks of their other bits, which loses no pair either.
Trees stay in the shard's task with the fingerprints that search them: a tree over a whole corpus has no size bound, and a search of
radius 4 sees 1,000 of 10,000 nodes and 5,000 of 100,000, so that searching all broadcast shards of a corpus would be quadratic in it.
A shard gives a spanning forest, at most one link for each fingerprint in it, never all pairs. Components
come from distributed star contraction; equal fingerprints are one node from the start, named by their smallest document, so
that a component's root is its id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import HOT_KEYS, checkpoint, parts_for, small_batches

SHINGLE, BITS, RADIUS, SEED = 4, 64, 4, 42
ROWS_PER_SHARD = 8_000
#: Fingerprints that agree on one choice of blocks and are searched in one tree; more are dealt by their other bits too.
CROWD = 4_000
#: Links of a node from which on its smallest neighbour is broadcast.
STAR = 1_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a shorter sequence is one shingle, and no words give none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n, joined = max(1, len(words) - shingle + 1), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(joined[a:b], seed) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero for none."""
    if not len(hashes):
        return 0
    on = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65_536):
        on += np.unpackbits(hashes[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(on * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp) of each row; fp is the fingerprint as a signed long."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = np.fromiter((fingerprint(shingle_hashes(t, shingle)) for t in rows["text"]), np.uint64, len(rows))
            yield pd.DataFrame({"doc": rows["doc"], "fp": made.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).mapInPandas(of, "doc long, fp long")


class BKTree:
    """Nodes with children keyed by their distance to the parent."""

    def __init__(self, distance: Callable[[int, int], int] | None = None) -> None:
        self.distance = distance or (lambda a, b: (a ^ b).bit_count())
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        if not new:
            return
        at = 0
        while True:
            d = self.distance(self.values[at], value)
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        found, to_see = [], [0] if self.values else []
        values, children, distance = self.values, self.children, self.distance
        while to_see:
            at = to_see.pop()
            d = distance(values[at], value)
            if d <= radius:
                found.append(at)
            if edges := children[at]:
                to_see += [below for k, below in edges.items() if d - radius <= k <= d + radius]
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for each value that others reach within the radius, of distinct values; the root is the smallest reached."""
    tree, up = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            if a != b:
                up[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def block_masks(bits: int, radius: int, blocks: int) -> list[int]:
    """A mask for each choice of blocks - radius blocks; values within the radius agree under one mask at least."""
    edges = [round(k * bits / blocks) for k in range(blocks + 1)]
    own = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(own, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(nodes: DataFrame, count: int, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(u, v): a spanning forest, in labels, of each shard's links between nodes (fp, label) of distinct fp; count is their number."""
    blocks = radius + (1 if count < 1 << 20 else 2 if count < 1 << 30 else 3)
    masks = block_masks(BITS, radius, blocks)
    keyed = nodes.select("fp", "label", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(masks)))).alias("key"))
    crowded = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(crowd, count * len(masks) // HOT_KEYS))
    # Every radius + 1st bit: of so many groups of bits one is the same in any two within the radius.
    groups = [sum(1 << b for b in range(k, BITS, radius + 1)) for k in range(radius + 1)]
    finer = F.array(*(F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in enumerate(groups)))
    keyed = keyed.join(F.broadcast(checkpoint(crowded.select(F.col("key"), F.lit(True).alias("crowded")))), "key", "left")
    keyed = keyed.select("fp", "label", F.explode(F.when(F.col("crowded"), finer).otherwise(F.array("key"))).alias("key"))
    keyed = keyed.withColumn("shard", F.pmod("key", F.lit(parts_for(count * len(masks), ROWS_PER_SHARD))))

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "fp"])
        fps, keys, labels = rows["fp"].to_numpy(), rows["key"].to_numpy(), rows["label"].to_numpy()
        cuts = np.flatnonzero(np.diff(keys) != 0) + 1
        out: list[tuple[int, int]] = []
        for a, b in zip([0, *cuts], [*cuts, len(fps)], strict=True):
            if b - a > 1:
                name = dict(zip(fps[a:b].view(np.uint64).tolist(), labels[a:b].tolist(), strict=True))
                out += [(name[u], name[v]) for u, v in forest(list(name), radius)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return keyed.groupBy("shard").applyInPandas(links, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (u, v): root is the smallest node reachable. Large and small stars in turn. The smallest
    neighbours of nodes with a large share of all links, at most HOT_KEYS by the pigeonhole rule, are broadcast."""
    edges = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, most = None, max(STAR, edges.count() // HOT_KEYS)
    while True:
        # Large star: each node sends its larger neighbours to its smallest neighbour or itself.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        sent = both.where("v > u").join(F.broadcast(low.where(F.col("n") > most).select("u", F.col("m").alias("hot"))), "u", "left")
        large = sent.where("hot is not null").select(F.col("v").alias("u"), F.col("hot").alias("v"))
        large = large.unionByName(sent.where("hot is null").select("u", "v").join(low.where(F.col("n") <= most), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        # Small star: each node sends its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = checkpoint(small)
        # Decimal sums wrap nowhere; equal counts and sums of both ends with equal hashes mean that nothing has moved.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp long, component_id of each row of docs (doc_id, text and any more columns, which are ignored).

    A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, word shingles with repeats (a shorter sequence is one), XXH64 with seed 42; rows link
    whose fingerprints differ in at most radius bits; component_id is the smallest doc_id reachable. Null, empty and blank texts
    have fingerprint zero and link like any other. Null doc_id: kept, and never a component's id unless no row of it has another
    (then null). Repeated rows stay, each with its component. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    made = checkpoint(fingerprints(docs, shingle))
    nodes = checkpoint(made.groupBy("fp").agg(F.min("doc").alias("low")))
    count, top = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("low"), F.lit(0))).first()
    # Fingerprints of rows without ids alone come after all others.
    nodes = nodes.select("fp", F.coalesce("low", F.lit(top) + 1 + F.monotonically_increasing_id()).alias("label"))
    roots = components(near_links(nodes, count, radius))
    of_node = nodes.join(roots, F.col("label") == F.col("node"), "left").select("fp", F.coalesce("root", "label").alias("root"))
    of_node = of_node.select("fp", F.when(F.col("root") <= top, F.col("root")).alias("component_id"))
    return made.join(of_node, "fp").select(F.col("doc").alias("doc_id"), "fp", "component_id")


# Near copies by similarity: wide fingerprints find candidates, the exact Jaccard likeness decides.

#: Words of a shingle, the least Jaccard likeness, words of 64 bits, and the most of the pairs just that alike that the fingerprints may miss.
LIKE_SHINGLE, LIKENESS, WORDS, MISSED = 5, 0.8, 4, 0.03
#: Sets up to this size meet by their least hashes (a prefix filter, which misses none): few shingles move more bits than the plan allows for.
TINY = 5
#: Sets of one candidate group that a task compares; larger groups are dealt out in blocks.
GROUP = 1_000
_STEP, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> bytes:
    """A fingerprint of 64 * words bits over distinct hashes; each word takes another mix of the hash."""
    out = []
    hashes = np.unique(hashes)
    for k in range(words):
        with np.errstate(over="ignore"):
            x = hashes + _STEP * np.uint64(k + 1)
            x = (x ^ (x >> np.uint64(30))) * _M1
            x = (x ^ (x >> np.uint64(27))) * _M2
            out.append(fingerprint(x ^ (x >> np.uint64(31))))
    return b"".join(x.to_bytes(8, "little") for x in out)


def bit_differs(shared: int, one: int, other: int) -> float:
    """The chance that a bit differs between two sets with so many hashes in both, and in one of them only."""

    def on(s: int, more: int) -> float:
        return sum(math.comb(more, x) for x in range(more + 1) if 2 * (s + x) > shared + more) / 2**more

    return sum(math.comb(shared, s) * ((a := on(s, one)) * (1 - (b := on(s, other))) + b * (1 - a)) for s in range(shared + 1)) / 2**shared


@cache
def differing_share(likeness: float) -> float:
    """The largest expected share of differing bits of two sets of at least this Jaccard likeness, not both tiny: large sets of one
    size by the arc cosine, small ones by counting."""
    most = math.acos(2 * likeness / (1 + likeness)) / math.pi
    for shared in range(1, 41):
        for more in range(int(shared / likeness - shared + 1e-9) + 1):
            for one in range(more // 2 + 1):
                if shared + more - one > TINY:
                    most = max(most, bit_differs(shared, one, more - one))
    return most


def missed_share(share: float, width: int, bands: int, radius: int, bits: int = 64 * WORDS) -> float:
    """The chance that two fingerprints, each bit differing with this chance, are out of the radius or share no band."""
    out = 0.0
    for d in range(bits + 1):
        held = math.comb(bits - d, width) / math.comb(bits, width)
        out += math.comb(bits, d) * share**d * (1 - share) ** (bits - d) * (1 if d > radius else (1 - held) ** bands)
    return out


def band_plan(count: int, likeness: float = LIKENESS, bits: int = 64 * WORDS) -> tuple[list[list[int]], int]:
    """(bit positions of each band, radius) for that many fingerprints. A band takes more bits the more fingerprints there are, so
    that chance fills no bucket; radius and number of bands keep what both miss together, over all distances, under MISSED."""
    p = differing_share(likeness)
    width = max(14, math.ceil(math.log2(max(count, 2))) - 4)
    radius = next(r for r in range(bits + 1) if missed_share(p, 0, 1, r, bits) <= MISSED / 6)
    bands = math.ceil(math.log(MISSED) / math.log(1 - (1 - p) ** width))
    while missed_share(p, width, bands, radius, bits) > MISSED:
        bands += max(1, bands // 50)
    rnd = np.random.default_rng(11)
    return [sorted(rnd.choice(bits, width, replace=False).tolist()) for _ in range(bands)], radius


def least_hashes(hashes: np.ndarray, likeness: float = LIKENESS) -> np.ndarray:
    """Of a tiny set, so many least hashes that any two tiny sets of this likeness share one; none of a larger set."""
    n = len(hashes)
    return hashes[: n - math.ceil(likeness * n - 1e-9) + 1] if 0 < n <= TINY else hashes[:0]


def alike(sets: list[np.ndarray], known: int = 0, likeness: float = LIKENESS) -> list[tuple[int, int]]:
    """Links (i, j) of sets of distinct values with at least this Jaccard likeness: enough to connect all that are connected, where
    the first `known` sets are one group already. Each set meets only those that nothing has reached before."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    mine = [ids[b - n : b] for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    free = np.arange(len(sets)) >= known
    flat, owner = ids[free[owner]], owner[free[owner]]
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    out: list[tuple[int, int]] = []
    to_see = list(range(known))
    for start in range(known, len(sets) + 1):
        while to_see and free.any():
            at = to_see.pop()
            mark[mine[at]] = True
            shared = np.bincount(owner[mark[flat]], minlength=len(sets))
            mark[mine[at]] = False
            reached = np.flatnonzero(free & (shared > 0) & (shared >= likeness * (sizes[at] + sizes - shared) - 1e-9))
            if len(reached):
                out += [(int(x), at) for x in reached]
                to_see += reached.tolist()
                free[reached] = False
                flat, owner = flat[free[owner]], owner[free[owner]]
        if start < len(sets) and free[start]:
            free[start] = False
            flat, owner = flat[owner != start], owner[owner != start]
            to_see = [start]
    return out


def blocks_of(sets: DataFrame, most: int, likeness: float) -> tuple[DataFrame, DataFrame]:
    """(task, comp, node, side, hashes), and links (u, v), of the groups of sets (comp, node, hashes) with more than `most` sets.

    Sets alike to one pivot of their group are one part (side 0) and dealt out once; the rest (side 1) goes to each of its blocks,
    and in pairs of blocks to itself: all pairs meet but those of the first part, which need not.
    """
    few = [F.min(F.struct(F.xxhash64("node", F.lit(k)), "node"))["node"] for k in range(4)]
    chosen = sets.groupBy("comp").agg(F.array_distinct(F.array(*few)).alias("p")).select("comp", F.explode("p").alias("node"))
    pivots = sets.join(F.broadcast(chosen), ["comp", "node"]).select("comp", F.col("node").alias("pivot"), F.col("hashes").alias("theirs"))
    shared = F.size(F.array_intersect("hashes", "theirs"))
    near = sets.join(F.broadcast(pivots), "comp").where(shared >= F.lit(likeness) * (F.size("hashes") + F.size("theirs") - shared) - 1e-9)
    near = checkpoint(near.select("comp", "node", "pivot").distinct())
    best = near.groupBy("comp", "pivot").count().groupBy("comp").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    first = near.join(F.broadcast(best), ["comp", "pivot"]).select("node", F.lit(0).alias("side"))
    sided = sets.join(first, "node", "left").withColumn("side", F.coalesce("side", F.lit(1)))
    parts = sided.groupBy("comp").agg(*(F.ceil(F.count_if(F.col("side") == k) / most).cast("int").alias(f"n{k}") for k in (0, 1)))
    sided = sided.join(F.broadcast(parts), "comp").where("n1 > 0")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))).cast("int")
    sided = sided.withColumn("own", own)
    over0, over1 = F.sequence(F.lit(0), F.col("n0") - 1), F.sequence(F.lit(0), F.col("n1") - 1)
    both = F.when(F.col("side") == 0, F.transform(over1, lambda j: F.xxhash64("comp", F.lit(0), "own", j))).otherwise(F.transform(over0, lambda i: F.xxhash64("comp", F.lit(0), i, "own")))
    rest = F.transform(over1, lambda j: F.xxhash64("comp", F.lit(1), F.least("own", j), F.greatest("own", j)))
    tasks = F.when(F.col("side") == 0, both).otherwise(F.concat(both, rest))
    return sided.select(F.explode(tasks).alias("task"), "comp", "node", "side", "hashes"), near.select(F.col("node").alias("u"), F.col("pivot").alias("v"))


def verified_links(rows: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """(u, v) of nodes whose shingle sets have at least this exact Jaccard likeness, among the candidate groups comp of rows (comp, node,
    text): enough links to connect in each group all that such pairs connect. A set goes once to its group, whatever its bands."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in rows["text"]]
            yield pd.DataFrame({"comp": rows["comp"], "node": rows["node"], "hashes": made})

    sets = checkpoint(rows.mapInPandas(of, "comp long, node long, hashes array<long>"))
    counts = checkpoint(sets.groupBy("comp").count())
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    most = max(GROUP, total // HOT_KEYS)
    hot = counts.where(F.col("count") > most).select("comp")
    small, more = sets, None
    if hot.limit(1).count():
        small = sets.join(F.broadcast(hot), "comp", "left_anti")
        blocks, more = blocks_of(sets.join(F.broadcast(hot), "comp", "left_semi"), most, likeness)
    tasks = small.select(F.pmod(F.xxhash64("comp"), F.lit(parts_for(total, most))).alias("task"), "comp", "node", F.lit(1).alias("side"), "hashes")
    if more is not None:
        tasks = tasks.unionByName(blocks)

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, group in rows.groupby("comp"):
            group = group.sort_values(["side", "node"])
            nodes = group["node"].tolist()
            out += [(nodes[i], nodes[j]) for i, j in alike(group["hashes"].tolist(), int((group["side"] == 0).sum()), likeness)]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    found = tasks.groupBy("task").applyInPandas(links, "u long, v long")
    return found if more is None else found.unionByName(more)


def like_nodes(docs: DataFrame, shingle: int = LIKE_SHINGLE, likeness: float = LIKENESS) -> tuple[DataFrame, DataFrame]:
    """(doc, tid, digest) of the distinct rows (id, text), and (digest, doc, tid, root) of the nodes: rows with equal shingle sets are
    one node, doc and tid are those of its first row, and nodes with one root are near copies."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [np.unique(shingle_hashes(t, shingle)) for t in rows["text"]]
            tiny = [least_hashes(x, likeness).view(np.int64) for x in made]
            yield pd.DataFrame({"doc": rows["doc"], "tid": rows["tid"], "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in made], "fp": [wide_fingerprint(x) for x in made], "tiny": tiny})

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    made = checkpoint(rows.mapInPandas(of, "doc long, tid long, digest binary, fp binary, tiny array<long>"))
    nodes = checkpoint(made.groupBy("digest").agg(F.min(F.struct("doc", "tid")).alias("low"), F.first("fp").alias("fp"), F.first("tiny").alias("tiny")))
    nodes = nodes.select("digest", "low.*", "fp", "tiny", F.monotonically_increasing_id().alias("node"))
    count = nodes.count()
    places, radius = band_plan(count, likeness)
    bits = np.array(places)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            on = np.unpackbits(np.frombuffer(b"".join(rows["fp"]), np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            keys = np.stack([(on[:, b].astype(np.int64) << np.arange(len(b))).sum(axis=1) for b in bits], axis=1)
            yield pd.DataFrame({"node": rows["node"], "fp": rows["fp"], "keys": list(keys)})

    shards = parts_for(count * len(places), ROWS_PER_SHARD)
    banded = nodes.select("fp", "node").mapInPandas(keyed, "fp binary, node long, keys array<long>").select("node", "fp", F.posexplode("keys").alias("band", "key"))
    banded = banded.withColumn("shard", F.pmod(F.xxhash64("band", "key"), F.lit(shards)))

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["band", "key", "node"])
        own, keys, band = rows["node"].to_numpy(), rows["key"].to_numpy(), rows["band"].to_numpy()
        values = [int.from_bytes(x, "little") for x in rows["fp"]]
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(band) != 0)) + 1
        out: set[tuple[int, int]] = set()
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
            if b - a > 1:
                name: dict[int, int] = {}
                for v, x in zip(values[a:b], own[a:b].tolist(), strict=True):
                    if name.setdefault(v, x) != x:
                        out.add((x, name[v]))
                out.update((name[v], name[r]) for v, r in forest(list(name), radius))
        return pd.DataFrame(sorted(out), columns=["u", "v"], dtype="int64")

    tiny = nodes.where(F.size("tiny") > 0).select(F.col("node").alias("u"), F.explode("tiny").alias("key"))
    tiny = checkpoint(tiny.join(tiny.groupBy("key").agg(F.min("u").alias("v")), "key").where("u <> v").select("u", "v"))
    groups = components(banded.groupBy("shard").applyInPandas(links, "u long, v long").unionByName(tiny))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).distinct()
    candidates = checkpoint(nodes.join(groups, "node").select("doc", "tid", "node", F.col("root").alias("comp")))
    roots = components(verified_links(rows.join(candidates, ["doc", "tid"]).select("comp", "node", "text"), shingle, likeness))
    return made.select("doc", "tid", "digest"), nodes.join(roots, "node", "left").select("digest", "doc", "tid", F.coalesce("root", "node").alias("root"))


def like_groups(docs: DataFrame, shingle: int = LIKE_SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """(doc_id, root) of each row of docs (doc_id, text; more columns are ignored): root is the smallest id of its group of near copies.

    Near copies: exact Jaccard likeness of their sets of word shingles of at least `likeness`, or a chain of such texts. Candidates come
    from wide SimHash fingerprints: each band of bits deals them into buckets, and a BK-tree in each bucket finds those within the
    radius; the groups so found are compared set by set. Null, empty and blank texts have no words and are one group. Null ids are
    left out. Repeated rows each have their row; unlike texts of one id are in their own groups. Very long texts are read whole. An
    empty table gives an empty result.
    """
    made, nodes = like_nodes(docs, shingle, likeness)
    named = nodes.join(nodes.groupBy("root").agg(F.min("doc").alias("low")), "root").select("digest", "low")
    return made.join(named, "digest").select(F.col("doc").alias("doc_id"), F.col("low").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies (see like_groups): of each group the row with the smallest id stays, of equal ids that whose text's hash
    is least, of repeated rows one; so unlike texts of one id all stay. Rows without an id stay. Columns are kept as they are."""
    _, nodes = like_nodes(docs)
    kept = nodes.groupBy("root").agg(F.min(F.struct("doc", "tid")).alias("k")).select(F.col("k.doc").alias("__doc"), F.col("k.tid").alias("__tid"))
    own = docs.withColumn("__own", F.xxhash64(F.col("text").cast("string")))
    rows = own.join(kept, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.col("__own") == F.col("__tid")), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "__own").orderBy("doc_id"))
    rows = rows.withColumn("__n", first).where("__n = 1").select(*docs.columns)
    return rows.unionByName(docs.where("doc_id is null"))


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
