import random
from collections import Counter

import pytest
import xxhash

from ledgerloom.llm import simhash


def plain(text, shingle=4):
    words, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    held = Counter(b for p in parts for b in range(64) if xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if held[b] * 2 > len(parts))


def test_fingerprint():
    rnd = random.Random(1)
    for t in [None, "", " \n", "One", "one TWO\x0bthree", "É é ",*["".join(rnd.choices("ab C\t\né ", k=rnd.randint(1, 80))) for _ in range(150)]]:
        assert simhash.fingerprint(simhash.shingle_hashes(t)) == plain(t), t


def test_tree_finds_all():
    rnd = random.Random(2)
    values = list({rnd.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:60]:
        assert sorted(tree.values[i] for i in tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


def test_masks_cover_every_pair_in_reach():
    rnd = random.Random(3)
    for blocks in (5, 6, 7):
        masks = simhash.block_masks(64, 4, blocks)
        for _ in range(300):
            flips = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(flips & m == 0 for m in masks)


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("star", [simhash.STAR, 50])
def test_components_of_chains_stars_and_none(spark, monkeypatch, star):
    monkeypatch.setattr(simhash, "STAR", star)
    rnd = random.Random(4)
    pairs = [(i, i + 1) for i in range(-40, 60)] + [(500, 1000 + i) for i in range(200)] + [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(250)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    assert all(got.get(n, n) == r for n, r in want.items())
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("crowd", [simhash.CROWD, 3])
def test_groups_against_brute_force_and_edges(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (simhash.RADIUS, crowd))
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefg", k=4)) for _ in range(400)]
    docs, i = [], 0
    for _ in range(40):
        base = rnd.choices(words, k=rnd.randint(3, 300))
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            docs.append((i, " ".join(copy)))
            i += 3
    docs += [(7_000, None), (7_001, ""), (7_002, " \n"), (None, "only one with a null id"), (None, docs[0][1]), (docs[5][0], docs[5][1]), (None, "a second text of null ids"), (2**62, "late")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, fp int").repartition(4)
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(docs)
    fps = {plain(t) for _, t in docs}
    roots = union([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4], fps)
    low = {}
    for d, t in docs:
        if d is not None:
            r = roots[plain(t)]
            low[r] = min(d, low.get(r, d))
    want = [(repr(d), low.get(roots[plain(t)])) for d, t in docs]
    assert sorted(((repr(r["doc_id"]), r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert simhash.simhash_groups(df.limit(0)).count() == 0
