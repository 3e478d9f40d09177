import random

import numpy as np
import pytest

from ledgerloom.llm import simhash


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def roots(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def pairs_with(likeness, docs):
    return [(a, b) for k, (a, x) in enumerate(docs) for b, y in docs[k + 1 :] if jaccard(x, y) >= likeness - 1e-12]


def run(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r["root"] for r in simhash.like_groups(df).collect()}


def with_tail(rnd, n, share):
    """Two texts of n words that share their first part: Jaccard near `share`."""
    words = [f"w{rnd.getrandbits(40)}" for _ in range(2 * n)]
    keep = round((n - 4) * 2 * share / (1 + share)) + 4
    return " ".join(words[:n]), " ".join(words[:keep] + words[n : 2 * n - keep])


def test_pairs_from_a_half_to_four_fifths_do_not_link(spark):
    rnd = random.Random(1)
    docs, want = [], {}
    for k in range(300):
        a, b = with_tail(rnd, rnd.randint(60, 300), rnd.uniform(0.5, 0.99))
        docs += [(2 * k, a), (2 * k + 1, b)]
        want[k] = jaccard(a, b)
    got = run(spark, docs)
    under = [k for k, j in want.items() if 0.5 <= j < 0.8]
    assert len(under) > 100 and sum(0.6 < want[k] < 0.8 for k in under) > 50
    assert not [want[k] for k in under if got[2 * k + 1] != 2 * k + 1]


def test_pairs_just_that_alike_are_found(spark):
    rnd = random.Random(2)
    docs, k = [], 0
    while len(docs) < 1600:
        a, b = with_tail(rnd, rnd.randint(40, 300), 0.805)
        if 0.8 <= jaccard(a, b) < 0.82:
            docs += [(2 * k, a), (2 * k + 1, b)]
            k += 1
    got = run(spark, docs)
    assert sum(got[2 * i + 1] == 2 * i for i in range(k)) >= 0.96 * k


@pytest.mark.parametrize("count", [2, 10_000, 1_000_000, 30_000_000, 10**9])
def test_the_plan_misses_alike_at_every_size(count):
    places, radius = simhash.band_plan(count)
    assert simhash.missed_share(simhash.differing_share(0.8), len(places[0]), len(places), radius) <= simhash.MISSED
    assert simhash.missed_share(np.arccos(1.6 / 1.8) / np.pi, len(places[0]), len(places), radius) <= simhash.MISSED


def test_tiny_sets_miss_nothing(spark):
    docs, i = [], 0
    for k in range(60):
        w = [f"t{k}x{j}" for j in range(9)]
        for text in (w, w[:8], w[1:], w[:7]):
            docs.append((i, " ".join(text)))
            i += 1
    assert run(spark, docs) == roots(pairs_with(0.8, docs), [d for d, _ in docs])


@pytest.mark.parametrize("most", [7, 1_000])
def test_large_groups_in_blocks_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "GROUP", most)
    rnd = random.Random(3)
    docs = []
    for _ in range(3):
        base = [f"b{rnd.getrandbits(40)}" for _ in range(120)]
        chain = list(base)
        for _ in range(60):
            text = list(base if rnd.random() < 0.6 else chain)
            for _ in range(rnd.randint(1, 4)):
                text[rnd.randrange(120)] = f"n{rnd.getrandbits(40)}"
            chain = text if rnd.random() < 0.3 else chain
            docs.append((len(docs), " ".join(text)))
    rows = spark.createDataFrame([(0, *d) for d in docs], "comp long, node long, text string").repartition(4)
    links = [(r["u"], r["v"]) for r in simhash.verified_links(rows, 5, 0.8).collect()]
    near = set(pairs_with(0.8, docs))
    assert all((min(p), max(p)) in near for p in links if p[0] != p[1])
    want = roots(near, [d for d, _ in docs])
    assert roots(links, [d for d, _ in docs]) == want and len(set(want.values())) > 5


def test_alike_against_brute_force():
    rnd = np.random.default_rng(4)
    for _ in range(60):
        sets = [np.unique(rnd.integers(0, 14, rnd.integers(0, 14))) for _ in range(25)]
        near = lambda i, j: len(sets[i]) + len(sets[j]) > 0 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
        links = simhash.alike(sets)
        assert all(near(i, j) for i, j in links)
        full = [i for i in range(25) if len(sets[i])]
        assert {k: v for k, v in roots(links, range(25)).items() if k in full} == roots([(i, j) for i in full for j in full if i < j and near(i, j)], full)
