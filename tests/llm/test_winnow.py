import hashlib
import random

import numpy as np

from ledgerloom.llm import winnow


def brute(hashes, w):
    out, n = [], len(hashes)
    for i in range(max(1, n - w + 1) if n else 0):
        part = hashes[i : i + w]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if not out or out[-1] != (hashes[at], at):
            out.append((hashes[at], at))
    return out


def test_winnow_equals_brute_force_with_ties():
    rnd = random.Random(1)
    for n in [0, 1, 2, 5, 31, 32, 33, 200]:
        for w in (1, 2, 3, 5, 8, 32):
            h = np.array([rnd.randint(0, 3) for _ in range(n)], np.uint64)
            a, at = winnow.winnow(h, w)
            assert list(zip(a.tolist(), at.tolist())) == brute(h.tolist(), w), (n, w)


def test_gram_hashes_are_those_of_the_polynomial():
    rnd = random.Random(2)
    for k in (1, 2, 3, 5, 7, 16, 25):
        points = np.array([rnd.randint(0, 2**20) for _ in range(60)], np.uint32)
        marked, want = [winnow.MARK] * (k - 1) + points.tolist(), []
        for i in range(60):
            x = 0
            for c in marked[i : i + k]:
                x = (x * winnow._BASE + c) % 2**64
            x = (x ^ (x >> 32)) * int(winnow._MIX) % 2**64
            want.append(x >> 32)
        assert winnow.gram_hashes(points, k).tolist() == want


def test_match_guarantee():
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    for _ in range(50):
        shared = word(winnow.K + winnow.WINDOW - 1)
        a, b = (winnow.fingerprint(word(rnd.randint(0, 300)) + shared + word(rnd.randint(0, 300)))[1] for _ in "ab")
        assert len(np.intersect1d(a, b))


def plain_set(text, k=winnow.K, w=winnow.WINDOW):
    """The set of hashes that winnowing keeps, restated over strings of code points."""
    marked = [winnow.MARK] * (k - 1) + [ord(c) for c in text]
    hashes = []
    for i in range(len(text)):
        x = 0
        for c in marked[i : i + k]:
            x = (x * winnow._BASE + c) % 2**64
        hashes.append((x ^ (x >> 32)) * int(winnow._MIX) % 2**64 >> 32)
    return {h for h, _ in brute(hashes, w)}


def test_likeness_of_texts_of_all_lengths_equals_sets():
    rnd = random.Random(6)
    for n in range(61):
        text = "".join(rnd.choices("abcdefgh é😀", k=n))
        for other in [text[:m] for m in range(0, n + 1, 3)] + [winnow.edited(text, "xyz"), winnow.edited(text, text[::-1]), "".join(rnd.choices("abc", k=rnd.randint(0, 60)))]:
            a, b = plain_set(text), plain_set(other)
            want = 1.0 if not a | b else len(a & b) / len(a | b)
            assert abs(winnow.likeness(winnow.fingerprint(text)[1], winnow.fingerprint(other)[1]) - want) < 1e-12
            if text[: winnow.WINDOW] == other[: winnow.WINDOW] and min(len(text), len(other)) >= winnow.WINDOW:
                assert want > 0


def test_rows_and_edges(spark, monkeypatch):
    rnd = random.Random(4)
    docs = [(i * 3, "".join(rnd.choices("abcdefg é😀\n", k=rnd.choice([0, 1, 3, 50, 400]))), "x") for i in range(300)]
    docs += [(100_000, None, "x"), (None, "null id", "x"), (100_001, "long " * 40_000, "x"), (100_001, "long " * 40_000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, fingerprint string").repartition(7)
    got = winnow.fingerprints(df).collect()
    mix = {r["t"]: r["m"] for r in df.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) m").collect()}
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, mix[r[1] or ""], r[1] or ""))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        changed = winnow.edited(r[1] or "", nxt[1] or "")
        want.append((r[0], len(r[1] or ""), hashlib.sha256(changed.encode()).hexdigest(), winnow.fingerprint(r[1] or "")[0], winnow.fingerprint(changed)[0]))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r[0], r[1], r[2], r[3], r[4]) for r in got), key=key) == sorted(want, key=key)
    likeness = lambda a, b: 1.0 if not plain_set(a) | plain_set(b) else len(plain_set(a) & plain_set(b)) / len(plain_set(a) | plain_set(b))
    near = {}
    for r, nxt in zip(order, order[1:] + order[:1]):
        if len(r[1] or "") < 1000 and len(nxt[1] or "") < 1000:
            near[r[0]] = (likeness(r[1] or "", winnow.edited(r[1] or "", nxt[1] or "")), likeness(r[1] or "", nxt[1] or ""))
    assert all(abs(r["near_edited"] - near[r["doc_id"]][0]) < 1e-12 and abs(r["near_next"] - near[r["doc_id"]][1]) < 1e-12 for r in got if r["doc_id"] in near)
    from pyspark.sql import functions as F
    parts = winnow.in_ranges(df, per_range=20).where("tail = 0").agg(F.count(F.lit(1)), F.count_distinct("span")).first()
    assert parts[0] == len(docs) and parts[1] >= 10
    assert winnow.fingerprints(df.limit(0)).count() == 0
    # Ids in clumps and a third of them null: ranges between two cuts are divided on.
    monkeypatch.setattr(winnow, "CUTS", 3)
    clumps = [(i if i % 2 else 2**62 + i if i % 3 else None, f"text {i} " * (i % 4), "x") for i in range(900)] + [(-(2**63), "least", "x"), (2**63 - 1, "most", "x")]
    df = spark.createDataFrame(clumps, "doc_id long, text string, fingerprint string").repartition(5)
    rows = winnow.in_ranges(df, per_range=20).where("tail = 0").select("span", "doc", F.xxhash64("text").alias("mix")).collect()
    assert len(rows) == len(clumps) and len({r["span"] for r in rows}) > 15
    by = sorted(rows, key=lambda r: (r["doc"] is None, r["doc"] or 0, r["mix"]))
    assert [r["span"] for r in by] == sorted(r["span"] for r in rows)
    assert winnow.fingerprints(df).count() == len(clumps)
    assert winnow.fingerprints(spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")).count() == 2
    assert winnow.fingerprints(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1
