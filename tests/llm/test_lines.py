import hashlib
import random

import numpy as np

from ledgerloom.llm import lines


def test_minimal_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 20_000):
        k1, k2 = rnd.integers(0, 2**64, n, np.uint64), rnd.integers(0, 2**64, n, np.uint64)
        if n == 100:
            k1[:] = 7  # told apart by the second hash alone
        at = lines.find(k1, k2, *lines.build_hash(k1, k2))
        assert sorted(at.tolist()) == list(range(n))


def brute(docs, least=10):
    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and i is not None:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        each = (t or "").split("\n")
        keep = [x for x in each if i is None or len(held.get(key(x), ())) < 2 or min(held[key(x)]) == i]
        out.append((i, len(each), len(each) - len(keep), "\n".join(keep)))
    return out


def test_against_brute_force_and_edges(spark, monkeypatch):
    rnd = random.Random(3)
    stock = ["a common line here", "A Common LINE here\t ", "É common line here", "é common line here", "short", "", "  ", "exactly10c", "ninechars", "x" * 5000, "日本語日本語日本語日", "own hot line of many documents"]
    docs = [(i, "\n".join(rnd.choice([*stock, f"line of its own {rnd.randint(0, 9999)}"]) for _ in range(rnd.randint(0, 30)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "\n"), (None, "a common line here\nfoo"), (5, "a common line here\nown hot line of many documents"), (1003, "exactly10c\n" * 3000), (1003, "exactly10c\n" * 3000)]
    df = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, n_lines int, shard string").repartition(6)
    want = sorted((repr(x[0]), x[1], x[2], x[3]) for x in brute(docs))
    get = lambda: sorted((repr(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.dedup_lines(df).collect())
    assert get() == want
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 3)
    monkeypatch.setattr(lines, "LINES_PER_SHARD", 40)
    assert get() == want
    out = lines.dedup_lines(df)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "shard", "n_dropped", "kept_text"}
    assert lines.dedup_lines(df.limit(0)).count() == 0
    kept = lines.kept_documents(df)
    assert kept.columns == df.columns and kept.count() == len(docs)
    assert hashlib.sha256(want[0][3].encode()).hexdigest()
