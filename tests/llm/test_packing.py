import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing


def check(rows, capacity=1024):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def best(lengths, capacity):
    """Fewest bins, by search."""
    lengths = sorted(lengths, reverse=True)

    def fits(i, gaps):
        if i == len(lengths):
            return True
        for k in {g: j for j, g in enumerate(gaps)}.values():
            if gaps[k] >= lengths[i]:
                gaps[k] -= lengths[i]
                if fits(i + 1, gaps):
                    return True
                gaps[k] += lengths[i]
        return False

    n = 1
    while not fits(0, [capacity] * n):
        n += 1
    return n


@pytest.mark.parametrize("seed", range(12))
def test_bound_and_best_fit_around_the_optimum(seed):
    rnd, cap = random.Random(seed), 20
    lengths = np.array([rnd.randint(1, 19) for _ in range(rnd.randint(1, 11))])
    bins, offsets, gaps = packing.best_fit_decreasing(lengths, cap)
    least = best(lengths.tolist(), cap)
    assert packing.lower_bound(np.bincount(lengths, minlength=cap + 1), cap) <= least <= len(gaps) <= least * 11 / 9 + 1
    assert check([{"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(bins, offsets, lengths)], cap) == len(gaps)


def test_dual_feasible_functions_beat_the_sum():
    counts = np.zeros(1025, np.int64)
    counts[600] = 7
    assert packing.lower_bound(counts, 1024) == 7
    counts[:] = 0
    counts[342] = 9  # three don't fit
    assert packing.lower_bound(counts, 1024) == 5


def test_pieces():
    ids = np.arange(2050, dtype="<u4")
    assert [p[:3] for p in packing.pieces_of(ids, 1024)] == [(0, 0, 2), (1, 2, 1024), (2, 1026, 1024)]
    assert [p[:3] for p in packing.pieces_of(ids[:2048], 1024)] == [(0, 0, 1024), (1, 1024, 1024)]


def test_encoder_equals_tokenizers():
    slow = Tokenizer.from_file(packing.vocabulary_path())
    fast, rnd = packing.encoder(packing.vocabulary_path()), random.Random(5)
    alphabet = "abcdefgh ABC  \n\t'.,;:é日本語😀0123 ​\x00<|endoftext|>'s're\r"
    texts = ["", " ", "<|endoftext|>", " <|endoftext|> <|endoftext|>x", "a  <|endoftext|>\n\n<|endoftext|", "<|endoftext|><|endoftext|>", "a" * 5000, " " * 300, "x\n\n  y"] + ["".join(rnd.choices(alphabet, k=rnd.randint(1, 200))) for _ in range(300)]
    texts += ["".join(rnd.choices(["<|endoftext|>", " ", "  ", "\n", "a", "'s", "<|"], k=rnd.randint(1, 12))) for _ in range(300)]
    assert 50256 in fast("x<|endoftext|>")
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def test_pack_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "word " * 3000, 9), (4, "same", 9), (4, "same", 9), (None, "no id", 9)] + [(i, "tok " * (i % 700), 9) for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int")
    out = packing.pack(docs, per_part=40).collect()
    assert {(r["doc_id"], r["piece"]) for r in out} >= {(1, 0), (2, 0), (None, 0)}
    assert next(r["length"] for r in out if r["doc_id"] == 1) == 1
    assert sum(r["doc_id"] == 4 for r in out) == 2
    long = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == 3)
    assert long[0][0] == 0 and all(n == 1024 for _, n in long[1:]) and all(a + n == b for (a, n), (b, _) in zip(long, long[1:]))
    total = sum(r["length"] for r in out)
    assert check(out) <= -(-total // 1024) * 1.03 + 2
    assert packing.pack(docs.limit(0)).count() == 0
