import os
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import toxicity as t


def test_words_of_any_length_have_all_their_grams():
    assert t.grams_of("abcdefgh") == ["^ab", "^abc", "^abcd", "^abcde", "^abcdef", "fgh$", "bcd", "cde", "def", "efg"]
    assert "xyz" in t.grams_of("a" * 300 + "xyz" + "b" * 300)


def test_the_sample_is_bounded_by_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    whole, share = t.training_rows(docs, labels)
    monkeypatch.setattr(t, "MOST_CHARS", 3_000)
    rows, same = t.training_rows(docs, labels)
    assert len(rows) == 30 and share == same and 100 < len(whole) < 200 and {y for _, y in rows} == {0, 1}


def test_windows_overlap_and_cover():
    for n in range(0, 400):
        cuts = t.windows_of(n)
        assert cuts[0][0] == 0 and cuts[-1][1] == n
        assert all(b[0] < a[1] for a, b in zip(cuts, cuts[1:])) and all(0 <= b - a <= t.WINDOW for a, b in cuts)


def test_gradients_equal_differences():
    words = ["aa", "bb", "abc", "abcdefgh", "zz", "new"]
    grams = {g: i for i, g in enumerate(sorted({g for w in words[:5] for g in t.grams_of(w)}), 1)}
    net = t.Network.fresh({"aa": 1, "bb": 2, "abc": 3}, grams, dtype=np.float64)
    rnd = random.Random(1)
    windows = [[rnd.choice(words) for _ in range(n)] for n in (1, 5, 48, 7, 0)]
    labels = np.array([1, 0, 1, 0, 1], float)
    _, g = net.loss_and_gradients(windows, labels)
    dense = {}
    for k, v in g.items():
        if isinstance(v, tuple):
            dense[k] = np.zeros_like(net.weights[k])
            dense[k][v[0]] = v[1]
        else:
            dense[k] = v
    for name, w in net.weights.items():
        flat = w.reshape(-1)
        for i in rnd.sample(range(flat.size), min(12, flat.size)):
            if name in ("words", "grams") and i < w.shape[1]:
                continue  # row 0 stays zero
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = net.loss_and_gradients(windows, labels)[0]
            flat[i] = old - e
            down = net.loss_and_gradients(windows, labels)[0]
            flat[i] = old
            assert dense[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), abs=2e-6), name


def corpus(n, seed):
    rnd = random.Random(seed)
    syllables = ["ba", "ce", "di", "fo", "gu", "ha", "ke", "li", "mo", "nu"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    out = []
    for _ in range(n):
        ws, y = [word() for _ in range(rnd.randint(20, 200))], rnd.random() < 0.3
        for _ in range(rnd.randint(2, 5) if y else 0):
            ws[rnd.randrange(len(ws))] = rnd.choice(["dolt", "xeno" + word()])
        out.append((" ".join(ws), int(y)))
    return out


@pytest.fixture(scope="module")
def net():
    return t.train(corpus(500, 1), 0.3)


def test_held_out_accuracy_on_unseen_words_of_known_families(net):
    rows = corpus(300, 2)
    said = net.scores([x for x, _ in rows]) >= 0.5
    assert np.mean(said == np.array([y for _, y in rows], bool)) > 0.95


def test_batches_and_small_tables_give_the_same_scores(net, monkeypatch):
    texts = [x for x, _ in corpus(40, 3)] + [None, "", "!!", "dolt " * 5000]
    want = net.scores(texts)
    net.table, net.places = None, {}
    monkeypatch.setattr(t, "KEPT_WORDS", 50)
    monkeypatch.setattr(t, "AT_ONCE", 3)
    got = np.concatenate([net.scores(texts[k : k + 7]) for k in range(0, len(texts), 7)])
    assert np.allclose(want, got, atol=1e-5)
    assert want[-4] == want[-3] == want[-2] and want[-1] > 0.5


def test_table_and_edges(spark):
    rows = [(i, x, y) for i, (x, y) in enumerate(corpus(400, 4))]
    docs = spark.createDataFrame([(i, x, "s", 0.5) for i, x, _ in rows] + [(None, None, "s", 0.5), (9_000, "", "s", 0.5), (7, rows[7][1], "s", 0.5)], "doc_id long, text string, source string, score double").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None), (5, 1, rows[5][2])], "doc_id long, quality int, toxic int")
    got = t.score_documents(docs, labels).select("*", t.held_out(docs.doc_id).alias("held")).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    y = {i: v for i, _, v in rows}
    assert np.mean([(r["score"] >= 0.5) == y[r["doc_id"]] for r in got if r["held"] and r["doc_id"] in y]) > 0.9
    taught, _ = t.training_rows(docs, labels)
    held = {x for i, x, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not held & {x for x, _ in taught}
    assert t.score_documents(docs.limit(0), labels).count() == 0
    assert len({r["score"] for r in t.score_documents(docs, labels.limit(0)).collect()}) == 1


def test_the_driver_trains_nothing(spark, monkeypatch):
    """The sample's texts and the training are a task's: the driver's memory has room for neither."""
    rows = corpus(60, 5)
    docs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    want, train, driver = t.train(*t.training_rows(docs, labels)), t.train, os.getpid()

    def elsewhere(*args):
        assert os.getpid() != driver
        return train(*args)

    monkeypatch.setattr(t, "train", elsewhere)
    got = t.score_documents(docs, labels).orderBy("doc_id").collect()
    assert np.allclose([r["score"] for r in got], want.scores([x for x, _ in rows]), atol=0.02)  # sums of floats, by as many threads as there are
