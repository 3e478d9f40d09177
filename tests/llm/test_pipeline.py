import random

import pytest

import corpus_pipeline
from ledgerloom.llm import decontaminate, simhash


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(2000)]
    docs, i = [], 0
    for _ in range(120):
        base = rnd.choices(words, k=rnd.randint(30, 400))
        for _ in range(rnd.choice([1, 1, 2, 3, 6])):
            ws = list(base)
            for _ in range(rnd.randint(0, max(1, len(ws) // 60))):
                ws[rnd.randrange(len(ws))] = rnd.choice(words)
            docs.append((i, " ".join(ws)))
            i += 1
    rnd.shuffle(docs)
    return docs


def test_near_copies_against_brute_force(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    root = {r["doc_id"]: r["root"] for r in simhash.like_groups(df).collect()}
    assert len(root) == len(copies)
    pairs = [(a[0], b[0], jaccard(a[1], b[1])) for k, a in enumerate(copies) for b in copies[k + 1 :]]
    near = [(a, b) for a, b, j in pairs if j >= 0.8]
    assert len(near) > 50 and sum(root[a] == root[b] for a, b in near) >= 0.97 * len(near)
    assert not [1 for a, b, j in pairs if j < 0.3 and root[a] == root[b]]


def test_one_of_each_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "c"), (None, "a b"), (None, "a b"), (6, "x y z " * 20_000), (7, "x y z " * 20_000), (8, "d e"), (8, "d e"), (9, "one text of this id"), (9, "and a wholly other text of it"), (10, "one text of THIS id")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, root int, fp int")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((repr(r["doc_id"]) for r in got.collect()), key=repr) == sorted(["1", "3", "5", "6", "8", "9", "9", "None", "None"], key=repr)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_stages_on_a_small_corpus(spark, tmp_path, copies):
    rnd = random.Random(9)
    item = "every single word of this passage belongs to a test that no model should ever see before it is asked"
    docs = [(i, t, "en", "s", len(t)) for i, t in copies]
    docs += [(5_000 + i, " ".join(rnd.choices(["plain", "words", "of", "no", "harm", "at", "all", f"n{i}", f"m{i}", "here"], k=60)) + (" vilething" * 3 if i % 3 == 0 else ""), "en", "s", 9) for i in range(300)]
    docs += [(9_000, "before it " + item + " and after", "en", "s", 1), (9_001, None, None, None, None), (9_002, "first line that repeats\nown text of nine thousand two", "en", "s", 1), (9_003, "first line that repeats\nanother text of its own", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5_000 + i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = table.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        if name != "packing":
            assert table.columns == columns
            table.write.parquet(f"{tmp_path}/{name}")
            table = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = {r["doc_id"]: r["text"] for r in table.collect()}
    ids = set(seen["toxicity"])
    assert not any(5_000 <= i < 5_300 and (i - 5_000) % 3 == 0 for i in ids)
    assert sum(5_000 <= i < 5_300 for i in ids) >= 195 and {9_000, 9_001, 9_002, 9_003} <= ids
    assert seen["line_dedup"][9_003] == "another text of its own" and set(seen["line_dedup"]) == ids
    left = seen["simhash_dedup"]
    assert len(set(left.values())) == len(left)
    assert set(left) - set(seen["decontamination"]) == {9_000}
    assert not decontaminate.Matcher([(1, 0, decontaminate.normal(item))]).find(decontaminate.normal(" ".join(x or "" for x in seen["decontamination"].values())))
    packed = table.collect()
    assert {r["doc_id"] for r in packed} == set(seen["decontamination"])
    assert sorted((r["doc_id"], r["length"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r["doc_id"], r["length"]) for r in packed)
