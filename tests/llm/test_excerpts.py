import random

from ledgerloom.llm import decontaminate as d

LEAST = d.EXCERPT + d.EXCERPT_STEP - 1


def item_text(rnd, n):
    return d.normal(" ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(n)))


def test_excerpts_at_all_offsets_are_found(spark):
    rnd = random.Random(1)
    items = [item_text(rnd, n) for n in (12, 15, 22, 40, 70)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    (matcher,) = [m() for m in d.matchers(bench)]
    for item, text in enumerate(items):
        assert len(text) > d.EXCERPT + d.EXCERPT_STEP // 2
        for size in (LEAST, LEAST + 7, 100):
            for at in range(len(text) - size + 1):
                hits = matcher.find("own words before " + text[at : at + size] + " and own words after")
                assert any(h[0][0] == item and h[4] == 0 for h in hits), (item, size, at)


def test_all_texts_of_an_item_count(spark):
    rnd = random.Random(2)
    texts = [item_text(rnd, n) for n in (40, 14, 25)]
    bench = spark.createDataFrame([(1, t) for t in [*texts, texts[0].upper()]] + [(2, "x y z " * 4)], "item_id long, text string")
    parts = d.benchmark_parts(bench).collect()
    assert len({p[:3] for p in parts}) == len(parts) and sum(p[0] == 1 for p in parts) == sum(len(d.segments(t) + d.excerpts(t)) for t in texts)
    docs = spark.createDataFrame([(i, "before it " + t + " and after") for i, t in enumerate(texts)] + [(9, "clean")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, bench).collect()} == {(0, 1), (1, 1), (2, 1)}
    assert [r["doc_id"] for r in d.clean_documents(docs, bench).collect()] == [9]
