import random

from ledgerloom.llm import decontaminate as d


def distance_table(pattern, text):
    """Least edit distance of the pattern to substrings of the text that end at each place."""
    row = list(range(len(pattern) + 1))
    out = []
    for c in text:
        prev, row = row, [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(prev[i] + 1, row[-1] + 1, prev[i - 1] + (p != c)))
        out.append(row[-1])
    return out


def edit(text, n, rnd):
    out = list(text)
    for _ in range(n):
        at, kind = rnd.randrange(len(out)), rnd.randrange(3)
        if kind == 0:
            out[at] = rnd.choice("abcxyz ")
        elif kind == 1:
            out.insert(at, rnd.choice("abcxyz "))
        else:
            del out[at]
    return "".join(out)


def test_myers_equals_the_table():
    rnd = random.Random(1)
    for _ in range(200):
        p = "".join(rnd.choices("abc ", k=rnd.randint(1, 90)))
        t = "".join(rnd.choices("abc ", k=rnd.randint(0, 120)))
        want = min([len(p), *distance_table(p, t)])
        assert d.Pattern(p).best_in(t)[0] == want


def test_every_passage_within_the_budget_is_found():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(300)]
    text = lambda n: d.normal(" ".join(rnd.choice(words) for _ in range(n)))
    items = [text(rnd.randint(3, 40)) for _ in range(30)]
    parts = [(i, k, s) for i, t in enumerate(items) for k, s in enumerate(d.segments(t))]
    matcher = d.Matcher(parts)
    for item, k, segment in parts:
        p = d.Pattern(segment)
        passage = edit(segment, rnd.randint(0, p.errors), rnd)
        doc = d.normal(text(60) + " " + passage + " " + text(60))
        if min(distance_table(segment, doc)) <= p.errors:
            hits = [h for h in matcher.find(doc) if h[:2] == (item, k)]
            assert hits and all(h[4] <= p.errors for h in hits)
            assert min(h[4] for h in hits) == min(distance_table(segment, doc))
            i, _, start, stop, dist = min(hits, key=lambda h: h[4])
            assert distance_table(segment, doc[start:stop])[-1] <= dist or dist == min(distance_table(segment, doc[start:stop]))


def test_clean_texts_stay_clean():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    m = d.Matcher([(i, 0, " ".join(word() for _ in range(14))) for i in range(50)])
    assert not any(m.find(" ".join(word() for _ in range(500))) for _ in range(50))


def test_segments_cover_long_items():
    t = "".join(map(chr, range(200, 700)))
    parts = d.segments(t)
    assert all(len(p) == d.SEGMENT for p in parts) and parts[0] == t[: d.SEGMENT] and parts[-1] == t[-d.SEGMENT :]
    assert set(t) == set("".join(parts)) and d.segments("") == [] and d.segments("ab") == ["ab"]


def test_edges(spark):
    item = "this is the test item that nobody should have seen before the day of the exam in june " * 2
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (None, "foo", 0), (3, "", 0)], "item_id long, text string, doc_id int")
    docs = [(1, None), (2, ""), (3, "x " * 90_000 + item.upper().replace(" ", " \n") + "y"), (None, "a" + item), (4, "clean"), (3, "x " * 90_000 + item + "y"), (5, item[:100])]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(3)
    got = d.find_leaks(df, bench).collect()
    assert {r["doc_id"] for r in got} == {3, None, 5} and {r["item_id"] for r in got} == {1}
    assert all(r["distance"] == 0 for r in got if r["doc_id"] != 5)
    assert d.find_leaks(df.limit(0), bench).count() == 0 and d.find_leaks(df, bench.limit(0)).count() == 0


def test_blocks_of_a_large_benchmark_equal_one(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(n))
    items = [(k % 12, text(rnd.randint(3, 40))) for k in range(20)]
    docs = [(i, text(30) + " " + (edit(items[i % 20][1], 2, rnd) if i % 3 else "") + " " + text(9)) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    whole = sorted(map(tuple, d.find_leaks(df, bench).collect()))
    assert len(list(d.matchers(bench, 2_000))) > 4 and sorted(map(tuple, d.find_leaks(df, bench, 2_000).collect())) == whole
    # Every segment of every text, against the table of distances.
    within = {(i, item) for i, t in docs for item, x in items for s in d.segments(d.normal(x)) if min([len(s), *distance_table(s, d.normal(t))]) <= d.budget(len(s))}
    assert within and within <= {(r[0], r[1]) for r in whole}
    clean = {r["doc_id"] for r in d.clean_documents(df, bench, 2_000).collect()}
    assert clean == {r["doc_id"] for r in d.clean_documents(df, bench).collect()} == {i for i, _ in docs} - {r[0] for r in whole}


def test_two_texts_of_one_item(spark):
    texts = ["the first text of the item asks for the name of a town", "an answer that nobody could guess from it stands in the second"]
    bench = spark.createDataFrame([(7, t) for t in texts], "item_id long, text string")
    docs = spark.createDataFrame([(i, "x " + t + " y") for i, t in enumerate(texts)], "doc_id long, text string")
    got = d.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, 7), (1, 7)} and len({r["text_key"] for r in got}) == 2
