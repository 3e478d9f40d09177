import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_alias
from ledgerloom.operators import audit, draft, evaluate, interpret, match
from ledgerloom.sources import config, readers, sinks

REGION = "scan_id int, pos long, text string, yc double, x0 double, confidence double, circled boolean, struck boolean"


def page(spark, *regions):
    return spark.createDataFrame([(1, i, t, float(y), float(x), c, circled, struck) for i, (t, y, x, c, circled, struck) in enumerate(regions)], REGION)


def one(t, y, x=0, c=0.9, circled=False, struck=False):
    return (t, y, x, c, circled, struck)


def test_clustering_compares_with_the_running_mean(spark):
    rows = page(spark, *[one(str(y), y) for y in (100, 130, 165, 190, 300)])
    got = interpret.line_features(interpret.cluster_lines(rows)).orderBy("line_idx").collect()
    assert [r["line_text"] for r in got] == ["100 130 165 190", "300"] and got[0]["line_y"] == 146
    edge = page(spark, one("a", 0), one("b", 59.5, 1), one("c", 200), one("d", 260, 1))
    assert [r["line_text"] for r in interpret.line_features(interpret.cluster_lines(edge)).orderBy("line_idx").collect()] == ["a b", "c", "d"]


def test_interpretation_rules(spark):
    rows = page(
        spark,
        one("08", 0, 0), one("Okt", 0, 10), one("2026", 0, 20),
        one("Mbak", 100, 0), one("Tami", 100, 10),
        one("kopi", 200, 0), one("2", 200, 10), one("5000", 200, 20),
        one("gula", 300, 0, struck=True), one("12", 300, 5, circled=True), one("||", 300, 20),
        one("kamis depan", 400),
        one("zz9", 500, c=0.05),
    )
    got = interpret.interpret(rows, 2026).first()
    assert got["date"] is None and got["date_confidence"] == 0.0  # the later date line holds no date
    assert got["customer"]["detected_name"] == "Mbak Tami"
    first, second = got["items"]
    assert (first["detected_text"], first["quantity"], first["price"], first["uncertain_fields"]) == ("kopi", None, 5000.0, ["quantity_missing"])
    assert (second["detected_text"], second["quantity"], second["struck_through"]) == ("gula", 12, True)
    assert second["confidence"] == pytest.approx(0.9) and second["uncertain_fields"] == ["struck_through_excluded"]
    blank = interpret.interpret(page(spark, one("||", 0)), 2026).first()
    assert blank["items"] == [] and blank["total_confidence"] == 0.0


def catalog(spark, names, prices=None):
    return match.catalog(spark.createDataFrame([(i + 1, n, (prices or {}).get(n), None) for i, n in enumerate(names)], "id long, name string, price double, unit string"), "id", "name", "price", "unit")


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def plain_score(t, c):
    """The rule restated, on normalised texts."""
    from collections import Counter

    if not t or not c:
        return 0.0, "no_match"
    if t == c:
        return 1.0, "exact"
    best, how = 0.0, "no_match"
    if len(c) >= 2 and c in t:
        best, how = 0.90, "substring"
    elif len(c) >= 2 and t in c:
        best, how = 0.85, "substring"
    ga, gb = (Counter(s.ljust(3)[i : i + 3] for i in range(max(1, len(s) - 2))) for s in (t, c))
    tri = sum((ga & gb).values()) / sum((ga | gb).values())
    if len(c) <= 5 and tri > 0.4:
        tri = min(1.0, tri + 0.2)
    if tri > best:
        best, how = tri, "trigram"

    def skeleton(s):
        for a, b in [("kh", "k"), ("sy", "s"), ("ch", "c"), ("ng", "n"), ("ny", "n"), ("gh", "g"), ("ts", "c"), ("dj", "j")]:
            s = s.replace(a, b)
        s = "".join(x for x in s if "a" <= x <= "z")
        return s[:1] + "".join(x for x in s[1:] if x not in "aeiou")

    a, b = skeleton(t), skeleton(c)
    sound = 1.0 if a == b == "" else 0.0 if not a or not b else SequenceMatcher(None, a, b).ratio() * min(len(a), len(b)) / max(len(a), len(b))
    if sound > 0.90 and sound * 0.9 > best:
        best, how = sound * 0.9, "phonetic"
    if best < 0.5 and (r := SequenceMatcher(None, t, c).ratio()) > best:
        best, how = r, "levenshtein"
    return best, how


def test_scores_against_the_rule_restated(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("aeikopstngh ", k=rnd.randint(1, 16))).strip()
    ts, cs = {word() for _ in range(40)} | {"kopi", "12"}, {word() for _ in range(40)} | {"kopi susu", "es", "34"}
    a = texts(spark, [t for t in ts if t]).withColumn("a", match.prepared(F.col("text")))
    b = spark.createDataFrame([(c,) for c in cs if c], "name string").withColumn("b", match.prepared(F.col("name")))
    got = {(r["text"], r["name"]): (r["score"], r["method"]) for r in match.with_scores(a.join(b), 0.3).collect()}
    norms = {r["text"]: r["n"] for r in texts(spark, [x for x in ts | cs if x]).select("text", normalize_alias(F.col("text")).alias("n")).collect()}
    for t in filter(None, ts):
        for c in filter(None, cs):
            score, how = plain_score(norms[t], norms[c])
            if score >= 0.3 + 1e-9:
                assert got[t, c] == (pytest.approx(score), how), (t, c)
            elif score < 0.3 - 1e-9:
                assert (t, c) not in got


def test_ranks_and_best_equal_all_pairs(spark):
    """Texts against a catalog: what the bounds leave out is never among the best."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choices("aeioukopstrngh", k=rnd.randint(2, 9)))
    names = sorted({" ".join(word() for _ in range(rnd.randint(1, 3))) for _ in range(150)})

    def mutated(name):
        out = list(name)
        for _ in range(rnd.randint(0, 4)):
            out[rnd.randrange(len(out))] = rnd.choice("aeiou kst")
        return "".join(out).strip() or "a"

    asked = sorted({mutated(rnd.choice(names)) for _ in range(60)} | {"a", "ko", "kopi", "zzzz", names[3]})
    rows = catalog(spark, names)
    norm = {r["text"]: r["n"] for r in texts(spark, sorted(set(asked + names))).select("text", normalize_alias(F.col("text")).alias("n")).collect()}
    every = {t: sorted(((round(plain_score(norm[t], norm[c])[0], 4), -k, c) for k, c in enumerate(names)), reverse=True) for t in asked}
    got = {}
    for r in match.rank(texts(spark, asked), rows, match.RANK_PRODUCT, 3).collect():
        got.setdefault(r["text"], []).append((r["rank"], r["score"], r["name"]))
    for t in asked:
        want = [(s, c) for s, _, c in every[t] if s >= match.RANK_PRODUCT][:3]
        assert [s for _, s, _ in sorted(got.get(t, []))] == pytest.approx([s for s, _ in want], abs=1.1e-4), t
    best = {r["text"]: r["score"] for r in match.best_match(texts(spark, asked), rows).collect()}
    assert all(best[t] == pytest.approx(every[t][0][0] if every[t][0][0] >= match.BEST else 0.0, abs=1.1e-4) for t in asked)


def test_known_matches(spark):
    rows = catalog(spark, ["Kopi", "Indomie Goreng", "Kopi Susu", "Teh Manis"])
    got = {r["text"]: (r["name"], r["score"], r["method"]) for r in match.best_match(texts(spark, ["Kopi", "indomi", "es kopi susu", "qqqq"]), rows).collect()}
    assert got["Kopi"] == ("Kopi", 1.0, "exact") and got["indomi"][0] == "Indomie Goreng" and got["indomi"][1] >= 0.85
    assert "Kopi" in got["es kopi susu"][0] and got["es kopi susu"][1] >= 0.8 and got["qqqq"] == ("", 0.0, "no_match")
    ranked = match.rank(texts(spark, ["tami"]), catalog(spark, ["Mbak Tami", "Pak Budi"]), match.RANK_CUSTOMER, 3).collect()
    assert ranked[0]["name"] == "Mbak Tami" and ranked[0]["score"] >= 0.8


def test_price_boost_and_order_of_equals(spark):
    rows = catalog(spark, ["kopi", "kopi", "kopi susu"], {"kopi": 5000.0, "kopi susu": 7000.0})
    t = spark.createDataFrame([("es kopi", 5100), ("es kopi", 9000)], "text string, price long")
    got = {r["price"]: (r["score"], r["method"]) for r in match.best_match(t, rows, with_price=True).collect()}
    assert got == {5100: (1.0, "substring+price"), 9000: (0.9, "substring")}
    assert [r["id"] for r in match.rank(texts(spark, ["kopi"]), rows, 0.3, 2).orderBy("rank").collect()] == [1, 2]


def test_blocks_of_a_large_catalog(spark, monkeypatch):
    rows = catalog(spark, [f"name {i}" for i in range(50)])
    want = sorted(map(tuple, match.rank(texts(spark, ["name 7", "nam"]), rows, 0.3, 5).collect()))
    monkeypatch.setattr(match, "BLOCK", 12_000)
    assert len(match.blocks(rows)) > 2
    assert sorted(map(tuple, match.rank(texts(spark, ["name 7", "nam"]), rows, 0.3, 5).collect())) == want


def test_cascades(spark):
    rows = catalog(spark, ["Kopi", "Teh", "Madu", "Rokok", "Aqua"])
    got = {r["text"]: (r["name"], r["score"]) for r in match.fuzzy_match(texts(spark, ["Kopi", "kopi", "Kop", "xyz"]), rows).collect()}
    assert got["Kopi"] == got["kopi"] == ("Kopi", 1.0) and got["Kop"][0] == "Kopi" and "xyz" not in got
    fixed = {r["text"]: (r["name"], r["confidence"], r["method"]) for r in match.corrected_names(texts(spark, ["es kopi", "M4du", "zzz"]), rows).collect()}
    assert fixed["es kopi"] == ("Kopi", 0.95, "catalog") and fixed["M4du"][0] == "Madu" and fixed["zzz"] == ("", 0.0, "none")
    assert {r["text"]: r["name"] for r in match.evaluated_match(texts(spark, ["kopi!", "q"]), rows).collect()} == {"kopi!": "Kopi", "q": None}
    assert match.fallback_candidates(texts(spark, ["kp"]), rows).first()["name"] == "Kopi"


def test_draft_total_and_half_even_money(spark):
    rows = spark.createDataFrame(
        [("d", "1", 1, "kopi", 2, 5000.0, 0.9, False, [], 1, "Kopi"), ("d", "2", 2, "gorengan", 4, None, 0.9, False, [], 7, "Gorengan"), ("e", "3", 1, "x", None, 2.5, 0.9, True, ["u"], None, None)],
        "draft_id string, item_id string, pos long, detected_text string, quantity int, price double, confidence double, struck_through boolean, uncertain_fields array<string>, matched_product_id long, matched_product_name string",
    )
    items = draft.apply_product_defaults(draft.draft_items(rows), catalog(spark, ["Kopi", "b", "c", "d", "e", "f", "Gorengan"], {"Gorengan": 2500.0}))
    drafts = spark.createDataFrame([("d", "2026-10-08", 5, "Tami", ""), ("e", None, None, "", ""), ("empty", None, None, "", "")], "draft_id string, date string, customer_id long, customer_name string, notes string")
    got = {r["draft_id"]: r for r in draft.confirm(drafts, items).collect()}
    assert got["d"]["total_amount"] == 20000 and [i["unit_price"] for i in got["d"]["items"]] == [5000, 2500]
    assert got["e"]["total_amount"] == 2 and got["e"]["items"][0]["unit_price"] == 2 and got["e"]["has_unresolved_warnings"]
    assert got["empty"]["total_amount"] == 0 and got["empty"]["items"] == []
    warned = {r["item_id"]: r["warnings"] for r in items.collect()}
    assert warned["3"] == [draft.NO_PRODUCT, draft.NO_QUANTITY, draft.STRUCK, "uncertain_u"]
    body = json.loads(sinks.transaction_body(draft.confirm(drafts, items)).where("draft_id = 'd'").first()["body"])
    assert body["customer_id"] == 5 and body["items"][1]["subtotal"] == 10000


def test_dedup_spans_sections(spark):
    rows = spark.createDataFrame([("a", 0, 0, "Kopi ", "2 kopi"), ("a", 1, 0, "kopi", "2 KOPI"), ("a", 1, 1, "kopi", "3 kopi"), ("b", 0, 0, "kopi", "2 kopi")], "image string, section_pos int, item_pos int, product string, raw_line string")
    assert sorted((r["image"], r["section_pos"], r["item_pos"]) for r in evaluate.dedup_items(rows).collect()) == [("a", 0, 0), ("a", 1, 1), ("b", 0, 0)]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt" / "a.json").write_text(json.dumps({"image": "a.jpg", "date": "08 OKT", "sections": [{"customer": "X", "items": [{"product": "kopi", "quantity": 2, "unit_price": None, "raw_line": "kopi 2"}]}]}))
    (tmp_path / "gt" / "b.json").write_text(json.dumps([{"image": "b.jpg", "customer": "Y", "items": [{"product": "teh", "quantity": 1}]}, {"image": "c.jpg", "error": "503"}]))
    rows = readers.sections(spark, str(tmp_path / "gt"))
    flat = {r["image"]: (r["customer"], r["product"]) for r in evaluate.flatten_sections(readers.without_errors(rows)).collect()}
    assert flat == {"a.jpg": ("X", "kopi"), "b.jpg": ("Y", "teh")}
    (tmp_path / "p.json").write_text('{"products": [{"id": 3, "name": "Kopi", "price": 5000}]}')
    assert [(r["id"], r["default_price"]) for r in readers.catalog(spark, str(tmp_path / "p.json"), []).collect()] == [(3, 5000.0)]
    assert readers.catalog(spark, None, readers.DEFAULT_CUSTOMERS).count() == 5
    log = audit.entries(spark.range(3).withColumn("t", F.lit("x")), "id", F.lit("phase1_ocr"), F.struct("t"), F.lit("2026-10-08 00:00:00").cast("timestamp"))
    sinks.append_audit(log, str(tmp_path / "log"))
    sinks.append_audit(log, str(tmp_path / "log"), enabled=False)
    assert audit.trace(readers.audit_log(spark, str(tmp_path / "log")), "1").count() == 1


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"top_products": 7, "unknown": 1}')
    c = config.load(str(tmp_path / "c.json"), {"LEDGERLOOM_AUDIT_ENABLED": "no", "LEDGERLOOM_TOP_PRODUCTS": "", "LEDGERLOOM_Y_TOLERANCE": "50"})
    assert (c.top_products, c.audit_enabled, c.y_tolerance) == (7, False, 50.0) and config.issues(c) == []
    assert config.choose_engine("tess", ["easyocr", "tesseract-ind"]) == "tesseract-ind" and config.choose_engine("auto", ["tesseract", "claude"]) == "claude"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from ledgerloom.streaming import audit as stream

    def put(name, *minutes):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"timestamp": f"2026-10-08T{10 + m // 60:02d}:{m % 60:02d}:00+00:00", "trace_id": "t", "phase": "phase1_ocr", "data": "{}"}) for m in minutes))

    run = lambda: stream.write(stream.sessions(stream.entries(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    put("a.json", 0, 10, 300)
    run()
    run()
    put("b.json", 600)
    run()
    got = sorted((r["started"].strftime("%H:%M"), r["entries"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("10:00", 2), ("15:00", 1)]

def close_call(spark):
    """One line whose mean confidence is just 0.4: added up in the order of height it is a bit less, in that of the text a bit more."""
    return page(spark, one("33", 0, 20, 0.28, struck=True), one("1254250", 1, 10, 0.46, struck=True), one("1194500", 2, 0, 0.46, struck=True))


def test_item_line_adds_up_by_height(spark):
    assert [r["fate"] for r in interpret.interpreted_lines(close_call(spark), 2026).collect()] == ["uncertain"]


def test_page_adds_up_by_height(spark):
    got = interpret.interpret(close_call(spark), 2026).first()
    assert len(got["items"]) == 0 and len(got["uncertain"]) == 1 and got["total_confidence"] == 0


def test_draft_adds_up_by_height(spark):
    log = draft.create_drafts(interpret.interpret(close_call(spark), 2026)).first()["interpretation_log"]
    assert log["items_before_matching"] == 0 and log["uncertain"] == ["Line 0: '1194500 1254250 33...' — unrecognized content"]


def test_fewer_texts_are_broadcast_to_many_names(spark):
    rows, few = catalog(spark, [f"Customer#{k:09d}" for k in range(match.MANY + 200)]), texts(spark, ["customer#000000007 jr", "zzz"])
    assert match.Sides(few, match.distinct_names(rows)).by_text and not match.Sides(rows.select(rows["name"].alias("text")), match.distinct_names(catalog(spark, ["a"]))).by_text
    assert match.best_match(few.where("text <> 'zzz'"), rows).first()["name"] == "Customer#000000007"


def test_spread_stays_in_the_plan(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        plan = match.spread(texts(spark, ["a", "b"]).select("text").distinct())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert "REPARTITION_BY_NUM" in plan


def test_scored_pairs_hold_no_more_equal_names_than_can_be_ranked(spark):
    pairs = match.scored_pairs(texts(spark, ["kopi"]), catalog(spark, ["kopi"] * 40), 0.3, top=5)
    assert pairs.count() == 5


def test_scan_summary_adds_up_by_pos(spark):
    """A mean of just 0.5: in the order of pos it is 0.5, in the order of the rows a bit less."""
    up = [0.43, 0.95, 0.12]
    assert (0.43 + 0.95 + 0.12) / 3 >= 0.5 > (0.12 + 0.95 + 0.43) / 3
    regions = page(spark, *[one("a", 0, c=c) for c in up])
    for order in ("pos", "-pos"):
        rows = regions.coalesce(1).sortWithinPartitions(F.expr(order))
        got = interpret.scan_summary(rows).first()
        assert (got["n_regions"], got["confidence"], got["status"]) == (3, 0.5, "ok")
    unread = page(spark, one("a", 0, c=None), one("b", 0, c=0.4))
    assert [tuple(r) for r in interpret.scan_summary(unread).collect()] == [(1, 2, 0.4, "uncertain")]
    assert interpret.scan_summary(page(spark, one("a", 0, c=None))).first()["status"] == "no_text_detected"


def test_fallback_asks_bits_first(spark):
    """What is costly isn't asked of every pair, in the join, and no candidate is lost by the bounds."""
    rng = random.Random(5)
    names = ["kopi susu", "es teh", "mie", "a b c d", "a a b", "x", "nasi goreng telur", "  ", "ééé teh"]
    words = ["kp", "ks", "teh", "b a", "x", "", " ", "mie mie", "nasi", "é teh", "A a", "d c b a", *["".join(rng.choice("akopise mtéx") for _ in range(rng.randint(1, 9))) for _ in range(60)]]
    asked, rows = texts(spark, words), catalog(spark, names)
    got = match.fallback_candidates(asked, rows, 99)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("lambda" in line for line in joins)
    low, name = F.trim(F.lower("text")), F.lower("name")
    pairs = asked.distinct().crossJoin(rows.where("name <> ''").select("name", "id"))
    own = {(r["text"], r["id"]): (r["s"], r["t"]) for r in pairs.select("text", "id", match.subsequence_score(low, name).alias("s"), match.token_share(low, name).alias("t")).collect()}
    want = {}
    for (t, k), (s, share) in own.items():
        score = max(s, 0.7 * share, 0.8 * SequenceMatcher(None, t.lower().strip(" "), names[k - 1].lower()).ratio())
        if score > 0.35:
            want[t, k] = round(score, 4)
    assert {(r["text"], r["id"]): r["score"] for r in got.collect()} == pytest.approx(want, abs=2e-4)
