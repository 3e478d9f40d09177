import gzip
import random

import pytest

from ledgerloom.llm import warc


def test_record_round_trip():
    raw = warc.record(3, "http://a/\r\nX: y", "é\r\n\r\nWARC/1.1".encode(), "D", None)
    told, block = warc.parse(raw)
    assert block == "é\r\n\r\nWARC/1.1".encode() and told["warc-type"] == "response" and told["warc-target-uri"] == "http://a/ X: y"
    told, block = warc.parse(warc.record(4, "u", b"body", "D", 3))
    assert block == b"" and told["warc-type"] == "revisit" and told["warc-x-refers-to-page"] == "3" and told["warc-x-payload-length"] == "4"


def test_coalesced_ranges():
    far = 10 * warc.MOST
    ranges = [(0, 10), (10, 5), (15 + warc.GAP, 5), (far, 2 * warc.MOST), (far + 2 * warc.MOST, 4)]
    assert [(a, b) for _, _, a, b in warc.coalesced(ranges)] == [(0, 3), (3, 4), (4, 5)]
    assert list(warc.coalesced([])) == []


def test_round_trip_selection_and_edges(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(i, f"http://h/{i}", rnd.choice(["same", "", None, f"own {i} é", "long " * rnd.randint(0, 9000)]), 1) for i in range(400)]
    rows += [(None, "http://null", "nobody's", 1), (500, None, "x", 1), (500, None, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(5)
    index = warc.write(pages, f"file://{tmp_path}/w")
    got = warc.read(index).collect()
    assert len(got) == len(rows)
    text = {i: (h or "").encode() for i, _, h, _ in rows}
    first = {}
    for i, p in text.items():
        if i is not None:
            first[p] = min(i, first.get(p, i))
    for r in got:
        p = text[r["page_id"]]
        assert r["payload_bytes"] == len(p) and r["payload_digest"] == warc.digest_of(p)
        lead = first.get(p)
        if lead in (None, r["page_id"]):
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("response", None, p)
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", lead, b"")
    some = warc.read(index.where("page_id % 7 = 3")).collect()
    assert sorted(r["page_id"] for r in some) == [i for i in range(400) if i % 7 == 3] + [500, 500]
    assert warc.archive_pages(pages.limit(0)).count() == 0
    # The archives are what other readers take: gzip members one after the other.
    archive = next((tmp_path / "w").iterdir())
    assert gzip.decompress(archive.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_damage_is_told(spark, tmp_path):
    index = warc.write(spark.createDataFrame([(1, "u", "abcdef")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    archive = next((tmp_path / "w").iterdir())
    archive.write_bytes(warc.record(1, "u", b"other", warc.digest_of(b"abcdef"), None).ljust(index.first()["length"], b"\0")[: index.first()["length"]])
    with pytest.raises(Exception):
        warc.read(index).collect()
