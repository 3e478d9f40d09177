import duckdb
import pytest

from ledgerloom.llm import queries

DIR = "/root/testdata/sf0.001"
ROWS = {"op9_warc": "pages", "op10_page_text": "pages"}
COLUMNS = {
    "op1_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op4_decontamination": ["doc_id", "item_id"],
    "op5_winnowing": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_simhash_dedup": ["doc_id", "fingerprint", "component_id"],
    "op7_license_scan": ["doc_id", "n_sentences", "sentence_ids", "licenses"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_page_text": ["page_id", "url", "text", "n_chars"],
}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DIR).toArrow()
    assert got.column_names[: len(COLUMNS[name])] == COLUMNS[name]
    if name in queries.SQL:
        names = sorted(got.column_names)
        rows = lambda t: sorted((tuple(r[n] for n in names) for r in t.to_pylist()), key=repr)
        assert rows(got) == rows(con.execute(queries.SQL[name]).to_arrow_table())
    elif name not in ("op1_best_fit_packing", "op4_decontamination"):
        assert got.num_rows == con.execute(f"SELECT count(*) FROM {ROWS.get(name, 'documents')}").fetchone()[0]


def test_winnowing_tells_edits_from_neighbours(spark):
    rows = queries.QUERIES["op5_winnowing"](spark, DIR).where("n_chars > 100").collect()
    assert sum(r["near_edited"] > 0.3 for r in rows) > 0.95 * len(rows)
    assert sum(r["near_next"] < 0.2 for r in rows) > 0.9 * len(rows)


def test_leaks_hold_every_verbatim_item(spark, con):
    want = {tuple(r) for r in con.execute("SELECT doc_id, item_id FROM documents JOIN benchmark b ON contains(documents.text, b.text)").fetchall()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_decontamination"](spark, DIR).collect()}
    assert want and want <= got
