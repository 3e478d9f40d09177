"""WARC archives, index first.

Each task writes its records as gzip members into one archive in a shared folder and returns an index row for each record (archive,
offset, length, URL, digest). The index is checkpointed, so it names the archives of the task attempts that counted; what a lost
attempt has written is never named. Readers take any selection of index rows, sort it by offset, coalesce neighbouring
ranges and read those only. Payload digests decide before writing which record is a response and which revisit it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import HOT_KEYS, checkpoint, frame, long_ids, shared_dir, small_batches, text_or_empty

INDEX = "page_id long, url string, archive string, chunk long, offset long, length long, digest string, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Reads: the gap that is read along, and the most that one read takes (a longer record is read alone).
GAP, MOST = 64 << 10, 8 << 20
#: Records of one archive that one task reads back.
CHUNK = 16 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def header_value(text: str) -> str:
    """Header values hold no line ends."""
    return " ".join(text.split())


def record(page: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit of page ``first`` unless that is None."""
    name = "" if page is None else str(page)
    body = payload if first is None else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{url}')}>",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-X-Page: {name}",
        f"WARC-X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-X-Refers-To-Page: {first}"]
    return gzip.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of the record in a gzip member."""
    told = gzip.decompress(raw)
    head, _, rest = told.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def firsts(pages: DataFrame) -> DataFrame:
    """pages (page, url, html) with sha (of the payload) and first: the smallest page id of the payloads equal to it, or null.

    Hot payloads, by the pigeonhole rule at most HOT_KEYS, are told by a broadcast list and the others by a join; both know the
    payload by digest and length.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8"))).withColumn("size", F.octet_length("html"))
    groups = checkpoint(rows.groupBy("sha", "size").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    many = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") >= max(64, many // HOT_KEYS + 1)
    hot, rest = groups.where(is_hot).select("sha", "size", "first"), groups.where(~is_hot).select("sha", "size", F.col("first").alias("other"))
    return rows.join(F.broadcast(hot), ["sha", "size"], "left").join(rest, ["sha", "size"], "left").withColumn("first", F.coalesce("first", "other")).drop("other")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html; more columns are ignored) into archives under folder, a URI; returns their index.

    Null html or url: empty. Null page_id: a response, unless another row has its payload. Repeated rows of one page_id: the
    record that comes first of those is written as a response and so is each other. Very long payloads: one record each, which a
    worker holds whole. An empty table writes nothing. Archives are what a user asks for, so nothing here removes them.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, sink, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for rows in batches:
                out = []
                for page, url, html, first in zip(rows["page"], rows["url"], rows["html"], rows["first"], strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    page, first = (None if x is None else int(x) for x in (page, first))
                    again = first is not None and first != page
                    digest = digest_of(payload)
                    raw = record(page, url, payload, digest, first if again else None)
                    if sink is None:
                        system, path = opened(where)
                        system.create_dir(path.rpartition("/")[0], recursive=True)
                        sink = system.open_output_stream(path, compression=None)
                    sink.write(raw)
                    out.append((page, url, where, at // CHUNK, at, len(raw), digest, "revisit" if again else "response"))
                    at += len(raw)
                yield frame(out, INDEX)
        finally:
            if sink is not None:
                sink.close()

    small_batches(pages.sparkSession)
    rows = firsts(pages).select(F.col("page").cast("string").alias("page"), "url", "html", F.col("first").cast("string").alias("first"))
    return checkpoint(rows.mapInPandas(put, INDEX))


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(start, stop, from, to): byte ranges to read, and which of the sorted (offset, length) ranges each holds."""
    begin = 0
    for i in range(1, len(ranges) + 1):
        stop = ranges[i - 1][0] + ranges[i - 1][1]
        if i == len(ranges) or ranges[i][0] - stop > GAP or ranges[i][0] + ranges[i][1] - ranges[begin][0] > MOST:
            yield ranges[begin][0], stop, begin, i
            begin = i


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records of the index rows; payload is that of the record's block (empty for revisits), or null without payloads.

    A record longer than MOST bytes is read alone, whole. Null page ids and repeated rows of the index come back as they are, an empty
    payload as an empty block, and an empty index as no row. More columns of the index are ignored.
    """

    def get(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ranges, out = list(zip(rows["offset"].tolist(), rows["length"].tolist(), strict=True)), []
        system, path = opened(rows["archive"].iloc[0])
        with system.open_input_file(path) as source:
            for start, stop, a, b in coalesced(ranges):
                source.seek(start)
                raw = source.read(stop - start)
                for offset, length in ranges[a:b]:
                    told, block = parse(raw[offset - start : offset - start + length])
                    digest = told["warc-payload-digest"].removeprefix("sha1:")
                    if told["warc-type"] == "response" and digest_of(block) != digest:
                        raise ValueError(f"damaged record at {offset} of {path}")
                    page, to = told["warc-x-page"], told.get("warc-x-refers-to-page")
                    out.append((int(page) if page else None, told["warc-target-uri"], int(told["warc-x-payload-length"]), digest, told["warc-type"], int(to) if to else None, block if payloads else None))
        return frame(out, READ).assign(refers_to=long_ids(r[5] for r in out))

    return index.groupBy("archive", "chunk").applyInPandas(get, READ)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as WARC and read every record back; see write() and read()."""
    place = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, place), payloads=False)
