import base64
import hashlib

import pytest

import cases
from tidemark.llm import common, warc

F = cases.F
BIG = "<p>é</p>" * 9000
PAGES = [(4, "u4", "same"), (2, "u 2\r\nx", "same"), (2, "u2", "same"), (7, None, None), (8, "u8", ""), (9, "u9", BIG), (3, "u3", BIG), (None, "un", "same"), (5, "u5", "alone\r\n0\r\n\r\n")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("__sha", F.lit("x")).repartition(3)


def brute(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        text = html or ""
        if page_id is not None and len(text.encode()) >= least:
            first[text] = min(page_id, first.get(text, page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html or "")
        revisit = page_id is not None and refers is not None and page_id > refers
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", refers if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize("least,segment", [(0, 16 << 10), (5, 100), (1 << 30, 1)])
def test_awkward_rows(spark, least, segment):
    rows = PAGES if segment > 1 else PAGES[:3]
    files = warc.write_pages(pages(spark, rows), common.fresh_dir(spark, "warc"), least, segment)
    got = warc.read_pages(files)
    assert found(got) == brute(rows, least)
    assert {r.payload.decode() for r in got.collect() if r.payload is not None} == {h or "" for _, _, h in rows}


@pytest.mark.parametrize("rows", [0, 500_000])
def test_revisits_name_real_records(spark, monkeypatch, rows):
    """Every WARC-Refers-To is the WARC-Record-ID of a response with the same digest; identifiers are unlike each other."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", rows)
    files = warc.write_pages(pages(spark), common.fresh_dir(spark, "warc"), segment_bytes=1000).collect()
    found = []
    for f in files:
        with open(f.path.removeprefix("file://"), "rb") as source:
            found += list(warc.records(source))
    ids = {f["warc-record-id"]: f for f, _ in found}
    assert len(ids) == len(found)
    revisits = [f for f, _ in found if f["warc-type"] == "revisit"]
    assert len(revisits) == 3
    for f in revisits:
        first = ids[f["warc-refers-to"]]
        assert first["warc-type"] == "response" and first["warc-payload-digest"] == f["warc-payload-digest"]
    for f, _ in found:
        if f["warc-type"] == "continuation":
            assert ids[f["warc-segment-origin-id"]]["warc-segment-number"] == "1"


def test_empty_table(spark):
    assert warc.read_pages(warc.write_pages(pages(spark, []), common.fresh_dir(spark, "warc"))).count() == 0


def test_query(spark, small):
    rows = [tuple(r) for r in cases.table(spark, small, "pages").select("page_id", "url", "html").collect()]
    assert found(warc.op4_warc(spark, small)) == brute(rows)


def test_a_missing_segment_is_an_error(spark):
    files = warc.write_pages(pages(spark, [(1, "u", BIG)]), common.fresh_dir(spark, "warc"), segment_bytes=1000)
    records = warc.read_records(files).filter("number != 3")
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(records).collect()


def test_chunked_framing():
    body = bytes(range(256)) * 50
    assert warc.unchunked(warc.chunked(body, 333)) == body and warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
