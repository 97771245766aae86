import base64
import gzip
import hashlib

import pytest

from offerlake.llm import arcfiles as A


def record(url, stamp, kind, body, version=1, ip="1.2.3.4", length=None):
    size = len(body) if length is None else length
    middle = [kind] if version == 1 else [kind, "404", "abc", "-", "12", "f.arc"]
    return " ".join([url, ip, stamp, *middle, str(size)]).encode() + b"\n" + body + b"\n"


def opening(version):
    block = f"{version} 0 crawl\n{A.V1 if version == 1 else A.V2}\n".encode()
    return f"filedesc://f.arc 0.0.0.0 20010101000000 text/plain {len(block)}\n".encode() + block + b"\n"


HTML = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>1\n\nhttp://x.y/ 1.1.1.1 20010101000000 text/html 5\n</p>"


@pytest.mark.parametrize("version", [1, 2])
def test_every_record_by_its_declared_length(version):
    data = opening(version) + record("http://a.b/", "20010203040506", "text/html", HTML, version) + record("dns:a.b", "20010203", "text/dns", b"", version)
    rows = list(A.convert("f.arc", data))
    assert [r[3] for r in rows] == ["warcinfo", "response", "resource"]
    assert {r[1] for r in rows} == {version} and {r[-1] for r in rows} == {"ok"}
    assert rows[1][5] == "2001-02-03T04:05:06Z" and rows[2][5] == "2001-02-03T00:00:00Z"
    payload = HTML.split(b"\r\n\r\n", 1)[1]
    assert rows[1][11] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert rows[1][12] == 200 and rows[2][12] == (404 if version == 2 else None)
    assert len({r[4] for r in rows}) == 3 and rows == list(A.convert("f.arc", data))


def test_members_of_gzip_and_a_cut_one():
    parts = [opening(1), record("http://a.b/", "20010203040506", "text/html", HTML), record("http://c.d/", "20010203040506", "text/html", HTML)]
    packed = b"".join(map(gzip.compress, parts))
    assert list(A.convert("f", packed)) == list(A.convert("f", b"".join(parts)))
    assert [r[3] for r in A.convert("f", packed[:-20])][:2] == ["warcinfo", "response"]


def test_what_is_no_record():
    good = record("http://a.b/", "20010203040506", "text/html", b"x")
    rows = list(A.convert("f", b"rubbish\nmore rubbish\n" + good + record("http://t.u/", "20010203040506", "text/html", b"yz", length=99)))
    assert [r[-1] for r in rows] == ["malformed", "ok", "truncated"]
    assert rows[0][9] == len(b"rubbish\nmore rubbish\n") and rows[2][9] == 3
    assert [r[-1] for r in A.convert("f", b"")] == ["empty"] == [r[-1] for r in A.convert(None, None)]
    assert A.iso_date("20011301000000") is None and A.iso_date("2001") is None and A.iso_date("2001020304") == "2001-02-03T04:00:00Z"


def test_table_with_nulls_repeats_and_other_columns(spark):
    data = opening(1) + record("http://a b/c", "20010203040506", "text/html", HTML)
    rows = [("f", bytearray(data), "k"), ("f", bytearray(data), "k"), (None, bytearray(data), None), ("g", None, None)]
    df = spark.createDataFrame(rows, "name string, content binary, warc_type string")
    out = A.to_warc(df).collect()
    assert len(out) == 7 and sum(r["state"] == "empty" for r in out) == 1
    assert len({r["warc_record_id"] for r in out if r["warc_type"] == "response"}) == 1
    assert {r["target_uri"] for r in out if r["warc_type"] == "response"} == {"http://a b/c"}
    assert A.to_warc(df.limit(0)).count() == 0


def test_round_trip_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([(0, "http://a.b/", "<p>é</p>"), (51, "http://c d/", ""), (None, None, None), (51, "http://c d/", "")], "page_id bigint, url string, html string")
    arcs = A.archive(pages)
    rows = [r for r in A.to_warc(arcs).collect() if r["warc_type"] != "warcinfo"]
    assert len(rows) == 3 + 0 or {r["state"] for r in rows} <= {"ok", "malformed"}
    assert sorted(r["target_uri"] for r in rows if r["state"] == "ok") == ["http://a.b/", "http://c%20d/", "http://c%20d/"]
    for r in arcs.collect():
        (tmp_path / r["name"]).write_bytes(gzip.compress(bytes(r["content"])))
    again = A.read_arc(spark, str(tmp_path)).filter("state = 'ok'")
    assert sorted(r["warc_record_id"] for r in again.collect()) == sorted(r["warc_record_id"] for r in A.to_warc(arcs).filter("state = 'ok'").collect())


def test_archives_of_hot_numbers_are_cut(spark):
    rows = [(None, f"http://n/{i}", "x") for i in range(200)] + [(3, "http://same/", "y")] * 200 + [(100 + i, f"http://o/{i}", "z") for i in range(20)]
    arcs = A.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(8), per_file=10)
    files = arcs.groupBy("file").count().collect()
    assert {r["file"]: r["count"] > 1 for r in files} == {-1: True, 0: True, 10: False, 11: False}
    assert arcs.select("name").distinct().count() == arcs.count()
    got = sorted(r["target_uri"] for r in A.to_warc(arcs).filter("warc_type = 'response'").collect())
    assert got == sorted(url for _, url, _ in rows)


def test_record_in_warc_form():
    row = dict(zip(A._NAMES, list(A.convert("f", opening(1)))[0], strict=True))
    text = A.warc_record(row, b"block")
    assert text.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"Content-Length: 5\r\n\r\nblock\r\n\r\n")


@pytest.mark.parametrize("version", [1, 2])
def test_malformed_record_lines_keep_their_records(version):
    data = opening(version) + record("", "20010203040506", "text/html", HTML, version) + record("http://a.b/", "20019903", "text/html", b"x", version) + record("http://c.d/", "20010203040506", "text/html", HTML, version)
    rows = list(A.convert("f.arc", data))
    assert [r[-1] for r in rows] == ["ok", "malformed", "malformed", "ok"]
    assert [r[6] for r in rows[1:]] == [None, "http://a.b/", "http://c.d/"] and [r[5] for r in rows[1:3]] == ["2001-02-03T04:05:06Z", None]
    assert rows[1][9] == len(HTML) and rows[1][10] == rows[3][10]


def test_blocks_stand_where_rows_say_and_records_can_be_written(spark):
    data = opening(1) + record("http://a.b/", "20010203040506", "text/html", HTML) + b"rubbish\n"
    df = spark.createDataFrame([("f", bytearray(gzip.compress(data)))], "name string, content binary")
    rows = A.to_warc(df, blocks=True).collect()
    assert [r["state"] for r in rows] == ["ok", "ok", "malformed"] and rows[2]["block"] is None
    for r in rows[:2]:
        block = bytes(r["block"])
        assert block == data[r["block_offset"] : r["block_offset"] + r["content_length"]] and A.digest(block) == r["block_digest"]
        assert A.warc_record(r.asDict(), block).endswith(block + b"\r\n\r\n")
    assert bytes(rows[1]["block"]) == HTML
