import gzip
import hashlib

import pytest

from helixframe.llm import warc

HTML = ["<p>short</p>", "<p>" + "long " * 400 + "</p>", "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n" + "é語" * 700, "", None, "http://x 0.0.0.0 20200101000000 text/html 5\nhello"]


def expected(rows):
    best = {}
    for page, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            best[data] = max(best.get(data, page), page)
    return sorted((p, len(d := (h or "").encode()), hashlib.sha1(d).hexdigest(), *(("revisit", best[d]) if d in best and best[d] != p else ("response", None))) for p, h in rows)


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    rows = [(i, HTML[i % len(HTML)]) for i in range(40)]
    df = spark.createDataFrame([(p, f"http://example.com/a b/{p}", h, "x") for p, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(tuple(r) for r in warc.archive(df, version=version).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == expected(rows)


def test_odd_tables(spark):
    schema = "page_id long, url string, html string"
    assert warc.archive(spark.createDataFrame([], schema)).collect() == []
    rows = warc.archive(spark.createDataFrame([(7, None, HTML[1]), (7, None, HTML[1]), (None, "u", HTML[1]), (None, "u", "x")], schema)).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in rows) == [(0, "response"), (0, "revisit"), (7, "response"), (7, "response")]


def test_arc_by_declared_lengths():
    body = "line one\nhttp://fake 0.0.0.0 20200101000000 text/html 3\n"
    text = "".join([warc.arc_start(1) + "\n", warc.arc_record(1, 1, "http://a", body) + "\n", warc.arc_record(1, 2, "http://b", "") + "\n"])
    for data in (text.encode(), gzip.compress(text.encode()), gzip.compress(text[:100].encode()) + gzip.compress(text[100:].encode())):
        found = [(f["URL"], warc.split_http(b)[2].decode()) for f, b in warc.read_arc(data)]
        assert found == [("http://a", body), ("http://b", "")]
    with pytest.raises(ValueError, match="declares"):
        list(warc.read_arc(text.encode()[:-3]))
    with pytest.raises(ValueError, match="fields"):
        list(warc.read_arc(b"http://a b c\n"))


def test_warc_headers():
    record = warc.warc_record({"page_id": 3, "url": "http://a", "date": "202001021314", "http_head": "HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\n", "payload": "hé", "digest": warc.sha1_base32("hé".encode())})
    (headers, block), = warc.read_warc((record + warc.SEPARATOR).encode())
    assert headers["warc-type"] == "response" and headers["warc-date"] == "2020-01-02T13:14:00Z" and block.endswith("hé".encode())
    assert headers["warc-record-id"] == warc.record_id(3, "http://a", "202001021314")
    assert warc.warc_date("nonsense") == "2020-01-01T00:00:00Z"
