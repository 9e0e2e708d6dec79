import hashlib

import duckdb

from cohortspark.llm import warc


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    found = warc.op3_warc(spark, sf_dir)
    columns = sorted(found.columns)
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(con.sql(f"select {', '.join(columns)} from ({warc.OP3_SQL})").fetchall())


def test_plain_text():
    page = "<html><head><title>T</title></head><body><!-- a <p> --><script>var t='<p>';</script><h1>A &amp;amp; B</h1><p>one<br>two&nbsp;x &lt;b&gt;</p>3 < 4 &#169;<p class='x'"
    assert warc.plain_text(page) == "A &amp; B\none\ntwo x <b>\n3 < 4 ©"
    assert warc.plain_text("") == "" and warc.plain_text("<style>p{}") == ""


def parsed(text):
    """A record read back: (headers, block)."""
    head, rest = text.split("\r\n\r\n", 1)
    version, *lines = head.split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest.encode()[: int(headers["Content-Length"])].decode()
    assert version == "WARC/1.1" and rest == block + "\r\n\r\n"
    return headers, block


def test_records_link_and_read_back(spark, sf_dir):
    sources = warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    by_id = {r.record_id: r for r in sources.collect()}
    records = warc.derive(sources)
    rows = records.withColumn("text", warc.record_text(records)).collect()
    assert len(rows) == 2 * len(by_id) == 2 * len({r.page_id for r in rows})
    for r in rows:
        headers, block = parsed(r.text)
        source = by_id[headers["WARC-Refers-To"]]
        assert headers["WARC-Target-URI"] == source.target_uri and headers["WARC-Source-Payload-Digest"] == source.payload_digest
        assert r.source_headers == source.headers and headers["WARC-Date"] == source.date
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block.encode()).hexdigest() and block == r.block
        assert source.payload_digest == "sha256:" + hashlib.sha256(source.payload.encode()).hexdigest()


def test_odd_pages(spark):
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (2, None, None), (None, "http://b/", ""), (3, "u", "y" * 300_000), (4, "v", "<a href=\"q\ns\">")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    found = warc.derive(warc.responses(frame)).collect()
    assert len(found) == 12 and len({r.record_id for r in found}) == 10
    assert warc.derive(warc.responses(frame.limit(0))).count() == 0
    assert [r.block for r in found if r.page_id == "2"] == ["outlinks: 0\r\n", ""]
    assert "outlink: q s\r\n" in [r.block for r in found if r.page_id == "4"][0]
