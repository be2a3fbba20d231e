import hashlib
import os
import zlib

from tallyframe.llm import warc

HTML = "<html>" + "é page " * 40 + "</html>"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 7) for i, u, h in rows], "page_id long, url string, html string, digest string, bytes long")


def test_round_trip_with_revisits(spark, tmp_path):
    rows = [(5, "http://a", HTML), (2, "http://b", HTML), (9, None, HTML), (3, "http://c", "small"), (4, "http://d", "small"), (6, "http://e", None), (None, "http://f", HTML)]
    got = {r.page_id: r for r in warc.archive_pages(pages(spark, rows), str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(r.verified for r in got.values())
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
        if got[i].record_type == "response":
            assert got[i].payload == data
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if i in (2, 3, 4, 5, 9)} == {
        2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("revisit", 2), 9: ("revisit", 2),
    }
    assert warc.archive_pages(pages(spark, []), str(tmp_path / "none")).count() == 0


def test_every_split_size_reads_each_record_once(tmp_path):
    """Records are owned by the range they start in, also when payloads hold the gzip magic."""
    members = []
    for i in range(12):
        body = os.urandom(300) + warc.MAGIC + os.urandom(40 * i)
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode()
        z = zlib.compressobj(0 if i % 2 else 6, zlib.DEFLATED, 31)
        members.append(z.compress(head + block + b"\r\n\r\n") + z.flush())
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    for step in (50, 333, 1000, size):
        ids = [f["warc-record-id"] for lo in range(0, size, step) for f, _ in warc.records_in(str(path), lo, lo + step)]
        assert ids == [f"<urn:page:{i}>" for i in range(12)]


def test_split_archives_in_spark(spark, tmp_path):
    rows = [(i, f"http://h/{i}", HTML + str(i)) for i in range(60)]
    files = warc.write_archives(warc.plan_records(pages(spark, rows)), str(tmp_path))
    got = warc.read_archives(files, split_bytes=300)
    assert sorted(r.page_id for r in got.collect()) == list(range(60))


def test_pages_with_very_long_urls_are_read_back(spark, tmp_path):
    long = "data:text/plain;base64," + os.urandom(2_000_000).hex()
    rows = [(1, "http://a", HTML), (2, "http://b/" + "x" * 70_000, HTML + "2"), (3, long, HTML + "3"), (4, "http://c", HTML + "4")]
    files = warc.write_archives(warc.plan_records(pages(spark, rows)), str(tmp_path))
    for step in (warc.SPLIT_BYTES, 500_000):
        got = {r.page_id: r.url for r in warc.read_archives(files, split_bytes=step).collect()}
        assert got == {i: url for i, url, _ in rows}
