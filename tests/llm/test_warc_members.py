"""Archives as others write them: a gzip member a record, other records between, base 32 digests, large payloads."""

import base64
import gzip
import hashlib
import os

import pytest

from fathom.llm import warc


def record(kind, key, payload=b"", **headers):
    block = b"HTTP/1.1 200 OK\r\ncontent-length: %d\r\n\r\n" % len(payload) + (b"" if kind == "revisit" else payload) if kind != "warcinfo" else b"software: x\r\n"
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{key}>", "WARC-Target-URI": f"http://a/{key}", "WARC-Payload-Digest": f"sha1:{sha}"} | headers | {"Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def test_members_are_all_read(spark, tmp_path):
    parts = [record("warcinfo", 0), record("response", 1, "é\r\n\r\nx".encode()), record("revisit", 2, b"abc", **{"WARC-Refers-To": "<urn:page:1>"}), record("revisit", 3, b"abc"), record("response", 4)]
    (tmp_path / "members.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    got = sorted(tuple(r)[:5] + (r.payload,) for r in warc.read_warc(spark, str(tmp_path), True).selectExpr("record_key", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload").collect())
    sha = lambda b: hashlib.sha1(b).hexdigest()
    x = "é\r\n\r\nx".encode()
    want = [(1, "response", None, len(x), sha(x), x.decode()), (2, "revisit", 1, 3, sha(b"abc"), None), (3, "revisit", None, 3, sha(b"abc"), None), (4, "response", None, 0, sha(b""), "")]
    assert sorted(map(str, got)) == sorted(str(w) for w in want for _ in range(3))
    (tmp_path / "bad.warc").write_bytes(parts[1][:-3])
    with pytest.raises(Exception, match="not closed"):
        warc.read_warc(spark, str(tmp_path / "bad.warc")).count()


def test_large_payloads_are_written_apart(spark, tmp_path):
    rows = [(k, "u", "x" * (3 << 20) + str(k)) for k in range(3)] + [(k, "u", "small") for k in range(3, 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    before, warc.FILE_BYTES = warc.FILE_BYTES, 4 << 20
    try:
        warc.write_warc(warc.records(df, "page_id", "url", "html").selectExpr("*", "cast(null as long) as refers_to"), str(tmp_path / "a"))
    finally:
        warc.FILE_BYTES = before
    sizes = [len(gzip.decompress((tmp_path / "a" / f).read_bytes())) for f in os.listdir(tmp_path / "a") if f.endswith(".gz")]
    assert len(sizes) >= 4 and max(sizes) < 4 << 20
    assert {(r.record_key, r.payload_bytes) for r in warc.read_warc(spark, str(tmp_path / "a")).collect()} == {(k, len(h)) for k, _, h in rows}
