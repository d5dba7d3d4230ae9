import base64
import hashlib

import pytest

from priorframe.llm import warc_archive as W

SCHEMA = "page_id long, url string, html string, payload string"
PAGES = [
    (5, "http://a/", "same", "x"), (3, "http://b/\r\nX: y", "same", "x"), (9, None, "same", "x"), (1, "u", None, "x"), (2, "u", "", "x"),
    (7, "é", "WARC/1.1\r\n\r\n\x00\U0001f600" * 2000, "x"), (3, "http://b/\r\nX: y", "same", "x"), (None, "n", "only null", "x"), (None, "n", "same", "x"),
]


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def archive(spark, rows, **options):
    return W.write_archive(spark.createDataFrame(rows, SCHEMA), **options)


def test_round_trip_and_dedup(spark):
    stored = archive(spark, PAGES)
    assert stored.payloads.count() == len({p[2] or "" for p in PAGES})
    got = W.read_archive(stored).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h, _ in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = sorted(str((i, sha(h), "response" if first.get(h or "") == i else "revisit", None if first.get(h or "") == i else first[h or ""], (h or "").encode())) for i, _, h, _ in PAGES)
    assert sorted(str((r.page_id, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))) for r in got) == want


def test_records_are_well_formed(spark):
    for r in W.read_archive(archive(spark, PAGES)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        length = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
        assert length == (len(r.payload) if r.record_type == "response" else 0)
        assert (b"WARC-Refers-To" in fields) == (r.record_type == "revisit")
        if r.record_type == "response":
            assert rest[:length] == bytes(r.payload)
        assert bytes(r.original) == head + b"\r\n\r\n" + bytes(r.payload) + b"\r\n\r\n" and r.payload_bytes == len(r.payload)


def test_short_payloads_are_not_shared(spark):
    got = W.read_archive(archive(spark, PAGES, min_bytes=5)).collect()
    assert all(r.record_type == "response" for r in got if len(r.payload) < 5)


def test_changed_bytes_are_refused(spark):
    stored = archive(spark, PAGES)
    broken = W.Archive(stored.headers, stored.payloads.withColumn("payload", W.F.lit("other").cast("binary")))
    with pytest.raises(Exception, match="does not match digest"):
        W.read_archive(broken).collect()


def test_empty_table(spark):
    assert W.read_archive(archive(spark, [])).collect() == []
