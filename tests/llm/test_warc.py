import base64
import hashlib
import io

import pytest

from concordat.llm import warc
from concordat.llm.shared import scratch

PAGES = [
    (1, "http://a/1", "<p>x</p>"),
    (2, "http://a/2", "<p>x</p>"),
    (5, None, "<p>x</p>"),
    (5, "http://a/again", "<p>x</p>"),
    (None, "http://a/none", "<p>x</p>"),
    (3, "http://a/3", None),
    (4, "http://a/4", ""),
    (6, "bad url\r\nWARC-Type: evil", "ünï\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (7, "http://a/7", "y" * 3_000_000),
    (None, "http://a/alone", "only here"),
]


def table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, payload string, payload_digest string")


def run(spark, pages, **kw):
    manifest = warc.write_archives(warc.with_roles(pages, **kw), scratch(spark, "w"), file_bytes=400)
    return warc.resolve_revisits(warc.read_archives(spark, manifest)), manifest


def brute(rows, min_bytes=0):
    groups = {}
    for page_id, _, html in rows:
        p = (html or "").encode()
        if page_id is not None and len(p) >= min_bytes:
            groups[p] = max(page_id, groups.get(p, page_id))
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        first = groups.get(p)
        again = first is not None and page_id != first
        out.append((page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_revisits_against_brute_force(spark, min_bytes):
    got, manifest = run(spark, table(spark), min_bytes=min_bytes)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.select(cols).collect()), key=repr) == brute(PAGES, min_bytes)
    assert manifest.count() > 1


def test_payloads_come_back_whole(spark):
    _, manifest = run(spark, table(spark))
    got = {r.page_id: r.payload for r in warc.read_archives(spark, manifest, payload=True).filter("record_type = 'response'").collect()}
    assert got[7] == "y" * 3_000_000
    assert got[6] == PAGES[7][2]


def test_empty_table(spark):
    got, _ = run(spark, table(spark).filter("false"))
    assert got.count() == 0


def test_torn_archive_is_an_error():
    import gzip

    data = gzip.compress(warc.encode_record(1, "u", b"abc", "D", "response", None, "2024-01-01T00:00:00Z"))
    assert len(list(warc.iterate_records(io.BytesIO(data)))) == 1
    with pytest.raises(EOFError):
        list(warc.iterate_records(io.BytesIO(data[:-9])))
