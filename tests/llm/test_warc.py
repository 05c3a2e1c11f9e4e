import hashlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import warc

FAKE = warc.record("response", [("X-Page-Id", 5), ("WARC-Payload-Digest", "sha1:0")], b"abc").decode()


def pages():
    rows = [(i, f"http://h{i % 5}.example/{i}", f"<p>{i} " + "words " * (i * 37 % 400)) for i in range(150)]
    rows += [(1000 + i, "http://copy.example/", "q" * 1200) for i in range(20)]
    rows += [(2000 + i, "http://short.example/", "q" * 999) for i in range(5)]
    rows += [(3000, "a\r\nWARC/1.1\r\nWARC-Type: response", "x" * 500 + FAKE + "y" * 600 + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 70\r\n\r\n" + "z" * 2000)]
    rows += [(3001, None, None), (3002, "", ""), (None, "u", "w" * 1500), (None, "u", "w" * 1500), (None, "u", "q" * 1200), (1019, "again", "q" * 1200)]
    rows += [(3003, "é", "é" * 600), (3004, "é", "é" * 499)]
    return rows


def expected(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for body, ids in groups.items():
        last = max((i for i in ids if i is not None), default=None)
        for i in ids:
            revisit = len(body) >= 1000 and last is not None and (i is None or i < last)
            out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return Counter(out)


@pytest.mark.parametrize(("file_bytes", "split_bytes"), [(warc.FILE_BYTES, warc.SPLIT_BYTES), (60_000, 1_000), (2_000, 500)])
def test_round_trip(spark, file_bytes, split_bytes):
    df = spark.createDataFrame([(*r, "x", 1) for r in pages()], "page_id long, url string, html string, digest string, size int").repartition(3)
    found = warc.warc_round_trip(df, None, file_bytes, split_bytes).collect()
    assert Counter(tuple(r) for r in found) == expected(pages())


def test_a_broken_chain_is_an_error(spark, tmp_path):
    whole = warc.record("warcinfo", [], b"a") + warc.page_record({"page_id": 1, "url": "u", "html": b"abc", "digest": hashlib.sha1(b"abc").hexdigest(), "size": 3, "record_type": "response", "refers_to": None})
    (tmp_path / "a.warc").write_bytes(whole + b"torn")
    manifest = spark.createDataFrame([("a.warc", len(whole) + 4)], "file string, size long")
    with pytest.raises(ValueError, match="no chain"):
        warc.read_archives(manifest, f"file://{tmp_path}", f"file://{tmp_path}/work").collect()


def test_a_damaged_payload_is_an_error(spark, tmp_path):
    bad = warc.page_record({"page_id": 1, "url": "u", "html": b"abd", "digest": hashlib.sha1(b"abc").hexdigest(), "size": 3, "record_type": "response", "refers_to": None})
    (tmp_path / "a.warc").write_bytes(bad)
    manifest = spark.createDataFrame([("a.warc", len(bad))], "file string, size long")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archives(manifest, f"file://{tmp_path}", f"file://{tmp_path}/work").collect()


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("split_bytes", [warc.SPLIT_BYTES, 100_000, 1_000])
def test_a_url_longer_than_the_window(spark, split_bytes):
    rows = [*pages(), (4000, "data:" + "u" * 300_000, "x" * 2000), (4001, "v" * 70_000 + "WARC/1.1", ""), (4002, "w", "WARC/1.1\r\n" * 300 + "a" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = warc.warc_round_trip(df, None, 500_000, split_bytes).collect()
    assert Counter(tuple(r) for r in found) == expected(rows)


def test_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(3)
    assert Counter(tuple(r) for r in warc.warc_round_trip(df).collect()) == expected(pages())


def test_payloads_of_false_headers_are_not_read(tmp_path):
    """Very many headers in one payload, each with a length that fits the file: offsets alone are collected."""
    import io
    import time

    inner = b"".join(warc.record("response", [("X-Page-Id", i), ("WARC-Payload-Digest", "sha1:0")], b"x" * 40) for i in range(20_000))
    page = {"page_id": 1, "url": "u", "html": inner, "digest": hashlib.sha1(inner).hexdigest(), "size": len(inner), "record_type": "response", "refers_to": None}
    raw = warc.page_record(page) + b" " * 9_000_000
    began = time.process_time()
    offsets, successors = warc.split_candidates(io.BytesIO(raw), len(raw), 0, len(raw))
    assert len(offsets) == 20_001 and time.process_time() - began < 5
    assert warc.page_of(io.BytesIO(raw), offsets[0], successors[0], len(raw))["payload_digest"] == page["digest"]
