from __future__ import annotations

import hashlib
import struct

from oracle import assert_same, connect

from barloom.llm import oracles, queries, warc

SCHEMA = "page_id long, url string, html string, digest string, first int"
BIG, SMALL = "<p>" + "é text " * 40, "tiny"
ROWS = [(5, "http://a/", BIG, "x", 1), (3, "http://b/\r\nX: y", BIG, "x", 1), (9, None, BIG, "x", 1), (4, "u", SMALL, "x", 1), (7, "u", SMALL, "x", 1), (8, "u", None, "x", 1), (2, "u", "", "x", 1), (None, "u", BIG, "x", 1)]


def test_matches_sql(spark, sf_dir):
    name = "op10_warc_archives"
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(oracles.ORACLES[name]).df())


def test_edges(spark, tmp_path):
    archives = warc.archive(spark.createDataFrame(ROWS, SCHEMA))
    rows = {r.page_id: r for r in warc.read_back(archives).collect()}
    assert len(rows) == len(ROWS)
    assert rows[3].record_type == "response" and rows[3].refers_to is None
    for k in (5, 9, None):
        assert (rows[k].record_type, rows[k].refers_to) == ("revisit", 3)
    assert all(rows[k].record_type == "response" for k in (4, 7, 8, 2))
    for page, _, text, *_ in ROWS:
        assert rows[page].payload_digest == hashlib.sha256((text or "").encode()).hexdigest() and rows[page].payload_bytes == len((text or "").encode())
    assert warc.read_back(warc.archive(spark.createDataFrame([], SCHEMA))).count() == 0
    saved = warc.export(archives, f"file://{tmp_path}/out").collect()
    for r in saved:
        content = (tmp_path / "out" / r.archive).read_bytes()
        assert len(content) == r.bytes and struct.unpack_from("<I", content)[0] in (0x184D2A5D, 0xFD2FB528)
        records = list(warc.read_archive(content))
        assert all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in records)
    twice = spark.createDataFrame([(1, "u", BIG, "x", 1)] * 2, SCHEMA)
    assert [r.record_type for r in warc.read_back(warc.archive(twice)).collect()] == ["response"] * 2


def test_dictionaries_have_the_standard_format():
    long = [warc.record(k, "u", (" ".join(f"w{(k * 7919 + j * j) % 4000}" for j in range(600_000))).encode(), "d", 1, None) for k in range(3)]
    few = [warc.record(k, "u", f"<p>{k} short page</p>".encode(), "d", 1, None) for k in range(200)]
    for records in (few[:1], few[:3], few, long):
        content = warc.write_archive(records)
        magic, n = struct.unpack_from("<II", content)
        assert list(warc.read_archive(content)) == records
        if magic == 0x184D2A5D:
            assert content[8:12] == bytes.fromhex("37a430ec") and n <= warc.DICT_BYTES
        else:
            assert magic == 0xFD2FB528 and len(records) < 4
    assert len(warc.write_archive(long)) < sum(map(len, long)) / 2


def test_records_are_frames_of_their_own():
    records = [warc.record(k, "http://x/", (f"<p>{k} " + "shared words of a site " * 30).encode(), "d", 1, None) for k in range(200)]
    content = warc.write_archive(records)
    assert list(warc.read_archive(content)) == records
    assert len(content) < sum(map(len, records)) / 3
    assert list(warc.read_archive(warc.write_archive(records[:1]))) == records[:1]
    assert warc.parse(warc.record(1, "u", b"a\r\n\r\nb", "d", 6, None))["payload"] == b"a\r\n\r\nb"
