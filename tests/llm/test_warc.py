"""Web archives: exact round trips, and what lies in the files."""

import hashlib
import io
import os
import random
import struct
from base64 import b32encode

import pytest
import zstandard

from paperfold.llm import warc
from paperfold.session import shared_folder

SCHEMA = "page_id bigint, url string, html string, row string, content string, sha1 int, refers_to string, `odd.name` int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "r", "c", 1, "t", 2) for r in rows], SCHEMA)


def some_pages(seed, n):
    rng = random.Random(seed)
    rows = [(k, f"http://h{k % 7}.org/a b/{k}\n", "<html><head><title>t</title></head><body>" + "<p>word</p>" * rng.randint(0, 40) + str(rng.random()) * rng.randint(0, 3)) for k in range(n)]
    rows += [(n + k, "http://copy.org", rows[k][2]) for k in range(20)]
    return rows


AWKWARD = [
    (5000, None, None), (5001, "", ""), (5002, "u", "\r\n\r\nWARC/1.1\r\n"), (5003, "é\x7f", "é\x00 " + "x" * 300_000),
    (None, "none", "no id"), (None, "none", "no id too"), (5004, "n", "no id"), (7000, "twice", "same row"), (7000, "twice", "same row"),
    (6999, "low", "same row"),
]


def written(spark, rows, least=0):
    folder = shared_folder(spark, "test-archives")
    warc.write_archives(pages(spark, rows).repartition(3), folder, least)
    return folder


@pytest.mark.parametrize("archive_bytes", [3000, 32 << 20])
def test_round_trip(spark, monkeypatch, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    rows = some_pages(1, 120) + AWKWARD
    got = warc.read_archives(spark, written(spark, rows)).collect()
    assert len(got) == len(rows)
    best = {}
    for page_id, _, html in rows:
        key = (page_id is not None, page_id or 0)
        best[html or ""] = max(best.get(html or "", key), key)
    left = {}
    for r in got:
        left.setdefault((r.page_id, r.payload_digest), []).append(r)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        digest = b32encode(hashlib.sha1(raw).digest()).decode()
        r = left[page_id, digest].pop()
        assert r.payload_bytes == len(raw)
        if r.record_type == "response":
            assert bytes(r.payload) == raw and r.refers_to is None
            assert (page_id is not None, page_id or 0) == best[html or ""]
        else:
            assert r.payload is None and (r.refers_to is not None, r.refers_to or 0) == best[html or ""]
    assert sum(r.record_type == "response" for r in got) == len(best)


def test_small_payloads_are_stored(spark):
    got = warc.read_archives(spark, written(spark, [(1, "a", "short"), (2, "b", "short"), (3, "c", "long enough"), (4, "d", "long enough")], 8)).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_files_are_frames_behind_a_dictionary(spark):
    folder = written(spark, some_pages(2, 200))
    names = [n for n in sorted(os.listdir(folder)) if n.endswith(".warc.zst")]
    assert names == sorted(r.archive for r in spark.read.parquet(f"{folder}/index").collect())
    told, ids = 0, set()
    for name in names:
        with open(f"{folder}/{name}", "rb") as file:
            raw = file.read()
        magic, size = struct.unpack("<II", raw[:8])
        if magic == warc.SKIPPABLE:
            assert zstandard.ZstdCompressionDict(raw[8 : 8 + size]).dict_id()
            told += 1
        for n, data in enumerate(warc.records_of(io.BytesIO(raw), 100)):
            headers, _ = warc.parsed(data)
            assert headers["warc-type"] == ("warcinfo" if n == 0 else headers["warc-type"])
            assert headers["warc-record-id"] not in ids
            ids.add(headers["warc-record-id"])
    assert told and len(ids) == 220 + len(names)


def test_dictionary_helps_and_is_left_out_where_it_cannot():
    records = [f"<html><head><title>Page</title></head><body class='main'>{k} {random.Random(k).random()}</body></html>".encode() * 3 for k in range(400)]
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert warc.dictionary_of(records[:5]) is None
    assert len(warc.compressed(records)) < alone
    assert list(warc.records_of(io.BytesIO(warc.compressed(records)))) == records
    assert list(warc.records_of(io.BytesIO(warc.compressed(records[:3])))) == records[:3]
    assert list(warc.records_of(io.BytesIO(b""))) == []


def test_damage_is_an_error():
    data = warc.compressed([warc._info("n", "f", warc.DATE)])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.records_of(io.BytesIO(data[:-9])))
    page = warc.record("f", warc.DATE, 1, 1, "u", hashlib.sha1(b"abc").digest(), 3, b"abd", None, None, None)
    with pytest.raises(ValueError):
        warc.page_of(*warc.parsed(page))


def test_writing_again_replaces(spark):
    folder = shared_folder(spark, "test-again")
    warc._store(folder, "a.warc.zst", b"1")
    warc._store(folder, "a.warc.zst", b"22")
    assert warc._opened(folder, "a.warc.zst").read() == b"22"


def test_empty_table(spark):
    folder = written(spark, [])
    assert warc.read_archives(spark, folder).collect() == []
