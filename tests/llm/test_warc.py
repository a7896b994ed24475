import io
import struct
from collections import Counter

import pytest
import zstandard

from tracefold.llm import warc as W

PAGES = "page_id BIGINT, url STRING, html STRING, archive STRING, position BIGINT, valid BOOLEAN"


def archive(records, dictionary=b"", packed=True):
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    head = b""
    if dictionary:
        body = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        head = struct.pack("<II", W.DICTIONARY_MAGIC, len(body)) + body
    c = zstandard.ZstdCompressor(dict_data=known)
    return head + b"".join(c.compress(r) for r in records)


def read(data):
    return [(r[2], r[5], r[7], r[8]) for r in W.rows_of(io.BytesIO(data), "a")]


GOOD = [W.record(i, f"http://x/{i}", "<p>" + "text " * i + "</p>") for i in range(50)]
DICTIONARY = zstandard.train_dictionary(2000, GOOD * 4).as_bytes()


@pytest.mark.parametrize("packed", (True, False))
def test_dictionary_frame_is_needed_and_used(packed):
    data = archive(GOOD, DICTIONARY, packed)
    assert [r[:3] for r in read(data)] == [(i, "<p>" + "text " * i + "</p>", True) for i in range(50)]
    n = struct.unpack("<I", data[4:8])[0]
    (row,) = read(data[8 + n :])  # without its dictionary the first frame can't be read
    assert not row[2] and "can't be read" in row[3]


def test_one_row_a_frame_and_skippable_frames_between():
    data = archive(GOOD[:2]) + struct.pack("<II", 0x184D2A50, 3) + b"abc" + archive(GOOD[2:3])
    assert [r[0] for r in read(data)] == [0, 1, 2]
    assert len({r[1] for r in W.rows_of(io.BytesIO(data), "a")}) == 3


def change(old, new, record=GOOD[7]):
    assert old in record
    return record.replace(old, new, 1)


@pytest.mark.parametrize(
    "bad, problem",
    [
        (change(b"WARC/1.1", b"HTTP/1.1"), "version"),
        (change(b"WARC-Date", b"X-Date"), "no warc-date"),
        (change(b"WARC-Type: resource\r\n", b""), "no warc-type"),
        (change(b"WARC-Type: resource", b"WARC-Type resource"), "bad header"),
        (change(b"Content-Length: 42", b"Content-Length: x"), "bad content-length"),
        (change(b"Content-Length: 42", b"Content-Length: 9999"), "block of"),
        (change(b"Content-Length: 42", b"Content-Length: 41"), "doesn't end"),
        (change(b"Content-Length: 42", b"X: 1"), "no content-length"),
        (change(b"text text", b"TEXT text"), "digest"),
        (b"WARC/1.1\r\nWARC-Type: resource", "no end of headers"),
        (b"", "no end of headers"),
    ],
)
def test_faulty_records_are_told(bad, problem):
    rows = read(archive([GOOD[1], bad, GOOD[2]]))
    assert [r[2] for r in rows] == [True, False, True]
    assert problem in rows[1][3]


def test_cut_archives():
    data = archive(GOOD[:3])
    for cut in (5, len(data) - 3):
        rows = read(data[:cut])
        assert not rows[-1][2] and all(r[2] for r in rows[:-1])
    assert read(b"") == []
    whole = archive([], DICTIONARY)
    assert read(whole) == [] and "cut off" in read(whole[:100])[0][3]
    assert "can't be read" in read(data + b"garbage after the frames")[-1][3]


def test_folded_headers_and_long_blocks():
    long = W.record(1, "u", "ä" * 3_000_000)
    folded = change(b"WARC-Target-URI: http://x/7", b"WARC-Target-URI: http://x/\r\n 7")
    rows = list(W.rows_of(io.BytesIO(archive([long, folded])), "a"))
    assert len(rows[0][5]) == 3_000_000 and rows[0][6] == 6_000_000
    assert rows[1][3] == "http://x/ 7" and rows[1][7]


def test_round_trip_of_odd_pages(spark, tmp_path):
    rows = [(1, "u", None, "x", 1, False), (2, None, "", "x", 1, False), (None, "u\r\nInjected: 1", "a\r\n\r\nb", "x", 1, False), (3, "u", "é" * 500_000, "x", 1, False), (3, "u", "same", "x", 1, False), (3, "u", "same", "x", 1, False), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    made = W.write_archives(pages, f"file://{tmp_path}/a", W.train_dictionary(pages)).collect()
    assert sum(r.records for r in made) == len(rows)
    got = W.read_archives(spark, [r.archive for r in made]).collect()
    assert all(r.valid for r in got)
    clean = lambda u: u and u.replace("\r", "%0D").replace("\n", "%0A")
    assert Counter((r.page_id, r.url, r.html) for r in got) == Counter((i, clean(u), h) for i, u, h, *_ in rows)


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    assert W.train_dictionary(none) == b""
    made = [r.archive for r in W.write_archives(none, f"file://{tmp_path}/a", b"").collect()]
    assert W.read_archives(spark, made).count() == 0 and W.read_archives(spark, []).count() == 0


def test_dictionary_sample_is_bounded(spark, tmp_path):
    pages = spark.range(3000).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "concat('<p>', repeat(concat('word', id % 17, ' '), 30), '</p>') AS html")
    assert len(W.train_dictionary(pages, sample=200, size=4096)) > 500
