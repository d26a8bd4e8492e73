"""Archives: what is written comes back, frames stand alone, odd rows."""

import hashlib

import zstandard

from meshloom.llm import warc
from meshloom.llm.common import file_system, fresh_dir

LONG, LONGER = "<p>" + "lorem ipsum " * 120, "<div>é" + "x" * 3000
ROWS = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/9", LONG), (4, "u 4", "short"), (5, "u5", "short"), (6, None, None), (7, "u7", ""), (None, "n", LONG), (8, "u8", LONGER), (9, "http://a/9", LONG), (None, "m", LONGER + "y"), (10, "u\n10", "a\r\n\r\nb" * 300)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def test_round_trip(spark):
    folder = fresh_dir(spark, "w")
    index = warc.write_archives(pages(spark), folder)
    got = warc.read_archives(spark, folder, index, payloads=True).collect()
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        last = max((j for j, _, x in ROWS if (x or "") == (h or "") and j is not None), default=None)
        refers = last if len(raw) >= 1000 and last is not None and i != last else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers, None if refers is not None else raw))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in got), key=key) == sorted(want, key=key)
    for r in index.collect():  # every record by its own frame alone
        headers, block = warc.read_record(folder, r["bundle"], r["frame"], r["offset"])
        assert headers["WARC-Record-ID"] == r["record_id"] and len(block) == int(headers["Content-Length"])


def test_frames(spark, monkeypatch):
    folder = fresh_dir(spark, "w")
    rows = [(i, f"u{i}", f"page {i} " * 3000) for i in range(40)]
    index = warc.write_archives(pages(spark, rows), folder)
    frames = index.groupBy("bundle", "frame").count().collect()
    assert len(frames) > 3
    name = frames[0]["bundle"]
    system, path = file_system(f"{folder}/{name}")
    raw = system.open_input_file(path).read()
    bundle = warc.Bundle(f"{folder}/{name}")
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()  # a plain decoder skips the table
    assert plain == b"".join(bundle.frame(i) for i in range(len(bundle.frames)))
    assert warc.read_archives(spark, folder, index).count() == 40


def test_empty_table(spark):
    folder = fresh_dir(spark, "w")
    assert warc.read_archives(spark, folder, warc.write_archives(pages(spark).where("false"), folder)).count() == 0


def test_damage_is_an_error():
    raw = bytearray(warc.record(1, "u", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None))
    raw[raw.index(b"payload")] ^= 1
    headers, block, _ = warc.parse(bytes(raw))
    try:
        warc.parsed(headers, block)
    except ValueError as e:
        assert "damaged" in str(e)
    else:
        raise AssertionError


def test_long_payloads_and_clashing_columns(spark):
    """Records larger than a frame, columns whose names the operator uses inside, and an index that names one record only."""
    huge = "<p>é" + "z" * 3_000_000
    rows = [(i, "u", huge if i < 3 else f"<b>{i}", "x", "y", "z", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, refers_to string, d string, n int").repartition(2)
    folder = fresh_dir(spark, "w")
    index = warc.write_archives(docs, folder)
    got = {r["page_id"]: r for r in warc.read_archives(spark, folder, index).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {0: ("revisit", 2), 1: ("revisit", 2)} | {i: ("response", None) for i in range(2, 6)}
    assert {r["payload_bytes"] for i, r in got.items() if i < 3} == {len(huge.encode())}
    (one,) = warc.read_archives(spark, folder, index.where("record_id = '<urn:x-page:2>'"), payloads=True).collect()
    assert bytes(one["payload"]) == huge.encode()


def test_a_wrong_index_is_an_error(spark):
    folder = fresh_dir(spark, "w")
    index = warc.write_archives(pages(spark), folder)
    wrong = index.selectExpr("replace(record_id, 'page:4', 'page:5') as record_id", "bundle", "frame", "offset", "length")
    try:
        warc.read_archives(spark, folder, wrong).collect()
    except Exception as e:
        assert "is not at" in str(e)
    else:
        raise AssertionError
