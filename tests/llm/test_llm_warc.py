"""WARC archives: exact round trips."""

import gzip
import hashlib
import io

import pytest

from modwarden.llm import warc

LONG = "é" * 700 + "\r\n\r\nWARC/1.1\r\n" + "x" * 3000
ROWS = [
    (5, "http://a", LONG), (3, "http://b", LONG), (9, "http://c\r\nbad", LONG), (7, None, "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""),
    (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "z" * 99), (13, "u", "z" * 99), (5, "http://again", "w" * 200), (3, "http://b", LONG),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, chunk int").repartition(3)


def expected(rows=ROWS):
    first, out = {}, []
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 10**9), i)
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and i > first[h or ""]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("chunk", [64, 1000, 1 << 20])
def test_round_trip(spark, tmp_path, chunk):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(warc.planned(pages(spark)), folder, chunk)
    back = warc.read(manifest, folder, chunk)
    rows = back.collect()
    ends = [r for r in rows if r["last"]]
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in ends) == expected()
    assert max(len(r.data) for r in rows) <= chunk
    # The chunks of a response make up its payload, in order.
    for i, html in ((3, LONG), (10, "y" * 100)):
        parts = [r for r in rows if r.page_id == i and r.record_type == "response"]
        joined = b"".join(bytes(r.data) for r in parts)
        assert joined.startswith(html.encode()) and [r.chunk for r in parts[: len(parts)]][0] == 0
    assert {f.name.split(".", 1)[1] for f in (tmp_path / "w").iterdir()} == {"warc.gz"}


def test_files_are_plain_archives(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write(warc.planned(pages(spark)), folder)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").iterdir())
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS) and raw.endswith(b"\r\n\r\n")
    assert b"http://c%0D%0Abad" in raw


def test_a_changed_payload_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write(warc.planned(pages(spark, [(1, "u", "hello " * 30)])), folder)
    (file,) = (tmp_path / "w").iterdir()
    raw = gzip.decompress(file.read_bytes()).replace(b"hello hello", b"hellO hello", 1)
    with pytest.raises(ValueError, match="does not match"):
        list(warc.records_of(io.BytesIO(gzip.compress(raw))))
    with pytest.raises(ValueError, match="ends early"):
        list(warc.records_of(io.BytesIO(gzip.compress(raw[:-80]))))


def test_empty_and_null_ids(spark):
    assert warc.round_trip(pages(spark, ROWS[:1]).limit(0)).count() == 0
    assert warc.round_trip(spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string")).count() == 0
