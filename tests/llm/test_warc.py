"""Archives that others wrote or that were cut off, records that belong to several captures, long pages."""

import collections
import gzip
import hashlib

from loomtext.llm import warc


def record(headers, block, length=None):
    lines = [f"{k}: {v}" for k, v in headers] + ([] if length == "" else [f"Content-Length: {len(block) if length is None else length}"])
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def read(spark, path):
    return {r.record_id: r for r in warc.read_records(spark, str(path)).collect()}


def test_lengths_that_are_no_numbers(spark, tmp_path):
    data = b"".join(record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>")], b"block\r\n\r\nmore " + str(i).encode(), x) for i, x in enumerate([None, "abc", "", "-5", "99999", None]))
    (tmp_path / "a.warc").write_bytes(data)
    rows = read(spark, tmp_path)
    assert [rows[f"<{i}>"].block for i in range(4)] == [b"block\r\n\r\nmore " + str(i).encode() for i in range(4)]
    assert [rows[f"<{i}>"].intact for i in range(5)] == [True, False, False, False, False]
    assert set(rows) == {f"<{i}>" for i in range(5)} and rows["<4>"].block.startswith(b"block\r\n\r\nmore 4")  # the longest takes the rest


def test_archives_that_are_cut_off(spark, tmp_path):
    import os

    one = record([("WARC-Type", "resource"), ("WARC-Record-ID", "<1>")], b"first")
    two = record([("WARC-Type", "resource"), ("WARC-Record-ID", "<2>")], os.urandom(50_000).hex().encode())
    whole = gzip.compress(one) + gzip.compress(two)
    (tmp_path / "a.warc.gz").write_bytes(whole[:-20_000])
    (tmp_path / "b.warc.gz").write_bytes(b"\x1f\x8b nothing")
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(one.replace(b"<1>", b"<3>")[:-8])
    rows = read(spark, tmp_path)
    assert rows["<1>"].block == b"first" and rows["<1>"].intact and rows["<3>"].block == b"f" and not rows["<3>"].intact
    assert not rows["<2>"].intact and 0 < rows["<2>"].payload_bytes < 100_000 and set(rows) == {"<1>", "<2>", "<3>"}


def test_a_record_concurrent_to_two_captures_and_a_capture_to_two_records(spark, tmp_path):
    parts = [
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Concurrent-To", "<q1>"), ("WARC-Concurrent-To", "<q2>")], b"A"),
        record([("WARC-Type", "response"), ("WARC-Record-ID", "<b>")], b"B"),
        record([("WARC-Type", "request"), ("WARC-Record-ID", "<q1>")], b"1"),
        record([("WARC-Type", "request"), ("WARC-Record-ID", "<q2>")], b"2"),
        record([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m>"), ("WARC-Concurrent-To", "<a>"), ("WARC-Concurrent-To", "<b>"), ("WARC-Concurrent-To", "<a>")], b"page-id: 7"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    rows = {r.record_id: r for r in warc.captures(spark, str(tmp_path)).collect()}
    assert [x.record_id for x in rows["<a>"].requests] == ["<q1>", "<q2>"] and rows["<b>"].requests == []
    assert [x.record_id for x in rows["<a>"].metadata] == ["<m>"] == [x.record_id for x in rows["<b>"].metadata]
    assert rows["<a>"].page_id == rows["<b>"].page_id == 7


def test_a_revisit_takes_the_response_that_it_names(spark, tmp_path):
    same = [("WARC-Payload-Digest", "sha256:00")]
    parts = []
    for i, name in ((1, "<x>"), (2, "<y>")):
        parts.append(record([("WARC-Type", "response"), ("WARC-Record-ID", name)], b"T" * i))
        parts.append(record([("WARC-Type", "metadata"), ("WARC-Record-ID", f"<m{i}>"), ("WARC-Concurrent-To", name)], f"page-id: {i}".encode()))
    parts.append(record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<r>"), ("WARC-Refers-To", "<y>"), *same], b""))
    parts.append(record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<s>"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(b"T").hexdigest())], b""))
    parts.append(record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<t>"), ("WARC-Refers-To", "<gone>"), *same], b""))
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    rows = {r.record_id: (r.refers_to_page, r.payload_bytes) for r in warc.captures(spark, str(tmp_path), with_block=False).collect() if r.type == "revisit"}
    assert rows == {"<r>": (2, 2), "<s>": (1, 1), "<t>": (None, None)}


def test_long_pages_go_to_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LONG_PAGE", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 6000)
    rows = [(i, "u", f"{i} " + "x" * (3000 if i % 5 == 0 else 200)) for i in range(40)] + [(41, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_captures(pages, path)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) == 9 and collections.Counter(x > 6000 for x in sizes)[False] >= 8
    got = {(r.page_id, r.block) for r in warc.captures(spark, path).collect()}
    assert got == {(i, (x or "").encode()) for i, _, x in rows}
