import gzip
import io
from pathlib import Path

from lumenframe.llm import warc

ROWS = [
    (5, "http://a/x\r\ny", "p" * 200), (3, "http://a", "p" * 200), (9, None, "p" * 200), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "é" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (8, "u", "x" * 99), (10, "u", "x" * 99), (11, "u", "y" * 100), (12, "u", "y" * 100),
    (13, "u", "long text " * 200_000), (13, "u", "long text " * 200_000), (None, "u", "n" * 150), (14, "u", "n" * 150),
]


def test_archives_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archives(df, str(tmp_path / "w"))
    back = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert len(back) == len(ROWS)
    stored = {r.page_id: r.payload for r in back if r.record_type == "response"}
    assert all(stored[i] == (h or "") for i, _, h in ROWS if i in stored) and next(r.url for r in back if r.page_id == 5) == "http://a/x%0D%0Ay"
    rows = {r.page_id: r for r in warc.resolve(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert {i: r.refers_to for i, r in rows.items() if r.record_type == "revisit"} == {5: 3, 9: 3, 12: 11, None: 14}
    assert rows[5].payload_bytes == 200 and rows[7].payload_bytes == len(ROWS[7][2].encode()) and rows[4].payload_bytes == 0
    stored_bytes = sum(len(gzip.decompress(f.read_bytes())) for f in Path(tmp_path / "w").glob("part-*"))
    assert stored_bytes < 4_300_000  # repeated rows of a first response are the only payload kept twice


def test_parser_rejects_damage():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.parse(io.BytesIO(good * 2)))[1][1] == b"abc"
    for bad in (b"nothing\r\n", good[:-5]):
        try:
            list(warc.parse(io.BytesIO(bad)))
        except ValueError:
            continue
        raise AssertionError


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "e"))).count() == 0


def test_records_are_members_with_fresh_headers_in_bounded_files(spark, tmp_path, monkeypatch):
    import zlib

    monkeypatch.setattr(warc, "BLOB", 20_000)
    rows = [(i, f"http://h/{i}", "".join(chr(33 + (i * k * 7919) % 90) for k in range(3000))) for i in range(400)]
    df = spark.createDataFrame(rows + [(500, None, rows[0][2]), (7, "u", "twice"), (7, "u", "twice")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) >= 3 and all(f.stat().st_size < 5 * 20_000 for f in files)
    ids, kinds = [], []
    for f in files:
        data = f.read_bytes()
        while data:  # each member is a record of its own, or empty between blobs
            d = zlib.decompressobj(31)
            text = d.decompress(data)
            data = d.unused_data
            if text:
                (headers, block), = warc.parse(io.BytesIO(text))
                ids.append(headers["warc-record-id"])
                kinds.append(headers["warc-type"])
                assert headers["warc-date"] > "2024" and int(headers["content-length"]) == len(block)
    assert len(set(ids)) == len(ids) == 403 + kinds.count("warcinfo") and kinds.count("revisit") == 1 and kinds.count("warcinfo") > 3


def test_only_payloads_that_may_repeat_are_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "x" * 150 + str(i // 2 if i < 20 else i)) for i in range(2000)], "page_id long, url string, html string").repartition(4)
    df = spark.createDataFrame(df.collect(), df.schema)
    warc.write_archives(df, str(tmp_path / "w"))
    rows = warc.resolve(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(rows) == 2000 and sorted((r.page_id, r.refers_to) for r in rows if r.record_type == "revisit") == [(2 * k + 1, 2 * k) for k in range(10)]
