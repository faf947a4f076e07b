import gzip
import io
import json

from pyspark.sql import functions as F

from platewright.llm import warc

PAGES = "page_id long, url string, html string, digest string, bytes string"


def _pages(spark):
    big, other = "<p>" + "same é " * 40, "<p>" + "other " * 3000
    rows = [(5, "http://a/x y\r\nX: 1", big), (3, None, big), (9, "http://é", big), (3, "http://b", big), (7, "http://c", other)]
    rows += [(11, "u", None), (12, "u", ""), (13, "u", "short"), (14, "u", "short"), (None, "u", big), (None, "v", "n" * 200)]
    rows += [(20, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (21, "u", "x" * 2_000_000)]
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], PAGES), rows


def test_round_trip(spark, tmp_path):
    pages, rows = _pages(spark)
    got = warc.round_trip(pages.repartition(3), str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {3}
    assert sorted(r.page_id or -1 for r in got if r.record_type == "revisit") == [-1, 5, 9]
    assert [r.record_type for r in by_id[3]] == ["response", "response"]
    for page, url, html in rows:
        if page is None or page in (3, 5, 9):
            continue
        (r,) = by_id[page]
        assert bytes(r.html).decode() == (html or "") and r.payload_bytes == len((html or "").encode())
    assert by_id[5][0].payload_bytes == by_id[3][0].payload_bytes
    assert by_id[5][0].uri == "http://a/x%20y%0D%0AX:%201"


def test_every_member_stands_alone(spark, tmp_path):
    pages, rows = _pages(spark)
    folder = str(tmp_path / "w")
    (tmp_path / "w").mkdir()
    whole = warc.write_archives(pages, folder, archive_bytes=10_000)
    assert whole.count() > 1 and whole.agg(F.sum("records")).first()[0] == len(rows)
    members = warc.normalise_archives(whole, folder).collect()
    n = 0
    for m in members:
        raw = open(m.path, "rb").read()
        index = [json.loads(x) for x in open(m.path + ".index.jsonl")]
        assert sum(e["length"] for e in index) == len(raw)
        for e in index:
            record = gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            n += 1
    assert n == len(rows)


def test_normaliser_reads_whole_files_and_members_alike():
    row = {"page_id": 1, "url": "u", "payload": b"abc" * 99, "digest": "d", "bytes": 297, "first": None, "revisit": False}
    raw = [warc.record_bytes(row | {"page_id": i}) for i in range(50)]
    want = None
    for source in (gzip.compress(b"".join(raw)), b"".join(gzip.compress(r) for r in raw)):
        out = io.BytesIO()
        index = warc.normalise(io.BytesIO(source), out)
        got = [gzip.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]]) for e in index]
        assert got == raw
        want = want or index
        assert index == want
    broken = gzip.compress(b"".join(raw)[:-10])
    try:
        warc.normalise(io.BytesIO(broken), io.BytesIO())
    except EOFError:
        return
    raise AssertionError("a cut archive must not pass")


def test_empty(spark, tmp_path):
    pages, _ = _pages(spark)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0
