import random

from compare import mismatch, views

from isobar.llm import queries, sql
from isobar.llm.warc import LoserTree, _order, archive, capture_history, capture_runs, parse, url_key, write_archives

SCHEMA = "page_id long, url string, html string, size long, digest string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", "p") for r in rows], SCHEMA)


ROWS = [
    (1, "http://a.example/x", "<p>same</p>"), (2, "http://a.example/y?b=2&a=1", "<p>same</p>"), (3, None, None), (4, "u\r\nX-Page-ID: 9", ""),
    (5, "https://www.B.example:8080/", "ü\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://c.example/", "<p>same</p>"), (6, "http://a.example/x", "x" * 300_000),
    (7, "not a url", "alone"), (7, "not a url", "alone"),
]


def test_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert mismatch(queries.op5_warc(spark, sf_dir), sql.ARCHIVE, views(sf_dir)) is None


def test_odd_rows_come_back(spark):
    result = archive(pages(spark, ROWS)).collect()
    told = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in result)
    assert told == [
        (0, 11, "revisit", 2), (1, 11, "revisit", 2), (2, 11, "response", 0), (3, 0, "revisit", 4), (4, 0, "response", 0),
        (5, 18, "response", 0), (6, 300_000, "response", 0), (7, 5, "response", 0), (7, 5, "response", 0),
    ]
    assert {r.url for r in result} == {None if u is None else u.replace("\r\n", "%0A") for _, u, _ in ROWS}
    small = archive(pages(spark, ROWS), least_bytes=12).collect()
    assert {r.record_type for r in small} == {"response"}
    assert archive(pages(spark, [])).collect() == []


def test_files_are_plain_archives_and_the_history_is_in_order(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example/{i % 13}", f"<p>{i % 50}</p>") for i in range(600)]
    write_archives(pages(spark, rows).repartition(5), f"{tmp_path}/warc")
    seen = 0
    for file in (tmp_path / "warc").glob("part-*"):
        data = file.read_bytes()
        for at, length, headers, _, payload in parse(memoryview(data)):
            assert data[at:].startswith(b"WARC/1.1\r\n") and data[at + length : at + length + 4] == b"\r\n\r\n"
            seen += 1
            if headers[b"WARC-Type"] == b"response":
                assert bytes(payload) == f"<p>{int(headers[b'X-Page-ID']) % 50}</p>".encode()
    assert seen == 600
    history = capture_history(capture_runs(spark, f"{tmp_path}/warc")).collect()
    keys = [_order(tuple(r)) for r in history]
    assert len(keys) == 600 and keys == sorted(keys)


def test_loser_tree_merges_like_a_sort():
    chance = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((chance.randrange(50),) for _ in range(chance.randrange(20))) for _ in range(k)]
        merged = [runs[r][i] for r, i in LoserTree(runs)]
        assert merged == sorted(x for run in runs for x in run)


def test_url_keys():
    assert url_key("HTTP://www.Example.com:80/A?b=2&a=1") == "com,example)/a?a=1&b=2"
    assert url_key("https://example.com:8080") == "com,example:8080)/"
    assert url_key(None) == ")/" and url_key("http://[bad") == "http://[bad"
