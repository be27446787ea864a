import hashlib

from kinetrace.llm.common import Workspace
from kinetrace.llm.warc import surt_key, write_archive

ROWS = [
    (1, "http://a.org/x", "y" * 1000, 0), (2, "http://a.org/x?q", "y" * 1000, 0), (9, "https://www.b.com/é#f", "y" * 1000, 0), (4, None, None, 0), (5, "no scheme", "", 0),
    (6, "http://a.org/x", "y" * 999, 0), (7, "http://c.net", "y" * 999, 0), (None, "http://d.net/\r\nInjected: x", "é" * 500, 0), (11, "http://a.org/x", "é" * 500, 0), (9, "https://www.b.com/é#f", "y" * 1000, 0), (12, "http://big.org", "z" * 3_000_000, 0),
]


def test_round_trip_and_lookup(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest int")
    work = Workspace(spark, "w")
    archive = write_archive(df.repartition(3), f"{work.path}/a", work)
    got = sorted(str(tuple(r)) for r in archive.records().collect())
    want = []
    for page, _, html, _ in ROWS:
        data = (html or "").encode()
        same = [p for p, _, h, _ in ROWS if h == html and len(data) >= 1000]
        top = max((p for p in same if p is not None), default=None)
        again = len(data) >= 1000 and len(same) > 1 and page != top
        want.append(str((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None)))
    assert got == sorted(want)
    assert sorted(r["page_id"] for r in archive.lookup(["http://a.org/x"])) == [1, 6, 11]
    found = archive.lookup(["https://www.b.com/é#f", "http://nowhere.org/"])
    assert [r["page_id"] for r in found] == [9, 9] and found[0]["payload"] == b"y" * 1000
    assert archive.lookup([]) == []


def test_many_blocks(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', id) as url", "repeat('x', 10) as html")
    work = Workspace(spark, "w")
    archive = write_archive(df, f"{work.path}/a", work)
    assert archive.directory.count() >= 5 and archive.records().count() == 5000
    assert [r["page_id"] for r in archive.lookup([f"http://h{i % 7}.org/{i}" for i in (0, 777, 4999)])] == [0, 777, 4999]


def test_empty_table(spark):
    work = Workspace(spark, "w")
    archive = write_archive(spark.createDataFrame([], "page_id long, url string, html string"), f"{work.path}/a", work)
    assert archive.records().collect() == [] and archive.lookup(["http://x.org"]) == []


def test_keys():
    assert surt_key("https://user@www.A.org:80/x?y") == "org,a,www:80)/x?y" and surt_key(None) == "" and surt_key("x") == "x"
