import glob
import os

import pytest

from tessera.llm import warc as W
from tessera.llm.common import new_path

BIG = "<p>é</p>" * 40
PAGES = [(1, "http://a/ü?x=1", BIG, 1), (2, None, BIG, 1), (3, "http://c", None, 2), (4, "http://d", "", 3), (5, "e f", "short", 4), (6, "g", "short", 5), (7, "h", BIG, 6), (8, "i", "x" * 3_000_000, 7), (9, "j", "line\r\n\r\nWARC/1.1\r\n" * 9, 8)]


def test_round_trip_with_edges(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, refers_to long").withColumnRenamed("refers_to", "payload_bytes")
    path = new_path(spark, "warc")
    W.write_archives(pages.repartition(2), path, archive_bytes=1000)
    rows = {r.page_id: r for r in W.read_archives(spark, path, payloads=True).collect()}
    assert sorted(rows) == list(range(1, 10))
    for i, url, html, _ in PAGES:
        r = rows[i]
        assert r.url == (url or "") and r.payload_bytes == len((html or "").encode())
        if i in (2, 7):
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("revisit", 1, b"")
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload).decode()) == ("response", None, html or "")


def test_leading_frame_holds_the_dictionary_and_damage_is_found():
    records = [W.record_bytes(i, f"http://x/{i}", (f"<html><body>{i} common words here</body></html>" * 9).encode(), None) for i in range(300)]
    data = W.archive(records)
    assert int.from_bytes(data[:4], "little") == W.DICT_MAGIC and len(data) < sum(map(len, records)) / 4
    assert sum(1 for _ in W.read_archive(data)) == 300
    with pytest.raises(ValueError):
        list(W.read_archive(data[100:]))


def test_a_cut_archive_is_an_error(spark):
    path = new_path(spark, "warc")
    W.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string, n long").coalesce(1), path)
    for name in glob.glob(path.removeprefix("file:") + "/archives/*.zst"):
        with open(name, "rb+") as f:
            f.truncate(os.path.getsize(name) - 20)
    with pytest.raises(Exception, match="cut off|Unable|zstd"):
        W.read_archives(spark, path).collect()


def test_empty_table_and_orphan_files(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    W.write_archives(pages, path)
    with open(path.removeprefix("file:") + "/archives/part-orphan.warc.zst", "wb") as f:
        f.write(b"left by a lost task")
    assert W.read_archives(spark, path).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a", BIG), (None, "b", BIG), (2, "c", BIG), (2, "d", BIG), (5, "e", BIG), (5, "f", BIG), (5, "g", "x" * 200), (5, "g", "x" * 200), (7, "h", "x" * 200), (-3, "i", None)]
    path = new_path(spark, "warc")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = sorted((r.url, r.page_id, r.record_type, r.refers_to) for r in W.read_archives(spark, path).collect())
    assert got == [
        ("a", None, "response", None), ("b", None, "response", None), ("c", 2, "response", None), ("d", 2, "response", None), ("e", 5, "revisit", 2), ("f", 5, "revisit", 2),
        ("g", 5, "response", None), ("g", 5, "response", None), ("h", 7, "revisit", 5), ("i", -3, "response", None),
    ]


def test_one_payload_of_most_pages(spark):
    pages = spark.range(2000).selectExpr("id as page_id", "'u' as url", f"if(id % 3 = 0, concat('own ', id, repeat('x', 100)), '{BIG}') as html").repartition(5)
    path = new_path(spark, "warc")
    W.write_archives(pages, path)
    rows = W.read_archives(spark, path).collect()
    assert len(rows) == 2000 and {r.refers_to for r in rows} == {None, 1} and sum(r.record_type == "response" for r in rows) == 668
