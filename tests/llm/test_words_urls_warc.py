"""URL filters and WARC archives on hand-made rows, and every corpus query with SQL against DuckDB."""

import types

import compare as C
import pytest
from pyspark.sql import functions as F

from footlamp.llm import QUERIES, SQL, url_filter, warc
from footlamp.plans.storage import scratch_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name, monkeypatch):
    monkeypatch.setitem(C.REGISTRY, name, types.SimpleNamespace(run=QUERIES[name], sql=SQL[name]))
    result = C.compare(spark, C.duck(SF), name, SF)
    assert result["ok"], result["note"]


def rules(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def test_url_rules(spark):
    urls = [
        (1, "http://A.Example.COM/en/7?x=/de/"), (2, "http://example.com/en/8"), (3, "x://com/en/"), (4, "http://notexample.com/en/7"),
        (5, None), (6, "no scheme /en/"), (7, "http://"), (8, "http://com?/en/"), (None, "http://a.com/en/z"), (2, "http://example.com/en/8"),
        (9, "http://" + "a." * 2000 + "com/en/" + "y" * 50_000), (10, "a://b://com/en/"), (11, ""),
    ]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").withColumn("verdict", F.lit("clash")).withColumn("n", F.lit(1))
    got = url_filter.judge_urls(pages, rules(spark, url_filter.RULES)).collect()
    by = {r.page_id: (r.rule, r.verdict) for r in got}
    assert len(got) == len(urls)
    assert by[1] == ("example.com/en/7", "allow") and by[2] == ("com/en/", "block") and by[3] == ("com/en/", "block")
    assert by[4] == ("com/en/", "block") and by[9] == ("com/en/", "block") and by[None] == ("com/en/", "block")
    assert all(by[i] == (None, "allow") for i in (5, 6, 7, 8, 10, 11))
    assert {(r.host, r.path) for r in got if r.page_id == 8} == {("com", "")}


def test_url_ties_and_empty(spark):
    same = rules(spark, [("a.b", "/x", "allow"), ("a.b", "/x", "block")])
    pages = spark.createDataFrame([(1, "http://a.b/xy")], "page_id bigint, url string")
    assert url_filter.judge_urls(pages, same).collect()[0].verdict == "block"
    assert url_filter.judge_urls(pages, same.limit(0)).collect()[0].verdict == "allow"
    assert url_filter.judge_urls(pages.limit(0), same).count() == 0


def pages(spark):
    big, odd = "ä" * 60, "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 10
    rows = [
        (5, "http://a/\r\nX: y%0D", big), (3, "u", big), (9, None, big), (None, "n", big), (1, "s", "short"), (2, "s", "short"), (4, "e", ""), (6, "e", None),
        (7, "odd", odd), (8, "odd", odd + "\x00\r\n"), (3, "u", big), (10, "long", "x" * 3_000_000),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record_type", F.lit("clash"))


def test_warc(spark):
    path = scratch_dir(spark, "warc-test")
    warc.archive_pages(pages(spark).repartition(3), path)
    got = warc.join_revisits(warc.read_archives(spark, path, payloads=True)).collect()
    assert len(got) == 12
    by = {r.page_id: r for r in got}
    assert [r.record_type for r in got if r.page_id == 3] == ["response"] * 2
    assert all(by[i].record_type == "revisit" and by[i].refers_to == 3 and by[i].payload_bytes == 120 for i in (5, 9, None))
    assert all(by[i].record_type == "response" and by[i].refers_to is None for i in (1, 2, 4, 6, 7, 8, 10))
    assert by[5].url == "http://a/\r\nX: y%0D" and by[9].url is None and bytes(by[9].payload).decode() == "ä" * 60
    assert bytes(by[8].payload).endswith(b"\x00\r\n") and by[10].payload_bytes == 3_000_000 and by[6].payload_bytes == 0


def test_warc_again_and_empty(spark):
    first, second, none = (scratch_dir(spark, "warc-test") for _ in range(3))
    all_responses = warc.payload_headers(pages(spark)).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("bigint"))
    warc.write_archives(all_responses, first)
    warc.deduplicate_archives(spark, first, second)
    got = warc.join_revisits(warc.read_archives(spark, second)).collect()
    assert sorted(r.record_type for r in got) == ["response"] * 9 + ["revisit"] * 3
    warc.archive_pages(pages(spark).limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_cut_archive_fails():
    whole = b"WARC/1.1\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    assert [b for _, b in warc.parse(whole * 2)] == [b"abcd"] * 2
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-6]))
