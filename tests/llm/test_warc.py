import hashlib
import io

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import files, queries, warc
from ridgeline.session import run_path
from tests.duck import same

SF = "/root/testdata/sf0.001"


def brute(rows, least=1000):
    key = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    first = {}
    for page_id, _, html in rows:
        k = key(html)
        if k not in first or (page_id is not None and (first[k] is None or page_id > first[k])):
            first[k] = page_id
    out, used = [], set()
    for page_id, _, html in rows:
        n, k = len((html or "").encode()), key(html)
        revisit = n >= least and (page_id != first[k] or k in used)
        if page_id == first[k]:
            used.add(k)
        out.append((page_id, n, k, "revisit" if revisit else "response", first[k] if revisit else None))
    return sorted(out, key=str)


def run(spark, pages):
    return sorted((tuple(r)[:5] for r in warc.round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op2_warc_revisits(spark, SF)
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(rows)
    same(got, SF, queries.ORACLES["op2_warc_revisits"])


def test_copies_and_odd_rows(spark):
    big, nasty = "é" * 600, "\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/", big), (5, "http://b/", big), (3, None, big), (3, None, big), (5, "x", big), (7, "u\r\nX: 1", nasty), (8, "u v", nasty), (9, "s", "small"), (10, "s", "small"), (11, "n", None), (12, "n", ""), (None, "z", "q" * 2000), (None, "z", "r" * 1000), (2, "z", "r" * 1000), (20, "h", "k" * 999), (21, "h", "k" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"file": F.lit("f"), "record_type": F.lit(1)}).repartition(3)
    assert run(spark, pages) == brute(rows)
    assert run(spark, pages.limit(0)) == []


def test_common_payload_and_long_text(spark):
    """A payload that most pages have, and one longer than a piece of an archive."""
    rows = [(i, "http://c/", "c" * 1500) for i in range(3000)] + [(9000, "http://l/", "".join(map(str, range(1_500_000)))), (9001, "", "r" * 1200), (9002, "", "r" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert run(spark, pages) == brute(rows)


def test_reading_tasks_follow_the_bytes(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", hashlib.sha512(str(i).encode()).hexdigest() * 20) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    a, b = run_path(spark, "a"), run_path(spark, "b")
    monkeypatch.setattr(warc, "PIECE_BYTES", 2000)
    index = warc.deduplicate(warc.write_pages(pages, a), a, b)
    size = index.agg(F.sum("n_bytes")).first()[0]
    read = warc.read_archives(index, b).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() > size / 2000 / 4 > 5
    assert read.count() == 200 and {r.page_id for r in read.collect()} == set(range(200))


def test_archives_hold_fresh_headers_and_few_payloads(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "w" * 5000) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    a, b = run_path(spark, "a"), run_path(spark, "b")
    first = warc.write_pages(pages, a)
    second = warc.deduplicate(first, a, b)
    ids = {r.record_id for r in first.collect()}
    records = warc.read_archives(second, b).collect()
    assert not ids & {r.record_id for r in records} and len({r.record_id for r in records}) == 20
    response = [r for r in records if r.record_type == "response"]
    assert [r.page_id for r in response] == [19] and {r.refers_to_id for r in records if r.record_type == "revisit"} == {response[0].record_id}
    assert {r.warc_date for r in records} == {"2024-01-02T00:00:00Z"}
    store, folder = files.open_store(b)
    with store.open_input_stream(f"{folder}/{second.first().file}", compression=None) as f:
        whole = b"".join(warc.members(f))
    assert whole.count(b"WARC/1.1\r\n") == 20 and whole.count(b"w" * 5000) == 1


def test_members_across_chunks(monkeypatch):
    packed = b"".join(warc.pack("response", f"urn:uuid:{i}", "d", i, "u", hashlib.sha1(b"x" * i).hexdigest(), b"x" * i) for i in range(50))
    for chunk in (1, 7, 1 << 20):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        got = [warc.unpack(r) for r in warc.members(io.BytesIO(packed))]
        assert [(f["x-page-id"], p) for f, p in got] == [(str(i), b"x" * i) for i in range(50)]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed[:-3])))
