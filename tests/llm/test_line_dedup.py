import pandas as pd
from pyspark.sql import functions as F

from ridgeline.llm import line_dedup, queries
from tests.duck import same

SF = "/root/testdata/sf0.01"


def test_whole_table(spark):
    got = queries.op5_site_lines(spark, SF)
    same(got, SF, queries.ORACLES["op5_site_lines"])
    assert got.agg(F.sum("n_dropped")).first()[0] > 0


def test_hosts_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    same(queries.op5_site_lines(spark, SF), SF, queries.ORACLES["op5_site_lines"])


def test_rules_and_odd_rows(spark):
    page = lambda *x: "<!-- a\n --><body><p>" + "</p><p>".join(x) + "</p><script>no()</script>"
    rows = [(i, f"http://Site.example/{i}?q", page("Menu", f"text {i}", "Menu", "&lt;b&gt;" if i < 2 else f"own {i}")) for i in range(6)]
    rows += [(20 + i, f"https://small.example/{i}", page("Menu")) for i in range(4)]
    rows += [(40, "https://one.example/", page("Menu")), (41, "https://me@two.example:80/a", page("Menu", "left")), (42, "https://TWO.example:443", page("Menu", "right")), (43, "http://[::1]:8080/x", page("long " * 50_000))]
    rows += [(None, None, None), (30, "nonsense", ""), (3, "http://site.example", page("x  y", "\tMenu ")), (3, "http://site.example", page("x  y", "\tMenu "))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "lines": F.lit(1), "text": F.lit(None)})
    got = line_dedup.drop_site_lines(pages)
    same(got, SF, line_dedup.oracle_sql(), {"pages": pd.DataFrame(rows, columns=["page_id", "url", "html"])})
    rows = got.collect()
    by = {r.page_id: r for r in rows}
    assert by[1].text == "text 1\n<b>" and by[1].n_dropped == 2  # 2 of 8 pages is within the ratio
    assert by[21].text == "" and sorted(r.text for r in rows if r.page_id == 3) == ["text 3\nown 3", "x  y", "x  y"] and by[None].n_lines == 0
    assert by[40].text == "Menu" and (by[41].text, by[42].text) == ("left", "right") and by[42].host == "two.example" and by[43].host == "[::1]" and len(by[43].text) > 200_000
    assert line_dedup.drop_site_lines(pages.limit(0)).count() == 0
