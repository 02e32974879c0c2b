"""Line removal by site-relative frequency.

A line that most pages of a host have is that site's boilerplate.  Pages become lines of
visible text; for each host, the pages that have a line are divided by the pages of the host,
and lines above ``ratio`` are dropped from the host's pages.

A page counts a line once, so all counts are sums of ones with map-side partial sums: a host
with a third of all pages is no large group.  A host has at most (distinct lines of a page,
on average) / ratio lines above the ratio, so the lines to drop fit in one row for each host,
and pages only meet that row; no line of a page is ever shuffled back.

Defined results: null html has no lines; a null or unreadable url has the empty host, which is
a host like any other; lines are trimmed and empty ones ignored; a line repeated in a page
counts once and is dropped everywhere; a line on fewer than ``least_pages`` pages of its host stays,
whatever its ratio, since one page alone shows no boilerplate; a ratio equal to the limit is kept;
rows that share a ``page_id`` are pages of their own; very long pages are read whole; other columns
are not read.  The host is without user name and port.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.session import materialize

RATIO = 0.3
LEAST_PAGES = 2  # with a line, for it to be dropped
BROADCAST_BYTES = 32 << 20
SALTS = 32

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
#: What of a page is not text, and which tags end a line.
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAKS = r"(?is)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>|[\r\n]+"
TAGS = r"(?s)<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines(html: Column) -> Column:
    """Lines of visible text, in order, with repeats."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^[ \t]+|[ \t]+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def _key(line: Column) -> Column:
    """128 bits of hash stand for a line, so that counting moves no text."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _with_host(pages: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """Pages beside their host's row: broadcast if all rows are known to be small, else joined with salt,
    so that the pages of one host go to many tasks."""
    size = boilerplate.agg(F.sum(F.octet_length("host") + F.size("drop") * 16 + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(boilerplate), "host", "left")
    salted = boilerplate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", (F.rand(0) * SALTS).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def drop_site_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text``: each page's lines without its site's boilerplate."""
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host(F.col(url_col)).alias("host"), lines(F.col(html_col)).alias("lines"))
    parsed = materialize(parsed, "page-lines")
    totals = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    each = parsed.select("host", F.explode(F.transform(F.array_distinct("lines"), _key)).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    common = counts.join(totals, "host").where(F.col("n") / F.col("pages") > ratio)
    boilerplate = materialize(common.groupBy("host").agg(F.collect_list("line").alias("drop")), "boilerplate")
    joined = _with_host(parsed, boilerplate)
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), _key(x))))
    return joined.select("page_id", "host", F.size("lines").alias("n_lines"), (F.size("lines") - F.size(kept)).alias("n_dropped"), F.array_join(kept, "\n").alias("text"))


def oracle_sql(ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """DuckDB SQL over ``pages`` for the same rows."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(coalesce(html, ''), {quote(UNSEEN)}, '', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {quote(BREAKS)}, chr(10), 'g'), {quote(TAGS)}, '', 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, {quote(name)}, {quote(char)})"
    trim = "regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g')"
    return f"""
WITH parsed AS (
  SELECT row_number() OVER () AS k, page_id, coalesce(lower(regexp_extract(url, {quote(HOST)}, 1)), '') AS host,
         list_filter(list_transform(string_split({text}, chr(10)), lambda x: {trim}), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM parsed GROUP BY host),
each AS (SELECT host, unnest(list_distinct(lines)) AS line FROM parsed),
counts AS (SELECT host, line, count(*) AS n FROM each GROUP BY host, line HAVING count(*) >= {least_pages}),
common AS (SELECT host, list(line) AS gone FROM counts JOIN totals USING (host) WHERE n / pages > {ratio} GROUP BY host),
kept AS (
  SELECT page_id, p.host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS rest
  FROM parsed p LEFT JOIN common c ON p.host = c.host)
SELECT page_id, host, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(lines) - len(rest) AS INTEGER) AS n_dropped, array_to_string(rest, chr(10)) AS text FROM kept
"""
