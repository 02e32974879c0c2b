"""Mixing to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Token totals of the cells are raked:
one dimension after another, every cell is scaled by target over current total of its value,
``ROUNDS`` times.  ``residual``, the largest gap between a share and its target, tells how near
the marginals came; where cells are missing, no weights may meet all targets.  A document is
sampled with the probability (raked weight / tokens) of its cell over the largest such ratio, so
that the expected tokens of the sample follow the targets.

Targets are shares raised to ``TEMPERATURE`` unless given: a mild flattening, since the least
favoured cell decides how much is kept of all others.  A topic is any column expression over the
text; the one at hand tells kinds of text apart.  Only DataFrame functions are used.  Documents are
read once to sum up cells and once to sample; the cells, whose number does not follow the
documents, are what iterates, written to the shared folder every ``ROUNDS_A_WRITE`` rounds.

Defined results: a null source or language is the value ``''``; null text has no tokens and
topic ``none``; cells without tokens get probability 1 (nothing is known against them); rows that
share a ``doc_id`` are sampled alike, by a hash of the id; a null id hashes as ``''``; very long texts
are read whole; cells of equal ratio have equal probability; an empty table gives an empty result;
all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.skew import join_counted
from ridgeline.session import materialize

ROUNDS = 12
ROUNDS_A_WRITE = 4
MOST_BROADCAST = 100_000  # cells
TEMPERATURE = 0.9
DIMENSIONS = ("source", "lang", "topic")
DIGITS = 6


def n_tokens(text: Column) -> Column:
    """Words, as runs of other characters than blanks and line breaks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A topic by what kind of text it is: tables, code or licence text, shouting, symbols, prose."""
    return (
        F.when(text.isNull() | (F.length(text) == 0), "none")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(F.lower(text), F.lit("license")), "licence")
        .when(F.contains(text, F.lit("!!")), "shouting")
        .when(F.contains(text, F.lit("###")) | F.contains(text, F.lit("$$$")), "symbols")
        .otherwise("prose")
    )


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE) -> DataFrame:
    """``source, lang, topic, tokens, docs, weight, residual`` with the weights' marginals near the targets.

    ``cells``: ``source, lang, topic, tokens, docs``.  ``targets``: for any dimension a table
    ``value, share`` whose shares add up to 1 over the values that occur.
    """
    for d in DIMENSIONS:
        if targets and d in targets:
            cells = cells.join(targets[d].select(F.col("value").alias(d), F.col("share").alias(f"target_{d}")), d, "left").fillna(0.0, [f"target_{d}"])
        else:
            powered = cells.groupBy(d).agg((F.sum("tokens").cast("double") ** temperature).alias("p"))
            total = powered.agg(F.sum("p").alias("all"))
            # One number beside each value of the dimension.
            cells = cells.join(powered.join(F.broadcast(total)).select(d, F.coalesce(F.try_divide("p", "all"), F.lit(0.0)).alias(f"target_{d}")), d)
    cells = materialize(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for k in range(1, rounds + 1):
        for d in DIMENSIONS:
            now = F.sum("weight").over(Window.partitionBy(d))
            cells = cells.withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"target_{d}"), now), F.lit(0.0)))
        if k % ROUNDS_A_WRITE == 0 or k == rounds:
            cells = materialize(cells, "cells")
    gaps = F.greatest(*(F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"target_{d}")) for d in DIMENSIONS))
    residual = cells.select(gaps.alias("gap")).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("residual"))
    return cells.join(F.broadcast(residual)).select(*DIMENSIONS, "tokens", "docs", "weight", "residual")  # one row


def probabilities(raked: DataFrame) -> DataFrame:
    """``source, lang, topic, docs, weight, residual, probability, p``: the largest ratio of weight to tokens is kept whole.

    ``p`` is the probability unrounded, which draws take, so that cells of any size are sampled.
    """
    ratio = raked.withColumn("ratio", F.try_divide("weight", "tokens"))
    top = ratio.agg(F.max("ratio").alias("top"))
    p = F.coalesce(F.try_divide("ratio", "top"), F.lit(1.0))
    return ratio.join(F.broadcast(top)).select(*DIMENSIONS, "docs", F.round("weight", DIGITS).alias("weight"), F.round("residual", DIGITS).alias("residual"), F.round(p, DIGITS).alias("probability"), p.alias("p"))


def _described(docs: DataFrame, id_col: str, text_col: str, topic_of: Callable[[Column], Column]) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), topic_of(text).alias("topic"), n_tokens(text).alias("tokens"),
    )


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE, id_col: str = "doc_id", text_col: str = "text", topic_of: Callable[[Column], Column] = topic) -> DataFrame:
    """Every input row as the struct ``row`` with its cell, tokens, ``weight``, ``probability``, ``residual`` and ``kept``."""
    described = _described(docs, id_col, text_col, topic_of)
    cells = materialize(described.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "document-cells")
    chosen = materialize(probabilities(rake(cells, targets, rounds, temperature)), "probabilities")
    # Cells are few; where they are not, only those of many documents are broadcast.
    joined = described.join(F.broadcast(chosen), list(DIMENSIONS)) if chosen.count() <= MOST_BROADCAST else join_counted(described, chosen, list(DIMENSIONS), "docs", "inner")
    return joined.select("row", *DIMENSIONS, "tokens", "weight", "residual", "probability", (draw(F.col("id")) < F.col("p")).alias("kept"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their own columns."""
    return mix(docs, **options).where("kept").select("row.*")


def oracle_sql(rounds: int = ROUNDS, temperature: float = TEMPERATURE) -> str:
    """DuckDB SQL over ``documents`` for ``doc_id, source, lang, topic, tokens, weight, residual, probability, kept``."""
    steps, last = [], "start"
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"w{i}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (coalesce(weight * (t_{d} / nullif(sum(weight) OVER (PARTITION BY {d}), 0)), 0) AS weight) FROM {last})")
            last = name
    shares = ",\n".join(
        f"s_{d} AS (SELECT {d}, coalesce(p / nullif(sum(p) OVER (), 0), 0) AS t_{d} FROM (SELECT {d}, power(CAST(sum(tokens) AS DOUBLE), {temperature}) AS p FROM cells GROUP BY {d}))" for d in DIMENSIONS
    )
    sums = ", ".join(f"sum(weight) OVER (PARTITION BY {d}) AS sum_{d}" for d in DIMENSIONS)
    gaps = ", ".join(f"abs(sum_{d} - t_{d})" for d in DIMENSIONS)
    return f"""
WITH described AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
         CASE WHEN text IS NULL OR length(text) = 0 THEN 'none' WHEN contains(text, ' | ') THEN 'table' WHEN contains(lower(text), 'license') THEN 'licence'
              WHEN contains(text, '!!') THEN 'shouting' WHEN contains(text, '###') OR contains(text, '$$$') THEN 'symbols' ELSE 'prose' END AS topic,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS tokens
  FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM described GROUP BY ALL),
{shares},
start AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM cells JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic)),
{", ".join(steps)},
ratio AS (SELECT *, weight / nullif(tokens, 0) AS ratio FROM {last}),
gap AS (SELECT round(coalesce(max(greatest({gaps})), 0), {DIGITS}) AS residual FROM (SELECT *, {sums} FROM {last})),
p AS (SELECT source, lang, topic, round(weight, {DIGITS}) AS weight, coalesce(ratio / nullif(max(ratio) OVER (), 0), 1) AS p, round(p, {DIGITS}) AS probability FROM ratio)
SELECT doc_id, source, lang, topic, tokens, weight, residual, probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) < p AS kept
FROM described JOIN p USING (source, lang, topic), gap
"""
