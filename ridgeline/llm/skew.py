"""Joins where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1_000  # a key with more than one in so many rows is hot


def join_counted(rows: DataFrame, found: DataFrame, keys: list[str], count: str = "n", how: str = "left") -> DataFrame:
    """``rows.join(found, keys, how)`` for ``found`` with unique, non-null ``keys`` and, in ``count``, how many rows have each.

    Hot keys have more than a thousandth of the counted rows each, so they are fewer than a
    thousand whatever the input, and their side is broadcast; all others are joined by a shuffle
    in which no key is large.  ``found`` should be a written table, since it is read three times.
    """
    total = found.agg(F.sum(count)).first()[0] or 0
    hot = found.where(F.col(count) * SHARE > total)
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    extra = [c for c in found.columns if c not in keys]
    rest = marked.where("__hot is null").drop("__hot", *extra).join(found.where(F.col(count) * SHARE <= total), keys, how)
    return marked.where("__hot").drop("__hot").select(rest.columns).unionByName(rest)
