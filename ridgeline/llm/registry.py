"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from ridgeline.llm import queries

QUERIES: dict = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES: dict = dict(queries.ORACLES)
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
