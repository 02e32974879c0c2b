"""Every registered query of the terrain engine, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from ridgeline.plans import field, network, surface

QUERIES: dict = {**surface.QUERIES, **network.QUERIES, **field.QUERIES}
ORACLES: dict = {**surface.ORACLES, **network.ORACLES, **field.ORACLES}
FLAGSHIP = "class_shares"
