"""Registered queries over the driver tables, with the DuckDB SQL of each."""

from __future__ import annotations

from heliograin.plans import cluster, datasets, decimals, fitting, flows, graph, market, monitoring, recurrence, retrieval, sequences, series, signal, state, stats, tabular, text  # noqa: F401
from heliograin.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "tabular_flagship"
