"""Registered queries of the match and map operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchspark.plans import map_queries, match_queries, oracles, room_queries, route_queries, source_queries, study_queries
from matchspark.plans.inputs import Inputs

FLAGSHIP = "q4a_life_outcomes"
PAIRED = map_queries.QUERIES | source_queries.QUERIES | study_queries.QUERIES | room_queries.QUERIES | route_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> function of (spark, folder of tables)."""
    bind = lambda f: lambda spark, sf_dir: f(Inputs(spark, sf_dir))
    paired = {name: f for name, (f, _, _) in PAIRED.items()}
    return {name: bind(f) for name, f in (match_queries.QUERIES | paired).items()}


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL with the same rows."""
    return oracles.oracle_sql() | {name: oracles.composed(inputs, sql) for name, (_, inputs, sql) in PAIRED.items()}
