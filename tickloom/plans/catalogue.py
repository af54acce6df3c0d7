"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import problem_sql, problems, timing, timing_sql

PROBLEMS = ["p1_found", "p1_grid", "p2_found", "p2_flags", "p3_found", "p4_found", "p4_instants", "p5_found", "p5_table", "p6_found", "p6_energies", "p6_times"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {name: getattr(problems, name) for name in PROBLEMS} | {name: getattr(timing, name) for name in timing.NAMES}


def oracle_sql() -> dict[str, str]:
    """SQL by the name of the query."""
    return {"p1_found": problem_sql.P1_FOUND, "p1_grid": problem_sql.P1_GRID, "p6_times": problem_sql.P6_TIMES, "p3_found": problem_sql.P3_FOUND, "p6_found": problem_sql.P6_FOUND} | timing_sql.SQL
