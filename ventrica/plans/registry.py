"""All queries of the engine by name, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clinical, cutter, files, frames, gates, graphs, meshes, orbits, packs, points, probes, signals, surfaces, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _plans in (points, meshes, gates, signals, packs, surfaces, views, frames, graphs, probes, files, clinical, orbits, cutter):
    QUERIES |= _plans.QUERIES
    ORACLES |= _plans.ORACLES
