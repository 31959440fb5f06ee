"""Forests and graphs as tables: walks to the root by pointer doubling, components by contraction.

Every round is written to the shared folder and the round before it deleted, so a plan never
grows with the rounds and a lost executor costs at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written


def climbed(nodes: DataFrame) -> DataFrame:
    """node, root, top, endless for nodes(node, parent, name).

    ``root`` is the last node of the walk along parents, ``top`` the name met last on the walk, the
    node's own included (null names don't count). A parent that is no node ends the walk. A walk
    that runs into a circle never ends: it is ``endless`` and its root is null. Nodes must be
    unique; a null parent is none; no nodes give no rows. After r rounds a pointer spans 2^r
    parents, so the rounds are as many as the number of nodes has bits.
    """
    known = nodes.select(F.col("node").alias("_n"))
    start = nodes.join(known, F.col("parent") == F.col("_n"), "left").select("node", F.col("_n").alias("up"), F.col("node").alias("last"), F.col("name").alias("top"))
    state = written(start, "walks")
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("up is not null").isEmpty():
            break
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("last").alias("_last"), F.col("top").alias("_top"))
        moved = state.join(ahead, "up", "left")
        old, state = state, written(moved.select("node", F.col("_up").alias("up"), F.coalesce("_last", "last").alias("last"), F.coalesce("_top", "top").alias("top")), "walks")
        discard(old)
    endless = F.col("up").isNotNull()
    return state.select("node", F.when(~endless, F.col("last")).alias("root"), "top", endless.alias("endless"))


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges(u, v); component is the smallest node reachable.

    Each round a component hooks on to its smallest neighbour if that is smaller, the trees that
    come of it are climbed, and edges inside a component drop out. Self-loops make a node of its
    own known; repeated and reversed edges count once; nulls are left out; no edges give no rows.
    """
    sound = edges.where("u is not null and v is not null")
    nodes = sound.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found = written(nodes.select("node", F.col("node").alias("component")), "components")
    left = written(sound.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not left.isEmpty():
        hooks = left.groupBy("u").agg(F.min("v").alias("parent"))
        ends = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        trees = ends.join(hooks.withColumnRenamed("u", "node"), "node", "left").select("node", "parent", F.lit(None).cast("string").alias("name"))
        roots = climbed(trees).select("node", "root")
        moved = found.join(roots.withColumnRenamed("node", "component"), "component", "left")
        old, found = found, written(moved.select("node", F.coalesce("root", "component").alias("component")), "components")
        discard(old)
        by = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))  # noqa: B023, E731
        mapped = left.join(by("u"), "u").join(by("v"), "v").where("_u <> _v")
        old, left = left, written(mapped.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct(), "links")
        discard(old)
        discard(roots)
    return found
