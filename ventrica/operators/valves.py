"""Valves named by the chambers that they part, with every way to fail as a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mesh import GRAZE

#: Tags of chambers and vessels, and by valve its published tag and the two that it parts.
CHAMBERS = (1, 2, 3, 4, 5, 6)
VALVES = {"aortic": (9, (1, 5)), "mitral": (7, (1, 3)), "pulmonary": (10, (2, 6)), "tricuspid": (8, (2, 4))}


def identify(borders: DataFrame) -> DataFrame:
    """mesh, valve, tags, published, outcome, verdict, measured from rows borders(mesh, tag, chamber, n_faces).

    A tag that is no chamber is a valve if the chambers that hold at least GRAZE of its faces
    with chambers are just the pair of one. Of each valve: "missing" without a tag, "ambiguous"
    with several, "disagrees" with another than the published one, else "agrees". The verdict of
    a mesh is the first of ambiguous, missing, disagrees that any valve has; ``measured`` lists
    valve=tag with the least tag of each. Rows with a null tag or chamber, or with no faces,
    count for nothing but their mesh; repeated rows add up; a null mesh is one more mesh.
    Empty input gives no rows.
    """
    chamber = F.col("chamber").isin(*CHAMBERS) & ~F.col("tag").isin(*CHAMBERS) & (F.col("n_faces") > 0)
    faces = F.when(chamber, F.col("n_faces"))
    shared = borders.groupBy("mesh", "tag", F.when(chamber, F.col("chamber")).alias("chamber")).agg(F.sum(faces).alias("n"))
    met = F.collect_list(F.when(F.col("n").isNotNull(), F.struct("chamber", "n")))  # one a chamber
    by_tag = shared.groupBy("mesh", "tag").agg(met.alias("met"), F.sum("n").alias("total"))
    strong = F.array_sort(F.transform(F.filter("met", lambda m: m.n >= F.col("total") * GRAZE), lambda m: m.chamber.cast("int")))
    valve = F.coalesce(*[F.when(strong == F.array(*map(F.lit, pair)), F.lit(name)) for name, (_, pair) in VALVES.items()])
    found = F.array_sort(F.collect_set(F.when(valve.isNotNull(), F.struct(valve.alias("valve"), F.col("tag").alias("tag")))))  # at most the tags of a mesh
    by_mesh = by_tag.groupBy("mesh").agg(found.alias("found"))
    names = F.array(*[F.struct(F.lit(n).alias("valve"), F.lit(t).alias("published")) for n, (t, _) in VALVES.items()])
    tags = lambda w: F.transform(F.filter(F.col("found"), lambda f: f.valve == w.valve), lambda f: f.tag)
    outcome = lambda w: F.when(F.size(tags(w)) == 0, "missing").when(F.size(tags(w)) > 1, "ambiguous").when(tags(w)[0] != w.published, "disagrees").otherwise("agrees")
    told = by_mesh.select("mesh", F.transform(names, lambda w: F.struct(w.valve.alias("valve"), w.published.alias("published"), tags(w).alias("tags"), outcome(w).alias("outcome"))).alias("told"))
    verdict = F.coalesce(*[F.when(F.array_contains(F.col("told.outcome"), o), F.lit(o)) for o in ("ambiguous", "missing", "disagrees")], F.lit("agrees"))
    measured = F.concat_ws(",", F.transform(F.filter("told", lambda t: F.size(t.tags) > 0), lambda t: F.concat(t.valve, F.lit("="), t.tags[0].cast("string"))))
    each = told.select("mesh", verdict.alias("verdict"), measured.alias("measured"), F.explode("told").alias("t"))
    return each.select("mesh", "t.valve", F.concat_ws(",", F.col("t.tags").cast("array<string>")).alias("tags"), "t.published", "t.outcome", "verdict", "measured")
