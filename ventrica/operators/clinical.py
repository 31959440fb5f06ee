"""Imaging views from measured landmarks: a frame for each case, poses built from it, refusals as rows, and the order in which sweeps reach structures."""

from __future__ import annotations

from functools import reduce
from math import radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import views as v
from ..scratch import written
from . import frames

#: Structures that landmarks are measured from, the valve rings among them.
ROLES = ("lv", "rv", "la", "ra", "mitral", "tricuspid", "aortic", "pulmonary", "svc", "ivc")
RINGS = ("mitral", "tricuspid", "aortic", "pulmonary")
LANDMARKS = ("apex", "base", *ROLES)
#: Half slabs of the image and of the depth and the stand-off in mm, room below the deepest point, share of the way to the apex, steps of a sweep.
SLAB, DEPTH_SLAB, STAND_OFF, DEPTH_ROOM, TRAVEL = 6.0, 12.0, 8.0, 1.08, 0.88
SAMPLES = 61
#: Fixed names: views that no landmark of such a mesh can place, and why; they are rows as well.
NOT_BUILT = {"a3-subcostal-coronal": "no landmark below the heart", "a4-subcostal-sagittal": "no landmark below the heart"}


def landmarks(points: DataFrame) -> DataFrame:
    """case and, for each of LANDMARKS, its place, for points(case, role, along, x, y, z).

    A role's place is the mean of its different points, the base the mean of the four rings, the
    apex the mean of the lowest percentile of the left ventricle along its own coordinate. A case
    without points of a role has nulls there.
    """
    spots = points.select("case", "role", *"xyz").distinct()
    means = spots.groupBy("case").agg(*[F.avg(F.when(F.col("role") == r, F.col(x))).alias(f"{r}_{x}") for r in ROLES for x in "xyz"])
    apex = frames.axis_ends(points.where("role = 'lv'"), "case", "along").select("case", *[F.col(f"a{x}").alias(f"apex_{x}") for x in "xyz"])
    base = {f"base_{x}": sum(F.col(f"{r}_{x}") for r in RINGS) / len(RINGS) for x in "xyz"}
    return means.join(apex, "case", "left").withColumns(base)


def framed(marks: DataFrame) -> DataFrame:
    """Landmarks of each case turned into its own frame (left, basal, front), with checks, n_passed, n_checks and failed.

    The long axis runs from apex to base, left from the right atrium to the left one. The nine
    checks use what the frame was not built from, or what right angles cannot force.
    """
    df = frames.frame(marks, v.of("apex"), v.of("base"), g.sub(v.of("la"), v.of("ra")))
    basis = [v.of(n) for n in ("left", "long", "front")]
    df = df.withColumn("long_axis", g.norm(g.sub(v.of("base"), v.of("apex"))))
    df = v.held(df, **{n: frames.framed(basis, v.of(n)) for n in LANDMARKS})
    at = lambda n, x: F.col(f"{n}_{x}")
    checks = {
        "pulmonary valve before aortic valve": at("pulmonary", "z") > at("aortic", "z"),
        "mitral valve left of tricuspid valve": at("mitral", "x") > at("tricuspid", "x"),
        "left ventricle left of right one": at("lv", "x") > at("rv", "x"),
        "aortic valve right of mitral valve": at("aortic", "x") < at("mitral", "x"),
        "left atrium basal to left ventricle": at("la", "y") > at("lv", "y"),
        "right atrium basal to right ventricle": at("ra", "y") > at("rv", "y"),
        "upper vein basal to the valves": at("svc", "y") > at("base", "y"),
        "lower vein behind the upper one": at("ivc", "z") < at("svc", "z"),
        "apex beyond every valve": F.forall(F.array(*[at(r, "y") for r in RINGS]), lambda y: at("apex", "y") < y),
    }
    df = df.withColumn("checks", F.create_map(*[c for n, ok in checks.items() for c in (F.lit(n), ok)]))
    failed = F.array_join(F.map_keys(F.map_filter("checks", lambda _, ok: ~ok)), "; ")
    return df.withColumns({"n_checks": F.size("checks"), "n_passed": F.size(F.map_filter("checks", lambda _, ok: ok)), "failed": failed})


def _facing(a: g.Vec, towards: Column) -> g.Vec:
    """a, or its opposite where ``towards`` is negative."""
    return tuple(F.when(towards < 0, -c).otherwise(c) for c in a)


def _half(p: g.Vec, q: g.Vec) -> g.Vec:
    return v.scaled(v.added(p, q), 0.5)


def _poses(df: DataFrame) -> DataFrame:
    """case, view_id, through, beam, side, turn (axis of the sweep), how it sweeps, and what the view must hold or meet, one row a view."""
    apex, base, mitral, tricuspid, aortic = (v.of(n) for n in ("apex", "base", "mitral", "tricuspid", "aortic"))
    up = g.vec(0, 0, 1)
    def built(view: str, steps: list[dict], half: float, tilt: tuple[float, float] | None, holds: list[str], meets: list[str]) -> DataFrame:
        out = df
        for s in steps:
            out = v.held(out, **{n: f() for n, f in s.items()})
        marks = lambda names: F.array(*[F.struct(F.lit(n).alias("name"), *[F.col(f"{n}_{x}").alias(x) for x in "xyz"]) for n in names]) if names else F.array().cast("array<struct<name:string,x:double,y:double,z:double>>")
        low, high = tilt or (0.0, 0.0)
        cols = [F.col(f"{n}_{x}") for n in ("through", "beam", "side", "turn", "apex") for x in "xyz"]
        return out.select("case", F.lit(view).alias("view_id"), *cols, F.lit(half).alias("half"), F.lit(tilt is not None).alias("tilts"), F.lit(low).alias("low"), F.lit(high).alias("high"), marks(holds).alias("holds"), marks(meets).alias("meets"))

    plane = lambda p, q: {"n": lambda: v.unit(g.cross(g.sub(p, apex), g.sub(q, apex)))}
    four = built("b1-apical-four-chamber", [
        plane(mitral, tricuspid), {"n": lambda: _facing(v.of("n"), v.of("n")[2])},
        {"through": lambda: apex, "beam": lambda: v.unit(g.sub(_half(mitral, tricuspid), apex))},
        {"side": lambda: v.unit(g.cross(v.of("n"), v.of("beam"))), "turn": lambda: v.unit(g.cross(v.of("beam"), v.of("n")))},
        {"side": lambda: _facing(v.of("side"), g.dot(v.of("side"), g.sub(mitral, tricuspid)))},
    ], 40.0, (-18.0, 22.0), ["mitral", "tricuspid", "apex"], [])
    long_axis = built("c1-parasternal-long-axis", [
        plane(mitral, aortic), {"n": lambda: _facing(v.of("n"), v.of("n")[0])},
        {"through": lambda: _half(mitral, aortic), "beam": lambda: v.scaled(v.unit(g.sub(up, v.scaled(v.of("n"), v.of("n")[2]))), -1)},
        {"side": lambda: v.unit(g.cross(v.of("n"), v.of("beam"))), "turn": lambda: v.unit(g.cross(v.of("beam"), v.of("n")))},
        {"side": lambda: _facing(v.of("side"), g.dot(v.of("side"), g.sub(base, apex)))},
    ], 35.0, (-20.0, 20.0), ["mitral", "aortic"], ["apex"])
    short_axis = built("c2-parasternal-short-axis", [
        {"turn": lambda: v.unit(g.sub(apex, base))},
        {"beam": lambda: v.unit(v.scaled(g.sub(up, v.scaled(v.of("turn"), v.of("turn")[2])), -1)), "through": lambda: v.added(base, v.scaled(v.of("turn"), g.dot(g.sub(aortic, base), v.of("turn")) + 2.0))},
        {"side": lambda: v.unit(g.cross(v.of("turn"), v.of("beam")))}, {"side": lambda: _facing(v.of("side"), v.of("side")[0])},
    ], 35.0, None, ["aortic"], [])
    return reduce(DataFrame.unionByName, (four, long_axis, short_axis))


def clinical_views(points: DataFrame, cases: DataFrame) -> DataFrame:
    """case, view_id, refused, depth_cm, vacuous, structures_in_order of every view of every case of ``framed``.

    The probe stands off as far as the case's points reach behind the aim, and looks as deep as
    what lies in its slab. A landmark that the view must hold but the sector does not, or that the
    plane misses, refuses the view: ``refused`` names all of them with their distance from the
    plane. A kept view has the roles that its sweep reaches in order of the first sample, larger
    ones first in one sample; an order that the sweep did not make (all in one sample, or fewer
    than two) is vacuous and empty. Views of NOT_BUILT are refused in every case.
    """
    # each step reads the one before several times; views are three rows a case, so writing them keeps plans short
    cases = written(cases, "cases")
    basis = [v.of(n) for n in ("left", "long", "front")]
    turned = points.join(cases.select("case", *[f"{n}_{x}" for n in ("left", "long", "front") for x in "xyz"]), "case")
    inside = turned.select("case", "role", *[c.alias(f"p_{x}") for x, c in zip("xyz", frames.framed(basis, tuple(F.col(x) for x in "xyz")), strict=True)])
    views = written(_poses(cases), "poses")
    p = v.of("p")
    behind = inside.join(views.select("case", "view_id", *[f"{n}_{x}" for n in ("through", "beam") for x in "xyz"]), "case").groupBy("case", "view_id").agg(F.max(g.dot(g.sub(v.of("through"), p), v.of("beam"))).alias("behind"))
    views = views.join(behind, ["case", "view_id"])
    views = v.held(views, origin=g.sub(v.of("through"), v.scaled(v.of("beam"), F.greatest("behind", F.lit(0.0)) + STAND_OFF)))
    views = written(v.held(views, normal=g.cross(v.of("beam"), v.of("side"))), "views")
    away = g.sub(p, v.of("origin"))
    reach = g.norm(away)
    seen = inside.join(views.select("case", "view_id", *[f"{n}_{x}" for n in ("origin", "normal") for x in "xyz"]), "case")
    deep = seen.groupBy("case", "view_id").agg(F.coalesce(F.max(F.when(F.abs(g.dot(away, v.of("normal"))) <= DEPTH_SLAB, reach)), F.max(reach)).alias("deep"))
    views = views.join(deep, ["case", "view_id"]).withColumn("depth_cm", F.bround(F.col("deep") * DEPTH_ROOM / 10, 2))
    travel = F.bround(g.dot(g.sub(v.of("apex"), v.of("origin")), v.of("turn")) * TRAVEL, 1)
    views = views.withColumn("high", F.when(F.col("tilts"), F.col("high")).otherwise(travel))

    def parts(m: Column) -> tuple[Column, Column, Column]:
        d = tuple(m[x] - F.col(f"origin_{x}") for x in "xyz")
        return g.dot(d, v.of("beam")), g.dot(d, v.of("side")), F.abs(g.dot(d, v.of("normal")))

    def outside(m: Column) -> Column:
        along, across, off = parts(m)
        return ~((off <= SLAB) & (F.abs(F.atan2(across, along)) <= F.radians("half")) & (F.hypot(along, across) <= F.col("depth_cm") * 10))

    told = lambda what: lambda m: F.concat(F.lit(f"{what} "), m["name"], F.lit(" "), F.round(parts(m)[2], 1).cast("string"))
    reasons = F.concat(F.transform(F.filter("holds", outside), told("does not hold")), F.transform(F.filter("meets", lambda m: parts(m)[2] > SLAB), told("misses")))
    views = written(views.withColumn("refused", F.nullif(F.array_join(reasons, "; "), F.lit(""))), "judged")
    order = _order(inside, views.where("refused is null"))
    kept = views.select("case", "view_id", "refused", "depth_cm").join(order, ["case", "view_id"], "left")
    vacuous = F.when(F.col("refused").isNull(), F.coalesce("vacuous", F.lit(True)))
    kept = kept.select("case", "view_id", "refused", "depth_cm", vacuous.alias("vacuous"), F.when(F.col("refused").isNull(), F.when(vacuous, "").otherwise(F.col("names"))).alias("structures_in_order"))
    absent = F.explode(F.array(*[F.struct(F.lit(n).alias("view_id"), F.lit(why).alias("refused")) for n, why in NOT_BUILT.items()]))
    return kept.unionByName(cases.select("case", absent.alias("n")).select("case", "n.*"), allowMissingColumns=True)


def _order(inside: DataFrame, views: DataFrame) -> DataFrame:
    """case, view_id, vacuous, names: in which order each sweep first reaches the roles."""

    def pose(step: Column) -> Column:
        reading = F.col("low") + (F.col("high") - F.col("low")) * step.cast("double") / (SAMPLES - 1)
        angle = F.when(F.col("tilts"), F.radians(reading)).otherwise(0.0)
        slide = F.when(F.col("tilts"), 0.0).otherwise(reading)
        at = {"o": v.added(v.of("origin"), v.scaled(v.of("turn"), slide)), **{n: g.rotated(v.of(c), v.of("turn"), angle) for n, c in (("b", "beam"), ("s", "side"))}}
        return F.struct(step.alias("step"), *[c.alias(f"{n}{x}") for n, vec in at.items() for x, c in zip("xyz", vec, strict=True)])

    def contains(m: Column) -> Column:
        beam, side = (tuple(m[f"{n}{x}"] for x in "xyz") for n in "bs")
        d = tuple(F.col(f"p_{x}") - m[f"o{x}"] for x in "xyz")
        along, across = g.dot(d, beam), g.dot(d, side)
        return (F.abs(g.dot(d, g.cross(beam, side))) <= SLAB) & (F.abs(F.atan2(across, along)) <= radians(1) * F.col("half")) & (F.hypot(along, across) <= F.col("depth_cm") * 10)

    # poses are worked out once a view, so that a point only compares
    poses = views.select("case", "view_id", "half", "depth_cm", F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), pose).alias("poses"))
    at = inside.join(poses, "case")
    reached = F.transform(F.filter("poses", contains), lambda m: m["step"])
    steps = at.select("case", "view_id", "role", F.when(F.size(reached) > 0, F.element_at(reached, 1)).alias("step"))
    first = steps.groupBy("case", "view_id", "role").agg(F.min("step").alias("step"), (-F.count("*")).alias("less")).where("step is not null")
    listed = F.array_sort(F.collect_list(F.struct("step", "less", "role")))  # ten roles at most
    return first.groupBy("case", "view_id").agg(((F.count("*") < 2) | (F.min("step") == F.max("step"))).alias("vacuous"), F.array_join(listed["role"], ",").alias("names"))
