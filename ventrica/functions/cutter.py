"""A cut plane under a hand, and a probe that leaves the pose its view saved, as expressions on plain columns.

A gesture is worked out from its whole drag and the state it began with, so the result does not
depend on how often the pointer was sampled. Screen y grows downward, a camera's up upward.
"""

from __future__ import annotations

from math import atan, pi, radians, sin, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g
from . import views as v

#: Length of a normal's projection under which a plane counts as face-on, and over which it does not at all.
FACE_ON, EDGE_ON = 0.1, 0.3
#: One notch of the wheel, and the distances a camera keeps; one notch of a plane's depth as a share of the reach.
ZOOM, NEAREST, FARTHEST, DEPTH_NOTCH = 0.04, 40.0, 3000.0, 0.02
#: One press of a button in degrees and mm, the farthest a probe stands off, and what still counts as on track.
PRESS_DEG, PRESS_MM, STAND_OFF_MM = 2.0, 2.0, 60.0
TRACK_DEG, TRACK_MM = 0.05, 0.05
#: A probe's travel may widen the framed sphere to this share of the model's reach; the sphere gets this margin.
MOST_FRAMED, MARGIN = 1.5, 1.05


def direction(a: g.Vec) -> g.Vec:
    """a over its length; the zero vector stays as it is."""
    length = g.norm(a)
    return v.scaled(a, 1 / F.when(length == 0, 1.0).otherwise(length))


def anchor(pivot: g.Vec, normal: g.Vec, offset: Column) -> g.Vec:
    """The plane's point nearest to the pivot."""
    return v.added(pivot, v.scaled(normal, offset))


def kept(p: g.Vec, pivot: g.Vec, normal: g.Vec, offset: Column, flipped: Column) -> Column:
    """Whether a cut leaves p: at most ``offset`` along the normal, or at least that much if flipped."""
    along = g.dot(normal, g.sub(p, pivot))
    return F.when(flipped, along >= offset).otherwise(along <= offset)


def faces_away(normal: g.Vec, camera: g.Vec, pivot: g.Vec) -> Column:
    """Whether a cut has to be reversed to open toward the camera."""
    return g.dot(normal, g.sub(camera, pivot)) < 0


def aligned_offset(normal: g.Vec, point: g.Vec, pivot: g.Vec) -> Column:
    """How far from the pivot, along its unit normal, a plane through ``point`` lies."""
    return g.dot(normal, g.sub(point, pivot))


def mode_change(now: Column, then: Column, depth: Column, offset: Column) -> Column:
    """The depth after a change of mode: a free cutter starts where the cut is, an echo one at the image; no change, no move."""
    return F.when(now == then, depth).when(then == "free", offset).otherwise(0.0)


def tilted(df: DataFrame, normal: g.Vec, handle: g.Vec, right: g.Vec, up: g.Vec, dx: Column, dy: Column, per_pixel: float) -> DataFrame:
    """``df`` with the unit vector ``tilt``: a normal after its edge handle was dragged by (dx, dy) pixels.

    The handle can only leave the plane, so the drag counts along the way that minus the normal
    goes on the screen. A plane that faces the camera has no such way; there its edge tips like
    that of a picture frame, and between FACE_ON and EDGE_ON the two are blended. A handle along
    the normal turns nothing.
    """
    kept_columns = df.columns
    df = v.held(df, _n=direction(normal), _r=direction(right), _p=direction(up))
    df = v.held(df, _h=g.sub(handle, v.scaled(v.of("_n"), g.dot(handle, v.of("_n")))))
    df = df.withColumn("_lost", g.dot(v.of("_h"), v.of("_h")) < 1e-8)
    df = v.held(df, _h=direction(v.of("_h")))
    flat = lambda a: (g.dot(v.of(a), v.of("_r")), -g.dot(v.of(a), v.of("_p")))  # noqa: E731  # as pixels go
    df = df.withColumns({f"_{name}{axis}": c for name, a in (("n", "_n"), ("h", "_h")) for axis, c in zip("uv", flat(a), strict=True)})
    df = df.withColumns({"_nlen": F.hypot("_nu", "_nv"), "_hlen": F.hypot("_hu", "_hv")})
    along = lambda name: -(dx * F.col(f"_{name}u") + dy * F.col(f"_{name}v")) / F.col(f"_{name}len") * per_pixel
    out = F.when(F.col("_nlen") > FACE_ON, along("n")).otherwise(0.0)
    blend = F.least(F.greatest((F.col("_nlen") - FACE_ON) / (EDGE_ON - FACE_ON), F.lit(0.0)), F.lit(1.0))
    frame = (F.col("_nlen") < EDGE_ON) & (F.col("_hlen") > 1e-6)
    df = df.withColumn("_turn", F.when(frame, out * blend + along("h") * (1 - blend)).otherwise(out))
    # the axis is square to both, so the normal turns within the plane of itself and the handle
    turned = v.added(v.scaled(v.of("_n"), F.cos("_turn")), v.scaled(v.of("_h"), F.sin("_turn")))
    df = v.held(df, tilt=tuple(F.when(F.col("_lost"), n).otherwise(t) for n, t in zip(v.of("_n"), turned, strict=True)))
    return df.select(*kept_columns, *[f"tilt_{x}" for x in "xyz"])


def dragged_offset(offset: Column, normal: g.Vec, right: g.Vec, up: g.Vec, dx: Column, dy: Column, units: Column) -> Column:
    """A plane's offset after a drag; as it was where the unit normal has no way on the screen or a pixel no finite size."""
    x, y = g.dot(normal, right), -g.dot(normal, up)
    length = F.hypot(x, y)
    stays = (length < 1e-6) | units.isNull() | F.isnan(units) | (F.abs(units) == float("inf"))
    return F.when(stays, offset).otherwise(offset + (dx * x + dy * y) / length * units)


def zoomed(radius: Column, notch: Column) -> Column:
    return F.least(F.greatest(radius * (1 + F.signum(notch) * ZOOM), F.lit(NEAREST)), F.lit(FARTHEST))


def deepened(depth: Column, notch: Column, reach: Column) -> Column:
    """A plane's depth after a notch of the wheel with shift, held within the reach."""
    return F.greatest(-reach, F.least(reach, depth - F.signum(notch) * DEPTH_NOTCH * reach))


def nudged(df: DataFrame, about: Column, degrees: Column, name: str = "nudged") -> DataFrame:
    """``df`` that has the frame of :func:`views.imaging_frame`, with vectors ``name``_beam and ``name``_lateral.

    Turned in place about the lateral ("fan"), the normal ("aim") or the beam ("rotate").
    """
    turn = F.radians(degrees)
    axis = tuple(F.when(about == "fan", a).when(about == "aim", n).otherwise(b) for a, n, b in zip(v.of("lateral"), v.of("normal"), v.of("beam"), strict=True))
    df = v.held(df, _axis=axis)
    beam, lateral = f"{name}_beam", f"{name}_lateral"
    df = v.held(df, **{beam: direction(g.rotated(v.of("beam"), v.of("_axis"), turn)), lateral: g.rotated(v.of("lateral"), v.of("_axis"), turn)})
    df = v.held(df, **{lateral: g.sub(v.of(lateral), v.scaled(v.of(beam), g.dot(v.of(lateral), v.of(beam))))})  # many presses must not leave the frame askew
    return v.held(df, **{lateral: direction(v.of(lateral))}).drop(*[f"_axis_{x}" for x in "xyz"])


def stood_off(steps: Column) -> Column:
    """How far in mm presses move a probe along its beam."""
    return F.least(F.greatest(steps * PRESS_MM, F.lit(-STAND_OFF_MM)), F.lit(STAND_OFF_MM))


def left_track(free: tuple[g.Vec, g.Vec, g.Vec], saved: tuple[g.Vec, g.Vec, g.Vec]) -> Column:
    """Whether (origin, beam, lateral) is no longer the saved pose: by place or by direction. False for a null pose."""
    moved = g.norm(g.sub(free[0], saved[0])) > TRACK_MM
    turned = F.greatest(v.angle_deg(free[1], saved[1]), v.angle_deg(free[2], saved[2])) > TRACK_DEG
    return F.coalesce(moved | turned, F.lit(False))


def framing_distance(reach: Column, travel: Column, fov_deg: float, aspect: float) -> Column:
    """How far a camera stands to hold a sphere of ``reach``, widened for a probe's travel; null for a model without extent."""
    wide = F.least(F.greatest(reach, travel), MOST_FRAMED * reach)
    upright = radians(fov_deg)
    across = 2 * atan(tan(upright / 2) * aspect)
    return F.when(wide != 0, wide / sin(min(upright, across, pi) / 2) * MARGIN)
