"""Orientations of an orbiting camera as quaternions (x, y, z, w) of plain columns.

A camera at rest looks along -z with y up. Where there is no answer, a direction or an up
vector without length or along the view, the result is null.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g
from . import views as v

Quat = tuple[Column, Column, Column, Column]
#: Fixed value: radians that a pixel of a drag turns.
DRAG_SPEED = 0.008
SLERP_FLAT = 1 - 2.0**-52


def let(df: DataFrame, **quats: Quat) -> DataFrame:
    """``df`` with quaternions as columns name_x, name_y, name_z, name_w."""
    return df.withColumns({f"{n}_{x}": c for n, q in quats.items() for x, c in zip("xyzw", q, strict=True)})


def of(name: str) -> Quat:
    return tuple(F.col(f"{name}_{x}") for x in "xyzw")


def product(a: Quat, b: Quat) -> Quat:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz


def around(axis: tuple[float, float, float], angle: Column) -> Quat:
    s = F.sin(angle / 2)
    return tuple(s * a for a in axis) + (F.cos(angle / 2),)


def turned(p: g.Vec, q: Quat) -> g.Vec:
    """p turned by a unit quaternion."""
    u, w = q[:3], q[3]
    t = v.scaled(g.cross(u, p), 2)
    return v.added(p, v.added(v.scaled(t, w), g.cross(u, t)))


def unit(q: Quat) -> Quat:
    n = F.sqrt(sum(c * c for c in q))
    return tuple(c / F.when(n > 0, n) for c in q)


def yaw_pitch(yaw: Column, pitch: Column) -> Quat:
    """Yaw about y, then pitch about the camera's own x; a positive pitch looks down from above."""
    return product(around((0.0, 1.0, 0.0), yaw), around((1.0, 0.0, 0.0), -pitch))


def dragged(q: Quat, dx: Column, dy: Column) -> Quat:
    """q after a drag in pixels: yaw about the world's y, the other way round where the camera is upside down, and pitch about its own x."""
    upright = F.when(turned(g.vec(0, 1, 0), q)[1] >= 0, 1.0).otherwise(-1.0)
    return unit(product(around((0.0, 1.0, 0.0), -dx * DRAG_SPEED * upright), product(q, around((1.0, 0.0, 0.0), -dy * DRAG_SPEED))))


def offset(q: Quat, radius: Column) -> g.Vec:
    """Where the camera stands from what it orbits."""
    return turned((F.lit(0.0), F.lit(0.0), radius), q)


def looking(df: DataFrame, forward: g.Vec, up: g.Vec, name: str) -> DataFrame:
    """``df`` with the orientation ``name`` that looks along ``forward`` with ``up`` upwards, made of its three axes."""
    kept = df.columns
    length = g.norm(forward)
    df = v.held(df, _b=v.scaled(forward, -1 / F.when(length > 0, length)))
    df = v.held(df, _u=g.sub(up, v.scaled(v.of("_b"), g.dot(up, v.of("_b")))))
    square = g.dot(v.of("_u"), v.of("_u"))
    df = v.held(df, _u=v.scaled(v.of("_u"), 1 / F.when(square >= 1e-12, F.sqrt(square))))
    df = v.held(df, _r=g.cross(v.of("_u"), v.of("_b")))
    (rx, ry, rz), (ux, uy, uz), (bx, by, bz) = v.of("_r"), v.of("_u"), v.of("_b")
    # the largest of the four squared parts is taken as root, the others follow from sums and gaps of the axes
    parts = {"w": 1 + rx + uy + bz, "x": 1 + rx - uy - bz, "y": 1 - rx + uy - bz, "z": 1 - rx - uy + bz}
    rest = {"w": (uz - by, bx - rz, ry - ux, parts["w"]), "x": (parts["x"], ry + ux, bx + rz, uz - by), "y": (ry + ux, parts["y"], uz + by, bx - rz), "z": (bx + rz, uz + by, parts["z"], ry - ux)}
    df = df.withColumns({f"_p{n}": c for n, c in parts.items()})
    best = F.greatest(*[F.col(f"_p{n}") for n in parts])
    pick = lambda k: F.coalesce(*[F.when(F.col(f"_p{n}") == best, rest[n][k] / (2 * F.sqrt(F.col(f"_p{n}")))) for n in parts])
    return let(df, **{name: tuple(pick(k) for k in range(4))}).select(*kept, *[f"{name}_{x}" for x in "xyzw"])


def echo_looking(df: DataFrame, beam: g.Vec, lateral: g.Vec, vertex_down: Column, flipped: Column, name: str) -> DataFrame:
    """The orientation from which a fan is seen as its image shows it: the beam down the screen unless the vertex is below, the lateral to the right unless flipped."""
    up = tuple(F.when(vertex_down, c).otherwise(-c) for c in beam)
    right = tuple(F.when(flipped, -c).otherwise(c) for c in lateral)
    return looking(df, g.cross(up, right), up, name)


def eased(t: Column) -> Column:
    return g.smoothstep(0.0, 1.0, t)


def shortest(a: Quat, b: Quat) -> Quat:
    """b, or what turns the same with all signs changed, whichever lies nearer to a."""
    near = sum(p * q for p, q in zip(a, b, strict=True)) < 0
    return tuple(F.when(near, -c).otherwise(c) for c in b)


def slerp(a: Quat, b: Quat, t: Column) -> Quat:
    """The orientation a share t of the way from a to b along the shorter arc; a straight line where they are all but equal."""
    b = shortest(a, b)
    cosine = F.least(sum(p * q for p, q in zip(a, b, strict=True)), F.lit(1.0))
    sine = F.sqrt(1 - cosine * cosine)
    angle = F.atan2(sine, cosine)
    flat = cosine >= SLERP_FLAT
    s = F.when(flat, 1.0).otherwise(sine)
    weights = F.when(flat, 1 - t).otherwise(F.sin((1 - t) * angle) / s), F.when(flat, t).otherwise(F.sin(t * angle) / s)
    return tuple(p * weights[0] + q * weights[1] for p, q in zip(a, b, strict=True))


def wrapped(angle: Column) -> Column:
    """The same angle from -pi up to pi."""
    return F.pmod(angle + pi, F.lit(2 * pi)) - pi
