"""Imaging frames, screens, affine maps and colours as expressions on plain columns."""

from __future__ import annotations

from math import pi, radians, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as g

#: Distance in mm that a probe's envelope stands behind its origin.
ENVELOPE_MM = 46.0
#: Radii in pixels within which a pointer grabs, and beyond which a handle is hidden.
GRAB_PX, COARSE_GRAB_PX, NEAR_PX = 16, 26, 90
#: What is left of luminance and saturation of a dimmed colour.
DIM_LUMINANCE, DIM_SATURATION = 0.6, 0.28
#: Linear sRGB to XYZ by rows, the white, and where and how the cube root turns into a line.
SRGB_TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (0.95047, 1.0, 1.08883)
LINE_BELOW, LINE_SLOPE, LINE_START = 0.008856, 7.787, 16 / 116


def scaled(a: g.Vec, by) -> g.Vec:
    return tuple(c * by for c in a)


def added(a: g.Vec, b: g.Vec) -> g.Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def unit(a: g.Vec) -> g.Vec:
    """a over its length; an error for the zero vector, null for nulls."""
    length = g.norm(a)
    return scaled(a, 1 / F.when(length == 0, F.raise_error(F.lit("the zero vector has no direction")).cast("double")).otherwise(length))


def held(df: DataFrame, **vectors: g.Vec) -> DataFrame:
    """``df`` with vectors as columns name_x, name_y, name_z, so that what is built on them doesn't repeat how they are made."""
    return df.withColumns({f"{n}_{x}": c for n, v in vectors.items() for x, c in zip("xyz", v, strict=True)})


def of(name: str) -> g.Vec:
    return tuple(F.col(f"{name}_{x}") for x in "xyz")


def imaging_frame(df: DataFrame, beam: g.Vec, lateral: g.Vec) -> DataFrame:
    """``df`` with vectors beam, lateral and normal of unit length at right angles; the lateral gives way to the beam."""
    df = held(df, beam=unit(beam), lateral=lateral)
    df = held(df, lateral=g.sub(of("lateral"), scaled(of("beam"), g.dot(of("lateral"), of("beam")))))
    df = held(df, lateral=unit(of("lateral")))
    return held(df, normal=g.cross(of("beam"), of("lateral")))


def sample_point(origin: g.Vec, beam: g.Vec, lateral: g.Vec, u: Column, half_deg: float, mm: Column) -> g.Vec:
    """The point of a fan at lateral place u (-1 to 1) and a depth in mm."""
    turn = u * radians(half_deg)
    return added(origin, added(scaled(beam, F.cos(turn) * mm), scaled(lateral, F.sin(turn) * mm)))


def swept(t: Column, low: Column, high: Column) -> Column:
    """The reading of a sweep at t, which is held to 0 to 1."""
    return low + (high - low) * F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def step_share(low: Column, high: Column, step: float) -> Column:
    """How much of a sweep one press moves; nothing for a sweep without extent."""
    span = F.abs(high - low)
    return F.when(F.isnan(span) | span.isNull() | (span < 1e-9) | (span == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), step / span))


def behind(origin: g.Vec, beam: g.Vec) -> g.Vec:
    """The end of a probe's envelope: ENVELOPE_MM back along the beam; a beam without length moves nothing."""
    length = g.norm(beam)
    return g.sub(origin, scaled(beam, ENVELOPE_MM / F.when(length == 0, 1.0).otherwise(length)))


def plane_basis(df: DataFrame, normal: g.Vec, preferred: g.Vec) -> DataFrame:
    """``df`` with two unit vectors u and w in the plane across a unit normal, u as near to ``preferred`` as can be; x or y stands in where that is along the normal."""
    flat = lambda v: g.sub(v, scaled(normal, g.dot(v, normal)))
    use_x = F.abs(normal[0]) < 0.9
    df = held(df, u=flat(preferred), w=flat((F.when(use_x, 1.0).otherwise(0.0), F.when(use_x, 0.0).otherwise(1.0), F.lit(0.0))))
    lost = g.dot(of("u"), of("u")) < 1e-8
    df = held(df, u=tuple(F.when(lost, o).otherwise(f) for f, o in zip(of("u"), of("w"), strict=True)))
    df = held(df, u=unit(of("u")))
    return held(df, w=g.cross(normal, of("u")))


def angle_deg(a: g.Vec, b: g.Vec) -> Column:
    """The angle between two directions, steady near 0 and 180 too."""
    return F.degrees(F.atan2(g.norm(g.cross(a, b)), g.dot(a, b)))


def mapped(m: list[Column], p: g.Vec) -> g.Vec:
    """p under an affine map of 16 numbers by columns."""
    return tuple(m[r] * p[0] + m[4 + r] * p[1] + m[8 + r] * p[2] + m[12 + r] for r in range(3))


def unmapped(m: list[Column], p: g.Vec) -> g.Vec:
    """The point that the map takes to p; null where the map is singular (determinant under 1e-12).

    Cramer's rule: the determinant with one column replaced, over the determinant.
    """
    columns = [(m[4 * c], m[4 * c + 1], m[4 * c + 2]) for c in range(3)]
    rest = g.sub(p, (m[12], m[13], m[14]))
    det = lambda a, b, c: g.dot(a, g.cross(b, c))
    whole = det(*columns)
    sound = F.when(F.abs(whole) >= 1e-12, whole)
    return tuple(det(*[rest if k == c else columns[k] for k in range(3)]) / sound for c in range(3))


def screen_point(p: g.Vec, distance: float, fov_deg: float, width: int, height: int) -> tuple[Column, Column, Column]:
    """x and y in pixels, and whether it is in front, of a point seen from (0, 0, distance) along -z with y up."""
    depth = distance - p[2]
    reach = depth * tan(radians(fov_deg) / 2)
    return (p[0] / (reach * (width / height)) + 1) / 2 * width, (1 - p[1] / reach) / 2 * height, depth > 0


def segment_distance(ax: Column, ay: Column, bx: Column, by: Column, x: float, y: float) -> Column:
    """Distance in the plane from (x, y) to the segment a b, which may be a point."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    u = F.when(square < 1e-9, 0.0).otherwise(F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / F.when(square < 1e-9, 1.0).otherwise(square), F.lit(0.0)), F.lit(1.0)))
    return F.hypot(ax + dx * u - x, ay + dy * u - y)


def reveal(px: Column, coarse: bool) -> Column:
    """How visible a handle is at a pointer's distance: all at the grab radius, nothing at NEAR_PX; always all for a coarse pointer."""
    if coarse:
        return F.lit(1.0)
    near = F.least(F.greatest((NEAR_PX - px) / float(NEAR_PX - GRAB_PX), F.lit(0.0)), F.lit(1.0))
    return F.when(px.isNull() | F.isnan(px), 0.0).otherwise(near)


def channels(colour: Column) -> g.Vec:
    """Red, green and blue, 0 to 255, of a colour as a number 0xRRGGBB."""
    return tuple(F.shiftright(colour, bits).bitwiseAND(255).cast("double") for bits in (16, 8, 0))


def dimmed(rgb: g.Vec) -> g.Vec:
    luma = 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]
    return tuple(F.least(F.greatest((luma + DIM_SATURATION * (c - luma)) * DIM_LUMINANCE, F.lit(0.0)), F.lit(255.0)) for c in rgb)


def lab(rgb: g.Vec) -> g.Vec:
    """CIE L*, a*, b* of sRGB channels 0 to 255."""
    share = [c / 255 for c in rgb]
    linear = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) for c in share]
    f = []
    for row, white in zip(SRGB_TO_XYZ, WHITE, strict=True):
        t = sum(k * c for k, c in zip(row, linear, strict=True)) / white
        f.append(F.when(t > LINE_BELOW, F.pow(t, F.lit(1 / 3))).otherwise(t * LINE_SLOPE + LINE_START))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def colour_difference(df: DataFrame, one: g.Vec, two: g.Vec, name: str) -> DataFrame:
    """``df`` with the CIEDE2000 difference of two L*a*b* colours, by the published formula; steps are columns, so no expression is repeated."""
    kept = df.columns
    let = lambda d, **new: d.withColumns(new)
    c = lambda n: F.col(f"_{n}")
    df = let(df, **{f"_{n}{k}": v for k, lab_ in ((1, one), (2, two)) for n, v in zip("Lab", lab_, strict=True)})
    df = let(df, _m7=F.pow((F.hypot(c("a1"), c("b1")) + F.hypot(c("a2"), c("b2"))) / 2, F.lit(7.0)))
    df = let(df, _g=1.5 - 0.5 * F.sqrt(c("m7") / (c("m7") + 25.0**7)))
    df = let(df, **{f"_C{k}": F.hypot(c(f"a{k}") * c("g"), c(f"b{k}")) for k in (1, 2)}, **{f"_h{k}": F.when((c(f"a{k}") == 0) & (c(f"b{k}") == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(c(f"b{k}"), c(f"a{k}") * c("g"))), F.lit(360.0))) for k in (1, 2)})
    grey, gap = c("C1") * c("C2") == 0, c("h2") - c("h1")
    turn = F.when(grey, 0.0).when(gap > 180, gap - 360).when(gap < -180, gap + 360).otherwise(gap)
    total = c("h1") + c("h2")
    mean = F.when(grey, total).when(F.abs(gap) <= 180, total / 2).when(total < 360, total / 2 + 180).otherwise(total / 2 - 180)
    df = let(df, _dL=c("L2") - c("L1"), _dC=c("C2") - c("C1"), _dH=2 * F.sqrt(c("C1") * c("C2")) * F.sin(F.radians(turn / 2)), _H=mean, _C=(c("C1") + c("C2")) / 2, _l=F.pow((c("L1") + c("L2")) / 2 - 50, F.lit(2.0)))
    wave = lambda k, off: F.cos(F.radians(c("H") * k + off))
    df = let(df, _t=1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.20 * wave(4, -63), _C7=F.pow(c("C"), F.lit(7.0)))
    df = let(df, _x=c("dL") / (1 + 0.015 * c("l") / F.sqrt(20 + c("l"))), _y=c("dC") / (1 + 0.045 * c("C")), _z=c("dH") / (1 + 0.015 * c("C") * c("t")))
    df = let(df, _r=-2 * F.sqrt(c("C7") / (c("C7") + 25.0**7)) * F.sin(F.lit(pi / 3) * F.exp(-F.pow((c("H") - 275) / 25, F.lit(2.0)))))
    return df.withColumn(name, F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z") + c("r") * c("y") * c("z"))).select(*kept, name)
