"""Vector and sector expressions on plain columns; everything stays inside generated code."""

from __future__ import annotations

from math import radians
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(x, y, z) -> Vec:
    return tuple(c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def rotated(v: Vec, axis: Vec, angle: Column) -> Vec:
    """Rodrigues rotation of v about a unit axis by radians."""
    c, s, k = F.cos(angle), F.sin(angle), dot(axis, v)
    return tuple(p * c + q * s + a * k * (1 - c) for p, q, a in zip(v, cross(axis, v), axis, strict=True))


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


class Probe(NamedTuple):
    """Where a fan stands and how it looks: origin, unit beam and lateral, half angle, depth and slab in mm and degrees."""

    origin: Vec
    beam: Vec
    lateral: Vec
    half_deg: float = 35.0
    depth: float = 120.0
    slab: float = 6.0

    def parts(self, p: Vec) -> tuple[Column, Column, Column]:
        """Along the beam, across it in the plane, and off the plane."""
        d = sub(p, self.origin)
        return dot(d, self.beam), dot(d, self.lateral), dot(d, cross(self.beam, self.lateral))

    def contains(self, p: Vec) -> Column:
        """Inside the sector; all bounds count as inside."""
        along, across, off = self.parts(p)
        return (F.abs(off) <= self.slab) & (F.abs(F.atan2(across, along)) <= radians(self.half_deg)) & (F.sqrt(along * along + across * across) <= self.depth)

    def crossed(self, p: Vec) -> Column:
        """Soft membership in 0 to 1, falling off near slab, depth and angle."""
        along, across, off = self.parts(p)
        reach, turn = F.sqrt(along * along + across * across) / self.depth, F.abs(F.atan2(across, along)) / radians(self.half_deg)
        soft = (1 - smoothstep(0.6, 1.0, F.abs(off) / self.slab)) * (1 - smoothstep(0.97, 1.0, reach)) * (1 - smoothstep(0.94, 1.0, turn))
        return F.when(along >= 0, soft).otherwise(0.0)


def translated(probe: Probe, axis: Vec, mm: Column) -> Probe:
    return probe._replace(origin=tuple(o + a * mm for o, a in zip(probe.origin, axis, strict=True)))


def tilted(probe: Probe, axis: Vec, degrees: Column) -> Probe:
    turn = lambda v: rotated(v, axis, F.radians(degrees))
    return probe._replace(beam=turn(probe.beam), lateral=turn(probe.lateral))


def time_gain(db: float, depth: Column, whole: float) -> Column:
    fraction = F.least(F.greatest(depth / whole, F.lit(0.0)), F.lit(1.0)) if whole > 0 else F.lit(0.0)
    return F.pow(F.lit(10.0), db * fraction / 20)


def compressed(envelope: Column, gain: float = 1.0, reject: float = 0.0008, range_db: float = 60.0, gamma: float = 1.25) -> Column:
    """Grey level 0 to 1 of an envelope: reject, one log window, gamma."""
    x = envelope * gain
    level = F.least(F.greatest(20 * F.log10(F.greatest(x, F.lit(1e-30))) / range_db + 1, F.lit(0.0)), F.lit(1.0))
    return F.when(x <= reject, 0.0).otherwise(F.pow(level, F.lit(gamma)))


def hash01(x: Column, y: Column, z: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) for a lattice point: a 32-bit integer hash nested over z, y, x."""
    mask = (1 << 32) - 1

    def let(value: Column, f) -> Column:  # names a value, so that using it twice doesn't double the expression
        return F.element_at(F.transform(F.array(value), f), 1)

    def times(a: Column, k: int) -> Column:  # 32-bit product without overflow of 64
        high = F.shiftleft((F.shiftrightunsigned(a, 16) * k).bitwiseAND(65535), 16)
        return (high + a.bitwiseAND(65535) * k).bitwiseAND(mask)

    def folded(a: Column, bits: int) -> Column:
        return let(a, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))

    def mix(a: Column) -> Column:
        a = let(folded(a, 16), lambda v: times(v, 0x7FEB352D))
        a = let(folded(a, 15), lambda v: times(v, 0x846CA68B))
        return folded(a, 16)

    at = lambda c: (c.cast("long") + 8192).bitwiseAND(mask)
    h = mix(at(x).bitwiseXOR(mix(at(y).bitwiseXOR(mix((at(z) + seed % 65536).bitwiseAND(mask))))))
    return h.bitwiseAND(0xFFFFFF) / float(1 << 24)
