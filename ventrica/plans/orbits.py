"""Queries of camera orientations: each customer is a camera, its key tells yaw, pitch and a drag."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import orbit
from ..functions import views as v


def camera_orbits(spark, sf_dir):
    """Where each camera stands after a drag and half a glide back to where it was."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 63 / 10.0 - 3.1).alias("yaw"), (F.col("c_custkey") % 29 / 10.0 - 1.4).alias("pitch"), (F.col("c_custkey") % 200 - 100).cast("double").alias("dx"), (F.col("c_custkey") % 90 - 45).cast("double").alias("dy"))
    rows = orbit.let(rows, q=orbit.yaw_pitch(F.col("yaw"), F.col("pitch")))
    rows = orbit.let(rows, d=orbit.dragged(orbit.of("q"), F.col("dx"), F.col("dy")))
    rows = orbit.let(rows, h=orbit.slerp(orbit.of("d"), orbit.of("q"), orbit.eased(F.lit(0.5))))
    rows = v.held(rows, at=orbit.offset(orbit.of("h"), F.lit(100.0)))
    return rows.select("c_custkey", *[(F.round(f"at_{x}", 5) + 0.0).alias(f"at_{x}") for x in "xyz"], F.round(orbit.wrapped(F.col("yaw") * 3), 6).alias("turn"))


_MUL = lambda a, b: [f"({a[3]}*{b[0]} + {a[0]}*{b[3]} + {a[1]}*{b[2]} - {a[2]}*{b[1]})", f"({a[3]}*{b[1]} - {a[0]}*{b[2]} + {a[1]}*{b[3]} + {a[2]}*{b[0]})", f"({a[3]}*{b[2]} + {a[0]}*{b[1]} - {a[1]}*{b[0]} + {a[2]}*{b[3]})", f"({a[3]}*{b[3]} - {a[0]}*{b[0]} - {a[1]}*{b[1]} - {a[2]}*{b[2]})"]
_Q = lambda n: [f"{n}_{x}" for x in "xyzw"]
_AS = lambda n, q: ", ".join(f"{c} AS {n}_{x}" for c, x in zip(q, "xyzw", strict=True))
_Y = lambda angle: ["0", f"sin(({angle})/2)", "0", f"cos(({angle})/2)"]
_P = lambda angle: [f"sin(({angle})/2)", "0", "0", f"cos(({angle})/2)"]
# the camera's axes from a rotation matrix: its third column times the radius is where it stands, the middle of the second tells whether it is upright
ORBITS = f"""WITH c AS (SELECT c_custkey, (c_custkey % 63) / 10.0::DOUBLE - 3.1::DOUBLE AS yaw, (c_custkey % 29) / 10.0::DOUBLE - 1.4::DOUBLE AS pitch, (c_custkey % 200 - 100)::DOUBLE AS dx, (c_custkey % 90 - 45)::DOUBLE AS dy FROM customer),
q AS (SELECT *, {_AS("q", _MUL(_Y("yaw"), _P("-pitch")))} FROM c), u AS (SELECT *, CASE WHEN 1 - 2*(q_x*q_x + q_z*q_z) >= 0 THEN 1 ELSE -1 END AS up FROM q),
e AS (SELECT *, {_AS("r", _MUL(_Q("q"), _P("-dy*0.008::DOUBLE")))} FROM u), d AS (SELECT *, {_AS("d", _MUL(_Y("-dx*0.008::DOUBLE*up"), _Q("r")))} FROM e),
s AS (SELECT *, CASE WHEN d_x*q_x + d_y*q_y + d_z*q_z + d_w*q_w < 0 THEN -1 ELSE 1 END AS near FROM d),
m AS (SELECT *, {_AS("m", [f"(d_{x} + near*q_{x})" for x in "xyzw"])} FROM s), h AS (SELECT *, {_AS("h", [f"(m_{x} / sqrt(m_x*m_x + m_y*m_y + m_z*m_z + m_w*m_w))" for x in "xyzw"])} FROM m)
SELECT c_custkey, round(200*(h_x*h_z + h_w*h_y), 5) + 0.0 AS at_x, round(200*(h_y*h_z - h_w*h_x), 5) + 0.0 AS at_y, round(100*(1 - 2*(h_x*h_x + h_y*h_y)), 5) + 0.0 AS at_z, round(yaw*3 - 2*pi()*floor((yaw*3 + pi()) / (2*pi())), 6) AS turn FROM h"""

QUERIES = {"camera_orbits": camera_orbits}
ORACLES = {"camera_orbits": ORBITS}
