"""Queries of cut planes, probes off their track, requested views, reference poses and valves; embeddings are read as vectors, line items as faces of one mesh a supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cutter as c
from ..functions import geometry as g
from ..functions import views as v
from ..operators import valves
from .views import _E, _shown, _t, _vec

PER_PIXEL, REACH, FOV, ASPECT, GRID = 0.01, 4.0, 40.0, 1.6, 96
STOPS = 24


def cut_gestures(spark, sf_dir):
    """A handle's drag, a drag along the normal, a notch of the wheel and the change of mode of a cut for each embedding."""
    k = F.col("vec_id")
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    yaw, pitch = k % 63 / 10.0, k % 27 / 10.0 - 1.3
    back = (F.cos(pitch) * F.cos(yaw), F.cos(pitch) * F.sin(yaw), F.sin(pitch))
    rows = v.held(rows, given=_vec(0), h=_vec(3), p=_vec(6), right=(-F.sin(yaw), F.cos(yaw), F.lit(0.0)), back=back)
    rows = v.held(rows, up=g.cross(v.of("back"), v.of("right")), n=c.direction(v.of("given")))
    rows = rows.withColumns({"dx": (k % 41 - 20).cast("double"), "dy": (k % 31 - 15).cast("double"), "notch": k % 3 - 1, "offset": k % 9 / 4.0 - 1, "flipped": k % 2 == 1})
    # every fifth plane is seen nearly face-on
    rows = v.held(rows, n=tuple(F.when(k % 5 == 0, b + 0.2 * a).otherwise(a) for a, b in zip(v.of("n"), v.of("back"), strict=True)))
    rows = v.held(rows, n=c.direction(v.of("n")))
    rows = c.tilted(rows, v.of("n"), v.of("h"), v.of("right"), v.of("up"), F.col("dx"), F.col("dy"), PER_PIXEL)
    moved = c.dragged_offset(F.col("offset"), v.of("n"), v.of("right"), v.of("up"), F.col("dx"), F.col("dy"), F.lit(0.05))
    pivot, camera = g.vec(0.1, 0.2, 0.3), v.scaled(v.of("back"), F.lit(100.0))
    rows = rows.withColumns({"moved": moved, "echo": c.aligned_offset(v.of("n"), v.of("p"), pivot) + F.col("offset")})
    return rows.select(
        "vec_id", *_shown(v.of("tilt"), "t"), *_shown(c.anchor(pivot, v.of("n"), F.col("moved")), "a"), F.round("moved", 6).alias("moved"),
        c.kept(v.of("p"), pivot, v.of("n"), F.col("offset"), F.col("flipped")).alias("kept"), c.faces_away(v.of("n"), camera, pivot).alias("reverse"),
        F.round(c.zoomed(k % 3100 + 10.0, F.col("notch")), 6).alias("zoom"), F.round(c.deepened(F.col("moved"), F.col("notch"), F.lit(REACH)), 6).alias("depth"),
        F.round(c.mode_change(F.lit("echo"), F.when(k % 4 == 0, "echo").otherwise("free"), F.col("offset"), F.col("echo")), 6).alias("free_depth"),
    )


_DOT = lambda a, b: "(" + " + ".join(f"{a}{i}*{b}{i}" for i in range(3)) + ")"
# the turn of the normal about the axis normal x handle by Rodrigues' formula in full
GESTURES = f"""WITH {_E}, k AS (SELECT *, vec_id % 63 / 10.0::DOUBLE AS yaw, vec_id % 27 / 10.0::DOUBLE - 1.3::DOUBLE AS pitch, (vec_id % 41 - 20)::DOUBLE AS dx, (vec_id % 31 - 15)::DOUBLE AS dy, vec_id % 3 - 1 AS notch, vec_id % 9 / 4.0::DOUBLE - 1 AS s FROM e),
b AS (SELECT *, cos(pitch)*cos(yaw) AS b0, cos(pitch)*sin(yaw) AS b1, sin(pitch) AS b2, -sin(yaw) AS r0, cos(yaw) AS r1, 0.0::DOUBLE AS r2, sqrt({_DOT("e", "e")}) AS en FROM k),
g AS (SELECT *, b1*r2-b2*r1 AS u0, b2*r0-b0*r2 AS u1, b0*r1-b1*r0 AS u2, {", ".join(f"CASE WHEN vec_id % 5 = 0 THEN b{i} + 0.2::DOUBLE*e{i}/en ELSE e{i}/en END AS g{i}" for i in range(3))} FROM b),
n AS (SELECT *, {", ".join(f"g{i}/sqrt({_DOT('g', 'g')}) AS n{i}" for i in range(3))} FROM g),
f AS (SELECT *, {", ".join(f"e{i + 3} - n{i}*(e3*n0+e4*n1+e5*n2) AS f{i}" for i in range(3))} FROM n), d AS (SELECT *, {", ".join(f"f{i}/sqrt({_DOT('f', 'f')}) AS d{i}" for i in range(3))} FROM f),
w AS (SELECT *, {_DOT("n", "r")} AS nr, {_DOT("n", "u")} AS nu, {_DOT("d", "r")} AS dr, {_DOT("d", "u")} AS du, n1*d2-n2*d1 AS x0, n2*d0-n0*d2 AS x1, n0*d1-n1*d0 AS x2 FROM d),
l AS (SELECT *, sqrt(nr*nr+nu*nu) AS nl, sqrt(dr*dr+du*du) AS dl FROM w),
t AS (SELECT *, CASE WHEN nl > 0.1 THEN (dy*nu - dx*nr)/nl*{PER_PIXEL}::DOUBLE ELSE 0 END AS out, CASE WHEN nl < 0.3 AND dl > 1e-6 THEN greatest(0, (nl-0.1)/0.2::DOUBLE) ELSE 1 END AS mix FROM l),
a AS (SELECT *, mix*out + CASE WHEN mix < 1 THEN (1-mix)*(dy*du - dx*dr)/dl*{PER_PIXEL}::DOUBLE ELSE 0 END AS a, s + CASE WHEN nl < 1e-6 THEN 0 ELSE (dx*nr - dy*nu)/nl*0.05::DOUBLE END AS moved, (e6-0.1::DOUBLE)*n0 + (e7-0.2::DOUBLE)*n1 + (e8-0.3::DOUBLE)*n2 AS along FROM t)
SELECT vec_id, {", ".join(f"round(n{i}*cos(a) + (x{(i + 1) % 3}*n{(i + 2) % 3}-x{(i + 2) % 3}*n{(i + 1) % 3})*sin(a) + x{i}*{_DOT('x', 'n')}*(1-cos(a)), 6) + 0.0 AS t{x}" for i, x in enumerate("xyz"))},
 {", ".join(f"round({p}::DOUBLE + n{i}*moved, 6) + 0.0 AS a{x}" for i, (x, p) in enumerate(zip("xyz", (0.1, 0.2, 0.3), strict=True)))}, round(moved, 6) AS moved,
 CASE WHEN vec_id % 2 = 1 THEN along >= s ELSE along <= s END AS kept, n0*(100*b0-0.1::DOUBLE) + n1*(100*b1-0.2::DOUBLE) + n2*(100*b2-0.3::DOUBLE) < 0 AS reverse,
 round(least(3000, greatest(40, (vec_id % 3100 + 10)*(1 + notch*0.04::DOUBLE))), 6) AS zoom, round(greatest(-{REACH}::DOUBLE, least({REACH}::DOUBLE, moved - notch*{REACH * 0.02}::DOUBLE)), 6) AS depth, round(CASE WHEN vec_id % 4 = 0 THEN s ELSE along + s END, 6) AS free_depth FROM a"""


def free_probes(spark, sf_dir):
    """Each embedding's probe after presses about one of its axes and along its beam, how far it stands off, and whether it left its sweep."""
    k = F.col("vec_id")
    rows = v.held(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), p=_vec(0), q=_vec(3), o=_vec(6))
    rows = v.imaging_frame(rows, v.of("p"), v.of("q"))
    about = F.when(k % 3 == 0, "fan").when(k % 3 == 1, "aim").otherwise("rotate")
    rows = c.nudged(rows.withColumns({"about": about, "presses": k % 9 - 4}), F.col("about"), F.col("presses") * c.PRESS_DEG)
    along = c.stood_off(k % 81 - 40)
    rows = v.held(rows.withColumn("mm", F.when(k % 2 == 0, along).otherwise(0.0)), at=v.added(v.of("o"), v.scaled(v.of("beam"), F.col("mm"))))
    # the sweep fans the saved pose by 0 to 8 degrees; at a quarter of it every pose of two presses is on track again
    swept = v.swept(F.lit(0.25), F.lit(0.0), F.lit(8.0))
    rows = c.nudged(rows, F.lit("fan"), swept * (k % 3 == 0).cast("int"), "saved")
    off = c.left_track((v.of("at"), v.of("nudged_beam"), v.of("nudged_lateral")), (v.of("o"), v.of("saved_beam"), v.of("saved_lateral")))
    stands = g.dot(g.sub(v.of("at"), v.of("o")), v.of("beam"))
    return rows.select("vec_id", *_shown(v.of("nudged_beam"), "b"), *_shown(v.of("nudged_lateral"), "l"), (F.round(stands, 5) + 0.0).alias("stands_off"), F.when(k % 7 != 0, off).otherwise(False).alias("off_track"))


# turns about an axis of the frame mix the two others
PROBES = f"""WITH {_E}, b AS (SELECT *, sqrt({_DOT("e", "e")}) AS bn FROM e), r AS (SELECT *, {", ".join(f"e{i}/bn AS b{i}, e{i + 3} - e{i}*(e0*e3+e1*e4+e2*e5)/bn**2 AS q{i}" for i in range(3))} FROM b),
m AS (SELECT *, {", ".join(f"q{i}/sqrt({_DOT('q', 'q')}) AS m{i}" for i in range(3))}, vec_id % 3 AS about, vec_id % 9 - 4 AS presses, CASE WHEN vec_id % 2 = 0 THEN greatest(-60, least(60, 2*(vec_id % 81 - 40))) ELSE 0 END::DOUBLE AS mm FROM r),
n AS (SELECT *, b1*m2-b2*m1 AS n0, b2*m0-b0*m2 AS n1, b0*m1-b1*m0 AS n2, radians(2.0::DOUBLE*presses) AS a FROM m)
SELECT vec_id, {", ".join(f"round(CASE about WHEN 0 THEN b{i}*cos(a)-n{i}*sin(a) WHEN 1 THEN b{i}*cos(a)+m{i}*sin(a) ELSE b{i} END, 6) + 0.0 AS b{x}" for i, x in enumerate("xyz"))},
 {", ".join(f"round(CASE about WHEN 0 THEN m{i} WHEN 1 THEN m{i}*cos(a)-b{i}*sin(a) ELSE m{i}*cos(a)+n{i}*sin(a) END, 6) + 0.0 AS l{x}" for i, x in enumerate("xyz"))},
 round(mm, 5) + 0.0 AS stands_off, vec_id % 7 <> 0 AND (mm <> 0 OR presses <> CASE about WHEN 0 THEN 1 ELSE 0 END) AS off_track FROM n"""


def requested_views(spark, sf_dir):
    """The pack, view, mode and scale that each customer's address asks for: regions are packs, their nations views."""
    part = lambda name: F.try_url_decode(F.try_parse_url("address", F.lit("QUERY"), F.lit(name)))
    nations = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.lower("n_name").alias("view_id"), F.col("n_nationkey").alias("nation"))
    packs = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.lower("r_name").alias("pack"))
    # a region has few nations; the first of an id counts
    ordered = nations.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("nation", "view_id"))), lambda s: s.view_id).alias("views"))
    known = packs.join(ordered, "region", "left").select("pack", F.coalesce("views", F.array().cast("array<string>")).alias("views"))
    asked = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://viewer.example/app?"), _query()).alias("address"))
    asked = asked.select("c_custkey", F.lower(F.coalesce(part("pack"), F.lit("asia"))).alias("pack"), part("view").alias("view"), part("mode").alias("mode"), part("polar").alias("polar"))
    rows = asked.join(known, "pack", "left")
    by_id = F.array_position("views", F.col("view")) - 1
    number = F.regexp_extract("view", r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    at = F.when(F.col("views").isNull(), None).when(by_id >= 0, by_id).when((number >= 0) & (number < F.size("views")), number).otherwise(0)
    scale = F.regexp_extract("polar", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    polar = F.when(scale.isNull() | F.isnan(scale) | (F.abs(scale) == float("inf")), 1.0).otherwise(F.least(F.greatest(scale, F.lit(0.25)), F.lit(4.0)))
    rows = rows.withColumn("view_index", at)
    return rows.select("c_custkey", "pack", "view_index", F.get("views", F.col("view_index").cast("int")).alias("view_id"), F.when(F.col("mode") == "explore", "explore").otherwise("echo").alias("mode"), polar.alias("polar"))


#: What addresses ask for, dealt by key; %20 is a blank.
ASKED_PACKS = ("", "pack=EUROPE", "pack=middle%20east", "pack=nowhere", "pack=Africa")
ASKED_VIEWS = ("", "&view=france", "&view=3", "&view=2nd", "&view=-1", "&view=99", "&view=united%20kingdom", "&view=", "&view=%201")
ASKED_MODES = ("", "&mode=explore", "&mode=Explore&polar=9", "&polar=.5x", "&polar=-3e2", "&polar=wide", "&polar=1e999")


def _query():
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") / by % len(values)).cast("int") + 1)
    return F.concat(pick(ASKED_PACKS, 1), pick(ASKED_VIEWS, 5), pick(ASKED_MODES, 45))


# what each dealt value means, stated in place of being parsed
_PICK = lambda values, by: f"([{', '.join(values)}])[c_custkey // {by} % {len(values)} + 1]"
REQUESTS = f"""WITH a AS (SELECT c_custkey, {_PICK(["'asia'", "'europe'", "'middle east'", "'nowhere'", "'africa'"], 1)} AS pack, {_PICK(["NULL", "'france'", "NULL", "NULL", "NULL", "NULL", "'united kingdom'", "NULL", "NULL"], 5)} AS wanted,
 {_PICK(["0", "0", "3", "2", "0", "0", "0", "0", "1"], 5)} AS ordinal, {_PICK(["'echo'", "'explore'", *["'echo'"] * 5], 45)} AS mode, {_PICK(["1.0", "1.0", "4.0", "0.5", "0.25", "1.0", "1.0"], 45)}::DOUBLE AS polar FROM customer),
v AS (SELECT lower(r_name) AS pack, lower(n_name) AS view_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS place, count(*) OVER (PARTITION BY r_regionkey) AS many FROM nation JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT pack, max(many) AS n FROM v GROUP BY 1), i AS (SELECT a.*, CASE WHEN n IS NULL THEN NULL WHEN v.place IS NOT NULL THEN v.place WHEN ordinal < n THEN ordinal ELSE 0 END AS view_index FROM a LEFT JOIN s USING (pack) LEFT JOIN v ON v.pack = a.pack AND v.view_id = wanted)
SELECT c_custkey, i.pack, view_index::BIGINT AS view_index, v.view_id, mode, polar FROM i LEFT JOIN v ON v.pack = i.pack AND v.place = view_index"""


def reference_poses(spark, sf_dir):
    """For each label's points: a probe above them that looks down, as deep as the farthest corner of their box, and the map from model to cells of a grid round them."""
    rows = v.held(_t(spark, sf_dir, "embeddings").select("label", "embedding"), p=_vec(0))
    box = rows.groupBy("label").agg(*[f(f"p_{x}").alias(f"{n}_{x}") for n, f in (("low", F.min), ("high", F.max)) for x in "xyz"])
    low, high = v.of("low"), v.of("high")
    box = v.held(box, mid=v.scaled(v.added(low, high), F.lit(0.5)))
    box = v.held(box, at=(F.col("mid_x"), F.col("mid_y"), high[2] + (high[2] - low[2]) * 0.12))
    # the farthest corner lies on the far side of each axis
    far = tuple(F.greatest(F.abs(a - p), F.abs(b - p)) for a, b, p in zip(low, high, v.of("at"), strict=True))
    box = box.withColumn("depth", F.round(g.norm(far) * (1.05 / 10), 3))
    pitch = F.greatest(*g.sub(high, low)) / (GRID - 2)
    scale = 1 / F.when(pitch != 0, pitch)
    moved = tuple(GRID / 2.0 - m * scale for m in v.of("mid"))
    return box.select("label", *_shown(v.of("at"), "o"), F.col("depth"), F.round(F.col("depth") * 0.55, 4).alias("focus"), F.round(scale, 6).alias("scale"), *_shown(moved, "m"))


REFERENCE = f"""WITH {_E}, b AS (SELECT label, {", ".join(f"min(e{i}) AS a{i}, max(e{i}) AS b{i}, (min(e{i})+max(e{i}))/2 AS m{i}" for i in range(3))} FROM e GROUP BY 1),
o AS (SELECT *, b2 + (b2-a2)*0.12::DOUBLE AS o2, greatest(b0-a0, b1-a1, b2-a2)/{GRID - 2} AS pitch FROM b),
c AS (SELECT label, max(sqrt((x-m0)**2 + (y-m1)**2 + (z-o2)**2)) AS reach FROM (SELECT *, unnest([a0, b0]) AS x FROM o) JOIN (SELECT label AS l1, unnest([a1, b1]) AS y FROM o) ON l1 = label JOIN (SELECT label AS l2, unnest([a2, b2]) AS z FROM o) ON l2 = label GROUP BY 1),
d AS (SELECT o.*, round(reach*(1.05::DOUBLE/10), 3) AS depth FROM o JOIN c USING (label))
SELECT label, round(m0, 6) + 0.0 AS ox, round(m1, 6) + 0.0 AS oy, round(o2, 6) + 0.0 AS oz, depth, round(depth*0.55::DOUBLE, 4) AS focus, round(1/pitch, 6) AS scale, {", ".join(f"round({GRID / 2}::DOUBLE - m{i}/pitch, 6) + 0.0 AS m{x}" for i, x in enumerate("xyz"))} FROM d"""


def framed_views(spark, sf_dir):
    """How far a camera stands to hold each label's points and the whole travel of each embedding's probe."""
    rows = v.held(_t(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), p=_vec(0))
    reach = rows.groupBy("label").agg(F.max(g.norm(v.of("p"))).alias("reach"))
    stops = F.transform(F.sequence(F.lit(0), F.lit(STOPS)), lambda s: g.norm(v.behind(g.vec(0, 0, -44), g.rotated(v.of("p"), g.vec(0, 0, 1), F.radians(v.swept(s / float(STOPS), F.lit(-20.0), F.lit(20.0)))))))
    joined = rows.withColumn("travel", F.array_max(stops)).join(reach, "label")
    return joined.select("vec_id", F.round("reach", 6).alias("reach"), F.round(c.framing_distance(F.col("reach"), F.col("travel"), FOV, ASPECT), 5).alias("distance"))


# a turn about z moves no end of an envelope that starts on z nearer or farther
FRAMED = f"""WITH {_E}, r AS (SELECT label, max(sqrt({_DOT("e", "e")})) AS reach FROM e GROUP BY 1),
t AS (SELECT vec_id, reach, sqrt((46**2)*(e0*e0+e1*e1)/{_DOT("e", "e")} + (44 + 46*e2/sqrt({_DOT("e", "e")}))**2) AS travel FROM e JOIN r USING (label))
SELECT vec_id, round(reach, 6) AS reach, round(least(1.5::DOUBLE*reach, greatest(reach, travel))/sin(radians({FOV / 2}))*1.05::DOUBLE, 5) AS distance FROM t"""


def valve_outcomes(spark, sf_dir):
    """Valves of one mesh a supplier: line items are faces between a ring, by part, and a chamber; some suppliers swap rings, share a pair among rings or lack one."""
    s, ring, side = F.col("l_suppkey"), 7 + F.col("l_partkey") % 5, F.col("l_linenumber") % 2
    named = F.when((ring == 11) & (s % 5 != 0), 11).when(ring == 11, 7).when((s % 7 == 0) & (ring <= 8), 15 - ring).when((s % 3 == 0) & (ring == 9), 11).otherwise(ring)  # whose chambers it borders
    pair = lambda k: F.element_at(F.array(*[F.lit(valve[1][k]) for valve in sorted(valves.VALVES.values())]), (named - 6).cast("int"))
    met = F.when(named == 11, 1).when(F.col("l_quantity") == 50, 6 - F.col("l_linenumber") % 6).when(side == 0, pair(0)).otherwise(pair(1))
    faces = _t(spark, sf_dir, "lineitem").select(s.alias("mesh"), F.when(F.col("l_tax") > 0.07, 1).otherwise(ring).alias("tag"), met.alias("chamber"), F.lit(1).alias("n_faces"))
    return valves.identify(faces)


OUTCOMES = """WITH l AS (SELECT l_suppkey AS s, 7 + l_partkey % 5 AS ring, l_linenumber AS ln, l_quantity AS q, l_tax AS tax FROM lineitem),
m AS (SELECT *, CASE WHEN ring = 11 THEN CASE WHEN s % 5 = 0 THEN 7 ELSE 11 END WHEN s % 7 = 0 AND ring IN (7, 8) THEN CASE ring WHEN 7 THEN 8 ELSE 7 END WHEN s % 3 = 0 AND ring = 9 THEN 11 ELSE ring END AS role FROM l),
f AS (SELECT s, ring, CASE WHEN role = 11 THEN 1 WHEN q = 50 THEN 6 - ln % 6 WHEN ln % 2 = 0 THEN CASE role WHEN 7 THEN 1 WHEN 8 THEN 2 WHEN 9 THEN 1 ELSE 2 END ELSE CASE role WHEN 7 THEN 3 WHEN 8 THEN 4 WHEN 9 THEN 5 ELSE 6 END END AS chamber FROM m WHERE NOT tax > 0.07),
n AS (SELECT s, ring, chamber, count(*) AS n FROM f GROUP BY ALL), h AS (SELECT *, n >= sum(n) OVER (PARTITION BY s, ring) * 0.02 AS strong FROM n),
k AS (SELECT s, ring, string_agg(chamber::VARCHAR, '' ORDER BY chamber) AS pair FROM h WHERE strong GROUP BY 1, 2),
p(valve, published, pair) AS (VALUES ('aortic', 9, '15'), ('mitral', 7, '13'), ('pulmonary', 10, '26'), ('tricuspid', 8, '24')),
o AS (SELECT d.s AS mesh, p.valve, p.published, coalesce(string_agg(k.ring::VARCHAR, ',' ORDER BY k.ring), '') AS tags, count(k.ring) AS n, min(k.ring) AS tag FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem) d CROSS JOIN p LEFT JOIN k ON k.s = d.s AND k.pair = p.pair GROUP BY ALL),
c AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN tag <> published THEN 'disagrees' ELSE 'agrees' END AS outcome FROM o),
v AS (SELECT mesh, CASE WHEN bool_or(outcome = 'ambiguous') THEN 'ambiguous' WHEN bool_or(outcome = 'missing') THEN 'missing' WHEN bool_or(outcome = 'disagrees') THEN 'disagrees' ELSE 'agrees' END AS verdict, coalesce(string_agg(valve || '=' || tag, ',' ORDER BY valve) FILTER (n > 0), '') AS measured FROM c GROUP BY 1)
SELECT mesh, valve, tags, published, outcome, verdict, measured FROM c JOIN v USING (mesh)"""

QUERIES = {f.__name__: f for f in (cut_gestures, free_probes, requested_views, reference_poses, framed_views, valve_outcomes)}
ORACLES = {"cut_gestures": GESTURES, "free_probes": PROBES, "requested_views": REQUESTS, "reference_poses": REFERENCE, "framed_views": FRAMED, "valve_outcomes": OUTCOMES}
