"""Graphs, rays, fewer facets, neighbours, orientations, packs on disk, ledgers and streams on hand-made cases."""

import itertools
import json
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ventrica.functions import orbit
from ventrica.functions import views as v
from ventrica.operators import assets, clinical, graph, ledger, mesh, packs, points, rays, reduce, surfaces
from ventrica.sources import packs as pack_files
from ventrica.streaming import first_seen

XYZ = "id long, x double, y double, z double"


def test_walks_end_at_roots_and_tell_circles(spark):
    rows = [(1, None, "top"), (2, 1, None), (3, 2, "low"), (4, 99, "alone"), (5, 6, "a"), (6, 7, "b"), (7, 6, "c"), (8, 8, "self")] + [(100 + k, 99 + k if k else None, None) for k in range(40)]
    got = {r.node: (r.root, r.top, r.endless) for r in graph.climbed(spark.createDataFrame(rows, "node long, parent long, name string")).collect()}
    assert got[1] == (1, "top", False) and got[2] == (1, "top", False) and got[3] == (1, "top", False) and got[4] == (4, "alone", False)
    assert {k for k, r in got.items() if r[2]} == {5, 6, 7, 8} and all(got[k][0] is None for k in (5, 6, 7, 8))
    assert got[139] == (100, None, False)
    assert graph.climbed(spark.createDataFrame([], "node long, parent long, name string")).count() == 0


def test_components_equal_union_find(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(900, 900), (None, 3), (500 + 2, 500), (500, 502)] + [(1000 + k, 1001 + k) for k in range(60)]
    up = {}

    def root(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: root(a) for a in up}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def box_facets(spark, structure=1):
    """A closed box of 10 by 4 by 2, wound outwards."""
    tets, at = mesh.box_tets(spark).withColumn("tag", F.lit(structure)), mesh.box_points(spark)
    held = mesh.with_corners(surfaces.wound_boundary(tets, at), at, "abc")
    corner = lambda c: F.struct(*[F.col(f"{c}{x}").alias(x) for x in "xyz"]).alias(c)
    return held.select(F.col("tag").alias("structure"), *map(corner, "abc"))


def test_points_inside_a_box_are_told(spark):
    places = [("in", 5.03, 2.01, 1.02), ("in", 0.51, 0.52, 0.23), ("out", 11.0, 2.01, 1.02), ("out", -1.0, 2.03, 1.04), ("out", 5.01, 5.02, 1.0), ("null", None, 1.0, 1.0), ("null", 5.0, float("nan"), 1.0)]
    found = rays.enclosed(box_facets(spark), spark.createDataFrame(places, "group string, x double, y double, z double"), 0.7)
    assert {(r.group, r.n, r.inside) for r in found.collect()} == {("in", 2, 2), ("out", 3, 0), ("null", 2, 0)}
    parity = rays.ray_parity(box_facets(spark), spark.createDataFrame([(k, 0.13 + 0.37 * k, 1.01) for k in range(12)], "ray long, y double, z double"), 0.9).collect()
    assert [(r.hits, r.rays, r.odd) for r in parity] == [(2, 11, False)]


def test_a_cut_box_is_capped_where_it_is_cut(spark):
    f = box_facets(spark)
    grid = surfaces.fitted_grid(f, 22)
    whole = rays.caps(f, grid, 22, F.lit(True))
    assert whole.count() == 0  # what goes in comes out again
    cut = rays.caps(f, grid, 22, F.col("x") <= 5)
    lines = surfaces.crossings(f, grid, 22).select("j", "k").distinct().count()
    assert cut.count() == lines and {r.net for r in cut.collect()} == {-1}
    assert rays.caps(f, grid, 22, F.col("x") > 50).count() == 0


def test_facets_fit_their_budget_and_keep_their_box(spark):
    f = box_facets(spark, 1).unionByName(box_facets(spark, 2).limit(3))
    kept, report = reduce.decimated(f, 150, 4)
    told = {r.structure: r for r in report.collect()}
    assert told[1].after <= told[1].allowed and told[1].before > told[1].after and told[2].before == 3
    counts = {r.structure: r["count"] for r in kept.groupBy("structure").count().collect()}
    assert all(counts.get(s, 0) == r.after for s, r in told.items())
    ends = kept.where("structure = 1").agg(F.min("a.x"), F.max("a.x")).first()
    assert -0.5 < ends[0] < 3 and 7 < ends[1] < 10.5
    assert reduce.decimated(f.limit(0), 100)[0].count() == 0


def test_neighbours_equal_brute_force_with_ties(spark):
    rnd = random.Random(2)
    rows = [(k, float(rnd.randint(0, 4)), float(rnd.randint(0, 4)), float(rnd.randint(-2, 2))) for k in range(120)] + [(500, 1000.0, 0.0, 0.0), (501, None, 1.0, 1.0), (502, float("nan"), 1.0, 1.0)]
    frame = spark.createDataFrame(rows, XYZ)
    got = {}
    for r in points.nearest_k(frame, frame, 5, 0.8).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.other, r.distance)
    sound = [r for r in rows if r[0] < 501]
    for i, *p in sound:
        near = sorted((math.dist(p, q), j) for j, *q in sound if j != i)[:5]
        assert [got[i][k + 1] for k in range(5)] == [(j, pytest.approx(d)) for d, j in near]
    assert set(got) == {r[0] for r in sound}
    assert points.nearest_k(frame, frame.limit(0), 3, 1.0).count() == 0
    few = points.nearest_k(frame, spark.createDataFrame(rows[:2], XYZ), 3, 1.0).where("id = 50").collect()
    assert len(few) == 2


def test_of_equally_near_handles_the_rule_decides(spark):
    pointers = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "pointer long, px_x double, px_y double")
    handles = spark.createDataFrame([(1, 16.0, 0.0), (2, 0.0, 16.0), (3, -16.0, 0.0), (4, 117.0, 0.0)], "handle long, x double, y double")
    for last, want in ((False, 1), (True, 3)):
        assert [tuple(r) for r in points.grabbed(pointers, handles, 16.0, last).collect()] == [(1, want, 16.0)]


def test_orientations_turn_as_they_should(spark):
    df = spark.createDataFrame([(0.3, 0.2), (-2.5, 1.2), (3.1, -0.7)], "yaw double, pitch double")
    df = orbit.let(df, q=orbit.yaw_pitch(F.col("yaw"), F.col("pitch")))
    df = v.held(df, at=orbit.offset(orbit.of("q"), F.lit(10.0)))
    for r in df.collect():
        want = (10 * math.sin(r.yaw) * math.cos(r.pitch), 10 * math.sin(r.pitch), 10 * math.cos(r.yaw) * math.cos(r.pitch))
        assert (r.at_x, r.at_y, r.at_z) == pytest.approx(want)
    # looking back at the centre from there gives the same orientation, up to all signs
    again = orbit.looking(df, v.scaled(v.of("at"), -1), tuple(map(F.lit, (0.0, 1.0, 0.0))), "back")
    for r in again.collect():
        assert abs(sum(r[f"q_{x}"] * r[f"back_{x}"] for x in "xyzw")) == pytest.approx(1)
    none = orbit.looking(df, tuple(map(F.lit, (0.0, 2.0, 0.0))), tuple(map(F.lit, (0.0, 1.0, 0.0))), "n").first()
    assert none.n_w is None
    steps = orbit.let(df, one=orbit.around((0.0, 1.0, 0.0), F.lit(0.0)), two=orbit.around((0.0, 1.0, 0.0), F.lit(1.0)))
    steps = orbit.let(steps, mid=orbit.slerp(orbit.of("one"), tuple(-c for c in orbit.of("two")), F.lit(0.5)), same=orbit.slerp(orbit.of("one"), orbit.of("one"), F.lit(0.3)))
    r = steps.first()
    assert (r.mid_y, r.mid_w) == pytest.approx((math.sin(0.25), math.cos(0.25))) and r.same_w == pytest.approx(1)
    dragged = orbit.let(steps, d=orbit.dragged(orbit.of("one"), F.lit(10.0), F.lit(0.0))).first()
    assert dragged.d_y == pytest.approx(math.sin(-10 * orbit.DRAG_SPEED / 2))
    turns = df.select(orbit.wrapped(F.lit(3.5)).alias("a"), orbit.wrapped(F.lit(-math.pi)).alias("b"), orbit.eased(F.lit(2.0)).alias("c")).first()
    assert tuple(turns) == pytest.approx((3.5 - 2 * math.pi, -math.pi, 1.0))


def test_packs_are_found_written_once_and_left_alone_by_failures(spark, tmp_path):
    for name, body in {"b": "{}", "a": "[1]", "c": ""}.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "pack.json").write_text(body)
    (tmp_path / "in" / "d").mkdir()
    found = pack_files.discover_packs(spark, str(tmp_path / "in")).collect()
    assert [(r.pack_dir, r.problem) for r in found] == [("a", "not an object"), ("b", None), ("c", "empty file"), ("d", "no pack.json")]
    spark.dataSource.register(pack_files.PackSink)
    rows = spark.createDataFrame([(f"p{k}", json.dumps({"k": k})) for k in range(20)], "pack_dir string, body string").repartition(4)
    out = tmp_path / "out"
    rows.write.format("packs").mode("append").save(str(out))
    read = pack_files.read_packs(spark, str(out))
    assert {(r.pack_dir, r.body, r.problem) for r in read.collect()} == {(r.pack_dir, r.body, None) for r in rows.collect()}
    bad = rows.withColumn("body", F.when(F.col("pack_dir") == "p7", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("body")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("packs").mode("append").save(str(out))
    assert read.count() == 20 and not [p for p in out.iterdir() if p.name.startswith("_staging")]


def test_a_second_run_of_the_ledger_gives_hits(spark):
    files = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", None), ("d", b"four")], "name string, content binary")
    none = spark.createDataFrame([], "name string, md5 string, size_bytes long")
    expected = spark.createDataFrame([("d", "x", 4), ("b", "y", 9)], "name string, md5 string, size_bytes long")
    first = {r.name: r for r in ledger.merged(none, files, expected).collect()}
    assert {n: r.outcome for n, r in first.items()} == {"a": "added", "b": "wrong size", "c": "added", "d": "wrong digest"}
    assert first["d"].md5 is None and first["c"].size_bytes == 0
    kept = spark.createDataFrame([(r.name, r.md5, r.size_bytes) for r in first.values() if r.md5] + [("old", "z", 1)], none.schema)
    again = {r.name: (r.md5, r.outcome) for r in ledger.merged(kept, files, expected).collect()}
    assert {n: o for n, (_, o) in again.items()} == {"a": "hit", "b": "wrong size", "c": "hit", "d": "wrong digest", "old": "kept"}
    sizes = ledger.wire_sizes(files.withColumn("g", F.lit("all")), "g").first()
    raw = [b"one", b"two", b"", b"four"]
    assert (sizes.files, sizes.raw_bytes, sizes.wire_bytes) == (4, 10, sum(len(zlib.compress(c, 6, 31)) for c in raw))


def test_asset_and_frame_rules_on_single_cases(spark):
    body = json.dumps({"meshes": {"gltf": "m/s.gltf", "structures": [{"mesh_node": "A"}, {"mesh_node": "Z"}]}})
    scene = json.dumps({"nodes": [{"name": "B"}, {"name": "A"}, {"name": ""}, {}], "buffers": [{"uri": "b.bin"}, {"uri": "/abs"}, {"uri": "data:x"}], "images": []})
    packs_ = spark.createDataFrame([(1, body), (2, body), (3, None)], "key long, body string")
    files = spark.createDataFrame([(1, "m/s.gltf")], "key long, path string")
    got = {(r.key, r.place, r.issue) for r in assets.asset_issues(packs_, files, spark.createDataFrame([(1, scene)], "key long, content string")).collect()}
    assert got == {(1, "meshes.structures.1", "no node Z; there are A, B"), (1, "buffers.0", "does not exist: b.bin"), (1, "buffers.1", "bad path: /abs"), (2, "meshes.gltf", "does not exist: m/s.gltf")}
    one = spark.createDataFrame([("0",), (None,)], "v string").select(packs.fingerprint(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("f")).first()
    assert one.f == "a=1,b=2"


def test_a_view_that_misses_its_landmark_is_refused(spark):
    spots = {"lv": (8, 4, 0), "rv": (-8, 4, 0), "la": (10, 40, 0), "ra": (-10, 40, 0), "mitral": (8, 30, 1), "tricuspid": (-8, 30, -1), "aortic": (2, 32, 3), "pulmonary": (-2, 32, 9), "svc": (-10, 50, 2), "ivc": (-10, 20, -6)}
    rows = [(c, r, 0.5, *map(float, p)) for c in (1, 2) for r, p in spots.items()] + [(c, "lv", 0.0, 0.0, 0.0, 0.0) for c in (1, 2)] + [(2, "mitral", 0.5, 400.0, 30.0, 1.0)]
    frame = spark.createDataFrame(rows, "case long, role string, along double, x double, y double, z double")
    cases = clinical.framed(clinical.landmarks(frame))
    told = {r.case: r for r in cases.select("case", "n_checks", "n_passed", "failed").collect()}
    assert (told[1].n_checks, told[1].n_passed, told[1].failed) == (9, 9, "")
    views = {(r.case, r.view_id): r for r in clinical.clinical_views(frame, cases).collect()}
    assert len(views) == 10
    good = views[1, "b1-apical-four-chamber"]
    assert good.refused is None and good.vacuous is not None and "mitral" in (good.structures_in_order or "mitral")
    assert views[2, "b1-apical-four-chamber"].refused.startswith("does not hold") and views[2, "b1-apical-four-chamber"].structures_in_order is None
    assert views[1, "a3-subcostal-coronal"].refused == "no landmark below the heart"


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "user_id long, ts timestamp_ntz"
    source, folder = str(tmp_path / "events"), str(tmp_path / "state")
    write = lambda rows: spark.createDataFrame(rows, "user_id long, s string").select("user_id", F.col("s").cast("timestamp_ntz").alias("ts")).write.mode("append").parquet(source)
    read = lambda: {r.user_id: (str(r.first_time), r.n) for r in first_seen.stream_first_seen(spark.readStream.schema(schema).parquet(source), ["user_id"], "ts", folder).collect()}
    write([(1, "2024-01-02 00:00:00"), (None, "2024-01-05 00:00:00")])
    assert read() == {1: ("2024-01-02 00:00:00", 1), None: ("2024-01-05 00:00:00", 1)}
    write([(1, "2024-01-01 00:00:00"), (2, "2024-01-09 00:00:00")])
    want = {1: ("2024-01-01 00:00:00", 2), 2: ("2024-01-09 00:00:00", 1), None: ("2024-01-05 00:00:00", 1)}
    assert read() == want and read() == want
    assert list(itertools.islice(want, 1)) == [1]


def test_cut_gestures_by_hand(spark):
    """An edge-on drag follows the pointer, a face-on one tips the frame, a handle along the normal and a face-on depth drag do nothing."""
    from math import cos, sin

    from ventrica.functions import cutter as c
    from ventrica.functions import geometry as g
    from ventrica.functions import views as v

    one = spark.range(1)
    right, up = g.vec(1, 0, 0), g.vec(0, 1, 0)  # a camera that looks along -z

    def tilt(normal, handle, dx, dy):
        r = c.tilted(one, g.vec(*normal), g.vec(*handle), right, up, F.lit(float(dx)), F.lit(float(dy)), 0.01).first()
        return (r.tilt_x, r.tilt_y, r.tilt_z)

    assert tilt((2, 0, 0), (0, 3, 0), -10, 0) == pytest.approx((cos(0.1), sin(0.1), 0))
    assert tilt((2, 0, 0), (0, -3, 0), -10, 0) == pytest.approx((cos(0.1), -sin(0.1), 0))  # the other end of the pair
    assert tilt((2, 0, 0), (0, 3, 0), 0, 10) == pytest.approx((1, 0, 0))  # across the way it can go
    assert tilt((0, 1, 0), (1, 0, 0), 0, 10) == pytest.approx((sin(0.1), cos(0.1), 0))  # down is away from up
    assert tilt((0, 0, 1), (1, 0, 0), 10, 0) == pytest.approx((-sin(0.1), 0, cos(0.1)))  # face-on: pushed outward, tips away
    assert tilt((0, 0, 1), (0, 0, 5), 10, 7) == pytest.approx((0, 0, 1))
    assert tilt((0, 0, 0), (1, 0, 0), 10, 0) is not None

    moved = lambda n, dx, dy, units: one.select(c.dragged_offset(F.lit(1.5), g.vec(*n), right, up, F.lit(float(dx)), F.lit(float(dy)), units).alias("s")).first().s
    assert [moved((1, 0, 0), 8, 5, F.lit(0.5)), moved((0, 1, 0), 8, 5, F.lit(0.5)), moved((0, 0, 1), 8, 5, F.lit(0.5)), moved((1, 0, 0), 8, 5, F.lit(float("inf"))), moved((1, 0, 0), 8, 5, F.lit(None).cast("double"))] == pytest.approx([5.5, -1.0, 1.5, 1.5, 1.5])

    cases = [(1.0, 1), (3000.0, 1), (40.0, -1), (100.0, 0), (100.0, -1)]
    rows = spark.createDataFrame(cases, "r double, n int")
    assert [x.z for x in rows.select(c.zoomed(F.col("r"), F.col("n")).alias("z")).collect()] == [40.0, 3000.0, 40.0, 100.0, 96.0]
    depth = [x.d for x in rows.select(c.deepened(F.lit(0.99) * F.col("n"), F.col("n"), F.lit(1.0)).alias("d")).collect()]
    assert depth == pytest.approx([0.97, 0.97, -0.97, 0.0, -0.97])
    modes = one.select(*[c.mode_change(F.lit(a), F.lit(b), F.lit(2.0), F.lit(7.0)).alias(a + b) for a, b in (("echo", "echo"), ("echo", "free"), ("free", "echo"))]).first()
    assert tuple(modes) == (2.0, 7.0, 0.0)
    cut = one.select(c.kept(g.vec(1, 0, 0), g.vec(0, 0, 0), g.vec(1, 0, 0), F.lit(1.0), F.lit(False)).alias("a"), c.kept(g.vec(1, 0, 0), g.vec(0, 0, 0), g.vec(1, 0, 0), F.lit(1.0), F.lit(True)).alias("b"), c.kept(g.vec(2, 0, 0), g.vec(0, 0, 0), g.vec(1, 0, 0), F.lit(1.0), F.lit(False)).alias("c"), c.faces_away(g.vec(0, 0, -1), g.vec(0, 0, 9), g.vec(0, 0, 0)).alias("d")).first()
    assert tuple(cut) == (True, True, False, True)

    # a press and its opposite lead back; a null pose is on track; a shift along the beam leaves it
    frame = v.imaging_frame(one, g.vec(0, 0, 2), g.vec(1, 0, 1))
    there = c.nudged(frame, F.lit("aim"), F.lit(30.0))
    back = c.nudged(v.imaging_frame(there, v.of("nudged_beam"), v.of("nudged_lateral")), F.lit("aim"), F.lit(-30.0), "again")
    r = back.first()
    assert (r.again_beam_x, r.again_beam_z, r.again_lateral_x) == pytest.approx((0, 1, 1))
    assert (r.nudged_beam_x, r.nudged_beam_z) == pytest.approx((0.5, cos(0.5235987755982988)))
    o, z, x = g.vec(0, 0, 0), g.vec(0, 0, 1), g.vec(1, 0, 0)
    none = tuple(F.lit(None).cast("double") for _ in range(3))
    off = one.select(c.left_track((g.vec(0, 0, 0.04), z, x), (o, z, x)).alias("a"), c.left_track((g.vec(0, 0, 0.06), z, x), (o, z, x)).alias("b"), c.left_track((o, g.vec(0, 0.01, 1), x), (o, z, x)).alias("c"), c.left_track((none, none, none), (o, z, x)).alias("d")).first()
    assert tuple(off) == (False, True, True, False)
    far = one.select(c.framing_distance(F.lit(10.0), F.lit(12.0), 60.0, 2.0).alias("a"), c.framing_distance(F.lit(10.0), F.lit(99.0), 60.0, 2.0).alias("b"), c.framing_distance(F.lit(0.0), F.lit(9.0), 60.0, 2.0).alias("c")).first()
    assert tuple(far[:2]) == pytest.approx((25.2, 31.5)) and far.c is None


def test_valves_fail_in_three_ways(spark):
    """Each mesh ends in another way; grazes, chambers, nulls and repeated rows do not count as borders of their own."""
    from ventrica.operators import valves

    right = [(7, 1, 40), (7, 3, 60), (8, 2, 9), (8, 4, 9), (9, 1, 5), (9, 5, 5), (10, 2, 5), (10, 6, 5)]
    meshes = {
        "fine": [*right, (7, 2, 1), (1, 3, 700), (12, 1, 50), (None, 1, 4), (13, None, 4), (7, 3, 0)],
        "several": [*right, (20, 1, 8), (20, 3, 8), (9, 1, 5)],
        "lacking": [r for r in right if r[0] != 10] + [(10, 2, 5)],
        "swapped": [({7: 8, 8: 7}.get(t, t), c, n) for t, c, n in right],
        "bare": [(1, 2, 3)],
    }
    rows = [(m, *r, "x") for m, found in meshes.items() for r in found] + [(None, *r, "x") for r in right]
    got = valves.identify(spark.createDataFrame(rows, "mesh string, tag int, chamber int, n_faces long, valve string")).collect()
    assert len(got) == 4 * 6
    assert {r.mesh: r.verdict for r in got} == {"fine": "agrees", "several": "ambiguous", "lacking": "missing", "swapped": "disagrees", "bare": "missing", None: "agrees"}
    assert {r.mesh: r.measured for r in got}["swapped"] == "aortic=9,mitral=8,pulmonary=10,tricuspid=7" and {r.mesh: r.measured for r in got}["bare"] == ""
    assert {(r.valve, r.tags, r.outcome) for r in got if r.mesh == "several"} == {("aortic", "9", "agrees"), ("mitral", "7,20", "ambiguous"), ("pulmonary", "10", "agrees"), ("tricuspid", "8", "agrees")}
    assert {(r.valve, r.tags, r.outcome) for r in got if r.mesh == "lacking" and r.outcome != "agrees"} == {("pulmonary", "", "missing")}
    assert valves.identify(spark.createDataFrame([], "mesh string, tag int, chamber int, n_faces long")).collect() == []
