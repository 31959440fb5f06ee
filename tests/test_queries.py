"""Every query with a SQL twin gives the twin's rows."""

from pathlib import Path

import duckdb
import pytest

from ventrica.plans import registry

DATA = "/root/testdata/sf0.001"


#: Some faults show on more rows only.
LARGER = "/root/testdata/sf0.01"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([None if row[k] is None else round(row[k], 5) if isinstance(row[k], float) else row[k] for k in order]) for row in rows)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", ["stride_sample", "nearest_pair_thickness"])
def test_query_matches_sql_on_more_rows(spark, name):
    c = duckdb.connect()
    for p in Path(LARGER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    found, want = registry.QUERIES[name](spark, LARGER), c.sql(registry.ORACLES[name])
    assert rows_of(found.columns, found.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    rows = found.collect()
    assert rows and rows_of(found.columns, rows) == rows_of(want.columns, want.fetchall())


def test_text_rules(spark):
    from pyspark.sql import functions as F

    from ventrica.functions import text

    ask = lambda rule, values: [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(rule(F.col("v"))).collect()]
    assert ask(text.is_placeholder, ["TBD", " todo\nmore", "na", "N/A.", "???", "none", "Nashville", "", None, "unknowns"]) == [True, True, True, True, True, False, False, False, False, False]
    assert ask(text.slug, ["Left  Ventricle (LV)", "Éçole 2", "--", "", "\u4e2d\u6587"]) == ["left-ventricle-lv", "éçole-2", "structure", "structure", "\u4e2d\u6587"]
    refused = ["..\\outside.gltf", "a\\..\\..\\outside.gltf", "%2e%2e/outside.gltf", "a/%2e%2e/%2e%2e/outside.gltf", "%2E%2E/outside.gltf", "../outside.gltf", "./assets/stub.gltf", "/assets/stub.gltf", "https://elsewhere.invalid/a.gltf", "C:\\assets\\stub.gltf", "assets/stub.gltf?v=2", "assets/stub.gltf#frag", "assets//stub.gltf", "", "%ff"]
    assert all(ask(text.path_problem, refused))
    assert ask(text.path_problem, ["assets/stub.gltf", "stub.gltf", "a/b/c/stub-volume.raw", "assets/with%20space.gltf", "a%3Fb", "a+b"]) == [None] * 6


def test_packs_are_discovered_and_checked(spark, tmp_path):
    from ventrica.operators.packs import pack_issues
    from ventrica.plans.packs import BODY
    from ventrica.sources.packs import discover_packs

    sound = spark.sql(f"SELECT {BODY} AS body FROM VALUES (55L, 'ring', 'Brand#1', 'SMALL', 4) AS part(p_partkey, p_name, p_brand, p_type, p_size)").first().body
    for name, body in (("good", sound), ("broken", "{"), ("empty", " "), ("list", "[1]")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "pack.json").write_text(body)
    found = discover_packs(spark, str(tmp_path))
    assert {r.pack_dir: r.problem for r in found.collect()} == {"good": None, "broken": "not JSON", "empty": "empty file", "list": "not an object"}
    issues = pack_issues(found, "pack_dir").collect()
    assert {(r.pack_dir, r.issue) for r in issues} == {(d, "not a JSON object") for d in ("broken", "empty", "list")}


def test_nearest_keeps_every_row(spark):
    from ventrica.operators.points import nearest

    nan = float("nan")
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, nan, 0.0, 0.0), (4, 1e6, 0.0, 0.0)], "id int, x double, y double, z double")
    right = spark.createDataFrame([(3.0, 4.0, 0.0), (nan, 0.0, 0.0)], "x double, y double, z double")
    assert sorted(((r.id, r.near and round(r.near, 3)) for r in nearest(left, right, 0.5).collect()), key=str) == [(1, 5.0), (1, 5.0), (2, None), (3, None), (4, 999997.0)]
    assert [r.near for r in nearest(left, right.limit(0), 0.5).collect()] == [None] * 5


def test_hash_scatterers_match_integers(spark):
    mask = (1 << 32) - 1

    def mix(a):
        a ^= a >> 16
        a = a * 0x7FEB352D & mask
        a ^= a >> 15
        a = a * 0x846CA68B & mask
        return a ^ a >> 16

    for r in registry.QUERIES["hash_scatterers"](spark, DATA).where("cell % 97 = 0").collect():
        x, y, z = r.cell % 16 - 8 + 8192, r.cell // 16 % 16 + 8192, r.cell // 256 + 8192
        h = mix(x ^ mix(y ^ mix(z + 20260818 % 65536)))
        assert abs((h & 0xFFFFFF) / (1 << 24) - r.u) < 1e-8


def test_a_closed_box_is_filled_without_odd_lines(spark):
    from pyspark.sql import functions as F

    from ventrica.operators import mesh, surfaces

    whole = mesh.box_tets(spark).withColumn("tag", F.lit(1))
    surface = surfaces.wound_boundary(whole, mesh.box_points(spark))
    held = mesh.with_corners(surface, mesh.box_points(spark), "abc")
    facets = held.select(F.col("tag").alias("structure"), *[F.struct(*[F.col(f"{c}{x}").alias(x) for x in "xyz"]).alias(c) for c in "abc"])
    grid = surfaces.fitted_grid(facets, 22)  # pitch 0.5: lines run along edges and through vertices
    met = surfaces.crossings(facets, grid, 22)
    assert [(r.rays, r.odd, r.max_hits, r.verdict) for r in surfaces.parity_verdict(met, facets).collect()] == [(32, 0, 2, "solid")]
    assert surfaces.filled(surfaces.spans(met), grid, 22).count() == 20 * 8 * 4
    turned = surface.withColumns({"a": F.col("b"), "b": F.col("a")})
    assert surfaces.enclosed_volume(turned, mesh.box_points(spark)).first().volume == -80
    mixed = surface.orderBy("a", "b", "c").limit(1).select("tag", F.col("b").alias("a"), F.col("a").alias("b"), "c").union(surface.orderBy("a", "b", "c").offset(1))
    assert surfaces.winding_census(mixed).first().n_miswound == 3
    assert surfaces.fitted_grid(facets.limit(0), 22).first().pitch is None and surfaces.crossings(facets.limit(0), surfaces.fitted_grid(facets.limit(0), 22), 22).count() == 0


def test_mesh_files_are_read(spark, tmp_path):
    import json

    import numpy as np

    from ventrica.sources import meshes

    corners = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[1, 0, 0], [1, 1, 0], [0, 1, 0]]], "f4")
    (tmp_path / "two.stl").write_bytes(meshes.stl_bytes(corners))
    read = meshes.read_stl(spark, str(tmp_path)).orderBy("facet").collect()
    assert len({i for r in read for i in (r.ia, r.ib, r.ic)}) == 4 and [tuple(r.c) for r in read] == [(0, 1, 0), (0, 1, 0)]

    doc, blob = meshes.gltf_bytes([("odd", corners[0], [[0, 1, 2]]), ("even", corners[1], [[2, 1, 0]])], "held.bin")
    doc = json.loads(doc)
    assert all(v["byteOffset"] % 4 == 0 for v in doc["bufferViews"]) and doc["accessors"][0]["max"] == [1, 1, 0]
    half = 0.5**0.5
    doc["nodes"][0] |= {"translation": [10, 0, 0], "rotation": [0, 0, half, half], "scale": [2, 2, 2]}
    doc["nodes"][1] |= {"matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 5, 1]}
    doc["nodes"] += [{"children": [0], "translation": [0, 0, 1]}, {"mesh": 0}]
    doc["scenes"][0]["nodes"] = [2, 1]  # node 3 is in no scene
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.gltf").write_text(json.dumps(doc))
    (tmp_path / "a" / "held.bin").write_bytes(blob)
    found = {r.name: [tuple(round(v, 6) for v in r[c]) for c in "abc"] for r in meshes.read_gltf(spark, str(tmp_path)).collect()}
    assert found == {"odd#0": [(10, 0, 1), (10, 2, 1), (8, 0, 1)], "even#0": [(0, 1, 5), (1, 1, 5), (1, 0, 5)]}

    text = "# vtk DataFile Version 3.0\nx\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS  4  float\n0 0  0\n1 0 0 0 1 0\n0 0 1\nCELL_TYPES 1\n10\nCELLS  1  5\n4  0 1 2 3\nCELL_DATA 1\nSCALARS ID int\nLOOKUP_TABLE default\n9\nPOINT_DATA 4\nSCALARS Z float\nLOOKUP_TABLE default\n0 .5 1 -10\nSCALARS RHO float\nLOOKUP_TABLE default\n1 2 3 4\n"
    (tmp_path / "m.vtk").write_text(text)
    vtk = lambda part: meshes.read_vtk(spark, str(tmp_path), part)
    assert [(r.tag, r.a, r.d) for r in vtk("tets").collect()] == [(9, 0, 3)] and vtk("points").count() == 4
    assert {(r.field, r.pid): r.value for r in vtk("fields").collect()}[("Z", 3)] == -10 and vtk("fields").count() == 8
    (tmp_path / "m.vtk").write_text(text.replace("0 0 1\n", "0 0\n"))
    with pytest.raises(Exception, match="not 12"):
        vtk("points").collect()

    labels = np.arange(24).reshape(2, 3, 4)
    (tmp_path / "v.raw").write_bytes(meshes.raw_bytes(labels))
    assert all(labels[r.i, r.j, r.k] == r.label for r in meshes.read_raw(spark, str(tmp_path), (2, 3, 4)).collect())
    with pytest.raises(Exception, match="not the size"):
        meshes.read_raw(spark, str(tmp_path), (2, 3, 5)).collect()


def test_colour_difference_of_published_pairs(spark):
    from pyspark.sql import functions as F

    from ventrica.functions import views

    # fixed values: pairs of L*a*b* colours and their difference, from the published test data of the formula
    pairs = [
        (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425), (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669), (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
        (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492), (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
    ]
    rows = spark.createDataFrame(pairs, "l double, a double, b double, m double, c double, d double, want double")
    found = views.colour_difference(rows, tuple(map(F.col, "lab")), tuple(map(F.col, "mcd")), "found").collect()
    assert all(abs(r.found - r.want) < 1e-4 for r in found)


def test_maps_planes_and_sweeps(spark):
    from pyspark.sql import functions as F

    from ventrica.functions import geometry as g
    from ventrica.functions import views

    ask = lambda *columns: [c and round(c, 9) for c in spark.range(1).select(*columns).first()]
    m = [F.lit(float(c)) for c in (2, 1, 0, 0, 0, 3, 1, 0, 1, 0, 4, 0, 5, 6, 7, 1)]
    assert ask(*views.unmapped(m, views.mapped(m, g.vec(1, -2, 3)))) == [1, -2, 3]
    assert ask(*views.unmapped([F.lit(0.0)] * 16, g.vec(1, 2, 3))) == [None] * 3
    assert tuple(views.plane_basis(spark.range(1), g.vec(1, 0, 0), g.vec(1, 0, 0)).select("u_x", "u_y", "u_z", "w_z").first()) == (0, 1, 0, 1)
    assert ask(views.swept(F.lit(1.5), F.lit(2.0), F.lit(4.0)), views.step_share(F.lit(1.0), F.lit(1.0), 2.0), views.step_share(F.lit(0.0), F.lit(8.0), 2.0)) == [4, 0, 0.25]
    assert ask(views.reveal(F.lit(53.0), False), views.reveal(F.lit(float("nan")), False), views.reveal(F.lit(200.0), True)) == [0.5, 0, 1]
    with pytest.raises(Exception, match="no direction"):
        ask(*views.unit(g.vec(0, 0, 0)))


def test_planes_are_fitted_and_ends_found(spark):
    import numpy as np

    from ventrica.functions import geometry as g
    from ventrica.operators import frames

    rng = np.random.default_rng(5)
    data = [(k % 2, *map(float, p), float(p[0])) for k, p in enumerate(rng.normal(size=(400, 3)) * (3, 2, 0.1) + (100, 0, 7))]
    rows = spark.createDataFrame([*data, (0, 900.0, 0.0, 7.0, -10.0), (3, 0.0, 0.0, 0.0, None)], "k int, x double, y double, z double, along double")
    for r in frames.fitted_planes(rows.where("along > 0"), "k", g.vec(0, 0, -1)).collect():
        mine = np.array([p[1:4] for p in data if p[0] == r.k])
        normal = np.linalg.svd(mine - mine.mean(0))[2][2]
        assert np.allclose([r.nx, r.ny, r.nz], normal * np.sign(-normal[2])) and abs(r.spread - np.std((mine - mine.mean(0)) @ normal)) < 1e-9
    ends = {r.k: r for r in frames.axis_ends(rows, "k", "along").collect()}
    for k in (0, 1):
        x = np.array([p[1] for p in data if p[0] == k])
        assert abs(ends[k].ax - x[x <= np.percentile(x, 1)].mean()) < 1e-9 and abs(ends[k].bx - x[x >= np.percentile(x, 99)].mean()) < 1e-9
    assert set(ends) == {0, 1}
