"""Work that must grow no faster than the tables: tasks, broadcasts and pairs."""

DATA = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_points_are_never_broadcast(spark):
    from ventrica.operators import mesh, surfaces

    tets, points = mesh.box_tets(spark), mesh.box_points(spark)
    for df in (mesh.with_corners(tets, points, "abcd"), mesh.surface_scalars(tets, points), surfaces.wound_boundary(tets, points)):
        assert "SortMergeJoin" in plan_of(df)
    assert "Broadcast" not in plan_of(mesh.with_corners(tets, points, "abcd"))


def test_tasks_of_a_mesh_follow_its_size(spark, monkeypatch):
    from ventrica.plans import meshes, registry

    want = {q: sorted(registry.QUERIES[q](spark, DATA).collect()) for q in ("edge_census", "mesh_area_volume_euler", "voxelize_tets_binned", "vertex_reindex", "tag_face_adjacency")}
    monkeypatch.setattr(meshes, "CELLS_A_TASK", 10)
    tets, tasks = meshes.tets(spark, DATA)
    assert tasks == -(-spark.read.parquet(f"{DATA}/part.parquet").count() // 10) > 8
    for q, rows in want.items():
        df = registry.QUERIES[q](spark, DATA)
        assert f", {tasks})" in plan_of(df) or f", {tasks}), REPARTITION_BY_NUM" in plan_of(df)
        assert sorted(df.collect()) == rows


def test_texts_of_packs_are_never_broadcast(spark):
    from ventrica.plans import files

    plan = plan_of(files.pack_assets(spark, DATA))
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_packs_are_parsed_a_few_times_and_keys_seen_everywhere(spark):
    import json
    from functools import reduce

    from ventrica.operators import packs as checks
    from ventrica.plans import packs

    plan = packs.pack_validation(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and plan.count("from_json(") == 2 and "explode(found" in plan
    whole = next(json.loads(r.body) for r in packs.documents(spark, DATA).where("p_partkey % 2 = 0").sort("p_partkey").collect() if '"schema_version":"0"' in r.body and '"echo_volume"' in r.body and r.body.startswith("{"))
    issues = lambda doc: {(r.path, r.issue) for r in checks.pack_issues(spark.createDataFrame([(1, json.dumps(doc))], "k long, body string"), "k").collect()}
    before, want = issues(whole), {"<root>"}
    at = lambda doc, path: reduce(lambda x, n: x[int(n)] if isinstance(x, list) else x[n], path.split("."), doc)
    want |= {*checks.PLACES, "meshes.structures.1", "echo_volume.labels.1", "views.1", *[f"views.1.{p}" for p in checks.VIEW_PLACES]}
    for path in want:
        (whole if path == "<root>" else at(whole, path))["unheard of"] = {"x": 1}
    # a text that holds an object is looked into as well
    whole["views"][0]["probe"]["fan"] = '{"wide":1}'
    found = issues(whole)
    assert {p for p, issue in found if issue == "unknown key"} == want | {"views.0.probe.fan"} | {p for p, issue in before if issue == "unknown key"}
    assert before <= found
    # vectors that are too short are findings, not the end of the job
    whole["views"][0]["probe"]["beam_axis"], whole["interaction"]["camera"]["up"], whole["meshes"]["anatomical_frame"]["basis_source_to_pack"]["basal"] = [1, 0], [0], [1]
    assert {("views.0.probe.beam_axis", "not a unit vector"), ("meshes.anatomical_frame.basis_source_to_pack.basal", "not a unit vector")} <= issues(whole)
    # a ring of structures, one that leads into it and one below the root
    whole["meshes"]["structures"] = [{"id": i, "parent": p} for i, p in (("w0", "w1"), ("w1", "w0"), ("w2", "w1"), ("top", None), ("low", "top"), ("top", "low"))]
    found = issues(whole)
    assert {p for p, issue in found if issue == "cycle"} == {f"meshes.structures.{k}.parent" for k in range(3)}
    assert {p for p, issue in found if issue == "repeated"} >= {"meshes.structures.5.id"}


def test_handles_and_pointers_at_one_place_meet_once(spark, monkeypatch):
    from ventrica.operators import points

    pointers = spark.range(300).selectExpr("id AS pointer", "cast(id % 2 * 100 AS double) AS px_x", "0.0D AS px_y")
    handles = spark.range(400).selectExpr("id AS handle", "cast(id % 2 * 100 + 3 AS double) AS x", "4.0D AS y")
    pairs, where = [], type(pointers).where
    monkeypatch.setattr(type(pointers), "where", lambda df, c: pairs.append(df) or where(df, c) if "handle" in df.columns and "px" in df.columns else where(df, c))
    for last, want in ((False, (0, 1)), (True, (398, 399))):
        got = points.grabbed(pointers, handles, 26.0, last).collect()
        assert sorted((r.pointer, r.handle, r.px) for r in got) == [(k, want[k % 2], 5.0) for k in range(300)]
    assert pairs and all(p.count() == 2 for p in pairs)


def test_neighbours_of_dense_places_and_copies(spark, monkeypatch):
    from ventrica.operators import points

    # 400 copies of one place, 20 of another, a dense row of places, one far away
    rows = [(k, 0.0, 0.0, 0.0) for k in range(400)] + [(400 + k, 0.5, -0.0, 0.0) for k in range(20)] + [(500 + k, 5 + k / 64, 1.0, 0.0) for k in range(200)] + [(900, 40.0, 0.0, 0.0)]
    frame = spark.createDataFrame(rows, "id long, x double, y double, z double")
    met, written = [], points.written
    monkeypatch.setattr(points, "written", lambda df, tag: met.append((tag, df.count())) or written(df, tag))
    found = {}
    for r in points.nearest_k(frame, frame, 7, 16.0).collect():
        found.setdefault(r.id, {})[r["rank"]] = (r.other, r.distance)
    for i, *p in rows[::7] + rows[-1:]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5, j) for j, *q in rows if j != i)[:7]
        assert [found[i][n + 1] for n in range(7)] == [(j, d) for d, j in near]
    assert len(found) == len(rows) and dict(met)["right"] == 203
    right = spark.createDataFrame(rows, "id long, _x double, _y double, _z double").dropDuplicates(["_x", "_y", "_z"])
    assert points._fitting(right, 16.0) < 1 and points._fitting(right.limit(0), 16.0) == 16.0


def test_folders_of_packs_are_not_listed(spark, tmp_path):
    from ventrica.sources import packs

    spark.dataSource.register(packs.PackSink)
    rows = spark.createDataFrame([(f"p{k}", f'{{"k":{k}}}') for k in range(40)], "pack_dir string, body string").repartition(3)
    assert packs.read_packs(spark, str(tmp_path)).count() == 0
    for _ in range(2):
        rows.write.format("packs").mode("append").save(str(tmp_path))
    read = packs.read_packs(spark, str(tmp_path))
    assert sorted((r.pack_dir, r.body) for r in read.where("problem is null").collect()) == sorted([tuple(r) for r in rows.collect()] * 2)
    assert len(read.inputFiles()) == 6  # the lists of six tasks


def test_wide_facets_and_rays_meet_in_tiles(spark, monkeypatch):
    import random

    from ventrica.operators import rays

    draw = random.Random(5)
    place = lambda: tuple(round(draw.uniform(-9, 9), 2) for _ in "xyz")
    # wide ones, narrow ones, one along x, one without structure, one with a corner that is no place
    rows = [(k % 3, place(), place(), place()) for k in range(60)] + [(1, (0.0, k / 4, 0.0), (1.0, k / 4 + 0.3, 0.2), (0.0, k / 4, 0.5)) for k in range(30)]
    rows += [(2, (0.0, 0.0, 0.0), (5.0, 0.0, 0.0), (9.0, 0.0, 0.0)), (None, (0.0, -8.0, -8.0), (0.0, 8.0, -8.0), (0.0, 0.0, 9.0)), (2, (0.0, float("nan"), 0.0), (1.0, 3.0, 3.0), (2.0, 4.0, -4.0))]
    f = spark.createDataFrame(rows, "structure int, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>")
    places = [(k % 40, *place()) for k in range(120)] + [(90, 0.0, None, 1.0), (91, 0.0, float("inf"), 1.0), (92, None, 0.0, 0.0), (93, float("nan"), 0.0, 0.0)]
    at = spark.createDataFrame(places, "ray long, x double, y double, z double")
    want = {}
    for beyond in (False, True):
        pairs = rays.ray_crossings(f.where("not isnan(a.y)"), at, 1.0)
        found = (pairs.where("cross_x > x") if beyond else pairs).groupBy("structure", "ray").count().collect()
        want[beyond] = sorted(map(tuple, found), key=str)
    assert any(r[0] is None for r in want[False]) and len(want[True]) > 50
    for tile, few in ((40, 1000), (40, 0)):
        monkeypatch.setattr(rays, "FACETS_A_TILE", tile)
        monkeypatch.setattr(rays, "RAYS_A_TILE", 2 * tile)
        monkeypatch.setattr(rays, "RAYS_A_BIN", few)
        for beyond in (False, True):
            df = rays.hits(f, at, ["ray"], 1.0, beyond)
            assert sorted(map(tuple, df.collect()), key=str) == want[beyond]
            assert "FlatMapCoGroupsInArrow" in plan_of(df) and ("_bj" in plan_of(df)) == (few > 0)
    assert rays.hits(f.limit(0), at, ["ray"], 1.0).count() == rays.hits(f, at.limit(0), ["ray"], 1.0).count() == 0
