"""Queries over surfaces: the box mesh, and facets read from embeddings (seven triangles a row, its label as structure)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import surfaces
from ..sources import meshes
from .meshes import TETS, tets_and_places

SIDE = 48
FACETS_A_ROW = 7


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get(F.col("embedding"), F.col("t") * 9 + k).cast("double") * 100
    corner = lambda c: F.struct(*[e(c * 3 + k).alias(x) for k, x in enumerate("xyz")])
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").alias("structure"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(FACETS_A_ROW - 1))).alias("t"))
    return rows.select("vec_id", "t", "structure", *[corner(c).alias(n) for c, n in enumerate("abc")])


# axes are 1, 2, 3 here
_CORNERS = ", ".join(f"embedding[t*9+{c * 3 + k}]::DOUBLE*100 AS {n}{k}" for c, n in enumerate("abc") for k in (1, 2, 3))
FACETS = f"WITH f AS (SELECT vec_id, t, label AS structure, {_CORNERS} FROM embeddings, range({FACETS_A_ROW}) r(t))"
_BOUNDS = ", ".join(f"min(least(a{k}, b{k}, c{k})) AS lo{k}, max(greatest(a{k}, b{k}, c{k})) AS hi{k}" for k in (1, 2, 3))
GRID = f"{FACETS}, bo AS (SELECT {_BOUNDS} FROM f), gr AS (SELECT *, greatest(hi1-lo1, hi2-lo2, hi3-lo3) / {SIDE - 2}::DOUBLE AS pitch FROM bo), g AS (SELECT (lo1+hi1)/2-{SIDE // 2}*pitch AS o1, (lo2+hi2)/2-{SIDE // 2}*pitch AS o2, (lo3+hi3)/2-{SIDE // 2}*pitch AS o3, pitch FROM gr)"
# barycentric weights of the line through a cell centre, in the plane across it
MET = f"""{GRID}, lj AS (SELECT f.*, g.*, r.j, (r.j+0.5::DOUBLE)*pitch+o2 AS y FROM f, g, range({SIDE}) r(j) WHERE (r.j+0.5::DOUBLE)*pitch+o2 BETWEEN least(a2,b2,c2) AND greatest(a2,b2,c2)),
lk AS (SELECT lj.*, s.k, (s.k+0.5::DOUBLE)*pitch+o3 AS z FROM lj, range({SIDE}) s(k) WHERE (s.k+0.5::DOUBLE)*pitch+o3 BETWEEN least(a3,b3,c3) AND greatest(a3,b3,c3)),
w AS (SELECT *, (b2-a2)*(c3-a3)-(b3-a3)*(c2-a2) AS det FROM lk), uv AS (SELECT *, ((y-a2)*(c3-a3)-(z-a3)*(c2-a2))/det AS u, ((b2-a2)*(z-a3)-(b3-a3)*(y-a2))/det AS v FROM w WHERE det <> 0),
met AS (SELECT structure, j, k, a1 + u*(b1-a1) + v*(c1-a1) AS x, o1, pitch FROM uv WHERE u >= 0 AND v >= 0 AND u + v <= 1),
n AS (SELECT *, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY structure, j, k) AS hits FROM met WINDOW w AS (PARTITION BY structure, j, k ORDER BY x)),
sp AS (SELECT structure, j, k, x AS leave, n, lag(x) OVER (PARTITION BY structure, j, k ORDER BY n) AS enter, o1, pitch FROM n WHERE hits % 2 = 0),
spans AS (SELECT * FROM sp WHERE n % 2 = 1)"""


def _met(spark, sf_dir):
    f = facets(spark, sf_dir)
    grid = surfaces.fitted_grid(f, SIDE)
    return surfaces.crossings(f, grid, SIDE), grid


def ray_parity_histogram(spark, sf_dir):
    """How lines cross each structure, and what that says of it."""
    out = surfaces.parity_verdict(_met(spark, sf_dir)[0], facets(spark, sf_dir))
    return out.withColumn("over_two", F.round("over_two", 6))


PARITY = f"""{MET}, l AS (SELECT structure, j, k, count(*)::BIGINT AS hits FROM met GROUP BY 1, 2, 3), h AS (SELECT structure, count(*)::BIGINT AS rays, count(*) FILTER (hits % 2 = 1)::BIGINT AS odd, max(hits) AS max_hits, avg((hits > 2)::INT) AS over_two FROM l GROUP BY 1)
SELECT structure, coalesce(rays, 0) AS rays, coalesce(odd, 0) AS odd, coalesce(max_hits, 0) AS max_hits, round(coalesce(over_two, 0), 6) AS over_two, CASE WHEN rays IS NULL THEN 'inconclusive' WHEN over_two >= 0.5 THEN 'inner surfaces' WHEN over_two >= 0.1 THEN 'inner surfaces in places' ELSE 'solid' END AS verdict FROM (SELECT DISTINCT structure FROM f) LEFT JOIN h USING (structure)"""


def wall_chords(spark, sf_dir):
    """Chords through each structure: their number, mean, median and largest, and how many are 8 to 16 long."""
    found = surfaces.chords(surfaces.spans(_met(spark, sf_dir)[0])).groupBy("structure")
    c = F.col("chord")
    return found.agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, 0.5), 6).alias("median"), F.round(F.max(c), 6).alias("longest"), F.count_if(c.between(8, 16)).alias("walls"))


CHORDS = f"{MET}, c AS (SELECT structure, leave - enter AS chord FROM spans WHERE leave - enter > 1e-6) SELECT structure, count(*)::BIGINT AS n, round(avg(chord), 6) AS mean, round(quantile_cont(chord, 0.5), 6) AS median, round(max(chord), 6) AS longest, count(*) FILTER (chord BETWEEN 8 AND 16)::BIGINT AS walls FROM c GROUP BY 1"


def voxelize_surface_parity(spark, sf_dir):
    """Cells of each structure after later structures have overwritten earlier ones."""
    met, grid = _met(spark, sf_dir)
    cells = surfaces.filled(surfaces.spans(met), grid, SIDE)
    return cells.groupBy("structure").agg(F.count("*").alias("n"), *[F.sum(i).alias(f"s{i}") for i in "ijk"])


VOXELS = f"""{MET}, e AS (SELECT structure, j, k, unnest(range(greatest(ceil((enter-o1)/pitch-0.5), 0)::BIGINT, least(floor((leave-o1)/pitch-0.5), {SIDE - 1})::BIGINT + 1)) AS i FROM spans),
v AS (SELECT i, j, k, max(structure) AS structure FROM e GROUP BY 1, 2, 3) SELECT structure, count(*)::BIGINT AS n, sum(i)::BIGINT AS si, sum(j)::BIGINT AS sj, sum(k)::BIGINT AS sk FROM v GROUP BY 1"""


def bounds_grid(spark, sf_dir):
    return surfaces.fitted_grid(facets(spark, sf_dir), SIDE).select(*[F.round(c, 6).alias(c) for c in ("ox", "oy", "oz", "pitch")])


def _part_surface(spark, sf_dir):
    """The surface of each tag, where its points lie, and into how many tasks it is dealt."""
    tets, places, tasks = tets_and_places(spark, sf_dir)
    return surfaces.wound_boundary(tets, places, tasks), places, tasks


def vertex_normals(spark, sf_dir):
    out = surfaces.vertex_normals(*_part_surface(spark, sf_dir))
    return out.select("tag", "pid", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


# outwards is away from the fourth corner of the one tetrahedron that has the face
NORMALS = f"""{TETS}, own AS (SELECT tag, f[1] AS p, f[2] AS q, f[3] AS r, min(o) AS o FROM (SELECT tag, list_sort(unnest([[a,b,c],[a,b,d],[a,c,d],[b,c,d]])) AS f, unnest([d,c,b,a]) AS o FROM tets) GROUP BY tag, f HAVING count(*) = 1),
tri AS (SELECT s.*, P.x AS px, P.y AS py, P.z AS pz, Q.x-P.x AS ux, Q.y-P.y AS uy, Q.z-P.z AS uz, R.x-P.x AS vx, R.y-P.y AS vy, R.z-P.z AS vz, O.x-P.x AS ox, O.y-P.y AS oy, O.z-P.z AS oz FROM own s JOIN pts P ON P.pid = p JOIN pts Q ON Q.pid = q JOIN pts R ON R.pid = r JOIN pts O ON O.pid = o),
raw AS (SELECT tri.*, uy*vz-uz*vy AS x, uz*vx-ux*vz AS y, ux*vy-uy*vx AS z, -sign((uy*vz-uz*vy)*ox + (uz*vx-ux*vz)*oy + (ux*vy-uy*vx)*oz) AS s FROM tri),
co AS (SELECT tag, unnest([p, q, r]) AS pid, x*s AS x, y*s AS y, z*s AS z FROM raw), su AS (SELECT tag, pid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM co GROUP BY 1, 2), le AS (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM su)
SELECT tag, pid, round(x/greatest(n, 1e-300), 6) + 0.0 AS nx, round(y/greatest(n, 1e-300), 6) + 0.0 AS ny, round(z/greatest(n, 1e-300), 6) + 0.0 AS nz FROM le"""


def enclosed_volume(spark, sf_dir):
    surface, places, tasks = _part_surface(spark, sf_dir)
    return surfaces.enclosed_volume(surface, places).select("tag", F.round("volume", 6).alias("volume")).join(surfaces.winding_census(surface, tasks), "tag")


def vertex_reindex(spark, sf_dir):
    surface, _, tasks = _part_surface(spark, sf_dir)
    return surfaces.reindexed(surface, tasks)


REINDEX = f"{TETS} SELECT tag, pid, (row_number() OVER (PARTITION BY tag ORDER BY pid) - 1)::BIGINT AS n FROM (SELECT DISTINCT tag, unnest([p, q, r]) AS pid FROM surf)"


def _in_files(spark, sf_dir, make, columns) -> DataFrame:
    """A file of FACETS_A_ROW facets for each embedding, its id as path."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            corners = [np.asarray(e, "f4")[: 9 * FACETS_A_ROW].reshape(-1, 3, 3) for e in batch["embedding"]]
            yield pd.DataFrame({"path": batch["vec_id"].astype(str)} | {k: v for k, v in zip(columns, zip(*map(make, corners), strict=True), strict=True)})

    kinds = {"content": "binary", "buffers": "map<string,binary>"}
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").mapInPandas(build, "path string, " + ", ".join(f"{c} {kinds[c]}" for c in columns))


def _measured(read: DataFrame) -> DataFrame:
    """Facets, vertices and area of each file."""
    side = lambda c: tuple(F.col(f"{c}.{x}") - F.col(f"a.{x}") for x in "xyz")
    area = surfaces.g.norm(surfaces.g.cross(side("b"), side("c"))) / 2
    points = F.size(F.array_distinct(F.flatten(F.collect_list(F.array("ia", "ib", "ic")))))
    return read.groupBy(F.col("path").cast("long").alias("vec_id")).agg(F.count("*").alias("n_facets"), points.cast("long").alias("n_points"), F.round(F.sum(area), 4).alias("area"))


def stl_round_trip(spark, sf_dir):
    """Facets written as STL and read back, corners welded."""
    return _measured(meshes.parse_stl(_in_files(spark, sf_dir, lambda c: (meshes.stl_bytes(c),), ("content",))))


def gltf_round_trip(spark, sf_dir):
    """Facets written as glTF with a buffer of its own and read back."""

    def make(corners: np.ndarray):
        doc, blob = meshes.gltf_bytes([("facets", corners.reshape(-1, 3), np.arange(3 * len(corners)))], "facets.bin")
        return doc, {"facets.bin": blob}

    return _measured(meshes.parse_gltf(_in_files(spark, sf_dir, make, ("content", "buffers")))).drop("n_points")


def vtk_round_trip(spark, sf_dir):
    """The first twelve numbers of each embedding as a tetrahedron in a VTK file with sections out of order, read back."""

    def make(corners: np.ndarray):
        values = "\n".join("  ".join(repr(float(v)) for v in row) for row in corners.reshape(-1, 3)[:4])
        return (f"# vtk DataFile Version 3.0\nx\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS  4  double\n{values}\nCELL_TYPES  1\n10\nCELLS  1  5\n4  0 1  2 3\nCELL_DATA 1\nSCALARS ID int 1\nLOOKUP_TABLE default\n7\n".encode(),)

    held = _in_files(spark, sf_dir, make, ("content",))
    points = meshes.parse_vtk(held, "points").groupBy("path").agg(F.count("*").alias("n_points"), *[F.round(F.sum(x), 5).alias(f"s{x}") for x in "xyz"])
    return meshes.parse_vtk(held, "tets").join(points, "path").select(F.col("path").cast("long").alias("vec_id"), "tag", "n_points", "sx", "sy", "sz", F.col("d").alias("last"))


RAW = FACETS.replace("::DOUBLE*100", "::DOUBLE")
_AREA = "sqrt(((b2-a2)*(c3-a3)-(b3-a3)*(c2-a2))**2 + ((b3-a3)*(c1-a1)-(b1-a1)*(c3-a3))**2 + ((b1-a1)*(c2-a2)-(b2-a2)*(c1-a1))**2) / 2"
STL = f"{RAW}, p AS (SELECT vec_id, unnest([[a1,a2,a3],[b1,b2,b3],[c1,c2,c3]]) AS v FROM f), n AS (SELECT vec_id, count(DISTINCT v)::BIGINT AS n_points FROM p GROUP BY 1) SELECT vec_id, count(*)::BIGINT AS n_facets, any_value(n_points) AS n_points, round(sum({_AREA}), 4) AS area FROM f JOIN n USING (vec_id) GROUP BY 1"
GLTF = f"{RAW} SELECT vec_id, count(*)::BIGINT AS n_facets, round(sum({_AREA}), 4) AS area FROM f GROUP BY 1"
VTK = "SELECT vec_id, 7::BIGINT AS tag, 4::BIGINT AS n_points, " + ", ".join(f"round({' + '.join(f'embedding[{k + 3 * r}]::DOUBLE' for r in range(4))}, 5) AS s{x}" for k, x in ((1, "x"), (2, "y"), (3, "z"))) + ", 3::BIGINT AS last FROM embeddings"

QUERIES = {f.__name__: f for f in (ray_parity_histogram, wall_chords, voxelize_surface_parity, bounds_grid, vertex_normals, enclosed_volume, vertex_reindex, stl_round_trip, gltf_round_trip, vtk_round_trip)}
ORACLES = {
    "ray_parity_histogram": PARITY, "wall_chords": CHORDS, "voxelize_surface_parity": VOXELS, "vertex_normals": NORMALS, "vertex_reindex": REINDEX, "stl_round_trip": STL, "gltf_round_trip": GLTF, "vtk_round_trip": VTK,
    "bounds_grid": f"{GRID} SELECT round(o1, 6) AS ox, round(o2, 6) AS oy, round(o3, 6) AS oz, round(pitch, 6) AS pitch FROM g",
    "enclosed_volume": f"{TETS}, vo AS (SELECT tag, round(count(*) / 6.0::DOUBLE, 6) AS volume FROM tets GROUP BY 1) SELECT tag, volume, n_edges, n_boundary, n_nonmanifold, 0::BIGINT AS n_miswound FROM vo JOIN census USING (tag)",
}
