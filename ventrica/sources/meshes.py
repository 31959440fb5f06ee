"""Mesh and volume files as tables: STL, ASCII VTK, glTF and raw volumes.

A file is one row (path, content), read by Spark from any store, and is parsed in one task; a
set of files spreads over the cluster. A file that breaks its format raises an error with its path.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_XYZ = "struct<x:double,y:double,z:double>"
_FACETS = f"ia long, ib long, ic long, a {_XYZ}, b {_XYZ}, c {_XYZ}"
STL_HEAD, STL_FACET = 84, np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("attribute", "<u2")])
#: Fixed values of the glTF format: element types by component type, and elements by accessor type.
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT4": 16}
#: Fixed values of the VTK format: words that begin a section.
SECTIONS = ("POINTS", "CELLS", "CELL_TYPES", "CELL_DATA", "POINT_DATA", "SCALARS", "VECTORS", "LOOKUP_TABLE", "FIELD", "METADATA")
TETRA = 10


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def _facets(points: np.ndarray, faces: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({f"i{c}": faces[:, k].astype("int64") for k, c in enumerate("abc")})
    for k, c in enumerate("abc"):
        out[c] = [dict(zip("xyz", p, strict=True)) for p in points[faces[:, k]].astype(float).tolist()]
    return out


# --- STL


def stl_bytes(corners: np.ndarray) -> bytes:
    """A binary STL of facets (n, 3, 3), with their unit normals, zero for flat ones."""
    rows = np.zeros(len(corners), STL_FACET)
    rows["corner"] = corners
    normal = np.cross(rows["corner"][:, 1] - rows["corner"][:, 0], rows["corner"][:, 2] - rows["corner"][:, 0])
    length = np.linalg.norm(normal, axis=1, keepdims=True)
    rows["normal"] = normal / np.where(length == 0, 1, length)
    return struct.pack("<80sI", b"", len(rows)) + rows.tobytes()


def parse_stl(rows: DataFrame) -> DataFrame:
    """path, facet, ia, ib, ic, a, b, c: facets of binary STL contents; corners of equal coordinates share an id from 0."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                n = int.from_bytes(content[80:STL_HEAD], "little") if len(content) >= STL_HEAD else -1
                if n < 0 or len(content) < STL_HEAD + n * STL_FACET.itemsize:
                    raise ValueError(f"{path}: shorter than its facets")
                points, ids = np.unique(np.frombuffer(content, STL_FACET, n, STL_HEAD)["corner"].reshape(-1, 3), axis=0, return_inverse=True)
                out = _facets(points, ids.reshape(-1, 3))
                out.insert(0, "facet", np.arange(n))
                out.insert(0, "path", path)
                yield out

    return rows.select("path", "content").mapInPandas(parse, f"path string, facet long, {_FACETS}")


def read_stl(spark: SparkSession, folder: str) -> DataFrame:
    return parse_stl(files(spark, folder, "*.stl"))


# --- VTK


class _Vtk:
    """Sections of an ASCII VTK text, found by their words in any order; each runs to the next."""

    def __init__(self, path: str, text: str):
        self.path = path
        heads = list(re.finditer(rf"^(?:{'|'.join(SECTIONS)})\b.*$", text, re.MULTILINE))
        ends = [h.start() for h in heads[1:]] + [len(text)]
        self.sections = [(h.group().split(), text[h.end() : end]) for h, end in zip(heads, ends, strict=True)]

    def place(self, word: str, name: str | None = None, after: int = -1) -> int:
        for k, (head, _) in enumerate(self.sections):
            if k > after and head[0] == word and (name is None or head[1:2] == [name]):
                return k
        raise ValueError(f"{self.path}: no section {word} {name or ''}")

    def values(self, k: int, n: int, kind=np.float64) -> np.ndarray:
        found = np.array(self.sections[k][1].split(), dtype=np.float64)
        if len(found) != n:
            raise ValueError(f"{self.path}: {len(found)} values in {' '.join(self.sections[k][0])}, not {n}")
        return found.astype(kind)

    def size(self, k: int) -> int:
        return int(self.sections[k][0][1])

    def points(self) -> pd.DataFrame:
        k = self.place("POINTS")
        xyz = self.values(k, self.size(k) * 3).reshape(-1, 3)
        return pd.DataFrame({"pid": np.arange(len(xyz))} | {c: xyz[:, i] for i, c in enumerate("xyz")})

    def tets(self) -> pd.DataFrame:
        k, kinds = self.place("CELLS"), self.place("CELL_TYPES")
        n = self.size(k)
        cells = self.values(k, int(self.sections[k][0][2]), np.int64)
        if len(cells) != 5 * n or (cells.reshape(n, 5)[:, 0] != 4).any() or self.size(kinds) != n or (self.values(kinds, n) != TETRA).any():
            raise ValueError(f"{self.path}: holds cells that are no tetrahedra")
        tags = self.values(self.place("LOOKUP_TABLE", after=self.place("SCALARS", "ID")), n, np.int64)
        return pd.DataFrame({"tid": np.arange(n), "tag": tags} | {c: cells.reshape(n, 5)[:, i + 1] for i, c in enumerate("abcd")})

    def fields(self) -> pd.DataFrame:
        heads = [head for head, _ in self.sections]
        first = next((k for k, head in enumerate(heads) if head[0] == "POINT_DATA"), len(heads))
        out = [pd.DataFrame({"field": pd.Series(dtype=str), "pid": pd.Series(dtype="int64"), "value": pd.Series(dtype=float)})]
        for k in range(first, len(heads)):
            if heads[k][0] == "SCALARS":
                value = self.values(self.place("LOOKUP_TABLE", after=k), self.size(first))
                out.append(pd.DataFrame({"field": heads[k][1], "pid": np.arange(len(value)), "value": value}))
        return pd.concat(out)


_VTK = {"points": "pid long, x double, y double, z double", "tets": "tid long, tag long, a long, b long, c long, d long", "fields": "field string, pid long, value double"}


def parse_vtk(rows: DataFrame, part: str) -> DataFrame:
    """Points, tets (with the cell scalar ID as tag) or point fields of ASCII VTK contents, each with its path."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                out = getattr(_Vtk(path, content.decode("ascii", "replace")), part)()
                out.insert(0, "path", path)
                yield out

    return rows.select("path", "content").mapInPandas(parse, f"path string, {_VTK[part]}")


def read_vtk(spark: SparkSession, folder: str, part: str) -> DataFrame:
    return parse_vtk(files(spark, folder, "*.vtk"), part)


# --- glTF


def gltf_bytes(parts: list[tuple[str, np.ndarray, np.ndarray]], uri: str) -> tuple[bytes, bytes]:
    """glTF document and its binary buffer for named parts of points (n, 3) and faces (m, 3); views start at multiples of 4 bytes."""
    blob, doc = bytearray(), {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(parts)))}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": []}

    def add(array: np.ndarray, component: int, kind: str, **more) -> int:
        data = np.ascontiguousarray(array, COMPONENTS[component]).tobytes()
        doc["bufferViews"].append({"buffer": 0, "byteOffset": len(blob), "byteLength": len(data)})
        doc["accessors"].append({"bufferView": len(doc["bufferViews"]) - 1, "componentType": component, "count": len(array), "type": kind} | more)
        blob.extend(data + bytes(-len(data) % 4))
        return len(doc["accessors"]) - 1

    for k, (name, points, faces) in enumerate(parts):
        points = np.asarray(points, "<f4")
        bounds = {"min": points.min(0).tolist(), "max": points.max(0).tolist()} if len(points) else {}
        doc["nodes"].append({"name": name, "mesh": k})
        doc["meshes"].append({"name": name, "primitives": [{"attributes": {"POSITION": add(points, 5126, "VEC3", **bounds)}, "indices": add(np.asarray(faces).reshape(-1), 5125, "SCALAR")}]})
    doc["buffers"] = [{"uri": uri, "byteLength": len(blob)}]
    return json.dumps(doc).encode(), bytes(blob)


def _accessor(doc: dict, buffers: list[bytes], which: int) -> np.ndarray:
    """The elements of an accessor; a stride wider than an element is stepped over."""
    spec = doc["accessors"][which]
    view, kind, width = doc["bufferViews"][spec["bufferView"]], np.dtype(COMPONENTS[spec["componentType"]]), WIDTHS[spec["type"]]
    step = view.get("byteStride") or width * kind.itemsize
    return np.ndarray((spec["count"], width), kind, buffers[view.get("buffer", 0)], view.get("byteOffset", 0) + spec.get("byteOffset", 0), (step, kind.itemsize))


def _local(node: dict) -> np.ndarray:
    """The node's own 4x4 matrix: as given by columns, else translation after rotation (a quaternion) after scale."""
    if "matrix" in node:
        return np.array(node["matrix"], float).reshape(4, 4, order="F")
    out = np.eye(4)
    v, w = np.array(node.get("rotation", (0, 0, 0, 1))[:3], float), float(node.get("rotation", (0, 0, 0, 1))[3])
    across = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    out[:3, :3] = (np.eye(3) + 2 * w * across + 2 * across @ across) * np.array(node.get("scale", (1, 1, 1)), float)
    out[:3, 3] = node.get("translation", (0, 0, 0))
    return out


def gltf_surfaces(doc: dict, buffers: list[bytes]) -> Iterator[tuple[int, str, int, np.ndarray, np.ndarray]]:
    """node, name, material (-1 if none), points and faces of each triangle primitive in the scene, in world coordinates."""
    world, todo = {}, [(r, np.eye(4)) for r in doc["scenes"][doc.get("scene", 0)]["nodes"]]
    while todo:
        k, above = todo.pop()
        world[k] = above @ _local(doc["nodes"][k])
        todo += [(c, world[k]) for c in doc["nodes"][k].get("children", ())]
    for k, node in enumerate(doc["nodes"]):
        if k not in world or "mesh" not in node:
            continue
        held = doc["meshes"][node["mesh"]]
        for n, primitive in enumerate(held.get("primitives", ())):
            if primitive.get("mode", 4) == 4:
                points = _accessor(doc, buffers, primitive["attributes"]["POSITION"]) @ world[k][:3, :3].T + world[k][:3, 3]
                ids = _accessor(doc, buffers, primitive["indices"]) if "indices" in primitive else np.arange(len(points))
                name = held.get("name") or node.get("name") or f"node{k}"
                yield k, f"{name}#{n}", primitive.get("material", -1), points, ids.astype("int64").reshape(-1, 3)


def parse_gltf(rows: DataFrame) -> DataFrame:
    """path, node, name, material, facet, ia, ib, ic, a, b, c of glTF rows (path, content, buffers: map of uri to bytes).

    Buffers within the document (data addresses) need no entry; one that is nowhere raises an error.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, given in zip(batch["path"], batch["content"], batch["buffers"], strict=True):
                doc, given = json.loads(content), dict(given or {})
                uris = [b.get("uri") for b in doc.get("buffers", ())]
                if missing := [u for u in uris if u is None or not (u.startswith("data:") or u in given)]:
                    raise ValueError(f"{path}: no bytes for buffers {missing}")
                buffers = [base64.b64decode(u.split(",", 1)[1]) if u.startswith("data:") else bytes(given[u]) for u in uris]
                for node, name, material, points, faces in gltf_surfaces(doc, buffers):
                    out = _facets(points, faces)
                    for k, (column, value) in enumerate((("path", path), ("node", node), ("name", name), ("material", material), ("facet", np.arange(len(faces))))):
                        out.insert(k, column, value)
                    yield out

    return rows.select("path", "content", "buffers").mapInPandas(parse, f"path string, node long, name string, material long, facet long, {_FACETS}")


def read_gltf(spark: SparkSession, folder: str) -> DataFrame:
    """parse_gltf of all .gltf files under a folder, with the files that their buffers name beside them."""
    docs = files(spark, folder, "*.gltf")
    named = F.from_json(F.get_json_object(F.decode("content", "UTF-8"), "$.buffers"), "array<struct<uri:string>>")
    wanted = docs.select(F.col("path").alias("doc"), F.explode(named).alias("b")).select("doc", "b.uri").where("uri not like 'data:%'")
    wanted = wanted.withColumn("path", F.concat(F.regexp_extract("doc", r"^(.*/)", 1), "uri"))
    held = wanted.join(files(spark, folder, "*.bin"), "path").groupBy("doc").agg(F.map_from_entries(F.collect_set(F.struct("uri", "content"))).alias("buffers"))
    return parse_gltf(docs.join(held, docs.path == held.doc, "left"))


# --- raw volumes


def raw_bytes(labels: np.ndarray) -> bytes:
    """Labels (i, j, k) as bytes with i fastest."""
    return np.asarray(labels, "u1").tobytes(order="F")


def parse_raw(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """path, i, j, k, label of each cell of raw volumes of one byte a cell, i fastest; a wrong size raises an error."""
    nx, ny, nz = shape
    size = F.when(F.length("content") == nx * ny * nz, F.col("content")).otherwise(F.raise_error(F.concat("path", F.lit(": not the size of its volume"))))
    plane = F.explode(F.sequence(F.lit(0), F.lit(nz - 1)))
    planes = rows.select("path", size.alias("content")).select("path", plane.alias("k"), "content").select("path", "k", F.substring("content", F.col("k") * (nx * ny) + 1, nx * ny).alias("bytes"))
    cells = planes.select("path", "k", "bytes", F.explode(F.sequence(F.lit(0), F.lit(nx * ny - 1))).alias("at"))
    label = F.conv(F.hex(F.substring("bytes", F.col("at") + 1, 1)), 16, 10).cast("int")
    return cells.select("path", (F.col("at") % nx).alias("i"), F.floor(F.col("at") / nx).cast("int").alias("j"), "k", label.alias("label"))


def read_raw(spark: SparkSession, folder: str, shape: tuple[int, int, int]) -> DataFrame:
    return parse_raw(files(spark, folder, "*.raw"), shape)
