"""Near-duplicate embeddings by PCA-ordered tiled comparison with suffix-norm bounds.

Vectors are normed in double precision and turned to the principal axes (from sums over
all rows), so that leading dimensions carry most of every product. A tile is compared with
a tile: the leading LEAD dimensions of all pairs first; with the norms of what follows,
``lead + |x_rest| |y_rest|`` bounds the cosine (Cauchy-Schwarz), and a pair goes on to the
next dimensions only while the bound reaches the threshold. Survivors are confirmed on
the original vectors. Tiles of a block are cut along the first axis, and two tiles whose
ranges are further apart than a pair at the threshold can be are skipped as a whole.

Equal vectors are one class from the start. Blocks are ranges of the first axes, and two blocks
meet only if their boxes on the leading axes are within the distance of a link, so a class is
copied to its neighbours alone. A task gets a pair of blocks of at most about
BLOCK classes and returns the count of links per class and the links that connect its
classes (a spanning forest), never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialize
from .components import connected_components

THRESHOLD = 0.9
BLOCK = 8192
TILE = 512
STEPS = (8, 16, 32)
#: Axes on which blocks have boxes, and those that are cut into ranges.
LEAD, CUT_AXES = 8, 3
SLACK = 1e-9


def _vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows can link at all, and their vectors in double precision."""
    good, rows = [], []
    for k, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                good.append(k)
                rows.append(x)
    return np.array(good, np.int64), rows


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(batches):
    for batch in batches:
        good, rows = _vectors(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(good)), pa.array([len(x) for x in rows], pa.int32()), pa.array([(x + 0.0).tobytes() for x in rows], pa.binary())], ["vec_id", "dim", "vec"])


def _moments(batches):
    """Of each dimension the sum of outer products of what a task has read, as (dim, i, j, value) with i <= j."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        data = batch.column("vec").to_pylist()
        for dim in set(map(len, data)):
            x = _unit(np.frombuffer(b"".join(d for d in data if len(d) == dim), np.float64).reshape(-1, dim // 8))
            sums[dim // 8] = sums.get(dim // 8, 0.0) + x.T @ x
    for dim, m in sums.items():
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], ["dim", "i", "j", "value"])


def _axes(packed: DataFrame) -> dict[int, bytes]:
    """Principal axes by dimension; what reaches the driver is one matrix for each dimension."""
    sums = packed.select("vec").mapInArrow(_moments, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect()
    whole = {d: np.zeros((d, d)) for d in {r.dim for r in sums}}
    for r in sums:
        whole[r.dim][r.i, r.j] = whole[r.dim][r.j, r.i] = r.value
    return {d: np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1]).tobytes() for d, m in whole.items()}


def _leading(axes: dict[int, bytes]):
    """rep, copies, dim, vec and the first LEAD coordinates on the principal axes."""

    def run(batches):
        for batch in batches:
            lead = [None] * batch.num_rows
            for k, (dim, vec) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("vec").to_pylist(), strict=True)):
                turn = np.frombuffer(axes[dim], np.float64).reshape(dim, dim)
                lead[k] = np.pad((_unit(np.frombuffer(vec, np.float64)[None]) @ turn)[0, :LEAD], (0, max(0, LEAD - dim)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "copies", "dim", "vec")), pa.array(lead, pa.list_(pa.float64()))], ["rep", "copies", "dim", "vec", "lead"])

    return run


def _in_blocks(classes: DataFrame, block: int) -> DataFrame:
    """``classes`` with the code of their block: ranges of the first axes, and parts of ranges that still hold too many."""
    sizes = classes.groupBy("dim").agg(F.count("*").alias("n")).collect()  # one row for each dimension
    many = {r.dim: max(1, round((r.n / block) ** (1 / CUT_AXES) + 0.499)) for r in sizes}
    out = classes.withColumn("range", F.lit(0).cast("long"))
    for axis in range(CUT_AXES if max(many.values(), default=1) > 1 else 0):
        k = max(many.values())
        cuts = out.groupBy("dim", "range").agg(F.percentile_approx(F.col("lead")[axis], [x / k for x in range(1, k)]).alias("cuts"))
        out = out.join(few(cuts, "cuts"), ["dim", "range"]).withColumn("range", F.col("range") * k + F.size(F.filter("cuts", lambda c: c < F.col("lead")[axis]))).drop("cuts")  # noqa: B023
    out = materialize(out, "ranges")
    parts = out.groupBy("dim", "range").agg(F.ceil(F.count("*") / (2 * block)).alias("parts"))
    return out.join(few(parts, "parts"), ["dim", "range"]).withColumn("block", F.col("range") * (1 << 20) + F.pmod(F.xxhash64("rep"), F.col("parts"))).drop("range", "parts")


def _block_pairs(dealt: DataFrame, threshold: float) -> DataFrame:
    """(dim, i, j), i <= j, of blocks whose boxes on the first LEAD axes are near enough for a link.

    Blocks meet by strips of the first axis, as wide as the distance of a link.
    """
    gap = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    lows, highs = [F.min(F.col("lead")[k]).alias(f"low{k}") for k in range(LEAD)], [F.max(F.col("lead")[k]).alias(f"high{k}") for k in range(LEAD)]
    boxes = materialize(dealt.groupBy("dim", "block").agg(*lows, *highs), "boxes")
    strips = lambda more: F.explode(F.sequence(F.floor(F.col("low0") / gap) - more, F.floor(F.col("high0") / gap) + more))
    left, right = boxes.withColumn("strip", strips(0)).alias("a"), boxes.withColumn("strip", strips(1)).alias("b")
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a.low{k}") - F.col(f"b.high{k}"), F.col(f"b.low{k}") - F.col(f"a.high{k}")), 2) for k in range(LEAD)), F.lit(0.0))
    on = (F.col("a.dim") == F.col("b.dim")) & (F.col("a.strip") == F.col("b.strip")) & (F.col("a.block") <= F.col("b.block")) & (apart <= gap * gap)
    return left.join(right, on).select("a.dim", F.col("a.block").alias("i"), F.col("b.block").alias("j")).distinct()


def _forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of links (u, v) those that connect what they connect: each end keeps the link to the smallest end it has, round by round."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label, kept = np.arange(len(ids)), []
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        # each label but the least of its links takes one link to a smaller label
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        order = np.lexsort((low, high))
        first = order[np.unique(high[order], return_index=True)[1]]
        kept.append(np.stack([ids[a[first]], ids[b[first]]], axis=1))
        up = np.arange(len(ids))
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return np.concatenate(kept) if kept else np.zeros((0, 2), np.int64)


def _compare(axes: dict[int, bytes], threshold: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """All links between a block and another (or itself): links per class, and connecting links."""
        out_u, out_v, out_n = [], [], []
        for dim in (int(key[0]),) if len(left) and len(right) else ():
            turn = np.frombuffer(axes[dim], np.float64).reshape(dim, dim)
            sides = []
            for side in (left, right):
                ids, weights = side["rep"].to_numpy(np.int64), side["copies"].to_numpy(np.int64)
                x = _unit(np.frombuffer(b"".join(side["vec"]), np.float64).reshape(-1, dim))
                z = x @ turn
                order = np.argsort(z[:, 0], kind="stable")
                x, z = x[order], z[order]
                rest = {d: np.sqrt(np.maximum((z[:, d:] ** 2).sum(axis=1), 0)) for d in STEPS if d < dim}
                sides.append((ids[order], weights[order], x, z, rest))
            same = key[1] == key[2]
            (ids_a, w_a, x_a, z_a, r_a), (ids_b, w_b, x_b, z_b, r_b) = sides
            n_a, n_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
            parent = {}

            def find(i):
                while parent.setdefault(i, i) != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            # at the threshold two unit vectors differ by sqrt(2-2t) at most, so on one axis too
            gap = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
            for i in range(0, len(ids_a), TILE):
                a = slice(i, i + TILE)
                lo, hi = z_a[a, 0][0] - gap, z_a[a, 0][-1] + gap
                start, stop = np.searchsorted(z_b[:, 0], lo), np.searchsorted(z_b[:, 0], hi, "right")
                for j in range(max(start, i) if same else start, stop, TILE):
                    b = slice(j, min(j + TILE, stop))
                    steps = [d for d in STEPS if d < dim]
                    done = steps[0] if steps else dim
                    part = z_a[a, :done] @ z_b[b, :done].T
                    bound = part + np.outer(r_a[done][a], r_b[done][b]) if steps else part
                    p, q = np.nonzero(bound >= threshold - SLACK)
                    part = part[p, q]
                    for d in [*steps[1:], dim]:
                        if not len(p):
                            break
                        part = part + np.einsum("ij,ij->i", z_a[a][p, done:d], z_b[b][q, done:d])
                        rest = r_a[d][a][p] * r_b[d][b][q] if d < dim else 0.0
                        keep = part + rest >= threshold - SLACK
                        p, q, part, done = p[keep], q[keep], part[keep], d
                    p, q = p + a.start, q + b.start
                    if same:
                        p, q = p[p < q], q[p < q]
                    if len(p):
                        keep = np.einsum("ij,ij->i", x_a[p], x_b[q]) >= threshold
                        p, q = p[keep], q[keep]
                        np.add.at(n_a, p, w_b[q])
                        np.add.at(n_a if same else n_b, q, w_a[p])
                        own = np.unique(np.stack([ids_a[p], ids_b[q]], axis=1), axis=0) if len(p) < 64 else _forest(ids_a[p], ids_b[q])
                        for u, v in own.tolist():
                            ru, rv = find(u), find(v)
                            if ru != rv:
                                parent[ru] = rv
                                out_u.append(u)
                                out_v.append(v)
                                out_n.append(0)
            for ids, n in ((ids_a, n_a),) if same else ((ids_a, n_a), (ids_b, n_b)):
                out_u += ids[n > 0].tolist()
                out_v += [-1] * int((n > 0).sum())
                out_n += n[n > 0].tolist()
        return pd.DataFrame({"u": np.array(out_u, np.int64), "v": np.array(out_v, np.int64), "n": np.array(out_n, np.int64)})

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Null, empty or zero vectors and those with null or non-finite components link with
    nothing; vectors of different lengths don't link. n_links counts rows, so each copy of an
    equal vector counts. Ties: the smallest id stays. A null id takes no part and is its own
    row with null component. Repeated rows get equal results. Other columns are not read. Empty
    input gives no rows.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    packed = base.where("vec_id is not null").mapInArrow(_packed, "vec_id long, dim int, vec binary")
    packed = packed.withColumn("code", F.sha2("vec", 256))
    packed = materialize(packed, "packed")
    classes = packed.groupBy("code").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("dim").alias("dim"), F.min("vec").alias("vec"))
    classes = materialize(classes, "classes")
    axes = _axes(packed)
    turned = classes.select("rep", "copies", "dim", "vec").mapInArrow(_leading(axes), "rep long, copies long, dim int, vec binary, lead array<double>")
    dealt = materialize(_in_blocks(turned, block), "blocks")
    pairs = few(_block_pairs(dealt, threshold), "block-pairs")
    # a class goes only where its block has a partner: left for (block, *), right for (*, block)
    sides = [dealt.withColumnRenamed("block", side).join(pairs, ["dim", side]).select(*[F.col(c).alias(c) for c in ("dim", "i", "j", "rep", "copies", "vec")]) for side in ("i", "j")]
    left, right = (side.groupBy("dim", "i", "j") for side in sides)
    found = materialize(left.cogroup(right).applyInPandas(_compare(axes, threshold), "u long, v long, n long"), "vector-links")
    counts = found.where("n > 0").groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "rep")
    components = connected_components(found.where("n = 0").select("u", "v")).withColumnRenamed("node", "rep")
    by_class = classes.select("code", "rep", "copies").join(counts, "rep", "left").join(components, "rep", "left")
    by_class = by_class.select("code", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = packed.select("vec_id", "code").join(by_class, "code").select("vec_id", "n_links", "component_id")
    alone = base.withColumn("ok", _links_at_all()).where("vec_id is null or not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links_at_all():
    """Column: the vector is not null, has no null or non-finite component, and is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
