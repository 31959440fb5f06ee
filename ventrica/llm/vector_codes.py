"""Vector codes: every part of a vector becomes the number of its nearest codebook entry.

The nearest entry is found in a geometric near-neighbour access tree over a part's
entries. A node holds split points; every other entry of the node belongs to its nearest
split, and for each pair (split, child) the node stores the range of distances from the
split to the child's entries. A query measures its distance to the splits; a child is left
out only if some split's range lies strictly farther than the best distance so far, with
distances rounded away from the decision, so an equally near entry is never lost. Which
entry is nearest is decided by whole squared distances, ties by the lower index.

All arithmetic on coordinates is exact: in doubles while sums stay below 2^53, beyond that
in Python integers. A round is one scan that adds up each task's assignments to at most
parts x entries rows, and one grouped sum. Only codebooks pass through the driver; their
size is set by the parameters and the vectors' length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
SPLITS = 16
#: Queries that walk down a tree together.
QUERIES_AT_ONCE = 8192
_WIDER = 1 + 2.0**-40
_EXACT = float(1 << 53)
#: Components beyond the largest float count as non-finite.
LARGEST = 3.4028234663852886e38
#: Sums of components travel as two decimals, above and below this bit.
LIMB = 60


def whole_vectors(column: pa.Array, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors and their components as whole numbers floor(SCALE * x), held in doubles.

    Usable is a vector without null and non-finite components that has the given length, if one is given.
    """
    if not isinstance(column, pa.Array):
        column = column.combine_chunks()
    flat = column.cast(pa.large_list(pa.float64()))
    offsets, values = flat.offsets.to_numpy().astype(np.int64), flat.values
    numbers = values.fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = np.abs(numbers) <= LARGEST
    bad = np.concatenate([[0], np.cumsum(~good)])
    sizes = np.diff(offsets)
    usable = np.asarray(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    if length is not None:
        usable &= sizes == length
    at = np.flatnonzero(usable)
    if length is None:
        return at, np.empty((0, 0))
    taken = numbers[(offsets[at][:, None] + np.arange(length)).ravel()] if len(at) else np.empty(0)
    return at, np.floor(taken.reshape(len(at), length) * SCALE)


def _exact(points: np.ndarray, entries: np.ndarray) -> bool:
    """Whether all squared distances, and the terms that make them up, stay below 2^53."""
    top = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    return bool(4.0 * top * top * max(points.shape[1], 1) < _EXACT)


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries; whole numbers without rounding (doubles or Python integers)."""
    if points.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in points], object).reshape(len(points), len(entries))
    return (points * points).sum(axis=1)[:, None] - 2.0 * (points @ entries.T) + (entries * entries).sum(axis=1)


def _integers(points: np.ndarray) -> np.ndarray:
    out = np.empty(points.shape, object)
    out[...] = [[int(x) for x in p] for p in points]
    return out


class AccessTree:
    """A geometric near-neighbour access tree over entries of whole numbers."""

    def __init__(self, entries: np.ndarray, members: np.ndarray | None = None) -> None:
        self.members = np.arange(len(entries)) if members is None else members
        self.entries = entries
        pairs = _squares(*(2 * [entries[self.members] if _exact(entries, entries) else _integers(entries[self.members])]))
        self.splits, self.children = np.arange(len(self.members)), []
        if len(self.members) > SPLITS and pairs.max():  # equal entries stay together
            near = pairs[0].copy()
            chosen = [0]
            while len(chosen) < SPLITS:  # the entry farthest from those chosen comes next
                near = np.minimum(near, pairs[chosen[-1]])
                if not near.max():
                    break
                chosen.append(int(np.argmax(near)))
            self.splits = np.array(chosen)
            rest = np.setdiff1d(np.arange(len(self.members)), self.splits)
            owner = np.argmin(pairs[np.ix_(rest, self.splits)], axis=1)
            for k in range(len(chosen)):
                mine = rest[owner == k]
                if len(mine):
                    there = np.sqrt(pairs[np.ix_(self.splits, mine)].astype(float))
                    low, high = there.min(axis=1) / _WIDER, there.max(axis=1) * _WIDER
                    self.children.append((k, low, high, AccessTree(entries, self.members[mine])))
        self.splits = self.members[self.splits]
        order = np.argsort(self.splits, kind="stable")  # so that the first least is the lowest index
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.sorted = self.splits[order]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each point's nearest entry, the lower of equals, and the squared distance."""
        exact = _exact(points, self.entries)
        index, best = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), np.inf)
        entries = self.entries
        if not exact:
            points, entries, best = _integers(points), _integers(entries), best.astype(object)
        for at in range(0, len(points), QUERIES_AT_ONCE):
            self._visit(entries, points, np.arange(at, min(at + QUERIES_AT_ONCE, len(points))), index, best)
        return index, best

    def _visit(self, entries: np.ndarray, points: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        squares = _squares(points[rows], entries[self.sorted])
        first = np.argmin(squares, axis=1)
        found, least = self.sorted[first], squares[np.arange(len(rows)), first]
        better = (least < best[rows]) | ((least == best[rows]) & (found < index[rows]))
        index[rows[better]], best[rows[better]] = found[better], least[better]
        if not self.children:
            return
        away = np.sqrt(squares.astype(float))[:, self.rank]
        own = np.argmin(away, axis=1)
        for k, _, _, child in self.children:  # a point's own child first, so that the others meet its smaller radius
            child._visit(entries, points, rows[own == k], index, best)
        radius = (np.sqrt(best[rows].astype(float)) * _WIDER)[:, None]
        beyond, within = away / _WIDER - radius, (away * _WIDER + radius) * _WIDER
        for k, low, high, child in self.children:
            out = ((beyond > high * _WIDER) | (within < low)).any(axis=1)
            child._visit(entries, points, rows[~out & (own != k)], index, best)


@dataclass
class Codebooks:
    """The entries of every part: ``books[part][entry]`` are whole numbers."""

    books: list[np.ndarray]

    @property
    def length(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def sha256(self) -> str:
        """Digest of all components as decimal integers, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for e in b for x in e).encode()).hexdigest()

    def trees(self) -> list[AccessTree]:
        return [AccessTree(b) for b in self.books]

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        return np.split(vectors, len(self.books), axis=1)

    def decode(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for, scaled back."""
        return np.concatenate([b[c] for b, c in zip(self.books, code, strict=True)]).astype(float) / SCALE


def _first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the first usable vectors by id (nulls last, ties by the vector): at most ``entries`` rows reach the driver."""

    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(whole_vectors(batch.column("vector"), None)[0]))

    usable = rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>")
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    whole = whole_vectors(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), length)[1]
    return Codebooks(np.split(whole, parts, axis=1))


def _next_books(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of its parts, unused entries stay."""
    trees, width = books.trees(), books.books[0].shape[1]
    names, number = [f"{limb}{k}" for k in range(width) for limb in "hl"], pa.decimal128(38, 0)

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            _, vectors = whole_vectors(batch.column("vector"), books.length)
            for p, (tree, part) in enumerate(zip(trees, books.parts(vectors), strict=True)):
                index, _ = tree.nearest(part)
                order = np.argsort(index, kind="stable")
                starts = np.flatnonzero(np.diff(index[order], prepend=-1))
                exact = np.abs(part).max(initial=0) * max(len(part), 1) < _EXACT
                if len(starts):
                    added = np.add.reduceat(part[order] if exact else _integers(part[order]), starts, axis=0)
                    for e, n, s in zip(index[order][starts].tolist(), np.diff(starts, append=len(order)).tolist(), added.tolist(), strict=True):
                        have = sums.setdefault((p, e), [0] * (width + 1))
                        sums[p, e] = [a + int(b) for a, b in zip(have, [n, *s], strict=True)]
        if sums:
            keys = list(sums)
            columns = [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([sums[k][0] for k in keys], pa.int64())]
            for j in range(1, width + 1):
                columns += [pa.array([Decimal(limb) for limb in limbs], number) for limbs in zip(*(divmod(sums[k][j], 1 << LIMB) for k in keys), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *names])

    schema = ", ".join(["part int", "entry int", "n long", *(f"{n} decimal(38,0)" for n in names)])
    added = rows.select("vector").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(n).cast("decimal(38,0)").alias(n) for n in names))
    new = [b.copy() for b in books.books]
    for r in added.collect():
        mean = [((int(r[f"h{k}"]) << LIMB) + int(r[f"l{k}"])) // r["n"] for k in range(width)]
        if max(map(abs, mean), default=0) >= _EXACT and new[r["part"]].dtype != object:
            new[r["part"]] = _integers(new[r["part"]])
        new[r["part"]][r["entry"]] = mean
    return Codebooks(new)


def _plain(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def train_codebooks(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of all usable vectors; None if there are none. ``entries`` is at most 256.

    Every book starts as the parts of the ``entries`` smallest ids (fewer if there are fewer
    vectors; a null id is last, equal ids go by their vectors). The first vector sets the
    length, and vectors of another length are left out; it must be a multiple of ``parts``,
    else ValueError.
    """
    rows = _plain(rows, id_col, vector_col)
    books = _first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = _next_books(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code (binary, one byte a part), error (squared distances summed over the parts).

    Vectors that are null, hold null or non-finite components or have another length than the
    codebooks get no row. An error beyond a long, which takes components beyond 10^6, is null.
    """
    trees = books.trees()

    def run(batches):
        for batch in batches:
            at, vectors = whole_vectors(batch.column("vector"), books.length)
            code, error = np.empty((len(at), len(trees)), np.uint8), np.zeros(len(at), object)
            for p, (tree, part) in enumerate(zip(trees, books.parts(vectors), strict=True)):
                index, squares = tree.nearest(part)
                code[:, p] = index
                error = error + (squares if squares.dtype == object else squares.astype(np.int64))
            errors = [int(e) if e < 1 << 63 else None for e in error]
            kept = batch.select(["vec_id", "label"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    plain = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return plain.mapInArrow(run, "vec_id long, label string, code binary, error long")


def compress_vectors(rows: DataFrame, **options) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (summed over equal labels, nulls together), codebooks_sha256.

    Nulls, lengths and large numbers are as in train_codebooks and encode; repeated rows each
    get a row; other columns are not read; no usable vector gives no rows. A sum beyond a
    long, or one that holds a null error, is null.
    """
    books = train_codebooks(rows, **options)
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(encode(rows, books), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = few(coded.groupBy("label").agg(F.when(F.count("*") == F.count("error"), total.cast("decimal(38,0)")).alias("total")), "label_errors")
    joined = coded.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    fits = F.when(F.col("total") <= F.lit(str((1 << 63) - 1)).cast("decimal(38,0)"), F.col("total")).cast("long")
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", fits.alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))
