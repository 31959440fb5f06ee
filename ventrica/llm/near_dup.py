"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Method. Shingles are mapped by one permutation (sigma) to places of a circle of size D;
a second permutation (pi), shifted by k, gives coordinate k: ``h_k = min pi[sigma(x)+k]``.
So all K coordinates of a shingle are one contiguous slice of pi. Bands of ROWS
coordinates are bucket keys. Candidates are verified on the full shingle sets.

Scale. Rows are numbered first, and all work is on these numbers, so ids may be null or
repeat. Rows with the same shingle set are one class from the start (a digest and a partial
minimum), so copies are never paired. First each class is verified with the nearest of its
buckets' hubs, which is linear in a bucket. Buckets that still hold several components are
compared in tiles: blocks of a bounded weight, block against block, leaving out blocks of the
bucket's largest component against each other. No pair of a bucket becomes a row: the first
pass gives the members that have any candidate in another component by signature, the second
one, which gets their full sets, gives only verified links that connect components. So rows
stay linear in a bucket; time goes with the pairs in different components only.

Chance to miss a link of similarity 0.75: (1-0.75^6)^64 < 4e-6 by banding, and under 1e-6
by MATCHES, which is five deviations below the mean.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_rows, materialize, numbered, without_rows
from .components import connected_components
from .shingles import mix64, shared, shingle_sets

ROWS, BANDS = 6, 64
BANDED = ROWS * BANDS
COORDINATES = BANDED + 256
CIRCLE_BITS = 20
SKETCH_LONGS = COORDINATES // 64
#: One-bit sketches differ in (1-J)/2 of their bits; at J=0.75 in 80 of 640 with a deviation of 8.4.
SKETCH_MISMATCHES = 80 + 50
#: Of the 640 coordinates a link of 0.75 shares 480 with a deviation of 11.
MATCHES = 425
#: Weight of a block in shingles; a member weighs its shingles and MEMBER_WEIGHT for its signature.
TILE_WEIGHT, MEMBER_WEIGHT = 400_000, 100
LEAST_PERCENT = 75
_cache: dict[str, np.ndarray] = {}


def _windows() -> np.ndarray:
    if "pi" not in _cache:
        pi = np.random.default_rng(7).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        _cache["pi"] = np.concatenate([pi, pi[:COORDINATES]])
    return np.lib.stride_tricks.sliding_window_view(_cache["pi"], COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All circulant MinHash coordinates of a non-empty shingle set."""
    windows = _windows()
    place = shingles & np.uint64((1 << CIRCLE_BITS) - 1)
    place = (place * np.uint64(0x5BD1E995)) & np.uint64((1 << CIRCLE_BITS) - 1)
    place = (place ^ (place >> np.uint64(CIRCLE_BITS // 2))).astype(np.int64)
    out = None
    for k in range(0, len(place), 2048):
        part = windows[place[k : k + 2048]].min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def packed(sig: np.ndarray) -> np.ndarray:
    """8 bits of each coordinate: a long of ROWS for each band, then longs of 8 for the rest."""
    low = mix64(sig.astype(np.uint64) + np.uint64(3)) & np.uint64(255)
    place = np.arange(8, dtype=np.uint64) * np.uint64(8)
    banded = (low[:BANDED].reshape(BANDS, ROWS) << place[:ROWS]).sum(axis=1, dtype=np.uint64)
    return np.concatenate([banded, (low[BANDED:].reshape(-1, 8) << place).sum(axis=1, dtype=np.uint64)]).view(np.int64)


SIG_LONGS = BANDS + (COORDINATES - BANDED) // 8


def sketch(sig: np.ndarray) -> np.ndarray:
    mixed = mix64(sig.astype(np.uint64) + np.uint64(1))
    return np.packbits((mixed & np.uint64(1)).astype(np.uint8)).view(np.int64)


def _profile(batches):
    for batch in batches:
        sizes, d0, d1, keys, sketches = [], [], [], [], []
        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            d0.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            d1.append(int((mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            if len(s):
                sig = signature(s)
                keys.append(packed(sig))
                sketches.append(sketch(sig))
        ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) > 0)]).astype(np.int32)
        lists = lambda rows, n: pa.ListArray.from_arrays(pa.array(ends * np.int32(n)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))  # noqa: B023, E731
        columns = [pa.array(sizes, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), lists(keys, SIG_LONGS), lists(sketches, SKETCH_LONGS)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], ["row", "doc_id", "n_shingles", "d0", "d1", "sig", "sketch"])


def _links(batches):
    for batch in batches:
        keep = [
            k
            for k, (a, b) in enumerate(zip(shingle_sets(batch.column("text_u")), shingle_sets(batch.column("text_v")), strict=True))
            if len(a) and len(b) and 100 * (both := shared(a, b)) >= LEAST_PERCENT * (len(a) + len(b) - both)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(keep, pa.int64())), batch.column("v").take(pa.array(keep, pa.int64()))], ["u", "v"])


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())], ["row", "shingles"])


def _differ(x: str, y: str):
    """Column: the bits in which the sketches of two classes differ."""
    return sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH_LONGS)), F.lit(0))


def _matches(x: str, y: str):
    """Column: the coordinates in which the signatures of two classes agree, by their 8 bits."""

    def differing(d):
        for step in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    unequal = F.zip_with(f"{x}.sig", f"{y}.sig", lambda a, b: differing(a.bitwiseXOR(b)))
    return F.lit(COORDINATES) - F.aggregate(unequal, F.lit(0), lambda total, d: total + d)


def _near(x: str, y: str):
    """Column: the sizes and sketches of two classes allow the threshold."""
    size = (F.col(f"{x}.n") * 100 >= F.col(f"{y}.n") * LEAST_PERCENT) & (F.col(f"{y}.n") * 100 >= F.col(f"{x}.n") * LEAST_PERCENT)
    return size & (_differ(x, y) <= SKETCH_MISMATCHES)


def _tiled(rows: DataFrame) -> DataFrame:
    """``rows(key, row, label, n)`` dealt to tiles: key, i, j, side, row, label.

    A bucket of at most TILE_WEIGHT is one tile, in which all meet (side 0). Of a larger one
    the members of its largest component are cut into blocks, and so are the others; each
    block of others meets every block, as left (side 1) and right (side 2).
    """
    weight = F.sum(F.col("n") + MEMBER_WEIGHT)
    parts = rows.groupBy("key", "label").agg(weight.alias("w"))
    keys = parts.groupBy("key").agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("all"))
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / TILE_WEIGHT)).cast("int")
    keys = keys.select("key", F.col("top.label").alias("top"), (F.col("all") <= TILE_WEIGHT).alias("small"), blocks(F.col("top.w")).alias("tops"), blocks(F.col("all") - F.col("top.w")).alias("others"))
    dealt = rows.join(keys, "key").withColumn("others_block", F.pmod(F.xxhash64("row"), "others").cast("int")).withColumn("top_block", F.pmod(F.xxhash64("row"), "tops").cast("int"))
    tile = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    b = F.col("others_block")
    # blocks of the largest component are numbered from -1 down
    to_others = F.transform(upto("others"), lambda x: tile(F.least(b, x), F.greatest(b, x), F.when(b == x, 0).when(b < x, 1).otherwise(2)))
    to_tops = F.transform(upto("tops"), lambda x: tile(-1 - x, b, 2))
    from_top = F.transform(upto("others"), lambda x: tile(-1 - F.col("top_block"), x, 1))
    tiles = F.when(F.col("small"), F.array(tile(F.lit(0), F.lit(0), 0))).when(F.col("label") == F.col("top"), from_top).otherwise(F.concat(to_others, to_tops))
    return dealt.select("key", "row", "label", F.explode(tiles).alias("t")).select("key", "t.i", "t.j", "t.side", "row", "label")


def _members(batches, with_sets: bool):
    """The arrays of one tile after another, from rows sorted by tile."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        now = {"tile": np.stack([number(c) for c in ("key", "i", "j")], axis=1)} | {c: number(c) for c in ("side", "row", "label", "n")}
        now["sig"] = batch.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIG_LONGS)
        if with_sets:
            now["set"] = np.empty(batch.num_rows, object)
            now["set"][:] = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        if held:
            now = {k: np.concatenate([held[k], x]) for k, x in now.items()}
        ends = np.flatnonzero((now["tile"][1:] != now["tile"][:-1]).any(axis=1)) + 1
        for a, b in itertools.pairwise([0, *ends.tolist()]):
            yield {k: x[a:b] for k, x in now.items()}
        last = int(ends[-1]) if len(ends) else 0
        held = {k: x[last:] for k, x in now.items()}
    if held:
        yield held


def _candidates(t: dict[str, np.ndarray]):
    """(p, places q, matches) of the tile's pairs in different components whose signatures allow the threshold, each in its first band only."""
    band, n, label = int(t["tile"][0, 0]) >> 48, t["n"], t["label"]
    octets = np.ascontiguousarray(t["sig"]).view(np.uint8).reshape(len(n), -1)
    right = np.flatnonzero(t["side"] == 2)
    within = not len(right) and not (t["side"] == 1).any()
    for p in range(len(n)) if within else np.flatnonzero(t["side"] == 1).tolist():
        q = np.arange(p + 1, len(n)) if within else right
        q = q[(label[q] != label[p]) & (100 * n[q] >= LEAST_PERCENT * n[p]) & (100 * n[p] >= LEAST_PERCENT * n[q])]
        if len(q):
            agree = np.count_nonzero(octets[q] == octets[p], axis=1) - (8 * SIG_LONGS - COORDINATES)
            q, agree = q[agree >= MATCHES], agree[agree >= MATCHES]
            first = np.argmax(t["sig"][q, :BANDS] == t["sig"][p, :BANDS], axis=1) == band if len(q) else np.zeros(0, bool)
            if first.any():
                yield p, q[first], agree[first]


def _hopeful(batches):
    """(key, row, label, n) of members with a candidate in another component."""
    for t in _members(batches, False):
        flag = np.zeros(len(t["n"]), bool)
        for p, q, _ in _candidates(t):
            flag[p] = flag[q] = True
        if flag.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t["tile"][flag, 0], t["row"][flag], t["label"][flag], t["n"][flag])], ["key", "row", "label", "n"])


def _connecting(batches):
    """(u, v): of a tile's verified links those that connect its components, the likeliest first."""
    for t in _members(batches, True):
        found = [(-m, p, q) for p, qs, ms in _candidates(t) for q, m in zip(qs.tolist(), ms.tolist(), strict=True)]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:  # noqa: B023
                root[x] = root[root[x]]  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        u, v = [], []
        for _, p, q in sorted(found):
            a, b = find(int(t["label"][p])), find(int(t["label"][q]))
            if a != b and 100 * (both := shared(t["set"][p], t["set"][q])) >= LEAST_PERCENT * (len(t["set"][p]) + len(t["set"][q]) - both):
                root[a] = b
                u.append(int(t["row"][p]))
                v.append(int(t["row"][q]))
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _verify(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """Of candidate pairs (u, v), those whose full shingle sets reach the threshold."""
    texts = keep_rows(base, pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct())
    named = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.select("u", "v").join(named("u"), "u").join(named("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(_links, "u long, v long")


def _grouped(base: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component_id, stays for ``base(row, doc_id, text)``, a written table with unique rows."""
    keep = Scratch()
    profile = keep(base.mapInArrow(_profile, "row long, doc_id long, n_shingles long, d0 long, d1 long, sig array<long>, sketch array<long>"), "profile")
    classes = profile.where("n_shingles > 0").groupBy("d0", "d1").agg(F.min("row").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    classes = keep(classes.select("d0", "d1", "rep"), "classes")
    members = profile.select("row", "doc_id", "n_shingles", "d0", "d1").join(classes, ["d0", "d1"], "left")
    members = keep(members.select("row", "doc_id", "n_shingles", F.coalesce("rep", "row").alias("rep"), F.col("rep").isNotNull().alias("grouped")), "members")
    signed = without_rows(profile.where("n_shingles > 0"), members.where("rep <> row").select("row"))
    signed = signed.select("row", F.col("n_shingles").alias("n"), "sig", "sketch")

    keyed = signed.select("row", F.posexplode(F.slice("sig", 1, BANDS)).alias("band", "low")).select("row", F.shiftleft(F.col("band").cast("long"), 48).bitwiseOR(F.col("low")).alias("key"))
    # hubs: the smallest row, in all bands, so hubs recur
    buckets = keyed.groupBy("key").agg(F.min("row").alias("hub"), F.count("*").alias("size")).where("size > 1")
    buckets = keep(keyed.join(buckets, "key").select("key", "row", "hub"), "buckets")
    facts = keep(keep_rows(signed, buckets.select("row").distinct()), "facts")

    # first each class with its nearest hub only, so texts move about once however large a group is
    pairs = buckets.where("row <> hub").select(F.col("hub").alias("u"), F.col("row").alias("v")).distinct()
    pairs = pairs.alias("p").join(facts.alias("x"), F.col("p.u") == F.col("x.row")).join(facts.alias("y"), F.col("p.v") == F.col("y.row")).where(_near("x", "y"))
    pairs = pairs.select("u", "v", _matches("x", "y").alias("matches")).where(F.col("matches") >= MATCHES)
    nearest = keep(pairs.groupBy("v").agg(F.max(F.struct("matches", (-F.col("u")).alias("u")))["u"].alias("u")).select((-F.col("u")).alias("u"), "v"), "nearest")
    first = keep(connected_components(_verify(nearest, base)), "first")

    # then, of buckets that hold several components, the members with a candidate in another one, and their links
    labelled = buckets.select("key", "row").join(first.withColumnRenamed("node", "row"), "row", "left").select("key", "row", F.coalesce("component", "row").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    opened = keep(labelled.join(mixed, "key").join(facts.select("row", "n"), "row").select("key", "row", "label", "n"), "open")
    hopeful = _by_tile(_tiled(opened).join(facts.select("row", "n", "sig"), "row")).mapInArrow(_hopeful, "key long, row long, label long, n long")
    hopeful = keep(hopeful.distinct(), "hopeful")
    rows = hopeful.select("row").distinct()
    full = keep_rows(base, rows).select("row", "text").mapInArrow(_sets, "row long, shingles binary").join(facts.select("row", "n", "sig"), "row")
    links = _by_tile(_tiled(hopeful).join(full, "row")).mapInArrow(_connecting, "u long, v long")
    final = connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
    final = final.withColumnRenamed("node", "rep")

    labels = members.join(final, "rep", "left").withColumn("grouped", F.col("grouped") | F.col("component").isNotNull()).withColumn("label", F.coalesce("component", "rep"))
    labels = materialize(labels.select("row", "doc_id", "n_shingles", "grouped", "label"), "labels")
    keep.clear()
    # of a group the smallest id stays, a null one only if there is no other, and of equal ids the first row
    heads = labels.where("grouped").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")).alias("head"))
    several = labels.where("grouped").join(materialize(heads, "heads"), "label").select("row", "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("stays"))
    return several.unionByName(labels.where("not grouped").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, stays for every row of ``docs``.

    component_id is the smallest id of the rows reachable by links, kept tells that it is the
    row's own id. Null or empty texts have no shingles, link with nothing and are their own
    component. A null id takes part through its text; its component is null if no row of its
    group has an id, and kept is false. Repeated rows are copies of each other, equal in all
    but ``stays``, which marks one row of each group: that of the smallest id, ties by place.
    Texts of any length are taken whole. Other columns are not read. Empty input gives no rows.
    """
    found = _grouped(numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "stays")


def keep_one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near-duplicates, all columns as they were.

    Of a group the smallest id stays, of repeated rows one; a document without words or with
    a null id and a text of its own stays. Columns other than doc_id and text are not read.
    """
    rows = numbered(docs.select(F.struct(*docs.columns).alias("data")))
    found = _grouped(rows.select("row", F.col("data.doc_id").cast("long").alias("doc_id"), F.col("data.text").cast("string").alias("text")))
    return without_rows(rows, found.where("not stays").select("row")).select("data.*")
