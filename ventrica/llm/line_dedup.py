"""Lines that many documents share, dropped by probing a sharded minimal perfect hash.

Every line's key (ends stripped, A-Z lower-cased) is hashed to 128 bits. Documents are
counted by key in grouped sums; only keys that reach the threshold enter the index. The
index is cut into shards by hash. A shard's minimal perfect hash is a cascade of bit
levels: a level keeps the keys that are alone on their bit, the others fall to the next;
the number of set bits before a key's bit is its place, 0 to n - 1, in three arrays:
fingerprints of 64 bits that the placing does not determine, numbers of documents, and the
largest id that holds the line. A line of no indexed key meets a foreign fingerprint; that
it passes has a chance of 2^-64.

Documents probe the arrays where they lie: texts are neither shuffled nor joined. An index
of at most SENT_BYTES goes to the tasks whole. A larger one stays in the shared folder: the
different hashes of a block of documents go to the shards, a shard answers with the keys
that it holds, and each block is put together with its answers. A line that is in all
documents is one question from each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize
from .shingles import mix64

MIN_CHARS, MIN_DOCS = 20, 3
SPACE = b" \t\n\v\f\r"
SHARD_KEYS = 1 << 18
#: So many bytes of shards are sent to every task; a larger index answers questions instead.
SENT_BYTES = 64 << 20
#: Bytes of text in a block, but for a longer document.
BLOCK_BYTES = 16 << 20
#: Bytes of text whose lines are looked up together.
PIECE_BYTES = 1 << 20
NO_ID = -(1 << 63)
SHARD = "shard long, keys long, levels binary, sizes array<long>, prints binary, counts binary, keepers binary"


def lines_of(text: bytes | None) -> list[bytes]:
    """The lines of a text; a null or empty one has one empty line."""
    return (text or b"").split(b"\n")


def line_hashes(lines: list[bytes], min_chars: int = MIN_CHARS) -> np.ndarray:
    """[line, 2]: the 128-bit hash of each line's key, zeros for keys below ``min_chars`` code points."""
    out = bytearray(16 * len(lines))
    for k, line in enumerate(lines):
        key = line.strip(SPACE)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            out[16 * k : 16 * k + 16] = xxhash.xxh3_128_digest(key.lower())  # bytes.lower() folds A-Z alone
    return np.frombuffer(bytes(out), np.uint64).reshape(-1, 2)


def _bit(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(a ^ mix64(b + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)


class Shard:
    """A minimal perfect hash over pairs of 64-bit hashes with its arrays."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> None:
        self.levels, self.prints, self.counts, self.keepers = levels, prints, counts, keepers
        self.ranks, before = [], 0
        for packed in levels:  # set bits before each byte; those inside a byte are counted on demand
            ones = _ONES[packed].astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        levels, left_a, left_b = [], a, b
        while len(left_a):
            size = 8 * ((len(left_a) + 7) // 8) + 8
            at = _bit(left_a, left_b, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            fall = ~alone[at]
            left_a, left_b = left_a[fall], left_b[fall]
        shard = cls(levels, b, counts, keepers)
        place = shard.places(a, b)
        for name, values in (("prints", b), ("counts", np.minimum(counts, (1 << 32) - 1).astype(np.uint32)), ("keepers", keepers)):
            column = np.empty(len(a), values.dtype)
            column[place] = values
            setattr(shard, name, column)
        return shard

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key; -1, or some place, for a key that was not built in."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (packed, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _bit(a[left], b[left], level, 8 * len(packed))
            byte = packed[at >> 3]
            found = (byte >> (at & 7).astype(np.uint8)) & 1 == 1
            below = byte & ((1 << (at & 7)) - 1).astype(np.uint8)
            out[left[found]] = (rank[at >> 3] + _ONES[below])[found]
            left = left[~found]
        return out

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys are in the index, and for those the number of documents and the largest id."""
        place = self.places(a, b)
        found = np.flatnonzero(place >= 0)
        found = found[self.prints[place[found]] == b[found]]
        return found, self.counts[place[found]], self.keepers[place[found]]

    def row(self, shard: int) -> tuple:
        return (shard, len(self.prints), b"".join(x.tobytes() for x in self.levels), [len(x) for x in self.levels], self.prints.tobytes(), self.counts.tobytes(), self.keepers.tobytes())

    @classmethod
    def of(cls, row: dict) -> Shard:
        cuts = np.cumsum(row["sizes"])[:-1] if row["sizes"] else []
        levels = np.split(np.frombuffer(row["levels"], np.uint8), cuts) if row["sizes"] else []
        return cls(levels, np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["keepers"], np.int64))


_ONES = np.array([bin(k).count("1") for k in range(256)], np.uint8)


def _pieces(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[list[tuple[int, bytes, list[bytes]]], np.ndarray, np.ndarray]]:
    """(row, text, lines) of some documents, about PIECE_BYTES together, the hashes of all their lines, and where each document's end."""
    docs, hashes, size = [], [], 0
    for k, text, lines, keys in _hashed(batch, min_chars):
        docs.append((k, text, lines))
        hashes.append(keys)
        size += len(text)
        if size > PIECE_BYTES or k + 1 == batch.num_rows:
            yield docs, np.concatenate(hashes), np.cumsum([len(h) for h in hashes])
            docs, hashes, size = [], [], 0


def _hashed(batch: pa.RecordBatch, min_chars: int) -> Iterator[tuple[int, bytes, list[bytes], np.ndarray]]:
    for k, text in enumerate(batch.column("text")):
        text = text.as_py() or b""
        lines = lines_of(text)
        yield k, text, lines, line_hashes(lines, min_chars)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """a, b (the halves of a key's hash), n (different ids that hold it), keeper (the largest) of keys in at least ``min_docs`` ids.

    A null id counts as the smallest long; repeated rows of one id count once.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts = [(h[(h != 0).any(axis=1)], k) for k, _, _, h in _hashed(batch, min_chars)]
            keys = np.concatenate([h for h, _ in parts]) if parts else np.empty((0, 2), np.uint64)
            owner = np.repeat(np.array([k for _, k in parts], np.int64), [len(h) for h, _ in parts])
            order = np.lexsort((ids[owner], keys[:, 1], keys[:, 0]))
            keys, held = keys[order].view(np.int64), ids[owner][order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1) | (held[1:] != held[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[new, 0]), pa.array(keys[new, 1]), pa.array(held[new])], ["a", "b", "doc_id"])

    held = _texts(docs, id_col, text_col).mapInArrow(run, "a long, b long, doc_id long")
    return held.distinct().groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _shard_of(a, shards: int):
    return F.pmod(F.shiftright(a, 17), F.lit(shards))


def build_line_index(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The index of ``lines(a, b, n, keeper)``: one row a shard, each built in its own task from about ``shard_keys`` keys."""
    shards = max(1, -(-lines.count() // shard_keys))

    def build(table: pa.Table) -> pa.Table:
        column = lambda name, kind: table.column(name).to_numpy().view(kind)
        made = Shard.build(column("a", np.uint64), column("b", np.uint64), column("n", np.int64), column("keeper", np.int64))
        row = made.row(table.column("shard")[0].as_py())
        names = [f.split()[0] for f in SHARD.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([v], t) for n, v, t in zip(names, row, kinds, strict=True)})

    return lines.withColumn("shard", _shard_of(F.col("a"), shards)).groupBy("shard").applyInArrow(build, SHARD)


class Index:
    """All shards in memory, for an index of bounded size."""

    def __init__(self, rows: list[dict]) -> None:
        self.shards, self.count = {r["shard"]: Shard.of(r) for r in rows}, max((r["shard"] for r in rows), default=0) + 1

    def probe(self, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Shard.probe, for keys [line, 2] of all shards."""
        of = ((keys[:, 0].view(np.int64) >> 17) % shards).astype(np.int64)
        usable = (keys != 0).any(axis=1)
        found, counts, keepers = [np.empty(0, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for s, shard in self.shards.items():
            at = np.flatnonzero(usable & (of == s)) if shards > 1 else np.flatnonzero(usable)
            hit, n, keeper = shard.probe(keys[at, 0], keys[at, 1])
            found.append(at[hit]), counts.append(n), keepers.append(keeper)
        return np.concatenate(found), np.concatenate(counts), np.concatenate(keepers)


OUT = "doc_id long, n_lines long, n_dropped long, text binary"


def _without(text: bytes, lines: list[bytes], drop: np.ndarray) -> tuple[int, int, bytes]:
    """n_lines, n_dropped, what is left."""
    if not len(drop):
        return len(lines), 0, text
    gone = set(drop.tolist())
    return len(lines), len(gone), b"\n".join(line for k, line in enumerate(lines) if k not in gone)


def _output(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [f.split()[0] for f in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], names)


def _by_probing(texts: DataFrame, index: Index, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            ids, rows, size = batch.column("doc_id").to_pylist(), [], 0
            for docs, keys, ends in _pieces(batch, min_chars):
                found, n, keeper = sent.value.probe(keys, shards)
                order = np.argsort(found[n >= min_docs], kind="stable")
                found, keeper = found[n >= min_docs][order], keeper[n >= min_docs][order]
                cuts = np.searchsorted(found, ends)
                for (k, text, lines), end, a, b in zip(docs, ends.tolist(), [0, *cuts.tolist()], cuts.tolist(), strict=False):
                    mine = found[a:b][keeper[a:b] != ids[k]] - (end - len(lines))
                    rows.append((ids[k], *_without(text, lines, mine)))
                    size += len(rows[-1][-1])
                if size > BLOCK_BYTES:
                    yield _output(rows)
                    rows, size = [], 0
            yield _output(rows)

    return texts.mapInArrow(run, OUT)


def _by_questions(texts: DataFrame, index: DataFrame, shards: int, min_chars: int, min_docs: int, scratch: Scratch) -> DataFrame:
    """The same for an index of any size: blocks of documents ask the shards."""

    def blocks(batches):
        part = None
        number = size = 0
        for batch in batches:
            sizes = [len(t) if t is not None else 0 for t in batch.column("text").to_pylist()]
            part = int(batch.column("part")[0].as_py()) if part is None and len(sizes) else part
            out = []
            for n in sizes:
                if size and size + n > BLOCK_BYTES:
                    number, size = number + 1, 0
                size += n
                out.append(((part or 0) << 32) + number)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, pa.int64())], ["doc_id", "text", "block"])

    dealt = scratch(texts.withColumn("part", F.spark_partition_id()).mapInArrow(blocks, "doc_id long, text binary, block long"), "blocks")

    def questions(batches):
        for batch in batches:
            owner = batch.column("block").to_numpy()
            parts = [(h[(h != 0).any(axis=1)].view(np.int64), k) for k, _, _, h in _hashed(batch, min_chars)]
            for block in np.unique(owner):
                keys = np.unique(np.concatenate([h for h, k in parts if owner[k] == block]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.full(len(keys), block))], ["a", "b", "block"])

    asked = dealt.mapInArrow(questions, "a long, b long, block long").distinct().withColumn("shard", _shard_of(F.col("a"), shards))

    def answers(batches):  # of each shard its arrays come first
        shard = None
        for batch in batches:
            first = np.flatnonzero(np.asarray(batch.column("levels").is_valid()))
            for at, end in zip([0, *first.tolist()], [*first.tolist(), batch.num_rows], strict=True):
                part = batch.slice(at, end - at)
                if part.num_rows and part.column("levels")[0].is_valid:
                    shard, part = Shard.of(part.slice(0, 1).to_pylist()[0]), part.slice(1)
                if shard is None or not part.num_rows:
                    continue
                a, b = (part.column(c).to_numpy().view(np.uint64) for c in "ab")
                # a partition may hold several shards; a question of one that is empty meets a foreign fingerprint
                found, n, keeper = shard.probe(a, b)
                found, keeper = found[n >= min_docs], keeper[n >= min_docs]
                hit = part.select(["block", "a", "b"]).take(pa.array(found))
                yield pa.RecordBatch.from_arrays([*hit.columns, pa.array(keeper)], ["block", "a", "b", "keeper"])

    both = index.withColumn("a", F.lit(0).cast("long")).withColumn("b", F.lit(0).cast("long")).withColumn("block", F.lit(-1).cast("long")).unionByName(asked, allowMissingColumns=True)
    dealt_shards = both.repartition("shard").sortWithinPartitions("shard", F.col("levels").isNull())
    known = scratch(dealt_shards.mapInArrow(answers, "block long, a long, b long, keeper long"), "answers")

    def put(docs: pa.Table, hits: pa.Table) -> pa.Table:
        keepers = dict(zip(zip(hits.column("a").to_pylist(), hits.column("b").to_pylist(), strict=True), hits.column("keeper").to_pylist(), strict=True))
        rows = []
        for batch in docs.to_batches():
            ids = batch.column("doc_id").to_pylist()
            for k, text, lines, keys in _hashed(batch, min_chars):
                found = [j for j, key in enumerate(map(tuple, keys.view(np.int64).tolist())) if key in keepers and keepers[key] != ids[k]]
                rows.append((ids[k], *_without(text, lines, np.array(found, np.int64))))
        return pa.Table.from_batches([_output(rows)])

    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(put, OUT)


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, sent_bytes: int = SENT_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is left): one row for each row of ``docs``.

    A line goes if its key has ``min_chars`` code points and is held by ``min_docs`` different
    ids, unless the document's id is the largest of them. Null and empty texts are one empty
    line; a null id counts as the smallest long and stays null; repeated rows of an id count
    once and are treated alike; other columns are not read; no rows give no rows.
    """
    texts, scratch = _texts(docs, id_col, text_col), Scratch()
    lines = scratch(repeated_lines(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, min_docs=min_docs), "lines")
    shards = max(1, -(-lines.count() // shard_keys))
    index = scratch(build_line_index(lines, shard_keys), "line_index")
    size = index.agg(F.sum(F.length("levels") + F.length("prints") + F.length("counts") + F.length("keepers"))).first()[0] or 0
    if size <= sent_bytes:
        out = _by_probing(texts, Index([r.asDict() for r in index.collect()]), shards, min_chars, min_docs)
    else:
        out = materialize(_by_questions(texts, index, shards, min_chars, min_docs, scratch), "kept_lines")
    scratch.clear()
    return out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_lines", "n_dropped", F.col("text").cast("string").alias("text"))
