"""Packing of tokenized documents into sequences of fixed size by bin completion.

Tokens come from a public tokenizer file. Where a few probes show that the tokenizer never
crosses ASCII white space, a text is cut there and the ids of each run are kept in a bounded
table, so the merges of one run are computed once per worker; else whole texts are encoded.

Packing. Only lengths matter, and there are at most CAPACITY different ones, so all pieces are
packed at once over a histogram, whatever their number: a solution is a list of fillings, each
with the number of sequences that have it. Best-fit decreasing, done on groups of equal
sequences, is the first incumbent. If it is above the lower bound, bin completion searches for
fewer: around the largest piece left, all undominated fillings (Martello and Toth) are tried in
order of least waste, each for as many sequences as it can and then for fewer; a branch ends when
its waste, or the bound of what is left, can't beat the incumbent, or when its counts were seen
with no more sequences (told by a digest of 128 bits). NODES fillings bound the search; when they run out the incumbent
stands, which may then be above the least number, but never above best fit. Pieces are numbered
within their length by counts of blocks, and get the places of their numbers.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, materialize

CAPACITY = 2048
NODES = 20_000
END_ID = 0
KNOWN_RUNS = 300_000
KNOWN_CORES = 300_000
LONG_RUN = 64
TOKENIZER = "word_bpe_49k.json"
_state: dict = {}
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|*#$%&-]*)\Z")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The byte-level alphabet: bytes that show a sign keep it, the others follow from 256 on.
_BYTE_SIGNS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


#: Texts on which the short ways must give what the whole tokenizer gives.
_PROBES = ("The quick brown fox, jumped; OVER 12 lazy dogs!", "Élan vital\tÜBER straße\r\nniño: señor? été.", " two  spaces \n\n lines ", "mixedCase*** #tag% a-b it's 'quoted' (x) Ä&")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _load(path: str) -> None:
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _state.update(path=path, tokenizer=tokenizer, model=tokenizer.model, runs={"": b""}, cores={})
        plain = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        _state["cut"] = all(plain(t) == [i for run in t.split() for i in plain(run)] for t in _PROBES)
        _state["parts"] = _state["cut"] and all(_parts(parts) == _packed_ids(plain(run)) for t in _PROBES for run in t.split() if (parts := _PLAIN.match(run)))
        _state["cores"].clear()


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _parts(parts: re.Match[str]) -> bytes:
    """Ids of a match of _PLAIN, a run of plain letters and a tail of plain marks: exactly two pre-tokens, which go straight to the model."""
    cores = _state["cores"]
    core, tail = parts[1].lower(), parts[2]
    ids = cores.get(core)
    if ids is None:
        # an ASCII letter is its own sign
        signs = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_SIGNS)
        ids = cores[core] = _packed_ids([t.id for t in _state["model"].tokenize(signs)])
    if tail:
        end = cores.get(tail)
        if end is None:
            end = cores[tail] = _packed_ids([t.id for t in _state["model"].tokenize(tail)])
        ids += end
    return ids


def _learn(fresh: list[str]) -> None:
    """Put the ids of new runs into the table."""
    runs, other, plain = _state["runs"], [], _state["parts"]
    if len(_state["cores"]) > KNOWN_CORES:
        _state["cores"].clear()
    for run in fresh:
        if plain and len(run) <= LONG_RUN and (parts := _PLAIN.match(run)):
            runs[run] = _parts(parts)
        else:
            other.append(run)
    for a in range(0, len(other), 4096):
        part = other[a : a + 4096]
        runs.update(zip(part, (_packed_ids(e.ids) for e in _state["tokenizer"].encode_batch_fast(part, add_special_tokens=False)), strict=True))


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text; null is the empty text."""
    _load(path)
    runs, out = _state["runs"], []
    if not _state["cut"]:
        return [_packed_ids(e.ids) for e in _state["tokenizer"].encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for text in texts:
        split = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(runs) > KNOWN_RUNS:
            runs.clear()
            runs[""] = b""
        fresh = [run for run in set(split) if run not in runs]
        _learn(fresh)
        out.append(b"".join(map(runs.__getitem__, split)))
        for run in fresh:
            if len(run) > LONG_RUN:
                del runs[run]
    return out


Solution = list[tuple[tuple[int, ...], int]]


def best_fit_decreasing(count: list[int], capacity: int) -> Solution:
    """Fillings and how many sequences have them, by best fit; ``count[n]`` pieces have length n.

    Equal sequences are one group. As a piece goes where least room is left, a sequence takes
    as many of a length as fit before the next one gets any.
    """
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    mask = 0  # bit r is set if a sequence has room r
    for n in range(capacity, 0, -1):
        left, passed = count[n], 0
        changed: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            fits = (mask >> n) << n & ~passed
            if fits:
                room = (fits & -fits).bit_length() - 1
                inside, have = groups[room].pop()
                if not groups[room]:
                    mask &= ~(1 << room)
            else:
                room, inside, have = capacity, (), left
            each = room // n
            whole = min(have, left // each)
            rest = left - whole * each if whole < have else 0
            rest = min(rest, each - 1)
            for take, times in ((each, whole), (rest, 1 if rest else 0), (0, have - whole - bool(rest))):
                if times and (take or inside):
                    changed.append((room - take * n, inside + (n,) * take, times))
            left -= whole * each + rest
        for room, inside, times in changed:
            groups.setdefault(room, []).append((inside, times))
            mask |= 1 << room
    return [(inside, times) for found in groups.values() for inside, times in found]


def lower_bound(count: list[int], capacity: int) -> int:
    """The largest of total size and, for each k, the bound by pieces over half and those of k or more that cannot join them."""
    c = np.array(count, np.int64)
    n, size = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * np.arange(len(c)))])  # of lengths under the index
    half = capacity // 2
    k = np.arange(1, half + 1)
    wide = n[capacity + 1] - n[capacity - k + 1]
    middle = n[capacity - k + 1] - n[half + 1]
    free = middle * capacity - (size[capacity - k + 1] - size[half + 1])
    rest = size[half + 1] - size[k] - free
    more = wide + middle + np.maximum(0, -(-rest // capacity))
    return max(-(-int(size[-1]) // capacity), int(more.max(initial=0)))


def _dominated(inside: tuple[int, ...], waste: int, free: int) -> bool:
    """A piece that is left over (bits of ``free``) could take the place of some of ``inside`` and leave no more waste."""
    one = two = 0  # sums of one or more, of two or more pieces
    for n in inside:
        two |= (one | two) << n
        one |= one << n | 1 << n
    spread, step = two, 1
    done = 0
    while done < waste:
        step = min(done + 1, waste - done)
        spread |= spread << step
        done += step
    if spread & free:
        return True
    return waste > 0 and any(free >> (n + 1) & ((1 << waste) - 1) for n in {0, *inside})


def fillings(count: list[int], room: int) -> Iterator[tuple[int, tuple[int, ...] | None]]:
    """(waste, pieces) of all undominated fillings of ``room`` in order of least waste; pieces is None for one that is dominated."""
    lengths = [n for n in range(min(room, len(count) - 1), 0, -1) if count[n]]
    cut = (1 << (room + 1)) - 1
    sums = [1]  # sums of the lengths from each place on
    for n in reversed(lengths):
        reached, copies, step = sums[-1], min(count[n], room // n), 1
        while copies:
            step = min(step, copies)
            reached |= reached << (step * n) & cut
            copies -= step
            step *= 2
        sums.append(reached)
    sums.reverse()

    def exactly(at: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for j in range(at, len(lengths)):
            if not sums[j] >> total & 1:
                return
            n = lengths[j]
            for k in range(min(count[n], total // n), 0, -1):
                if sums[j + 1] >> (total - k * n) & 1:
                    for more in exactly(j + 1, total - k * n):
                        yield (n,) * k + more

    free = sum(1 << n for n in lengths)
    for waste in range(room + 1):
        if sums[0] >> (room - waste) & 1:
            for inside in exactly(0, room - waste):
                gone = sum(1 << n for n, k in Counter(inside).items() if k == count[n])
                yield waste, None if _dominated(inside, waste, free & ~gone) else inside


def bin_completion(count: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[Solution, bool]:
    """The best solution found, and whether it is proven to have the least number of sequences."""
    incumbent = best_fit_decreasing(count, capacity)
    fewest, least = sum(m for _, m in incumbent), lower_bound(count, capacity)
    total, count = sum(n * c for n, c in enumerate(count)), list(count)
    seen: dict[bytes, int] = {}  # by digests, as the counts themselves take 16 KB a node
    done: Solution = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        for n in pattern:
            count[n] -= times

    def children() -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(pattern, times, waste) around the largest piece left; None as times for a dominated filling."""
        largest = next(n for n in range(capacity, 0, -1) if count[n])
        own = list(count)
        own[largest] -= 1
        for waste, inside in fillings(own, capacity - largest):
            if inside is None:
                yield (), 0, waste
                continue
            pattern = (largest, *inside)
            for times in range(min(count[n] // k for n, k in Counter(pattern).items()), 0, -1):
                yield pattern, times, waste

    stack, used, wasted = [], 0, 0
    entering, whole = fewest > least, True
    while entering or stack:
        if entering:
            entering = False
            if not any(count):
                incumbent, fewest = list(done), used
                if fewest <= least:
                    break
            else:
                key = hashlib.blake2b(np.array(count, np.int64).tobytes(), digest_size=16).digest()
                if seen.get(key, fewest) > used and used + lower_bound(count, capacity) < fewest:
                    seen[key] = used
                    stack.append([children(), None])
                    continue
            if not stack:
                break
        if stack[-1][1]:
            pattern, times, waste = stack[-1][1]
            put(pattern, -times)
            done.pop()
            used, wasted, stack[-1][1] = used - times, wasted - times * waste, None
        nodes -= 1
        if nodes < 0:
            whole = False
            break
        step = next(stack[-1][0], None)
        # children come in order of least waste, so one that wastes too much even once ends them
        if step is None or wasted + step[2] > (fewest - 1) * capacity - total:
            stack.pop()
            continue
        pattern, times, waste = step
        if times and wasted + times * waste <= (fewest - 1) * capacity - total:
            put(pattern, times)
            done.append((pattern, times))
            used, wasted, stack[-1][1], entering = used + times, wasted + times * waste, step, True
    return incumbent, whole or fewest <= least


def _pieces(path: str, capacity: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a in range(0, len(ids), 256):
                part = token_bytes(texts.slice(a, 256).to_pylist(), path)
                row, piece, start, length, crc = [], [], [], [], []
                for k, data in enumerate(part):
                    data += END_ID.to_bytes(4, "little")
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[at : at + 4 * capacity]
                        row.append(a + k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return run


def _places(solution: Solution) -> tuple[np.ndarray, ...]:
    """For runs of piece numbers, sorted by length and first number: both, the first sequence, pieces a sequence, and offset."""
    runs, first = [], 0
    for pattern, times in solution:
        at = 0
        for n, k in sorted(Counter(pattern).items(), reverse=True):
            runs.append((n, times * k, first, k, at))
            at += n * k
        first += times
    runs.sort(key=lambda r: (r[0], r[2]))
    length, size, sequence, each, offset = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 5
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    return length, start - start[np.searchsorted(length, length)] if runs else start[:0], sequence, each, offset


def _placed(solution: Solution):
    length, start, sequence, each, offset = _places(solution)
    below = np.searchsorted(length, np.arange(int(length[-1]) + 2)) if len(length) else None

    def run(batches):
        for batch in batches:
            n, k = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "number"))
            at = np.zeros(len(n), np.int64)
            for x in np.unique(n):
                mine, a, b = n == x, below[x], below[x + 1]
                at[mine] = a + np.searchsorted(start[a:b], k[mine], "right") - 1
            j = k - start[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = [pa.array(sequence[at] + j // each[at]), pa.array(offset[at] + j % each[at] * n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is the one id 0. Only documents over ``capacity`` are cut; texts of
    any length are taken whole. Null ids and repeated rows are packed like any other row.
    Pieces of equal length are dealt in the order in which they were written. Other columns
    are not read. Empty input gives no rows.
    """
    pieces = id_and_text(docs, id_col, text_col).mapInArrow(_pieces(tokenizer_path or default_tokenizer_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(pieces.withColumn("slot", F.monotonically_increasing_id()), "pieces").withColumn("part", F.shiftright("slot", 33))
    parts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    count = [0] * (capacity + 1)
    for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        count[r.length] = r.n
    solution, _ = bin_completion(count, capacity)
    before = parts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("slot")) - 1
    numbered = pieces.withColumn("within", within).join(before, ["length", "part"]).withColumn("number", F.col("before") + F.col("within"))
    return numbered.mapInArrow(_placed(solution), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their places in sequences, as :func:`pack` gives them."""
    return pack(docs)
