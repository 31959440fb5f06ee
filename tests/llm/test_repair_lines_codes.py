"""Conversation repair, line dedup and vector codes against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from ventrica.llm import audit, line_dedup, vector_codes

TURNS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()
LEGAL = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """(cost, letters, repaired) of the best edits, by trying all of them with up to two insertions in a gap."""
    seen, choices = set(), []
    for role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        mine = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            mine += [("K", more, (role, text)), *(("R", 1 + more, (r, text)) for r in ("user", "assistant"))]
        choices.append(mine)
    gap = [()] + [(("I", 5, (r, "")),) for r in ("user", "assistant")] + [(("I", 5, (a, "")), ("I", 5, (b, ""))) for a in ("user", "assistant") for b in ("user", "assistant")]
    best = None
    for picked in itertools.product(*choices):
        for gaps in itertools.product(gap, repeat=len(rows) + 1):
            edits = [*gaps[0], *(e for p, g in zip(picked, gaps[1:], strict=True) for e in (p, *g))]
            kept = [e[2] for e in edits if e[2]]
            if LEGAL.fullmatch("".join(r[:1] for r, _ in kept)):
                key = (sum(e[1] for e in edits), "".join(e[0] for e in edits), kept)
                best = key if best is None or key[:2] < best[:2] else best
    return best


def some_turns(rnd, n):
    roles = ["user", "assistant", "system", "tool", "User", ""]
    return [(rnd.choice(roles[: rnd.choice((2, 3, 6))]), rnd.choice(("Yes.", "No!", "cut", " ", "", "Yes.", "So?", "x. "))) for _ in range(n)]


def codes_of(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append((role[:1], audit.fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    return out


def test_edits_are_the_cheapest_and_least():
    rnd = random.Random(4)
    for n in (1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3):
        rows = some_turns(rnd, n)
        cost, letters, kept = every_repair(rows)
        assert audit.finished(audit.cheapest(codes_of(rows))) == (cost, letters), rows
        assert [(r, t) for _, r, t in audit.repaired(letters, iter(rows))] == kept
    assert audit.finished(audit.cheapest([])) == (0, "")


def plain_best(codes):
    """Cost and letters by whole strings, for any number of turns."""
    ways = {audit.NOTHING: (0, "")}

    def inserted(ways):
        for _ in range(2):
            ways = dict(ways)
            for s, (c, t) in list(ways.items()):
                ways[audit.TURNED[s]] = min(ways.get(audit.TURNED[s], (math.inf, "")), (c + 5, t + "I"))
        return ways

    ways = inserted(ways)
    for initial, fault in codes:
        new = {}
        for s, (c, t) in ways.items():
            offers = [(s, c + 2, "D")]
            if fault in (audit.SOUND, audit.TRUNCATED):
                more = 5 * (fault == audit.TRUNCATED)
                offers += [(audit.TURNED[s], c + 1 + more, "R")] + [(audit.KEPT.get((s, initial)), c + more, "K")] * ((s, initial) in audit.KEPT)
            for end, cost, letter in offers:
                new[end] = min(new.get(end, (math.inf, "")), (cost, t + letter))
        ways = inserted(new)
    return min(ways[s] for s in (audit.NOTHING, audit.ASSISTANT) if s in ways)


def test_long_repairs_and_chained_segments_equal_plain_strings():
    rnd = random.Random(5)
    for n in (5, 9, 40, 200, 700):
        for odd in (0.02, 0.5):
            codes = [(("u", "a")[k % 2] if rnd.random() > odd else rnd.choice("suax"), rnd.choice((0, 0, 0, 1, 2, 3)) if rnd.random() < odd else 0) for k in range(n)]
            want = plain_best(codes)
            assert audit.finished(audit.cheapest(codes)) == want
            cuts = [0, *sorted(rnd.sample(range(1, n), min(3, n - 1))), n]
            segments = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                segments.append({s: {e: (c, x.after(None)) for e, (c, x) in audit.cheapest(codes[a:b], s, k == 0).items()} for s in ((0,) if k == 0 else range(4))})
            assert audit.chained(segments) == want


def test_equal_hashes_of_unlike_letters_are_seen(monkeypatch):
    monkeypatch.setattr(audit, "_PRIME", 3)
    rnd = random.Random(6)
    for _ in range(30):
        codes = [(rnd.choice("suax"), rnd.choice((0, 0, 1, 2, 3))) for _ in range(25)]
        assert audit.finished(audit.cheapest(codes)) == plain_best(codes)


def conversation_rows():
    rnd = random.Random(7)
    rows = [(c, k, r, t) for c in range(60) for k, (r, t) in enumerate(some_turns(rnd, rnd.randint(1, 12)))]
    rows += [(100, k, ("user", "assistant")[k % 2], f"Turn {k % 50} of it.") for k in range(300)]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (101, None, "assistant", "x."), (101, None, "user", "x."), (102, 5, "user", "again."), (102, 5, "user", "again."), (103, -(1 << 63), "user", "a."), (103, (1 << 63) - 1, "assistant", "é" * 5000 + "?")]
    rows += [(200 + k, 0, "user", "Only.") for k in range(60)]  # some lose all their rows
    return rows


def damaged_rows(rows):
    out = []
    for c, k, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if k is None else k}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, k, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    codes = codes_of([r[2:] for r in rows])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), (1 << 63) - 1) if turns else 0
    faults = [sum(f == k for _, f in codes) for k in (1, 2, 3)]
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(codes))
    cost, letters = plain_best(codes)
    kept = [f"{r}:{t}" for _, r, t in audit.repaired(letters, iter([r[2:] for r in rows]))]
    return (gaps, *faults, illegal, cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest())


@pytest.mark.parametrize("segment", [audit.SEGMENT, 7])
def test_conversations_are_repaired_whole(spark, monkeypatch, segment):
    rows = conversation_rows()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", at string, audit int").repartition(5)
    by = {}
    for r in damaged_rows(rows):
        by.setdefault(r[0], []).append(r)
    monkeypatch.setattr(audit.repair_conversations, "__kwdefaults__", {"segment": segment, "segment_bytes": audit.SEGMENT_BYTES})
    got = {r.conv_id: tuple(r)[1:] for r in audit.audit_conversations(turns).collect()}
    want = {c: plain_repair(by[c]) if c in by else (0, 0, 0, 0, 0, 0, "", EMPTY) for c in {r[0] for r in rows}}
    assert got == want and sum(v[-2] == "" for v in want.values()) > 0


def test_repaired_turns_give_the_digest(spark):
    turns = audit.damaged(spark.createDataFrame(conversation_rows(), TURNS))
    repairs = audit.repair_conversations(turns)
    by = {}
    for r in audit.repaired_turns(turns, repairs).orderBy("place").collect():
        by.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in repairs.collect():
        assert hashlib.sha256("\n".join(by.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256
    empty = spark.createDataFrame([], TURNS)
    assert audit.audit_conversations(empty).count() == 0 and audit.repaired_turns(empty, audit.repair_conversations(empty)).count() == 0


def documents():
    rnd = random.Random(8)
    common = [" ".join(rnd.choice(("été", "lamp", "stone", "RIVER")) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    rows = [(k, "\n".join(rnd.choice((rnd.choice(common), rnd.choice(common).upper(), "  " + rnd.choice(common) + "\t", f"only {k} {rnd.random()}", "")) for _ in range(rnd.randint(1, 25)))) for k in range(200)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "a line that all of these hold\n" * 3000), (304, "A line that ALL of these hold"), (305, "a line that all of these hold\r")]
    rows += [(None, "a line that all of these hold"), (None, "a line with no id at all here"), (7, "a line with no id at all here"), (7, "a line with no id at all here")]
    return rows + [(400 + k, "19 characters, éé é\n20 characters, ééé é\ncopy of a copied line é") for k in range(40)]


def plain_lines(rows):
    held = {}
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    least = lambda d: -(1 << 63) if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(least(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == least(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("sent", [line_dedup.SENT_BYTES, 0])
def test_shared_lines_stay_in_one_document(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 20_000)
    rows = documents()
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, block string, a int").repartition(6)
    got = sorted(map(tuple, line_dedup.drop_repeated_lines(docs, sent_bytes=sent, shard_keys=16).collect()), key=repr)
    assert got == sorted(plain_lines(rows), key=repr) and sum(r[2] > 0 for r in got) > 50
    assert line_dedup.drop_repeated_lines(docs.limit(0), sent_bytes=sent).count() == 0


def test_perfect_hash_is_minimal_and_refuses_foreign_keys():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 5000):
        a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
        shard = line_dedup.Shard.build(a, b, np.arange(n) + 3, np.arange(n) * 7)
        assert sorted(shard.places(a, b)) == list(range(n))
        names = [f.split()[0] for f in line_dedup.SHARD.split(", ")]
        again = line_dedup.Shard.of(dict(zip(names, shard.row(0), strict=True)))
        found, counts, keepers = again.probe(a, b)
        assert (found == np.arange(n)).all() and (counts == found + 3).all() and (keepers == found * 7).all()
        assert not len(again.probe(b + np.uint64(1), a)[0])


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """As the operator, by whole Python integers."""
    good = [(i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [[math.floor(1024 * c) for c in v] for _, v, _ in good]
    width = len(whole[0]) // parts
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][1]))[:entries]
    books = [[whole[k][p * width : (p + 1) * width] for k in order] for p in range(parts)]

    def assign(p):
        out = []
        for w in whole:
            part = w[p * width : (p + 1) * width]
            out.append(min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p])))
        return out

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for w, (_, k) in zip(whole, assign(p), strict=True):
                mine.setdefault(k, []).append(w[p * width : (p + 1) * width])
            for k, ws in mine.items():
                books[p][k] = [sum(c) // len(ws) for c in zip(*ws, strict=True)]
    found = [assign(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(found[p][k][0] for p in range(parts)) for k in range(len(good))]
    total = {}
    for (_, _, label), e in zip(good, errors, strict=True):
        total[label] = total.get(label, 0) + e
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, "".join(f"{found[p][k][1]:02x}" for p in range(parts)), fit(errors[k]), fit(total[x]), digest) for k, (i, _, x) in enumerate(good)), key=repr)


def vectors(n, rng, spread):
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=16) * spread], None if k % 5 == 0 else k % 3) for k in range(n)]
    rows += [(n + k, rows[k][1], 2) for k in range(min(20, n - 1))]  # copies
    rows += [(None, rows[0][1], 1), (3, rows[4 % n][1], None), (2000, None, 1), (2001, [1.0, None] * 8, 1), (2002, [float("nan")] * 16, 1), (2003, [float("inf")] + [0.0] * 15, 1), (2004, [0.0] * 16, 7)]
    return rows


@pytest.mark.parametrize(("n", "spread"), [(700, 0.2), (90, 0.002), (40, 1e36), (1, 1.0)])
def test_codes_equal_plain_arithmetic(spark, n, spread):
    rows = vectors(n, np.random.default_rng(11), spread)
    frame = spark.createDataFrame([(i, v, x, "y", 0) for i, v, x in rows], "vec_id long, embedding array<float>, label int, code string, part int").repartition(5)
    got = sorted(map(tuple, vector_codes.compress_vectors(frame).collect()), key=repr)
    want = plain_codes(rows)
    if spread < 1e30:
        assert got == want
    else:  # sums of errors beyond a long are null where one of them is
        assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert vector_codes.compress_vectors(frame.limit(0)).count() == 0


def test_access_tree_takes_the_lower_of_equals():
    rng = np.random.default_rng(12)
    for low, high in ((-2, 3), (-300, 300), (-(1 << 40), 1 << 40)):
        entries = np.floor(rng.uniform(low, high, (256, 5)))
        points = np.concatenate([entries, entries, np.floor(rng.uniform(low, high, (3000, 5)))])
        index, square = vector_codes.AccessTree(entries).nearest(points)
        whole = entries.astype(np.int64).astype(object)
        for p, k, s in zip(points.astype(np.int64).astype(object)[::7], index[::7], square[::7], strict=True):
            all_squares = [int(((p - e) ** 2).sum()) for e in whole]
            assert k == all_squares.index(min(all_squares)) and s == min(all_squares)


def test_tree_leaves_out_subtrees(monkeypatch):
    seen, rng = [], np.random.default_rng(13)
    plain = vector_codes._squares
    monkeypatch.setattr(vector_codes, "_squares", lambda p, e: (seen.append(len(p) * len(e)), plain(p, e))[1])
    centres = np.floor(rng.uniform(-5000, 5000, (16, 4)))
    entries = np.concatenate([np.floor(c + rng.normal(size=(16, 4)) * 20) for c in centres])
    tree = vector_codes.AccessTree(entries)
    seen.clear()
    tree.nearest(np.floor(entries[rng.integers(0, 256, 2000)] + rng.normal(size=(2000, 4)) * 5))
    assert sum(seen) < 0.3 * 2000 * 256


def test_codes_decode_near_their_vectors(spark):
    rows = vectors(300, np.random.default_rng(14), 0.1)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = vector_codes.train_codebooks(frame)
    by_id = {i: v for i, v, _ in rows}
    for r in vector_codes.encode(frame, books).where("vec_id > 3 and vec_id < 200").collect():
        whole = np.floor(np.array(by_id[r.vec_id]) * 1024) / 1024
        assert round(((books.decode(bytes(r.code)) - whole) ** 2).sum() * 1024**2) == r.error
