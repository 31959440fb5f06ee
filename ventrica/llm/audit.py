"""Repair of conversation structure: the cheapest edits that make the roles alternate.

Each turn is kept, given the other role, or deleted, and turns can be put in, so that the
roles read: a system turn or none, then pairs of user and assistant. Dynamic programming
runs over four states (nothing yet, system said, user said, assistant said). The letters
of the edits so far are linked nodes that share their beginnings; a node knows its
ancestors 1, 2, 4, ... letters back and a rolling hash of its letters. Of equally cheap
edits those with the least letters win: two nodes are lifted to one depth, a descent over
ancestors with unequal hashes finds the first letter that differs, and equal hashes are
verified down to the node that both share. Of two ways to one state over the same turns at
one cost neither is a beginning of the other (the longer one would hold more insertions and
cost more), so what follows can't turn their order, and a conversation may be cut.

A conversation of usual size is repaired in one go. One with more than SEGMENT turns or
SEGMENT_BYTES of text is dealt to ranges in order, its segments are worked out on their own
for every state that may precede them, and the segments' results are chained the same way.
What one task then holds of it are letters, which the result holds too; its texts stream
through a running digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, Scratch, materialize

SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
CUT_OFF = 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with this initial is kept, and after a turn is rerolled or inserted.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURNED = (USER, USER, ASSISTANT, USER)
SAID = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
SEGMENT, SEGMENT_BYTES = 1024, 8 << 20
_BASE, _PRIME = 0x5DEECE66D, (1 << 61) - 1
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Node:
    """The last piece of a string of letters and its ancestors 1, 2, 4, ... pieces back."""

    __slots__ = ("piece", "depth", "up", "hash")

    def __init__(self, parent: Node | None, piece: str) -> None:
        self.piece = piece
        if parent is None:
            self.depth, self.up, self.hash = 0, [], 0
            return
        self.depth = parent.depth + 1
        number = ord(piece) if len(piece) == 1 else int.from_bytes(hashlib.md5(piece.encode()).digest()[:8], "big")
        self.hash = (parent.hash * _BASE + number + 1) % _PRIME
        up = [parent]
        while len(up) <= len(up[-1].up):
            up.append(up[-1].up[len(up) - 1])
        self.up = up

    def at_depth(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def after(self, start: Node | None) -> str:
        """The letters behind ``start``, an ancestor; None stands for the root."""
        pieces, node = [], self
        while node is not start and node.up:
            pieces.append(node.piece)
            node = node.up[0]
        return "".join(reversed(pieces))


def _same(x: Node, y: Node) -> bool:
    """Whether two nodes of one depth hold the same pieces; ends where they share a node."""
    while x is not y:
        if x.piece != y.piece:
            return False
        x, y = x.up[0], y.up[0]
    return True


def less(x: Node, y: Node) -> bool:
    """Whether the letters of x sort before those of y."""
    depth = min(x.depth, y.depth)
    a, b = x.at_depth(depth), y.at_depth(depth)
    if a is not b and a.hash != b.hash:
        for j in range(len(a.up) - 1, -1, -1):
            if j < len(a.up) and a.up[j].hash != b.up[j].hash:
                a, b = a.up[j], b.up[j]
        a, b = a.up[0], b.up[0]  # the longest common beginning, if hashes tell the truth
    if not _same(a, b):
        return x.after(None) < y.after(None)  # a collision: compare all letters
    if a.depth == depth:
        return x.depth < y.depth
    p, q = x.at_depth(a.depth + 1).piece, y.at_depth(a.depth + 1).piece
    return p < q if len(p) == len(q) else x.after(a) < y.after(b)


def _offer(best: dict, state: int, cost: int, parent: Node, piece: str) -> None:
    """Take the way to ``state`` through ``parent`` if it is cheaper, or as cheap with less letters."""
    have = best.get(state)
    if have is None or cost < have[0]:
        best[state] = (cost, parent, piece, None)
    elif cost == have[0]:
        mine, theirs = Node(parent, piece), have[3] or Node(have[1], have[2])
        best[state] = (cost, parent, piece, mine) if less(mine, theirs) else (*have[:3], theirs)


def _settled(best: dict) -> dict[int, tuple[int, Node]]:
    """Nodes of the winners, after the insertions that may follow; two in a row lead everywhere."""
    ways = {s: (c, made or Node(parent, piece)) for s, (c, parent, piece, made) in best.items()}
    return _inserted(ways)


def _inserted(ways: dict[int, tuple[int, Node]]) -> dict[int, tuple[int, Node]]:
    for _ in range(2):
        best = {s: (c, None, "", n) for s, (c, n) in ways.items()}
        for s, (c, n) in list(ways.items()):
            _offer(best, TURNED[s], c + INSERT, n, "I")
        ways = {s: (c, made or Node(parent, piece)) for s, (c, parent, piece, made) in best.items()}
    return ways


def cheapest(turns: list[tuple[str, int]], start: int = NOTHING, first: bool = True) -> dict[int, tuple[int, Node]]:
    """The cheapest edits of ``turns`` (initial, fault) from the state ``start`` to every state: its cost and last node.

    Insertions may follow every turn, and precede the ``first`` ones of a conversation.
    """
    ways = {start: (0, Node(None, ""))}
    if first:
        ways = _inserted(ways)
    for initial, fault in turns:
        best: dict = {}
        extra = CUT_OFF if fault == TRUNCATED else 0
        for s, (c, n) in ways.items():
            _offer(best, s, c + DELETE, n, "D")
            if fault not in (BLANK, DUPLICATE):
                if (s, initial) in KEPT:
                    _offer(best, KEPT[s, initial], c + KEEP + extra, n, "K")
                _offer(best, TURNED[s], c + REROLE + extra, n, "R")
        ways = _settled(best)
    return ways


def finished(ways: dict[int, tuple[int, Node]]) -> tuple[int, str]:
    """Cost and letters of the best way to an empty conversation or one that ends with the assistant."""
    ends = [ways[s] for s in (NOTHING, ASSISTANT) if s in ways]
    best = ends[0]
    for other in ends[1:]:
        if other[0] < best[0] or (other[0] == best[0] and less(other[1], best[1])):
            best = other
    return best[0], best[1].after(None)


def chained(segments: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, str]:
    """The same as ``finished`` for a conversation whose segments hold cost and letters from every state to every state."""
    ways = {NOTHING: (0, Node(None, ""))}
    for ends_of in segments:
        best: dict = {}
        for s, (c, n) in ways.items():
            for end, (cost, letters) in ends_of.get(s, {}).items():
                _offer(best, end, c + cost, n, letters)
        ways = {s: (c, made or Node(parent, piece)) for s, (c, parent, piece, made) in best.items()}
    return finished(ways)


def repaired(letters: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that are left after the edits ``letters`` of ``turns`` (role, text)."""
    state = NOTHING
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        state = KEPT[state, role[:1]] if letter == "K" else TURNED[state]
        yield letter, role if letter == "K" else SAID[state], text


class Digest:
    """SHA-256 of `role:text` of turns in order, joined by newlines, as they come."""

    def __init__(self) -> None:
        self.sha, self.empty = hashlib.sha256(), True

    def add(self, role: str, text: str) -> None:
        self.sha.update((("" if self.empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.empty = False


def fault_of(text: str, again: bool) -> int:
    """The first fault of a turn; ``again``: its role and text came before."""
    said = text.strip(SPACE)
    return BLANK if not said else DUPLICATE if again else TRUNCATED if said[-1] not in ".!?" else SOUND


class Counts:
    """What is counted over turns in order; a later segment can be added."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.low = self.high = self.last = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in LEGAL
        self.last_initial = initial
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.last
            self.last = turn

    def follow(self, faults: list[int], illegal: int, turns: int, low: int | None, high: int | None, first: str, last: str) -> None:
        """Add the counts of the segment that comes next."""
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]
        self.illegal += illegal + (self.last_initial is not None and self.last_initial + first not in LEGAL)
        self.turns += turns - (low is not None and low == self.high)
        self.low, self.high = (low if self.low is None else self.low), (self.high if high is None else high)
        self.first_initial, self.last_initial = first if self.first_initial is None else self.first_initial, last

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return (gaps, *self.faults[1:], self.illegal)


def plain_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes it the user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = plain_turns(turns).withColumn("kind", (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).cast("int"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return dealt.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _by_conversation(batches, columns: list[str]) -> Iterator[tuple]:
    """Rows of sorted batches in order, as tuples with the conversation first."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _whole(rows: DataFrame) -> DataFrame:
    """RESULT for conversations of bounded size, each in one go."""

    def one(conv, turns: list[tuple]) -> tuple:
        counts, seen, codes = Counts(), set(), []
        for turn, role, text in turns:
            fault = fault_of(text, (role, text) in seen)
            seen.add((role, text))
            counts.add(turn, role[:1], fault)
            codes.append((role[:1], fault))
        cost, letters = finished(cheapest(codes))
        digest = Digest()
        for _, role, text in repaired(letters, iter([t[1:] for t in turns])):
            digest.add(role, text)
        return (conv, *counts.row(), cost, letters, digest.sha.hexdigest())

    def run(batches):
        out, turns, conv = [], [], None
        for c, *turn in _by_conversation(batches, ["conv_id", "turn", "role", "text"]):
            if turns and c != conv:
                out.append(one(conv, turns))
                turns = []
            conv = c
            turns.append(tuple(turn))
            if len(out) >= 1000:
                yield _batch(out, RESULT)
                out = []
        if turns:
            out.append(one(conv, turns))
        yield _batch(out, RESULT)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, RESULT)


SEGMENTS = "conv_id long, at long, blank long, duplicate long, truncated long, sound long, illegal long, turns long, low long, high long, first string, last string, ways string"


def _segments(codes: DataFrame, segment: int) -> DataFrame:
    """Counts and ways of runs of up to ``segment`` turns of one conversation; ``codes`` lie in order."""

    def one(conv, at: int, rows: list[tuple], begins: bool) -> tuple:
        counts = Counts()
        for turn, initial, fault in rows:
            counts.add(turn, initial, fault)
        turns = [(i, f) for _, i, f in rows]
        ways = []
        for start in (NOTHING,) if begins else range(4):
            for end, (cost, node) in cheapest(turns, start, begins).items():
                ways.append(f"{start}{end}{cost}:{node.after(None)}")
        f = counts.faults
        return (conv, at, f[BLANK], f[DUPLICATE], f[TRUNCATED], f[SOUND], counts.illegal, counts.turns, counts.low, counts.high, counts.first_initial, counts.last_initial, " ".join(ways))

    def run(batches):
        rows, begins, conv, begun = [], False, None, 0
        for c, at, turn, initial, fault, head in _by_conversation(batches, ["conv_id", "at", "turn", "initial", "fault", "head"]):
            if rows and (c != conv or len(rows) >= segment):
                yield _batch([one(conv, begun, rows, begins)], SEGMENTS)
                rows = []
            if not rows:
                conv, begun, begins = c, at, head
            rows.append((turn, initial, fault))
        if rows:
            yield _batch([one(conv, begun, rows, begins)], SEGMENTS)

    return codes.mapInArrow(run, SEGMENTS)


def _chain(segments: DataFrame) -> DataFrame:
    """RESULT without a digest from the segments of each conversation, in order."""

    def one(conv, counts: Counts, ways: list[dict]) -> tuple:
        return (conv, *counts.row(), *chained(ways), None)

    def run(batches):
        conv, counts, ways = None, None, []
        for c, _, blank, duplicate, truncated, sound, illegal, turns, low, high, first, last, text in _by_conversation(batches, [f.split()[0] for f in SEGMENTS.split(", ")]):
            if ways and c != conv:
                yield _batch([one(conv, counts, ways)], RESULT)
                ways = []
            if not ways:
                conv, counts = c, Counts()
            counts.follow([sound, blank, duplicate, truncated], illegal, turns, low, high, first, last)
            ends: dict[int, dict[int, tuple[int, str]]] = {}
            for way in text.split(" "):
                head, letters = way.split(":")
                ends.setdefault(int(head[0]), {})[int(head[1])] = (int(head[2:]), letters)
            ways.append(ends)
        if ways:
            yield _batch([one(conv, counts, ways)], RESULT)

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, RESULT)


def _streamed(ordered: DataFrame, audits: DataFrame, use, schema: str) -> DataFrame:
    """``use(conv_id, edits)`` over each conversation's repaired turns, which are read as a stream in order."""
    rows = ordered.select("conv_id", "at", "role", "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")

    def run(batches):
        flat = _by_conversation(batches, ["conv_id", "at", "role", "text", "audit"])
        head = next(flat, None)
        while head is not None:
            conv, following = head[0], []

            def turns(following=following):
                for row in flat:
                    if row[1] == -1:
                        following.append(row)
                        return
                    yield row[2], row[3]

            mine = turns()
            yield from use(conv, repaired(head[4], mine))
            for _ in mine:  # turns that no edit is left for: none
                pass
            head = following[0] if following else None

    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, schema)


def _digests(ordered: DataFrame, audits: DataFrame) -> DataFrame:
    def use(conv, edits):
        digest = Digest()
        for _, role, text in edits:
            digest.add(role, text)
        yield _batch([(conv, digest.sha.hexdigest())], "conv_id long, repaired_sha256 string")

    return _streamed(ordered, audits, use, "conv_id long, repaired_sha256 string")


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _placed(rows: DataFrame, tag: str, scratch) -> DataFrame:
    """``rows`` with ``at``, a number that grows in the order of conversation and turn; a long conversation lies in many ranges."""
    keys = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*keys, F.left("text", F.lit(64))).sortWithinPartitions(*keys, "text")
    return scratch(dealt.withColumn("at", F.monotonically_increasing_id()), tag)


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place (0, 1, ...), edit (K, R or I), role, text of all conversations after the edits of ``repair_conversations``."""
    rows = _placed(plain_turns(turns), "ordered_turns", materialize)

    def use(conv, edits):
        out, size = [], 0
        for place, (edit, role, text) in enumerate(edits):
            out.append((conv, place, edit, role, text))
            size += len(text)
            if len(out) >= 1000 or size > SEGMENT_BYTES:
                yield _batch(out, REPAIRED)
                out, size = [], 0
        yield _batch(out, REPAIRED)

    return _streamed(rows, repairs, use, REPAIRED)


def _long(rows: DataFrame, segment: int, scratch: Scratch) -> DataFrame:
    """RESULT for conversations of any size."""
    ordered = _placed(rows, "ordered_turns", scratch)
    said = F.rtrim("text", F.lit(SPACE))
    # short rows only: which turns are the first with their role and text, and which begin a conversation
    short = ordered.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"), (said == "").alias("blank"), F.substring(said, -1, 1).isin(".", "!", "?").alias("ended"))
    firsts = short.groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    heads = short.groupBy("conv_id").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("head"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
    codes = short.join(firsts, "at", "left").join(heads, "at", "left").select("conv_id", "at", "turn", "initial", fault.alias("fault"), F.coalesce("head", F.lit(False)).alias("head"))
    segments = scratch(_segments(codes.repartitionByRange("at").sortWithinPartitions("at"), segment), "segments")
    audits = scratch(_chain(segments), "audits")
    digests = _digests(ordered, audits).withColumnRenamed("conv_id", "of")
    return audits.drop("repaired_sha256").join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def repair_conversations(turns: DataFrame, *, segment: int = SEGMENT, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """RESULT for each conversation of ``turns(conv_id, turn, role, text)``; the turns themselves come from repaired_turns.

    Turns go by number, nulls first, ties by role and text. A null role or text is one space;
    a null conv_id is a conversation of its own; repeated rows are repeated turns; roles count
    by their first character; other columns are not read; no rows give no rows. ``gaps`` beyond a
    long are the largest long. Copies of one turn number, role and first 64 characters of a
    text lie in one range, which is read as a stream.
    """
    rows, scratch = plain_turns(turns), Scratch()
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("decimal(20,0)")).alias("bytes"))
    large = scratch(sizes.where((F.col("n") > segment) | (F.col("bytes") > segment_bytes)).select(F.col("conv_id").alias("of")), "large")
    count = large.count()
    if not count:
        scratch.clear()
        return _whole(rows)
    sent = F.broadcast(large) if count <= SENT_ROWS else large
    of = F.col("conv_id").eqNullSafe(F.col("of"))
    small = _whole(rows.join(sent, of, "left_anti"))
    out = materialize(small.unionByName(_long(rows.join(sent, of, "left_semi"), segment, scratch)), "repairs")
    scratch.clear()
    return out


def audit_conversations(turns: DataFrame) -> DataFrame:
    """RESULT for every conv_id of ``turns`` after the damage of ``damaged``; one that lost all rows has zeros, no letters and the digest of nothing."""
    found = repair_conversations(damaged(turns))
    ids = turns.select(F.col("conv_id").cast("long").alias("of")).distinct()
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    names = [f.split()[0] for f in RESULT.split(", ")][1:]
    filled = [F.coalesce(n, F.lit(nothing[n]) if n in nothing else F.lit(0).cast("long")).alias(n) for n in names]
    return ids.join(found, F.col("of").eqNullSafe(F.col("conv_id")), "left").select(F.col("of").alias("conv_id"), *filled)
