"""Conversation structure repair: the cheapest edits, by a DP shared along a trie of signatures.

A conversation's rows stand by turn (nulls first), equal turns by role and text.  A row is
*blank* (no character but white space), a *duplicate* (its role and text were seen before) or
*truncated* (no end mark last); the first of these counts.  Edits, and their letters: Keep 0,
Rerole to user or assistant 1, Delete 2 (blank rows and duplicates must go), Insert an
empty user or assistant message 5; a truncated row that stays adds 5.  The initials of
the roles must then be ``(s?(ua)+)?``.  Of equal costs the ASCII-least letters win.

1. Equal rows are counted before anything is shuffled by conversation, and a row's
   first appearance is a minimum joined back; texts of a conversation never meet in one task.
2. Rows are sorted by range, so a long conversation lies in many tasks, and cut into
   segments of at most ``SEGMENT`` rows.  A segment's signature has a letter a row: its role's
   initial, a capital if it is truncated, ``x`` if it must go.
3. Distinct signatures are sorted: the path to a signature in their prefix trie is a stack of
   DP layers, and a layer is computed once for all signatures that share the prefix.
   A layer holds, for each state before the segment and each state after it, the least
   cost and how the letters compare.  Terminal nodes emit these and the letters.
4. A conversation's segments are folded in order over four states, and the letters of the
   way taken go back to its rows, which then pass in order with one row in memory at a time.

A null role or text is one space, a null turn stands first and has no part in ``gaps``, a null
``conv_id`` is a conversation of its own.  A role that starts with none of s, u, a
(an empty one too) can't be kept.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import stored

SEGMENT = 256
#: States: nothing yet, after a leading system message, after a user's, after an assistant's.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Messages that are to be inserted at the end, by state.
MISSING = (0, 2, 1, 0)
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
_STATES = range(4)


def _wanted(state: int) -> str:
    """The initial that an inserted or reroled message must have."""
    return "a" if state == 2 else "u"


def _moves(symbol: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of what can happen to a row, and of insertions before it."""
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def take(start: int, end: int, cost: int, letters: str) -> None:
        found[start, end] = min(found.get((start, end), (1 << 30, "")), (cost, letters))

    for start in _STATES:
        state = start
        for inserted in range(3):
            before, letters = INSERT * inserted, "I" * inserted
            take(start, state, before + DELETE, letters + "D")
            if symbol != "x":
                stays = before + (UNFINISHED if symbol.isupper() else 0)
                if (kept := NEXT.get((state, symbol.lower()))) is not None:
                    take(start, kept, stays + KEEP, letters + "K")
                take(start, NEXT[state, _wanted(state)], stays + REROLE, letters + "R")
            state = NEXT[state, _wanted(state)]
    return [(a, b, cost, letters) for (a, b), (cost, letters) in found.items()]


MOVES = {symbol: _moves(symbol) for symbol in "suaoSUAOx"}

#: For each start, for each end: (cost, order among the ends, end one row before, letters), or nothing.
Cell = tuple[int, int, int, str]
Layer = tuple[tuple[Cell | None, ...], ...]
ROOT: Layer = tuple(tuple((0, 0, end, "") if end == start else None for end in _STATES) for start in _STATES)


def advance(layer: Layer, symbol: str) -> Layer:
    """The next layer of the trie: what one more row makes of each start."""
    moves, out = MOVES[symbol], []
    for cells in layer:
        best: list[tuple[int, int, str, int] | None] = [None] * 4
        for a, b, cost, letters in moves:
            if cells[a] is not None:
                one = (cells[a][0] + cost, cells[a][1], letters, a)
                if best[b] is None or one < best[b]:
                    best[b] = one
        # letters of equal rows are never a proper prefix of one another, so that the order before decides
        order = {b: k for k, b in enumerate(sorted((b for b in _STATES if best[b]), key=lambda b: best[b][1:3]))}
        out.append(tuple((best[b][0], order[b], best[b][3], best[b][2]) if best[b] else None for b in _STATES))
    return tuple(out)


def way(layers: list[Layer], start: int, end: int) -> str:
    """The letters of the cheapest way to a terminal node."""
    parts = []
    for layer in reversed(layers[1:]):
        _, _, end, letters = layer[start][end]
        parts.append(letters)
    return "".join(reversed(parts))


_SOLVED = "sig string, first int, last int, cost long, place int, letters string"
_SOLVED_ARROW = pa.schema([("sig", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("letters", pa.string())])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of sorted signatures; ``layers`` is the path from the trie's root to the last one."""
    last, layers = "", [ROOT]
    for batch in batches:
        rows = []
        for sig in batch.column(0).to_pylist():
            shared = len(os.path.commonprefix([last, sig]))
            del layers[shared + 1 :]
            for symbol in sig[shared:]:
                layers.append(advance(layers[-1], symbol))
            last = sig
            for a in _STATES:
                for b in _STATES:
                    if layers[-1][a][b] is not None:
                        rows.append((sig, a, b, *layers[-1][a][b][:2], way(layers, a, b)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SOLVED_ARROW, strict=True)], schema=_SOLVED_ARROW)


def solved(signatures: DataFrame) -> DataFrame:
    """For each distinct ``sig``, each state before (``first``) and after (``last``): cost, ``place`` in the order of letters, and letters."""
    return signatures.select("sig").distinct().repartitionByRange("sig").sortWithinPartitions("sig").mapInArrow(_solve, _SOLVED)


class _Fold:
    """The cheapest way through the segments of one conversation."""

    def __init__(self):
        self.cells: dict[int, tuple[int, int]] = {0: (0, 0)}
        self.back: list[tuple[int, list[int | None]]] = []

    def add(self, seg: int, table: list[tuple[int, int, int, int]]) -> None:
        best: dict[int, tuple[int, int, int, int]] = {}
        for first, last, cost, place in table:
            if first in self.cells:
                one = (self.cells[first][0] + cost, self.cells[first][1], place, first)
                if last not in best or one < best[last]:
                    best[last] = one
        order = sorted(best, key=lambda b: best[b][1:3])
        self.cells = {b: (best[b][0], k) for k, b in enumerate(order)}
        self.back.append((seg, [best[b][3] if b in best else None for b in _STATES]))

    def ways(self) -> Iterator[tuple[int, int, int, int]]:
        """(segment, state before, state after, messages missing at the end), last segment first."""
        end = min(self.cells, key=lambda b: (self.cells[b][0] + INSERT * MISSING[b], self.cells[b][1]))
        missing = MISSING[end]
        for seg, back in reversed(self.back):
            yield seg, back[end], end, missing
            end, missing = back[end], 0


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with ``times`` (0: gone) after the damage that crc32 of ``conv_id:turn`` modulo 20 deals."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(text("conv_id"), F.lit(":"), text("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    kind = F.col("fault")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Different rows once, with ``times``, their first ``fault`` (b, d, t or nothing), and ``at``, which rises in their order.

    A conversation of which nothing is left keeps a row without role.
    """
    here = F.col("times") > 0
    only = lambda c: F.when(here, F.col(c)).alias(c)
    once = rows.select("conv_id", only("turn"), only("role"), only("text"), "times").groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    once = once.withColumn("digest", F.md5(F.encode("text", "UTF-8")))
    first = once.filter("role is not null").groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest")).agg(F.min(F.struct("turn")).alias("f"))
    c = F.col
    same = c("conv_id").eqNullSafe(c("f_conv")) & (c("role") == c("f_role")) & (c("digest") == c("f_digest")) & c("turn").eqNullSafe(c("f_turn"))
    known = once.join(first.select("f_conv", "f_role", "f_digest", c("f.turn").alias("f_turn")), same, "left")
    fault = F.when(~c("text").rlike(r"[^\x20\x09-\x0D]"), "b").when(c("f_digest").isNull(), "d").when(~c("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("")
    known = known.select("conv_id", "turn", "role", "text", "times", fault.alias("fault"), F.substring("text", 1, 64).alias("head"))
    order = ["conv_id", "turn", "role"]
    dealt = known.repartitionByRange(*order, "head").sortWithinPartitions(*order, "text")
    return dealt.drop("head").withColumn("at", F.monotonically_increasing_id())


_ROW = ("conv_id", "turn", "role", "text", "times", "fault", "letters", "missing")


def edited(rows: DataFrame) -> DataFrame:
    """The stream that ``repaired`` and ``audited`` read: by conversation and ``seg``, the letters of a segment and then its rows."""
    rows = stored(marked(rows).withColumn("seg", F.floor(F.col("at") / SEGMENT)), "turns")
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("b", "d"), "x").when(F.col("fault") == "t", F.upper(symbol)).otherwise(symbol)
    letters = F.array_sort(F.collect_list(F.struct("at", symbol.alias("symbol"))))  # SEGMENT at most
    segments = rows.filter("role is not null").groupBy("conv_id", "seg").agg(F.array_join(letters["symbol"], "").alias("sig"))
    segments = stored(segments, "segments")
    answers = stored(solved(segments), "answers")

    kind = rows.schema["conv_id"].dataType
    to_arrow = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    schema = pa.schema([("conv_id", to_arrow), ("seg", pa.int64()), ("sig", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("missing", pa.int32())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, sigs = None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            out = [(now[0], seg, sig, a, b, missing) for (seg, a, b, missing), sig in zip(one.ways(), reversed(sigs), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for conv, seg, sig, table in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if now != (conv,):
                    if one:
                        yield from close()
                    now, one, sigs = (conv,), _Fold(), []
                one.add(seg, [(t["first"], t["last"], t["cost"], t["place"]) for t in table])
                sigs.append(sig)
        if one:
            yield from close()

    tables = answers.groupBy(F.col("sig").alias("of")).agg(F.collect_list(F.struct("first", "last", "cost", "place")).alias("table"))  # 16 at most
    sized = segments.join(tables, F.col("sig") == F.col("of")).select("conv_id", "seg", "sig", "table")
    ways = sized.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(fold, f"conv_id {kind.simpleString()}, seg long, sig string, first int, last int, missing int")
    pieces = ways.join(answers.select("sig", "first", "last", "letters"), ["sig", "first", "last"]).select("conv_id", "seg", "letters", "missing")
    return rows.unionByName(pieces, allowMissingColumns=True)


class _Walk:
    """What the edits make of one conversation, row by row."""

    def __init__(self):
        self.state, self.edits, self.missing, self.letters = 0, iter(()), 0, []
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.low, self.high, self.turn, self.initial = 0, None, None, None, None

    def segment(self, letters: str, missing: int) -> None:
        self.edits, self.missing = iter(re.findall("I*[KRD]", letters)), missing

    def _inserted(self, n: int) -> Iterator[tuple[str, str]]:
        for _ in range(n):
            initial = _wanted(self.state)
            self.state = NEXT[self.state, initial]
            self.cost += INSERT
            yield ("assistant" if initial == "a" else "user"), ""

    def row(self, turn: int | None, role: str, text: str, times: int, fault: str) -> Iterator[tuple[str, str]]:
        """The messages that a row becomes."""
        if turn is not None and turn != self.turn:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.turn = turn
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        pairs = ([] if self.initial is None else [self.initial + initial]) + [initial * 2] * (times > 1)
        self.illegal += sum(p not in ("su", "ua", "au") for p in pairs) + max(0, times - 2)
        self.initial = initial
        if fault == "b":
            self.blank += times
        else:
            self.duplicate += times - (fault != "d")
            self.truncated += fault == "t"
        edit = next(self.edits)
        self.letters.append(edit + "D" * (times - 1))
        self.cost += DELETE * (times - 1)
        yield from self._inserted(len(edit) - 1)
        if edit[-1] == "D":
            self.cost += DELETE
            return
        self.cost += UNFINISHED * (fault == "t")
        if edit[-1] == "R":
            self.cost += REROLE
            initial = _wanted(self.state)
            role = "assistant" if initial == "a" else "user"
        self.state = NEXT[self.state, initial]
        yield role, text

    def close(self) -> Iterator[tuple[str, str]]:
        self.letters.append("I" * self.missing)
        yield from self._inserted(self.missing)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its walk, message), with None for the message when the conversation ends."""
    now, walk = None, None
    for batch in batches:
        for conv, turn, role, text, times, fault, letters, missing in zip(*(batch.column(j).to_pylist() for j in range(len(_ROW))), strict=True):
            if now != (conv,):
                if walk:
                    yield from ((now[0], walk, m) for m in walk.close())
                    yield now[0], walk, None
                now, walk = (conv,), _Walk()
            if letters is not None:
                walk.segment(letters, missing)
            elif role is not None:
                yield from ((conv, walk, m) for m in walk.row(turn, role, text, times, fault))
    if walk:
        yield from ((now[0], walk, m) for m in walk.close())
        yield now[0], walk, None


def _streamed(rows: DataFrame, each, names: str) -> DataFrame:
    """Each conversation's rows in order through ``each``, which gives a row or None for a message or an end."""
    stream = edited(rows).repartition("conv_id").sortWithinPartitions("conv_id", "seg", F.col("letters").isNull(), "at").select(*_ROW)
    kind = rows.schema["conv_id"].dataType.simpleString()
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [("conv_id", kind), *(x.split() for x in names.split(", "))]
    schema = pa.schema([(name, types[t]) for name, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, one = [], each()
        for found in map(one, _conversations(batches)):
            if found is not None:
                out.append(found)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return stream.mapInArrow(run, ", ".join(f"{name} {t}" for name, t in fields))


def repaired(rows: DataFrame) -> DataFrame:
    """The messages of repaired conversations: ``conv_id``, ``place`` (from 0), ``role``, ``text``."""

    def each():
        place = -1

        def one(found: tuple) -> tuple | None:
            nonlocal place
            conv, _, message = found
            place = place + 1 if message else -1
            return (conv, place, *message) if message else None

        return one

    return _streamed(rows, each, "place bigint, role string, text string")


def audited(rows: DataFrame) -> DataFrame:
    """A row for each conversation: its faults, the cheapest edits, their cost, and a digest of what they make.

    The digest and the letters are values over the whole conversation, so its rows pass
    through one task, in order and one at a time.
    """

    def each():
        digest, before = hashlib.sha256(), b""

        def one(found: tuple) -> tuple | None:
            nonlocal digest, before
            conv, w, message = found
            if message:
                digest.update(before + ":".join(message).encode())
                before = b"\n"
                return None
            out = (conv, w.gaps, w.blank, w.duplicate, w.truncated, w.illegal, w.cost, "".join(w.letters), digest.hexdigest())
            digest, before = hashlib.sha256(), b""
            return out

        return one

    counts = ", ".join(f"{n} bigint" for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return _streamed(rows, each, counts + ", audit string, repaired_sha256 string")
