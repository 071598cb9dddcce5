"""Repair of conversation structure: an auction for the cheapest edits over a cost lattice.

The rows of a conversation, in order, are read one after the other. A lattice node is (rows
consumed, state): nothing kept yet, a system row kept, a user row kept, an assistant row kept.
Arcs are edits with integer costs, and the end is reached from the first and the last state, so
the roles kept read `(s?(ua)+)?`. `auction` finds node prices; `marked` and `trace` read from the
arcs that the prices hold tight the edits whose letters are least in ASCII order.

Conversations that lie whole in one sorted task and are short are solved there. All others are cut
into segments of bounded length: tasks find each segment's costs from state to state, a stream
over these few numbers finds the price of every segment's end, and tasks then solve the segments
apart. Only the last step, a hash over the whole repaired conversation, reads its rows in turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import written
from tidelog.llm.streams import map_records, names, runs

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs; keeping is free
SHORT_ROWS = 1000  # distinct rows of a conversation solved at once
SHORT_CHARS = 1 << 22
SEGMENT_ROWS = 512
_POSITION_BITS = 40
_SPACE = " \t\n\x0b\x0c\r"

_GIVEN = (2, 2, 3, 2)  # state after a row that is given a role: user, but assistant after a user
_GIVEN_ROLE = ("user", "user", "assistant", "user")
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # state after a kept row, by its initial
_ENDS = (0, None, None, 0)  # a conversation may end in these states


class Lattice:
    """Nodes 4 * rows consumed + state, and one more for the end.

    `cells` are (must be deleted, initial, truncated, copies): all copies but the first are
    duplicates and must go. `ends` are the prices of the states after the last row, None where
    it can't end; rows may be inserted there only if `inserts_last`.
    """

    def __init__(self, cells, ends, inserts_last: bool) -> None:
        n = len(cells)
        self.rows, self.end = n, 4 * n + 4
        self.arcs: list[list[tuple[str, int, int]]] = []  # of each node: letter, cost, target
        least = []
        for i, (forced, initial, truncated, copies) in enumerate(cells):
            gone, more = DELETE * copies, DELETE * (copies - 1) + TRUNCATED * truncated
            least.append(gone if forced else min(gone, more))
            for state in range(4):
                at, below = 4 * i, 4 * i + 4
                own = [("D", gone, below + state), ("I", INSERT, at + _GIVEN[state])]
                if not forced:
                    if initial in _KEPT[state]:
                        own.append(("K", more, below + _KEPT[state][initial]))
                    own.append(("R", more + REROLE, below + _GIVEN[state]))
                self.arcs.append(own)
        for state in range(4):
            own = [] if ends[state] is None else [("", ends[state], self.end)]
            if inserts_last:
                own.append(("I", INSERT, 4 * n + _GIVEN[state]))
            self.arcs.append(own)
        # Prices to begin with: what the rows still to come cost at least, whatever is done.
        floor = min(e for e in ends if e is not None)
        self.price = [0] * (4 * n + 5)
        for i in range(n, -1, -1):
            floor += least[i] if i < n else 0
            self.price[4 * i : 4 * i + 4] = [floor] * 4

    def auction(self, origin: int) -> int:
        """Raises prices until a path of tight arcs leads from `origin` to the end; its cost.

        The last node of the path is priced at the best of its arcs: where that is more than it
        bids now, its price rises and the path contracts by it, else the path extends along the
        best arc. No price ever exceeds the true distance, and all arcs of every shortest path
        are tight at the end, so prices serve the next origin too.
        """
        price, arcs, end = self.price, self.arcs, self.end
        path = [origin]
        while True:
            node = path[-1]
            if node == end:
                return price[origin]
            best, target = min((cost + price[to], to) for _, cost, to in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(target)

    def marked(self) -> list[bool]:
        """Nodes with a path of tight arcs to the end."""
        price, arcs = self.price, self.arcs
        mark = [False] * self.end + [True]
        for i in range(self.rows, -1, -1):
            for _ in range(3):  # inserted rows lead from state to state, two at most
                for node in range(4 * i, 4 * i + 4):
                    mark[node] = mark[node] or any(
                        mark[to] and price[node] == cost + price[to] for _, cost, to in arcs[node]
                    )
        return mark

    def trace(self, origin: int, mark: list[bool]) -> list[str]:
        """Letters of the ASCII-least path of tight arcs, by the row that they come before or end
        with; rows inserted after the last one are with it."""
        price, node, out, pending = self.price, origin, [], ""
        while True:
            letter, target = min(
                (letter, to) for letter, cost, to in self.arcs[node] if mark[to] and price[node] == cost + price[to]
            )
            if target == self.end:
                if pending and out:
                    out[-1] += pending
                return out
            pending += letter
            if target // 4 > node // 4:
                out.append(pending)
                pending = ""
            node = target


@lru_cache(maxsize=4096)
def cheapest_edits(cells: tuple) -> tuple[str, ...]:
    """Letters of the cheapest edits of a whole conversation, for each of its cells."""
    lattice = Lattice(cells, _ENDS, True)
    lattice.auction(0)
    return tuple(lattice.trace(0, lattice.marked()))


def segment_costs(cells: list[tuple]) -> list[list[int | None]]:
    """Cost of a segment from each state before it to each state after it, None: impossible."""
    gone = sum(DELETE * copies for *_, copies in cells)
    kept = [TRUNCATED * t - DELETE for forced, initial, t, _ in cells if not forced and initial == "s"]
    out: list[list[int | None]] = [[None] * 4 for _ in range(4)]
    out[0][0] = out[1][1] = gone
    if kept:
        out[0][1] = gone + min(kept)
    for after in (2, 3):
        lattice = Lattice(cells, [0 if s == after else None for s in range(4)], True)
        for before in range(4):
            out[before][after] = lattice.auction(before)
    return out


def segment_edits(cells: list[tuple], ends, is_last: bool) -> list[list[str]]:
    """For each cell its letters by the state in which the segment is entered."""
    lattice = Lattice(cells, _ENDS if is_last else ends, is_last)
    for before in range(4):
        lattice.auction(before)
    mark = lattice.marked()
    return [list(own) for own in zip(*(lattice.trace(before, mark) for before in range(4)))]


class Walk:
    """One conversation, cell by cell: its counts, and what the edits leave of it."""

    def __init__(self) -> None:
        self.state = self.entered = 0
        self.segment = self.last = self.turn = self.first_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.kept = 0
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def see(self, turn, role: str, copies: int, blank: bool, truncated: bool, again: bool) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += copies - 1  # copies follow each other
        self.last = initial
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (not again)
            self.truncated += truncated and not again
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn = turn
            self.turns += 1

    def apply(self, letters: str, role: str, text: str, copies: int, truncated: bool) -> list[tuple[str, str]]:
        """The rows that are left where `letters` edit this cell."""
        out = []
        for letter in letters:
            if letter == "D":
                self.cost += DELETE * copies
            elif letter == "I":
                self.cost += INSERT
                out.append((_GIVEN_ROLE[self.state], ""))
                self.state = _GIVEN[self.state]
            else:
                self.cost += DELETE * (copies - 1) + (TRUNCATED if truncated else 0)
                if letter == "K":
                    out.append((role, text))
                    self.state = _KEPT[self.state][role[:1]]
                else:
                    self.cost += REROLE
                    out.append((_GIVEN_ROLE[self.state], text))
                    self.state = _GIVEN[self.state]
            self.audit.append(letter if letter == "I" else "D" * copies if letter == "D" else letter + "D" * (copies - 1))
        for own_role, own_text in out:
            self.digest.update(f"{'' if self.kept == 0 else chr(10)}{own_role}:{own_text}".encode("utf-8", "surrogatepass"))
            self.kept += 1
        return out

    def report(self) -> dict:
        gaps = 0 if self.turn is None else self.turn - self.first_turn + 1 - self.turns
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit),
            "repaired_sha256": self.digest.hexdigest(),
        }


_REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_MESSAGE = "position long, role string, text string"
_CELL = "turn long, role string, text string, copies long, is_blank boolean, is_truncated boolean"


def _lattice_cell(row: dict) -> tuple:
    return (row["is_blank"] or row["again"], row["role"][:1], row["is_truncated"], row["copies"])


def _finished(walk: Walk, conv_id, messages: bool) -> Iterator[dict]:
    if not messages:
        yield {"conv_id": conv_id, **walk.report()}


def _message_rows(walk: Walk, conv_id, left: list[tuple[str, str]]) -> Iterator[dict]:
    first = walk.kept - len(left)
    for n, (role, text) in enumerate(left):
        yield {"conv_id": conv_id, "position": first + n, "role": role, "text": text}


def _solve_short(messages: bool, short_rows: int, segment_rows: int):
    """Solves conversations that are short and surely whole; the rows of the others come out with
    their position and segment."""

    def whole(conv_id, run: list[dict]) -> Iterator[dict]:
        seen: set[tuple[str, str]] = set()
        walk = Walk()
        for row in run:
            row["again"] = (row["role"], row["text"]) in seen
            seen.add((row["role"], row["text"]))
        for row, letters in zip(run, cheapest_edits(tuple(map(_lattice_cell, run)))):
            copies, truncated = row["copies"], row["is_truncated"]
            walk.see(row["turn"], row["role"], copies, row["is_blank"], truncated, row["again"])
            left = walk.apply(letters, row["role"], row["text"], copies, truncated)
            if messages:
                yield from _message_rows(walk, conv_id, left)
        yield from _finished(walk, conv_id, messages)

    def solve(records: Iterator[dict]) -> Iterator[dict]:
        number = TaskContext.get().partitionId() << _POSITION_BITS
        pending: tuple | None = None  # the last run read, which may be the task's last
        is_edge = True  # nor is the first one surely whole

        def opened(run: list[dict]) -> Iterator[dict]:
            nonlocal number
            for n, row in enumerate(run):
                segment = number if n % segment_rows == 0 else segment
                yield {**row, "pos": number, "segment": segment}
                number += 1

        for conv_id, run in runs(records, "conv_id"):
            if pending is not None:
                yield from opened(pending[1]) if is_edge else whole(*pending)
                is_edge = False
            held, chars, is_long = [], 0, False
            for row in run:
                held.append(row)
                chars += len(row["text"])
                if len(held) >= short_rows or chars > SHORT_CHARS:
                    if pending is not None:
                        pending = None
                    is_long = True
                    yield from opened(held)
                    held, chars = [], 0
            if is_long:
                yield from opened(held)
                pending, is_edge = None, False
            else:
                pending = (conv_id, held)
        if pending is not None:
            yield from opened(pending[1])

    return solve


def _costs(records: Iterator[dict]) -> Iterator[dict]:
    for segment, run in runs(records, "segment"):
        rows = list(run)
        costs = segment_costs(list(map(_lattice_cell, rows)))
        yield {"conv_id": rows[0]["conv_id"], "segment": segment, "costs": [c for own in costs for c in own]}


def _fold(records: Iterator[dict]) -> Iterator[dict]:
    """Prices of the states after each segment, from the last segment of a conversation on."""
    for _, run in runs(records, "conv_id"):
        ends: list[int | None] = [0, 2 * INSERT, INSERT, 0]
        is_last = True
        for row in run:
            yield {"segment": row["segment"], "ends": ends, "is_last": is_last}
            costs, is_last = row["costs"], False
            ends = [
                min(c + e for c, e in zip(costs[4 * s : 4 * s + 4], ends) if c is not None) for s in range(4)
            ]


def _edits(records: Iterator[dict]) -> Iterator[dict]:
    for _, run in runs(records, "segment"):
        rows = list(run)
        edits = segment_edits(list(map(_lattice_cell, rows)), rows[0]["ends"], rows[0]["is_last"])
        for row, own in zip(rows, edits):
            yield {"conv_id": row["conv_id"], "pos": row["pos"], "again": row["again"], "edits": own}


def _join_up(messages: bool):
    """Walks long conversations: before each row comes what its segment decided for it."""

    def walk_all(records: Iterator[dict]) -> Iterator[dict]:
        for conv_id, run in runs(records, "conv_id"):
            walk, edits, again = Walk(), None, False
            for row in run:
                if row["edits"] is not None:
                    edits, again = row["edits"], row["again"]
                    continue
                if row["segment"] != walk.segment:
                    walk.segment, walk.entered = row["segment"], walk.state
                copies, truncated = row["copies"], row["is_truncated"]
                walk.see(row["turn"], row["role"], copies, row["is_blank"], truncated, again)
                left = walk.apply(edits[walk.entered], row["role"], row["text"], copies, truncated)
                if messages:
                    yield from _message_rows(walk, conv_id, left)
            yield from _finished(walk, conv_id, messages)

    return walk_all


def _repair(rows: DataFrame, messages: bool, short_rows: int, segment_rows: int) -> DataFrame:
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    key = f"conv_id {conv_type}"
    result = f"{key}, {_MESSAGE if messages else _REPORT}"
    given = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    cells = given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    cells = cells.withColumn("is_blank", bare == "")
    cells = cells.withColumn("is_truncated", ~F.col("is_blank") & ~F.right(bare, F.lit(1)).isin(".", "!", "?"))
    order = ["conv_id", "turn", "role", "text"]
    cells = cells.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions(*order)
    found_ddl = f"{key}, pos long, segment long, {_CELL}"
    found_ddl += ", position long" if messages else f", {_REPORT}"
    found = written(map_records(cells, _solve_short(messages, short_rows, segment_rows), found_ddl), "conversations")
    short = found.where(F.col("pos").isNull()).select(*names(result))

    opened = found.where(F.col("pos").isNotNull())
    first = opened.groupBy("conv_id", "role", F.sha2("text", 256), F.length("text")).agg(F.min("pos").alias("pos"))
    small = opened.select("conv_id", "segment", "pos", F.left("role", F.lit(1)).alias("role"), "copies", "is_blank", "is_truncated")
    first = first.select("pos", F.lit(False).alias("again"))
    small = small.join(first, "pos", "left").withColumn("again", F.coalesce("again", F.lit(True)))
    small = written(small, "conversation-cells")
    costs = map_records(
        small.repartition("segment").sortWithinPartitions("segment", "pos"), _costs, f"{key}, segment long, costs array<long>"
    )
    costs = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment"))
    ends = map_records(costs, _fold, "segment long, ends array<long>, is_last boolean")
    placed = small.join(ends, "segment").repartition("segment").sortWithinPartitions("segment", "pos")
    edits = map_records(placed, _edits, f"{key}, pos long, again boolean, edits array<string>")
    both = opened.select("conv_id", "pos", "segment", *names(_CELL)).unionByName(edits, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "pos", F.col("edits").isNull())
    return short.unionByName(map_records(both, _join_up(messages), result))


def repair_conversations(
    rows: DataFrame, short_rows: int = SHORT_ROWS, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Faults and cheapest repair of every conversation in `rows` (conv_id, turn, role, text).

    Rows are taken by turn, nulls first, then by role and text. Returns per conv_id: gaps in the
    turns, rows that are blank, duplicate or truncated (the first fault of each counts), illegal
    neighbours, cost and letters of the edits (Delete, Insert, Keep, Rerole), and the SHA-256 of
    the repaired `role:text` lines. A null role or text is one space; a null conv_id is a
    conversation too; a row with an empty role can't be kept as it is. Other columns are not
    read. An empty table gives no rows. Conversations of fewer than `short_rows` different rows
    are solved at once, longer ones in segments of `segment_rows`; the result is the same.
    """
    return _repair(rows, False, short_rows, segment_rows)


def repaired_messages(rows: DataFrame, short_rows: int = SHORT_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position from 0, role, text."""
    return _repair(rows, True, short_rows, segment_rows)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of `conv_id:turn`, remainder by 20: 0 drops, 1
    empties the text, 2 takes its `.!?` away, 3 repeats the row, 4 makes it the user's. Nulls in
    the key, role or text are one space."""

    def known(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    role = F.when(kind == 4, "user").otherwise(known("role"))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"), times.alias("_times"))
    return kept.where(F.col("_kind") != 0).select("conv_id", "turn", "role", "text", F.explode("_times").alias("_time")).drop("_time")
