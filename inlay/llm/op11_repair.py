"""Repair of conversation structure by a generalised LR parser with weighted edits (op11).

A conversation is legal if the initials of its roles match ``(s?(ua)+)?``.  The parser reads
the initials in order.  Before a row it may insert an empty ``user`` or ``assistant`` message,
then it keeps the row, gives it another role, or deletes it.  All choices run side by side on a
graph-structured stack over the LR automaton of the grammar: a vertex is an LR state on top of
another vertex, equal stacks are one vertex, and a vertex that is reached in several ways keeps
the least ``(cost, audit)`` only.  ``audit`` is the string of edits, ``D I K R``.

Inserted messages belong to the row behind them.  Audits that end at the same row therefore
never are prefixes of each other, so their order is settled once and for all when they part: a
*front* (the tops after a row, in the order of their audits, with costs above the least) says
all that later rows need, and no audit is carried along.  A top whose cost is more than
``SLACK`` above the least can't win any more; with it the fronts are a small finite set, and
steps between them are computed once and looked up afterwards.

Rows are range-partitioned by conversation and place, so a conversation with most of the rows
is cut over many parts.  A part is summarised as a table from stack tops at its begin to fronts
at its end; one pass over these tables (two rows a part at most) settles with which top every
part begins and ends, after which all parts are repaired on their own.

Results that are defined here: nulls in ``turn`` sort first, null roles and texts are one
space, a null ``conv_id`` is a conversation.  Rows of one turn are ordered by role, then by the
SHA-256 of the text.  Rows that agree in all of it are told apart by nothing and need not be.
Texts of any length stay whole; an empty table gives an empty result.  Columns other than the
four named ones are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inlay.llm import queries
from inlay.llm.common import materialize, table
from inlay.llm.op3_sharding import crc
from inlay.llm.words import SPACES
from inlay.operators.scan import PART, POS, range_stage

RULES = (("S", ""), ("S", "sT"), ("S", "T"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
# Two inserts lead from any top to a finished turn; one more delete makes up for a system message.
SLACK = 2 * INSERT + DELETE
LEGAL = ("su", "ua", "au")
BATCH_ROWS = 1000
CHUNK_CHARS = 1 << 22  # repaired text of a cut conversation is handed on in rows of about this size


# -- LR automaton ------------------------------------------------------------------------


def _closure(items: set[tuple[int, int]]) -> frozenset:
    todo, found = list(items), set(items)
    while todo:
        rule, dot = todo.pop()
        rest = RULES[rule][1][dot:]
        for i, (left, _) in enumerate(RULES):
            if rest and rest[0] == left and (i, 0) not in found:
                found.add((i, 0))
                todo.append((i, 0))
    return frozenset(found)


def _follow() -> dict[str, set[str]]:
    """Symbols that may stand behind each nonterminal; no rule but that of the start is empty."""
    lefts = {left for left, _ in RULES}
    first = {x: {x} for x in "sua"} | {x: set() for x in lefts}
    follow = {x: set() for x in lefts} | {"S": {"$"}}
    for _ in range(2 * len(RULES)):
        for left, right in RULES:
            if right:
                first[left] |= first[right[0]]
            for at, symbol in enumerate(right):
                if symbol in lefts:
                    follow[symbol] |= first[right[at + 1]] if at + 1 < len(right) else follow[left]
    return follow


class Stacks:
    """The graph-structured stack: vertices ``(LR state, vertex beneath)``, each kept once."""

    def __init__(self):
        start = _closure({(i, 0) for i, (left, _) in enumerate(RULES) if left == "S"})
        self.states, self.goto, todo = {start: 0}, {}, [start]
        while todo:
            items = todo.pop()
            for symbol in {RULES[r][1][d] for r, d in items if d < len(RULES[r][1])}:
                there = _closure({(r, d + 1) for r, d in items if RULES[r][1][d : d + 1] == symbol})
                if there not in self.states:
                    self.states[there] = len(self.states)
                    todo.append(there)
                self.goto[self.states[items], symbol] = self.states[there]
        follow = _follow()
        self.reduce: dict[tuple[int, str], list[int]] = {}
        self.always: dict[int, int] = {}  # states that can do nothing but one reduction
        for items, state in self.states.items():
            done = [r for r, d in items if d == len(RULES[r][1])]
            for rule in done:
                for symbol in follow[RULES[rule][0]]:
                    self.reduce.setdefault((state, symbol), []).append(rule)
            if len(items) == 1 and done:
                self.always[state] = done[0]
        self.vertices: list[tuple[int, int]] = [(0, -1)]
        self.known = {(0, -1): 0}
        self.tops = self._reachable()

    def push(self, below: int, state: int) -> int:
        vertex = (state, below)
        if vertex not in self.known:
            self.known[vertex] = len(self.vertices)
            self.vertices.append(vertex)
        return self.known[vertex]

    def reduced(self, top: int, rule: int) -> int | None:
        """The stack with a right side replaced by its left; None once the start symbol is complete."""
        left, right = RULES[rule]
        for _ in right:
            top = self.vertices[top][1]
        if left == "S":
            return None
        return self.settled(self.push(top, self.goto[self.vertices[top][0], left]))

    def settled(self, top: int) -> int:
        rule = self.always.get(self.vertices[top][0])
        return top if rule is None or RULES[rule][0] == "S" else self.reduced(top, rule)

    def read(self, top: int, symbol: str) -> Iterator[int]:
        """Tops after ``symbol``, by every reduction that may come before its shift."""
        todo = [top]
        while todo:
            top = todo.pop()
            state = self.vertices[top][0]
            todo += [t for r in self.reduce.get((state, symbol), []) if (t := self.reduced(top, r)) is not None]
            if (state, symbol) in self.goto:
                yield self.settled(self.push(top, self.goto[state, symbol]))

    def accepts(self, top: int) -> bool:
        state = self.vertices[top][0]
        return any(RULES[r][0] == "S" for r in self.reduce.get((state, "$"), []))

    def _reachable(self) -> list[int]:
        found, todo = {0}, [0]
        while todo:
            top = todo.pop()
            for symbol in "sua":
                fresh = set(self.read(top, symbol)) - found
                found |= fresh
                todo += fresh
        return sorted(found)


STACKS = Stacks()
ROOT = ((0, 0),)  # the front before the first row
Front = tuple[tuple[int, int], ...]  # (top, cost above the least), in the order of the audits


# -- fronts ------------------------------------------------------------------------------


def with_inserts(front: Front) -> dict[int, tuple[int, int, str]]:
    """Tops within reach of inserts: ``top -> (cost, place in the front, inserts)``."""
    best = {top: (cost, at, "") for at, (top, cost) in enumerate(front)}
    todo = list(best)
    while todo:
        top = todo.pop()
        cost, at, edits = best[top]
        if cost + INSERT > SLACK + INSERT:
            continue
        for role in ROLES:
            for there in STACKS.read(top, role):
                new = (cost + INSERT, at, edits + "I")
                if there not in best or new < best[there]:
                    best[there] = new
                    todo.append(there)
    return best


def step(front: Front, initial: str, fault: str) -> tuple[Front, int, list[tuple[int, str]]]:
    """Front behind a row, the cost taken out of it, and for each top the place it came from and the edits."""
    extra = TRUNCATED if fault == "t" else 0
    best: dict[int, tuple[int, int, str]] = {}

    def offer(top: int, cost: int, at: int, edits: str) -> None:
        if top not in best or (cost, at, edits) < best[top]:
            best[top] = (cost, at, edits)

    for top, (cost, at, edits) in with_inserts(front).items():
        offer(top, cost + DELETE, at, edits + "D")
        if fault in ("", "t"):
            for there in STACKS.read(top, initial):
                offer(there, cost + extra, at, edits + "K")
            for role in ROLES:
                for there in STACKS.read(top, role):
                    offer(there, cost + extra + REROLE, at, edits + "R")
    least = min(cost for cost, _, _ in best.values())
    left = sorted((at, edits, top, cost - least) for top, (cost, at, edits) in best.items() if cost - least <= SLACK)
    return tuple((top, cost) for _, _, top, cost in left), least, [(at, edits) for at, edits, _, _ in left]


def finish(front: Front) -> tuple[int, str]:
    """Place in the front of the best way to the end, and the inserts behind the last row."""
    ends = [(cost, at, edits) for top, (cost, at, edits) in with_inserts(front).items() if STACKS.accepts(top)]
    return min(ends)[1:]


class Steps:
    """Steps between fronts, computed once each."""

    def __init__(self):
        self.fronts: list[Front] = []
        self.ids: dict[Front, int] = {}
        self.moves: dict[tuple[int, str, str], tuple[int, int, list[tuple[int, str]]]] = {}

    def id_of(self, front: Front) -> int:
        if front not in self.ids:
            self.ids[front] = len(self.fronts)
            self.fronts.append(front)
        return self.ids[front]

    def walk(self, front: Front, rows: list[tuple[str, str]]) -> tuple[list, Front, int]:
        """Ways back for every row, the last front, and the cost taken out of it."""
        at, total, back = self.id_of(front), 0, []
        for initial, fault in rows:
            move = self.moves.get((at, initial, fault))
            if move is None:
                there, cost, ways = step(self.fronts[at], initial, fault)
                move = self.moves[at, initial, fault] = (self.id_of(there), cost, ways)
            at, cost, ways = move
            total += cost
            back.append(ways)
        return back, self.fronts[at], total

    def table(self, rows: list[tuple[str, str]]) -> list[list[tuple[int, int]]]:
        """For every top at the begin: tops at the end with their costs, in the order of the audits."""
        out = []
        for top in STACKS.tops:
            _, front, total = self.walk(((top, 0),), rows)
            out.append([(there, cost + total) for there, cost in front])
        return out


def edits_of(steps: Steps, rows: list[tuple[str, str]], begin: int, end: int | None) -> tuple[list[str], str]:
    """Edits for every row (inserts before it and its own), and the inserts behind the last one.

    ``begin`` and ``end`` are stack tops; without ``end`` the conversation ends here.
    """
    back, front, _ = steps.walk(((begin, 0),), rows)
    at, tail = finish(front) if end is None else ([top for top, _ in front].index(end), "")
    out = []
    for ways in reversed(back):
        at, edits = ways[at]
        out.append(edits)
    return out[::-1], tail


def chain(tables: list[list[list[tuple[int, int]]]]) -> list[tuple[int, int | None]]:
    """Tops with which the best repair enters and leaves each piece of a cut conversation."""
    front, back = ROOT, []
    for piece in tables:
        rows = dict(zip(STACKS.tops, piece))
        best: dict[int, tuple[int, int, int]] = {}
        for at, (top, cost) in enumerate(front):
            for rank, (there, more) in enumerate(rows[top]):
                best[there] = min(best.get(there, (cost + more, at, rank)), (cost + more, at, rank))
        least = min(cost for cost, _, _ in best.values())
        order = sorted((at, rank, top, cost - least) for top, (cost, at, rank) in best.items() if cost - least <= SLACK)
        back.append((front, [at for at, _, _, _ in order]))
        front = tuple((top, cost) for _, _, top, cost in order)
    at, out, leaves = finish(front)[0], [], None
    for before, ways in reversed(back):
        at = ways[at]
        out.append((before[at][0], leaves))
        leaves = before[at][0]
    return out[::-1]


# -- rows --------------------------------------------------------------------------------

ROW_COLUMNS = ["conv_id", PART, POS, "_row", "turn", "role", "initial", "fault", "text"]


@dataclass
class Run:
    """Rows of one conversation inside one part."""

    conv_id: int | None
    part: int
    turns: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    symbols: list = field(default_factory=list)  # (initial, fault)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Runs of sorted rows; a row with ``_row = 0`` before a row marks it as the first with its role and text."""
    run, first = None, False
    for batch in batches:
        for conv_id, part, _, row, turn, role, initial, fault, text in zip(*[c.to_pylist() for c in batch.columns]):
            if not row:
                first = True
                continue
            if run is None or run.conv_id != conv_id or run.part != part:
                if run:
                    yield run
                run = Run(conv_id, part)
            run.turns.append(turn)
            run.roles.append(role)
            run.texts.append(text)
            run.symbols.append((initial if initial in ("s", "u", "a") else "?", fault or ("" if first else "d")))
            if run.symbols[-1][1] == "t" and not first:
                run.symbols[-1] = (run.symbols[-1][0], "d")
            first = False
    if run:
        yield run


def ordered(staged: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows and first marks together, in order inside the tasks."""
    marks = firsts.select(PART, POS, F.lit(0).alias("_row"))
    both = staged.unionByName(marks, allowMissingColumns=True).select(*ROW_COLUMNS)
    return both.repartition(PART).sortWithinPartitions(PART, POS, "_row")


def staged_rows(rows: DataFrame) -> DataFrame:
    """Rows in global order with initial and the fault that shows in the row alone (``b``, ``t`` or none)."""
    spaces = F.lit(SPACES)
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    named = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    body = F.rtrim(F.col("text"), spaces)
    fault = F.when(body == "", "b").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    ready = named.withColumns(
        {
            "initial": F.substring("role", 1, 1),
            "fault": fault,
            "digest": F.sha2("text", 256),
            "_deal": F.rand(11),  # rows that agree in everything can be dealt to several parts
        }
    )
    out = range_stage(ready, ["conv_id", "turn", "role", "digest", "_deal"], "turns").drop("_deal")
    return out.withColumn("_row", F.lit(1))


def first_places(staged: DataFrame) -> DataFrame:
    """Places of rows whose role and text did not come earlier in their conversation."""
    place = F.min(F.struct(PART, POS)).alias("_at")
    return materialize(staged.groupBy("conv_id", "role", "digest").agg(place).select("_at.*"), "firsts")


def cut_conversations(staged: DataFrame) -> list[list[tuple[int, int | None]]]:
    """``(part, conv_id)`` of conversations that lie in several parts; one row a part comes to the driver."""
    ends = staged.groupBy(PART).agg(
        F.min_by("conv_id", POS).alias("first"), F.max_by("conv_id", POS).alias("last")
    )
    out: list[list[tuple[int, int | None]]] = []
    before = None
    for part, first, last in sorted(tuple(r) for r in ends.collect()):
        if before is not None and before[1] == first:
            if out and out[-1][-1] == before:
                out[-1].append((part, first))
            else:
                out.append([before, (part, first)])
        before = (part, last)
    return out


def entries(staged: DataFrame, firsts: DataFrame) -> dict[tuple[int, int | None], tuple[int, int | None]]:
    """Tops at begin and end of every piece of a cut conversation."""
    chains = cut_conversations(staged)
    wanted = {piece for pieces in chains for piece in pieces}
    if not wanted:
        return {}
    parts = staged.sparkSession.createDataFrame(list(wanted), f"{PART} int, conv_id bigint")
    near = staged.withColumn("text", F.lit(None).cast("string")).alias("r").join(
        F.broadcast(parts.withColumnsRenamed({PART: "_p", "conv_id": "_c"})),  # two rows a part at most
        (F.col(PART) == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_c")),
    ).drop("_p", "_c")
    places = firsts.join(F.broadcast(parts.select(PART).distinct()), PART)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for run in runs(batches):
            yield pa.RecordBatch.from_pydict(
                {"part": [run.part], "conv_id": [run.conv_id], "fronts": [[[list(x) for x in f] for f in steps.table(run.symbols)]]},
                schema=pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("fronts", pa.list_(pa.list_(pa.list_(pa.int64()))))]),
            )

    tables = ordered(near, places).mapInArrow(summarise, "part int, conv_id bigint, fronts array<array<array<bigint>>>")
    found = {(r.part, r.conv_id): [[tuple(x) for x in front] for front in r.fronts] for r in tables.collect()}
    out = {}
    for pieces in chains:
        out |= dict(zip(pieces, chain([found[p] for p in pieces])))
    return out


def lines_of(run: Run, edits: list[str], tail: str, begin: int) -> Iterator[tuple[str, int | None, str | None, str]]:
    """``(edit, row, role, text)`` in order; deleted rows have no role and keep their text."""
    top = begin

    def next_role(symbol: str) -> None:
        nonlocal top
        top = next(STACKS.read(top, symbol))

    def expected() -> str:
        return next(x for x in ROLES if next(STACKS.read(top, x), None) is not None)

    for at, text in enumerate([*edits, tail]):
        for edit in text:
            if edit == "D":
                yield edit, at, None, run.texts[at]
            elif edit == "K":
                next_role(run.symbols[at][0])
                yield edit, at, run.roles[at], run.texts[at]
            else:
                symbol = expected()
                next_role(symbol)
                yield edit, (at if edit == "R" else None), ROLES[symbol], run.texts[at] if edit == "R" else ""


@dataclass
class Prepared:
    """Ordered rows of all conversations and where cut ones begin and end."""

    rows: DataFrame
    cuts: dict

    @classmethod
    def of(cls, rows: DataFrame) -> Prepared:
        staged = staged_rows(rows)
        firsts = first_places(staged)
        return cls(ordered(staged, firsts), entries(staged, firsts))


def repaired(rows: DataFrame) -> DataFrame:
    """All messages of ``rows(conv_id, turn, role, text)`` with their edit, deleted ones included.

    Rows ``(conv_id, part, at, edit, turn, role, text)``: ``(part, at)`` orders the messages of a
    conversation, ``turn`` is null for inserted ones, ``role`` for deleted ones.
    """
    ready = Prepared.of(rows)
    cuts = ready.cuts
    names = ["conv_id", "part", "at", "edit", "turn", "role", "text"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for run in runs(batches):
            begin, end = cuts.get((run.part, run.conv_id), (0, None))
            edits, tail = edits_of(steps, run.symbols, begin, end)
            out = [
                (run.conv_id, run.part, n, edit, None if at is None else run.turns[at], role, text)
                for n, (edit, at, role, text) in enumerate(lines_of(run, edits, tail, begin))
            ]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ready.rows.mapInArrow(apply, "conv_id bigint, part int, at bigint, edit string, turn bigint, role string, text string")


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost", "turns"]
PIECE = (
    "conv_id bigint, part int, chunk int, low bigint, high bigint, first_initial string, last_initial string, "
    + ", ".join(f"{c} bigint" for c in COUNTS)
    + ", audit string, body string, sha string"
)
PIECE_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
     ("first_initial", pa.string()), ("last_initial", pa.string())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("audit", pa.string()), ("body", pa.string()), ("sha", pa.string())]
)


def piece_rows(run: Run, initials: list[str], steps: Steps, cuts: dict) -> Iterator[dict]:
    """A run as one row with its digest, or as several with repaired text if the conversation is cut."""
    cut = cuts.get((run.part, run.conv_id))
    begin, end = cut or (0, None)
    edits, tail = edits_of(steps, run.symbols, begin, end)
    faults = [f for _, f in run.symbols]
    audit = "".join(edits) + tail
    costs = {"I": INSERT, "R": REROLE, "D": DELETE, "K": 0}
    kept = sum(f == "t" and e[-1] != "D" for f, e in zip(faults, edits))
    present = [t for t in run.turns if t is not None]
    row = {
        "conv_id": run.conv_id, "part": run.part, "chunk": 0,
        "low": min(present, default=None), "high": max(present, default=None),
        "first_initial": initials[0], "last_initial": initials[-1],
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "cost": sum(costs[e] for e in audit) + TRUNCATED * kept, "turns": len(set(present)),
        "audit": audit, "body": None, "sha": None,
    }
    lines = (f"{role}:{text}" for edit, _, role, text in lines_of(run, edits, tail, begin) if edit != "D")
    if cut is None:
        yield row | {"sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
        return
    body: list[str] = []
    size = 0
    for line in lines:
        body.append(line)
        size += len(line)
        if size >= CHUNK_CHARS:
            yield row | {"body": "\n".join(body)}
            row = {k: v if k in ("conv_id", "part") else None for k, v in row.items()} | {"chunk": row["chunk"] + 1}
            body, size = [], 0
    yield row | {"body": "\n".join(body) if body else None}


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, of bounded text."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row.get("body") or "")
        if len(held) == BATCH_ROWS or size > CHUNK_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Pieces in order to one row a conversation; texts only pass through the hash."""
    whole, last_turn, hasher, some = None, None, None, False

    def close() -> dict:
        out = dict(whole)
        span = 0 if out["low"] is None else out["high"] - out["low"] + 1 - out["turns"]
        out |= {"gaps": span, "sha": out["sha"] or hasher.hexdigest(), "audit": "".join(out["audit"])}
        return {n: out[n] for n in REPORT_NAMES}

    for batch in batches:
        for row in batch.to_pylist():
            if whole is None or row["conv_id"] != whole["conv_id"]:
                if whole is not None:
                    yield close()
                whole, hasher, some, last_turn = row | {"audit": [row["audit"]]}, hashlib.sha256(), False, row["high"]
            elif row["chunk"] == 0:
                for name in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    whole[name] += row[name]
                whole["illegal"] += whole["last_initial"] + row["first_initial"] not in LEGAL
                whole["last_initial"] = row["last_initial"]
                whole["audit"].append(row["audit"])
                if row["low"] is not None:
                    whole["turns"] -= row["low"] == last_turn  # one turn on both sides of a border
                    whole["low"] = row["low"] if whole["low"] is None else whole["low"]
                    whole["high"] = last_turn = row["high"]
            if row["body"] is not None:
                hasher.update((b"\n" if some else b"") + row["body"].encode())
                some = True
    if whole is not None:
        yield close()


REPORT_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]
REPORT = ", ".join(f"{n} {'string' if n in ('audit', 'sha') else 'bigint'}" for n in REPORT_NAMES)
REPORT_ARROW = pa.schema([(n, pa.string() if n in ("audit", "sha") else pa.int64()) for n in REPORT_NAMES])


def report(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows(conv_id, turn, role, text)``: faults, cost, edits, digest of the repaired text."""
    ready = Prepared.of(rows)
    cuts = ready.cuts

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        found = (row for run in runs(batches) for row in piece_rows(run, [r[:1] for r in run.roles], steps, cuts))
        yield from batched(found, PIECE_ARROW)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(merged(batches), REPORT_ARROW)

    cut = ready.rows.mapInArrow(pieces, PIECE)
    return cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(merge, REPORT)


# -- query -------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of their place; about a quarter of them."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    dealt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return dealt.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        copies,
    ).drop("copy")


_STRIPPED = "rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
# Minimal automaton of the grammar: 0 begin, 1 after the system message, 2 after a user message, 3 after an assistant's.
SQL = rf"""
with recursive crc_table as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce("text", ' ') as body,
  encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')) as place from conversations),
dealt as (select conv_id, turn, role, body, {crc("place")} % 20 as kind from keyed, crc_table),
hurt as (select conv_id, turn, if(kind = 4, 'user', role) as role, case kind when 1 then '' when 2 then translate(body, '.!?', '')
  else body end as body, unnest(range(if(kind = 3, 2, 1))) as copy from dealt where kind <> 0),
turns as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(body), copy) as at_row,
  row_number() over (partition by conv_id, role, body order by turn nulls first, copy) as seen, role[1] as initial,
  case when {_STRIPPED} = '' then 'b' when right({_STRIPPED}, 1) not in ('.', '!', '?') then 't' else '' end as alone from hurt),
faulty as (select *, case when alone = 'b' then 'b' when seen > 1 then 'd' else alone end as fault,
  lag(initial) over (partition by conv_id order by at_row) as before from turns),
ins(q, q1, n, added) as (values (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']),
  (0, 3, 2, ['user:', 'assistant:']), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:'])),
moves(q1, symbol, q2, name) as (values (0, 's', 1, 'system'), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
dp(conv_id, at_row, q, cost, audit, lines) as (
  select conv_id, 0::bigint, 0, 0::bigint, '', []::varchar[] from (select distinct conv_id from faulty)
  union all (
  with here as (select d.conv_id, f.at_row, i.q1, d.cost + 3 * i.n as cost, d.audit || repeat('I', i.n) as audit, d.lines || i.added as lines,
    f.fault, f.initial, f.role, f.body from dp d join faulty f on f.conv_id is not distinct from d.conv_id and f.at_row = d.at_row + 1
    join ins i on i.q = d.q),
  offers as (select conv_id, at_row, q1 as q, cost + 4 as cost, audit || 'D' as audit, lines from here
    union all select h.conv_id, at_row, m.q2, cost + if(fault = 't', 3, 0), audit || 'K', list_append(lines, role || ':' || body)
    from here h join moves m on m.q1 = h.q1 and m.symbol = h.initial where fault in ('', 't')
    union all select h.conv_id, at_row, m.q2, cost + 3 + if(fault = 't', 3, 0), audit || 'R', list_append(lines, m.name || ':' || body)
    from here h join moves m on m.q1 = h.q1 and m.symbol in ('u', 'a') where fault in ('', 't'))
  select conv_id, at_row, q, best.cost, best.audit, best.lines from (select conv_id, at_row, q,
    min(struct_pack(cost := cost, audit := audit, lines := lines)) as best from offers group by conv_id, at_row, q))),
ends as (select d.conv_id, min(struct_pack(cost := d.cost + 3 * i.n, audit := d.audit || repeat('I', i.n), lines := d.lines || i.added)) as best
  from dp d join (select conv_id, max(at_row) as n from faulty group by conv_id) s on s.conv_id is not distinct from d.conv_id and s.n = d.at_row
  join ins i on i.q = d.q where i.q1 in (0, 3) group by d.conv_id),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
  count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
  count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.cost, 0)::bigint as cost,
  coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id
left join ends e on e.conv_id is not distinct from c.conv_id"""


@queries.query("op11_conversation_repair", SQL)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    found = report(damaged(rows)).withColumnRenamed("conv_id", "_found")
    ids = rows.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", nothing).alias("repaired_sha256")
    )
