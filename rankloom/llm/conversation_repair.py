"""Repair of conversation structure by a recursive DuckDB query inside hash-partitioned batches.

Rows of a conversation lie together, in order, in one partition by the hash of its id; Spark marks each row's fault
(blank, duplicate, truncated) there. A task hands whole conversations, some 16,384 rows at a time, to DuckDB, where
each step of one recursive query advances all conversations of the batch by a turn and keeps, for each state of the
grammar ``(s?(ua)+)?``, the least cost and of equally cheap audits the least. Equally cheap audits of the same rows
are never prefixes of each other (what follows a common prefix would cost nothing), so keeping one a state is exact.

A conversation longer than a segment goes through in segments that start from every state; the segments' best
(cost, audit) are chained, and one running SHA-256 a state stands for the repaired text, so its rows are never held
together. Its digest is one sequential value, which is why its rows pass through one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a batch, and of a segment of a longer conversation; characters at which either is closed early.
BATCH_ROWS, SEGMENT_ROWS, CHARS = 16_384, 1_024, 1 << 25
#: What counts as white space.
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. A repaired conversation ends in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
INSERT, REROLE, DELETE, UNDELETED = 2, 2, 3, 1
#: The turn that the grammar expects in a state.
EXPECTS = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
_AFTER = {"user": USER, "assistant": ASSISTANT}


def inserted(state: int, n: int) -> int:
    """The state after ``n`` inserted turns."""
    for _ in range(n):
        state = _AFTER[EXPECTS[state]]
    return state


def moves() -> list[tuple[int, str, bool, int, str, int]]:
    """(state, initial, must go, next state, edits, cost): up to two inserts (more would lead back to a state), then one row's edit. Initial '-' stands for any other."""
    out = []
    for state, n, initial, gone in product(STATES, range(3), "sua-", (False, True)):
        at, edits, cost = inserted(state, n), "I" * n, INSERT * n
        out.append((state, initial, gone, at, edits + "D", cost + DELETE))
        if not gone:
            out.append((state, initial, gone, _AFTER[EXPECTS[at]], edits + "R", cost + REROLE))
            if initial == "s" and at == START:
                out.append((state, initial, gone, SYSTEM, edits + "K", cost))
            elif initial == EXPECTS[at][0]:
                out.append((state, initial, gone, _AFTER[EXPECTS[at]], edits + "K", cost))
    return out


def endings() -> list[tuple[int, str, int]]:
    """(state, edits, cost) of the cheapest way from a state to an end."""
    return [min(((s, "I" * n, INSERT * n) for n in range(3) if inserted(s, n) in ENDS), key=lambda x: x[2]) for s in STATES]


#: One step a turn over all conversations of ``rows (conv, pos, initial, gone, late)`` from the states of ``entries (conv, entry)``.
RECURSION = """
WITH RECURSIVE step(conv, entry, state, pos, best) AS (
    SELECT conv, entry, entry, 0, {'cost': 0::BIGINT, 'audit': ''} FROM entries
    UNION ALL
    SELECT s.conv, s.entry, m.next, s.pos + 1, min({'cost': s.best.cost + m.cost + CASE WHEN r.late AND NOT suffix(m.edits, 'D') THEN $undeleted ELSE 0 END, 'audit': s.best.audit || m.edits})
    FROM step s JOIN rows r ON r.conv = s.conv AND r.pos = s.pos + 1 JOIN moves m ON m.state = s.state AND m.initial = r.initial AND m.gone = r.gone
    GROUP BY s.conv, s.entry, m.next, s.pos
), sizes AS (SELECT conv, max(pos) AS n FROM rows GROUP BY conv)
SELECT s.conv, s.entry, s.state, s.best.cost AS cost, s.best.audit AS audit FROM step s JOIN sizes z ON z.conv = s.conv AND z.n = s.pos
"""


class Solver:
    """A task's DuckDB."""

    def __init__(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE moves (state INT, initial VARCHAR, gone BOOLEAN, next INT, edits VARCHAR, cost BIGINT)")
        self.db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())

    def solve(self, rows: pa.Table, entries: pa.Table) -> list[tuple[int, int, int, int, str]]:
        """(conv, entry, state, cost, audit) of the cheapest edits of each conversation's rows between two states."""
        self.db.register("rows", rows)
        self.db.register("entries", entries)
        try:
            return self.db.execute(RECURSION, {"undeleted": UNDELETED}).fetchall()
        finally:
            self.db.unregister("rows")
            self.db.unregister("entries")


def edited(state: int, edits: str, rows: list[tuple[str, str]]) -> Iterator[str]:
    """The repaired ``role:text`` lines that edits of rows give from a state on."""
    rest = iter(rows)
    for edit in edits:
        if edit == "I":
            yield EXPECTS[state] + ":"
            state = _AFTER[EXPECTS[state]]
            continue
        role, text = next(rest)
        if edit == "R":
            role = EXPECTS[state]
        if edit != "D":
            yield f"{role}:{text}"
            state = SYSTEM if edit == "K" and role[:1] == "s" else _AFTER[EXPECTS[state]]


class _Long:
    """A conversation that is read in segments: (cost, audit, running digest, lines so far) of each state."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, str, object, bool]] = {START: (0, "", hashlib.sha256(), False)}

    def advance(self, found: list[tuple[int, int, int, str]], rows: list[tuple[str, str]]) -> None:
        """Take (entry, state, cost, audit) of a segment."""
        into: dict[int, tuple[int, str, int, str]] = {}
        for entry, state, cost, audit in found:
            if entry in self.best:
                before = self.best[entry]
                option = (before[0] + cost, before[1] + audit, entry, audit)
                if state not in into or option[:2] < into[state][:2]:
                    into[state] = option
        self.best = {state: (cost, audit, *self._digest(entry, own, rows)) for state, (cost, audit, entry, own) in into.items()}

    def _digest(self, entry: int, edits: str, rows: list[tuple[str, str]]) -> tuple[object, bool]:
        digest, begun = self.best[entry][2].copy(), self.best[entry][3]
        for line in edited(entry, edits, rows):
            digest.update(("\n" if begun else "").encode() + line.encode())
            begun = True
        return digest, begun

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, digest) of the whole conversation."""
        self.advance([(state, inserted(state, len(edits)), cost, edits) for state, edits, cost in endings()], [])
        cost, audit, digest, _ = min((self.best[s] for s in ENDS if s in self.best), key=lambda x: x[:2])
        return cost, audit, digest.hexdigest()


_COUNTS = ("fresh", "blank", "duplicate", "truncated", "illegal")


def _repair(batches: Iterator[pa.RecordBatch], batch_rows: int, segment_rows: int) -> Iterator[pa.RecordBatch]:
    """Marked rows, conversation after conversation, to one row a conversation."""
    solver, done, kind = Solver(), [], None
    convs: list[dict] = []  # of the open batch; the last one may be incomplete
    n_rows = n_chars = 0

    def fresh_conv(conv) -> dict:
        return {"conv_id": conv, "rows": [], "chars": 0, "long": None, "low": None, "high": None, **dict.fromkeys(_COUNTS, 0)}

    def table(own: list[dict], starts) -> list[tuple[int, int, int, int, str]]:
        conv, pos, initial, gone, late = [], [], [], [], []
        for i, c in enumerate(own):
            for p, (role, _, g, t) in enumerate(c["rows"], 1):
                conv.append(i), pos.append(p), initial.append(role[:1] if role[:1] in ("s", "u", "a") else "-"), gone.append(g), late.append(t)
        rows = pa.table({"conv": pa.array(conv, pa.int32()), "pos": pa.array(pos, pa.int32()), "initial": initial, "gone": gone, "late": late})
        entries = [(i, s) for i, c in enumerate(own) if c["rows"] for s in starts]
        return solver.solve(rows, pa.table({"conv": pa.array([i for i, _ in entries], pa.int32()), "entry": pa.array([s for _, s in entries], pa.int32())})) if entries else []

    def segment(c: dict) -> None:
        c["long"] = c["long"] or _Long()
        c["long"].advance([x[1:] for x in table([c], STATES)], [r[:2] for r in c["rows"]])
        c["rows"], c["chars"] = [], 0

    def finish(own: list[dict]) -> None:
        short, long = [c for c in own if c["long"] is None], [c for c in own if c["long"] is not None]
        found: dict[int, list] = {}
        for i, entry, state, cost, audit in table(short, (START,)):
            found.setdefault(i, []).append((entry, state, cost, audit))
        for i, c in enumerate(short):
            c["long"] = _Long()
            if c["rows"]:
                c["long"].advance(found[i], [r[:2] for r in c["rows"]])
        for c in long:
            if c["rows"]:
                segment(c)
        for c in own:
            cost, audit, digest = c["long"].end()
            gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["fresh"]
            done.append((c["conv_id"], gaps, *(c[k] for k in _COUNTS[1:]), cost, audit, digest))

    def out() -> pa.RecordBatch:
        columns = [pa.array(x, t) for x, t in zip(zip(*done), (kind, *[pa.int64()] * 6, pa.string(), pa.string()))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "gaps", *_COUNTS[1:], "cost", "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i in range(0, batch.num_rows, 2048):
            for row in batch.slice(i, 2048).to_pylist():
                if row["first"]:
                    if n_rows >= batch_rows or n_chars >= CHARS:
                        finish(convs)
                        convs, n_rows, n_chars = [], 0, 0
                        yield out()
                    convs.append(fresh_conv(row["conv_id"]))
                c = convs[-1]
                n_rows += 1
                if row["ghost"]:
                    continue
                for k in _COUNTS:
                    c[k] += row[k]
                if row["turn"] is not None:
                    c["low"], c["high"] = row["turn"] if c["low"] is None else c["low"], row["turn"]
                c["rows"].append((row["role"], row["text"], bool(row["blank"] or row["duplicate"]), bool(row["truncated"])))
                c["chars"] += len(row["text"])
                n_chars += len(row["text"])
                if len(c["rows"]) >= segment_rows or c["chars"] >= CHARS:
                    n_chars -= c["chars"]
                    segment(c)
    if convs:
        finish(convs)
        yield out()


def damage(rows: DataFrame, fault: Column) -> DataFrame:
    """Rows with planted faults by ``fault``: 0 drops the row (``ghost`` is true, so that its conversation is still known), 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it the user's."""
    f = rows.withColumn("__fault", fault)
    f = f.withColumn("text", F.expr("CASE __fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END"))
    f = f.withColumn("role", F.expr("CASE __fault WHEN 4 THEN 'user' ELSE role END")).withColumn("ghost", F.col("__fault") == 0)
    f = f.withColumn("__copy", F.explode(F.expr("CASE __fault WHEN 3 THEN array(1, 2) ELSE array(1) END")))
    return f.drop("__fault", "__copy")


def repair(rows: DataFrame, fault: Column | None = None, batch_rows: int = BATCH_ROWS, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` have conv_id, turn, role and text (other columns aren't read); ``fault`` (over these columns) damages them
    first. Null roles and texts count as one space. Rows come by turn (nulls first), of equal turns by role and text, so
    repeated rows are adjacent. A null conv_id is a conversation of its own. A role that begins with none of s, u, a can't
    be kept, only rerolled or deleted; so can't an empty one, whose initial is the empty string. An empty table gives an empty result.
    """
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    own = damage(own, fault) if fault is not None else own.withColumn("ghost", F.lit(False))
    own = own.withColumn("text", F.when(~F.col("ghost"), F.col("text"))).withColumn("role", F.when(~F.col("ghost"), F.col("role")))
    own = own.withColumn("__last", F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1))
    own = own.repartition("conv_id")  # both windows and the batches use this partitioning
    equal = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    own = own.withColumn("__seen", F.row_number().over(equal) > 1)
    order = (F.desc("ghost"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"))
    along = Window.partitionBy("conv_id").orderBy(*order)
    before = lambda c: F.lag(c).over(along)
    initial = F.substring("role", 1, 1)
    blank = F.col("__last") == ""
    duplicate = ~blank & F.col("__seen")
    number = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    marked = own.withColumn("__initial", initial).select(
        "conv_id", (F.row_number().over(along) == 1).alias("first"), "ghost", "turn", "role", "text",
        number(F.col("turn").isNotNull() & (before("ghost") | before("turn").isNull() | (before("turn") != F.col("turn")))).alias("fresh"),
        number(blank).alias("blank"), number(duplicate).alias("duplicate"), number(~blank & ~F.col("__seen") & ~F.col("__last").isin(".", "!", "?")).alias("truncated"),
        number(~before("ghost") & ~F.concat(before("__initial"), "__initial").isin("su", "ua", "au")).alias("illegal"),
    )
    marked = marked.sortWithinPartitions("conv_id", *order)
    kind = dict(rows.dtypes)["conv_id"]
    return marked.mapInArrow(lambda batches: _repair(batches, batch_rows, segment_rows), f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
