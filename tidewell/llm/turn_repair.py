"""Conversation structure: faults of turns, and the cheapest edits that mend them, by divide and conquer."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.text import crc_mod
from tidewell.storage import materialize

SPACE_CHARS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

#: What the turns so far end in. A repaired conversation is empty, or an optional system turn and then user and assistant in turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may be given or inserted next, and what closes a conversation.
FOLLOWS = (USER, USER, ASSISTANT, USER)
CLOSE = ("", "II", "I", "")
NAMES = {USER: "user", ASSISTANT: "assistant"}
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
CLEAN, TRUNCATED, UNUSABLE = range(3)

#: Row of a table: what a start state reaches, by end state: None or (cost, edits), where edits compare as text or as ranks.
Table = Sequence[Sequence[tuple | None]]


def _row_table(code: int) -> Table:
    """The least edits of one row, with what is inserted before it; ``code`` is 3 * kind of role + fault."""
    kind, fault = divmod(code, 3)
    out: list[list[tuple | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state, put = start, ""
        for _ in range(3):  # a third insertion comes back to the state after the first
            ways = [("D", DELETE_COST, state)]
            if fault != UNUSABLE:
                ways.append(("R", REROLE_COST + fault * TRUNCATED_COST, FOLLOWS[state]))
                if kind == 0 and state == START or kind == 1 and state != USER or kind == 2 and state == USER:
                    ways.append(("K", fault * TRUNCATED_COST, kind + 1))
            for edit, cost, to in ways:
                way = (cost + INSERT_COST * len(put), put + edit)
                if out[start][to] is None or way < out[start][to]:
                    out[start][to] = way
            state, put = FOLLOWS[state], put + "I"
    return out


ROW = [_row_table(code) for code in range(12)]


def ahead(vec: tuple, table: Table) -> tuple[int, tuple]:
    """One step of the forward vector: (what it costs at least, the new vector of (cost above that, rank) by state).

    The edits that lead from one start to different states differ and none begins another, as each ends with a row's own edit.
    So a rank a state tells which of them is least as text, and longer ones compare by rank first and then by what was added.
    """
    found = []
    for to in range(4):
        ways = [(v[0] + table[s][to][0], v[1], table[s][to][1]) for s, v in enumerate(vec) if v and table[s][to]]
        found.append(min(ways, default=None))
    order = {k: r for r, k in enumerate(sorted({f[1:] for f in found if f}))}
    least = min(f[0] for f in found if f)
    return least, tuple((f[0] - least, order[f[1:]]) if f else None for f in found)


def behind(costs: tuple, table: Table) -> tuple:
    """One step of the backward vector: the least cost from each state to the end, above the least of them."""
    out = [min((w[0] + costs[to] for to, w in enumerate(table[s]) if w and costs[to] is not None), default=None) for s in range(4)]
    least = min(c for c in out if c is not None)
    return tuple(None if c is None else c - least for c in out)


row_ahead = lru_cache(maxsize=None)(lambda vec, code: ahead(vec, ROW[code]))  # few vectors occur
row_behind = lru_cache(maxsize=None)(lambda costs, code: behind(costs, ROW[code]))


def at(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def crossings(items: Sequence, start: int, end: int, fwd: Callable = row_ahead, back: Callable = row_behind) -> list[int]:
    """The state after each item on the cheapest way from ``start`` to ``end``, of equal ways the least as text.

    Hirschberg's way: the forward vector of the first half meets the backward vector of the second, of the
    states that cross at the least cost the one whose edits so far are least is taken, and both halves go on. Held: the states.
    """
    out = [end] * len(items)
    todo = [(0, len(items), start, end)]
    while todo:
        lo, hi, a, z = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        vec = at(a)
        for k in range(lo, mid):
            vec = fwd(vec, items[k])[1]
        costs: tuple = tuple(0 if s == z else None for s in range(4))
        for k in range(hi - 1, mid - 1, -1):
            costs = back(costs, items[k])
        state = min((v[0] + c, v[1], s) for s, (v, c) in enumerate(zip(vec, costs, strict=True)) if v and c is not None)[2]
        out[mid - 1] = state
        todo += [(lo, mid, a, state), (mid, hi, state, z)]
    return out


def last_state(vec: tuple) -> int:
    """Where the whole's cheapest and least edits end, before what closes it."""
    return min((v[0] + INSERT_COST * len(CLOSE[s]), v[1], s) for s, v in enumerate(vec) if v)[2]


def audit_of(codes: bytes, start: int, end: int) -> tuple[str, int, list[int]]:
    """(edits of these rows, their cost, the state after each)."""
    states = crossings(codes, start, end)
    ways = [ROW[c][s][t] for c, s, t in zip(codes, [start, *states], states, strict=False)]
    return "".join(w[1] for w in ways), sum(w[0] for w in ways), states


@lru_cache(maxsize=50_000)
def _short(codes: bytes) -> tuple[str, int, list[int]]:
    vec = at(START)
    for c in codes:
        vec = row_ahead(vec, c)[1]
    return audit_of(codes, START, last_state(vec))


def whole_audit(codes: bytes) -> tuple[str, int, list[int]]:
    """As ``audit_of``, for all rows of a conversation; what closes it is not part of it."""
    return _short(codes) if len(codes) <= 64 else _short.__wrapped__(codes)


# --- rows ----------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after seeded damage by ``crc32(conv_id:turn) % 20``: dropped, emptied, cut of marks, repeated, given to the user.

    A null role or text, and a null id or turn in what is hashed, is one space. Columns ``conv_id, turn, role, text, copy, row``.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.concat(text("conv_id"), F.lit(":"), text("turn")).alias("key"))
    d = rows.withColumns({"d": crc_mod("key", 20), "row": F.monotonically_increasing_id()}).where("d != 0")
    d = d.withColumn("text", F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    d = d.withColumn("role", F.when(F.col("d") == 4, "user").otherwise(F.col("role")))
    return d.withColumn("copy", F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("d", "key")


def plain(conversations: DataFrame) -> DataFrame:
    """The rows as they are, null roles and texts as one space, in the columns of ``damage``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(0).alias("copy"), F.monotonically_increasing_id().alias("row"))


def _place() -> Column:
    """Order within a conversation: turn, nulls first, then the place where the row was read."""
    return F.struct(F.col("turn").isNotNull().alias("t"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "role", "digest", "row", "copy")


def _judged(rows: DataFrame, block_rows: int) -> DataFrame:
    """All rows in order as a written table: ``conv_id, turn, role, text, initial, code, fault, block, seq``."""
    spark = rows.sparkSession
    end = F.substring(F.rtrim("text", F.lit(SPACE_CHARS)), -1, 1)
    told = rows.withColumns({
        "digest": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)),
        "initial": F.substring("role", 1, 1),
        "blank": end == "",
        "cut": ~end.isin(".", "!", "?"),
    })
    told = materialize(told, "turns")
    # What occurs again in a conversation: aggregated first, so that a text all its rows share is one row here.
    again = told.groupBy("conv_id", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    j = told.join(again, told["conv_id"].eqNullSafe(again["c"]) & (told["digest"] == again["d"]), "left")
    fault = F.when(F.col("blank"), "blank").when(F.coalesce(_place() > F.col("first"), F.lit(False)), "duplicate").when(F.col("cut"), "truncated")
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    weight = F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault").isNotNull(), UNUSABLE).otherwise(CLEAN)
    j = j.withColumn("fault", fault).withColumn("code", (kind * 3 + weight).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-told.count() // block_rows))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "row", "copy"]
    ordered = j.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return materialize(ordered.select("conv_id", "turn", "role", "text", "initial", "code", "fault", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("seq")), "turns-ordered")


# --- conversations over several blocks ----------------------------------------------------


def _summary(g: pd.DataFrame) -> pd.DataFrame:
    """A block's part of a conversation as the forward vectors from each state, 4 * 4 * (cost or -1, rank)."""
    codes = g.sort_values("seq")["code"].tolist()
    flat: list[int] = []
    for start in range(4):
        vec, base = at(start), 0
        for c in codes:
            least, vec = row_ahead(vec, c)
            base += least
        flat += [x for v in vec for x in ((v[0] + base, v[1]) if v else (-1, 0))]
    return pd.DataFrame({"conv_id": g["conv_id"].iloc[:1], "block": g["block"].iloc[:1], "ways": [flat]})


def _ends(g: pd.DataFrame) -> pd.DataFrame:
    """The states at which the parts of a conversation meet."""
    g = g.sort_values("block")
    tables = [[[None if r[s][t][0] < 0 else (int(r[s][t][0]), int(r[s][t][1])) for t in range(4)] for s in range(4)] for r in (np.array(w).reshape(4, 4, 2) for w in g["ways"])]
    vec = at(START)
    for t in tables:
        vec = ahead(vec, t)[1]
    states = crossings(tables, START, last_state(vec), ahead, behind)
    return pd.DataFrame({"conv_id": g["conv_id"], "block": g["block"], "start": [START, *states[:-1]], "end": states, "last": [False] * (len(g) - 1) + [True]})


def _with_ends(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start, end, last`` where a block holds a part of a conversation only."""
    kind = dict(rows.dtypes)["conv_id"]
    split = rows.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("c"))
    split = materialize(split, "turns-split")  # fewer rows than blocks
    parts = rows.select("conv_id", "block", "seq", "code").join(F.broadcast(split), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    ways = parts.groupBy("conv_id", "block").applyInPandas(_summary, f"conv_id {kind}, block int, ways array<long>")
    ends = ways.groupBy("conv_id").applyInPandas(_ends, f"conv_id {kind}, block int, start int, end int, last boolean")
    ends = materialize(ends, "turns-ends").withColumnsRenamed({"conv_id": "c", "block": "b"})  # at most two rows a block
    return rows.join(F.broadcast(ends), rows["conv_id"].eqNullSafe(ends["c"]) & (rows["block"] == ends["b"]), "left").drop("c", "b")


_COLUMNS = ["conv_id", "turn", "role", "text", "initial", "code", "fault", "block", "start", "end", "last"]


class Part:
    """The rows of a conversation in one block, and their edits."""

    def __init__(self, conv_id, block: int, start: int | None, end: int | None, last: bool | None):
        self.conv_id, self.block, self.split = conv_id, block, start is not None
        self.start, self.end, self.last = start or START, end, last or not self.split
        self.turns, self.roles, self.texts, self.initials, self.faults, self.codes = [], [], [], [], [], bytearray()

    def edited(self) -> tuple[str, int, list[tuple[str, int | None, str, str]]]:
        """(audit, cost, (edit, row or None, role, text) in order)."""
        audit, cost, states = whole_audit(bytes(self.codes)) if not self.split else audit_of(bytes(self.codes), self.start, self.end)
        if self.last:
            close = CLOSE[states[-1]]
            audit, cost = audit + close, cost + INSERT_COST * len(close)
        out, state, k = [], self.start, 0
        for edit in audit:
            if edit == "I":
                state = FOLLOWS[state]
                out.append((edit, None, NAMES[state], ""))
                continue
            if edit == "D":
                out.append((edit, k, self.roles[k], self.texts[k]))
            elif edit == "R":
                state = FOLLOWS[state]
                out.append((edit, k, NAMES[state], self.texts[k]))
            else:
                state = self.codes[k] // 3 + 1
                out.append((edit, k, self.roles[k], self.texts[k]))
            k += 1
        return audit, cost, out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    part = key = None
    for batch in batches:
        for conv, turn, role, text, initial, code, fault, block, start, end, last in zip(*(batch.column(c).to_pylist() for c in _COLUMNS), strict=True):
            if key != (conv, block):
                if part:
                    yield part
                part, key = Part(conv, block, start, end, last), (conv, block)
            part.turns.append(turn)
            part.roles.append(role)
            part.texts.append(text)
            part.initials.append(initial)
            part.faults.append(fault)
            part.codes.append(code)
    if part:
        yield part


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _in_blocks(rows: DataFrame) -> DataFrame:
    parts = max(1, rows.select(F.max("block")).first()[0] or 0) + 1
    return _with_ends(rows).select(*_COLUMNS, "seq").repartition(parts, "block").sortWithinPartitions("block", "seq")


def repaired_turns(conversations: DataFrame, damaged: bool = False, block_rows: int = 20_000) -> DataFrame:
    """Every edit in order: ``conv_id, block, place, edit, turn, role, text, fault``.

    ``edit`` is K (kept), R (another role), D (deleted) or I (an empty turn was put in); the repaired conversation is the rows that are not D,
    by (block, place). See ``repair`` for what is taken as a fault and for odd rows.
    """
    rows = _judged((damage if damaged else plain)(conversations), block_rows)
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", batches_type), ("block", pa.int32()), ("place", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
        made = ((p.conv_id, p.block, n, edit, p.turns[k] if k is not None else None, role, text, p.faults[k] if k is not None else None) for p in _parts(batches) for n, (edit, k, role, text) in enumerate(p.edited()[2]))
        yield from _batches(made, schema)

    batches_type = _arrow(kind)
    return _in_blocks(rows).mapInArrow(run, f"conv_id {kind}, block int, place int, edit string, turn long, role string, text string, fault string")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


_PART = [("conv_id", None), ("block", "int"), ("k", "int"), ("split", "boolean"), ("lo", "long"), ("hi", "long"), ("turns", "long"), ("first_turn", "long"), ("last_turn", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("head", "string"), ("tail", "string"), ("cost", "long"), ("audit", "string"), ("any", "boolean"), ("piece", "string"), ("sha", "string")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
_RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("repaired_sha256", "string")]


def _report(kind: str, most_chars: int):
    schema = pa.schema([(n, _arrow(kind) if t is None else _ARROW[t]) for n, t in _PART])

    def rows(parts: Iterator[Part]) -> Iterator[tuple]:
        for p in parts:
            audit, cost, edits = p.edited()
            known = [t for t in p.turns if t is not None]
            counts = [sum(f == n for f in p.faults) for n in ("blank", "duplicate", "truncated")]
            odd = sum(a + b not in LEGAL for a, b in zip(p.initials, p.initials[1:], strict=False))
            left = [f"{role}:{text}" for edit, _, role, text in edits if edit != "D"]
            ends = (min(known), max(known), len(set(known)), known[0], known[-1]) if known else (None, None, 0, None, None)
            facts = (*ends, *counts, odd, p.initials[0], p.initials[-1], cost, audit, bool(left))
            if not p.split:
                yield (p.conv_id, p.block, 0, False, *facts, None, hashlib.sha256("\n".join(left).encode()).hexdigest())
                continue
            text = "\n".join(left)  # a block's rows at most, handed on in pieces
            pieces = [text[i : i + most_chars] for i in range(0, len(text), most_chars)] or [""]
            yield (p.conv_id, p.block, 0, True, *facts, pieces[0], None)
            for k, piece in enumerate(pieces[1:], 1):
                yield (p.conv_id, p.block, k, True, *(None,) * len(facts), piece, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(_parts(batches)), schema, 200)

    return run


def _joined(kind: str):
    """Parts of conversations, in order, to one row a conversation; a hash and counts are held, no text."""
    schema = pa.schema([("conv_id", _arrow(kind)), *((n, _ARROW[t]) for n, t in _RESULT)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: dict | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now:
                        yield close(now)
                    now = {"conv_id": r["conv_id"], "lo": None, "hi": None, "turns": 0, "last_turn": None, "tail": None, "any": False, "audit": [], "sha": hashlib.sha256()} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                if r["k"] == 0:
                    if r["lo"] is not None:
                        now["lo"] = r["lo"] if now["lo"] is None else min(now["lo"], r["lo"])
                        now["hi"] = r["hi"] if now["hi"] is None else max(now["hi"], r["hi"])
                        now["turns"] += r["turns"] - (now["last_turn"] == r["first_turn"])
                        now["last_turn"] = r["last_turn"]
                    for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                        now[c] += r[c]
                    now["illegal"] += now["tail"] is not None and now["tail"] + r["head"] not in LEGAL
                    now["tail"] = r["tail"]
                    now["audit"].append(r["audit"])
                    if r["any"] and now["any"]:
                        now["sha"].update(b"\n")
                    now["any"] |= r["any"]
                now["sha"].update(r["piece"].encode())
        if now:
            yield close(now)

    def close(x: dict) -> tuple:
        gaps = 0 if x["lo"] is None else x["hi"] - x["lo"] + 1 - x["turns"]
        return (x["conv_id"], gaps, x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], "".join(x["audit"]), x["sha"].hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema, 50)

    return run


def repair(conversations: DataFrame, damaged: bool = False, block_rows: int = 20_000, most_chars: int = 1_000_000) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits that mend it, and the SHA-256 of the result.

    Columns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. With ``damaged`` the rows are first damaged
    (``damage``), and conversations that lose all rows give zeros, an empty audit and the hash of nothing.

    Rows are put in order of conversation, turn (null first), role, content and place of reading, in blocks of about ``block_rows`` rows. A conversation
    within one block is mended there; of one that spans several, of any length, each block sends the forward vectors of its part from each
    state, these meet as rows do, and each block mends its part between two known states. So no task holds more than a block of texts, and
    a longer conversation's hash is taken in order over pieces of ``most_chars``. Its audit is one cell.

    A null role or text is one space; a role that begins with another letter than s, u or a can be given another role or deleted.
    Rows with null ids are one conversation, null turns make no gaps, and repeated rows are duplicates. Other columns are ignored.
    """
    kept = (damage if damaged else plain)(conversations)
    rows = _judged(kept, block_rows)
    kind = dict(rows.dtypes)["conv_id"]
    schema = ", ".join(f"`{n}` {kind if t is None else t}" for n, t in _PART)
    told = materialize(_in_blocks(rows).mapInArrow(_report(kind, most_chars), schema), "turns-told")
    gaps = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(F.col("hi") - F.col("lo") + 1 - F.col("turns")).cast("long").alias("gaps")
    names = ["conv_id", *(n for n, _ in _RESULT)]
    whole = told.where("NOT split").withColumn("repaired_sha256", F.col("sha")).select("conv_id", gaps, *names[2:])
    parts = told.where("split").repartition("conv_id").sortWithinPartitions("conv_id", "block", "k")
    joined = parts.mapInArrow(_joined(kind), ", ".join([f"conv_id {kind}", *(f"{n} {t}" for n, t in _RESULT)]))
    done = whole.unionByName(joined).withColumnRenamed("conv_id", "c")
    every = conversations.select("conv_id").distinct()
    out = every.join(done, every["conv_id"].eqNullSafe(done["c"]), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return out.select("conv_id", *(F.coalesce(n, nothing.get(n, F.lit(0).cast("long"))).alias(n) for n, _ in _RESULT))
