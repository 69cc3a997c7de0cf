"""Operator 11: cheapest repair of conversation structure, by Four-Russians block tables."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.registry import register
from pitchline.session import materialize

#: Costs of edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A row is one symbol: x must go, else the initial of its role (o: any other), in upper case if the row is truncated.
SYMBOLS = "xsuaoSUAO"
#: States of the output: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after a user or assistant row put out in a state: such a row's role is never a choice.
TURN = (USER, USER, ASSISTANT, USER)
BLOCK, CHUNK = 4, 4096
_BLANKS = " \t\n\x0b\x0c\r"


def _kept(state: int, symbol: str) -> int | None:
    """The state after keeping a row, None where its role doesn't fit."""
    initial = symbol.lower()
    if initial == "s" and state == START:
        return SYSTEM
    return TURN[state] if (initial == "u" and TURN[state] == USER) or (initial == "a" and TURN[state] == ASSISTANT) else None


def _with_inserts(costs: list[float]) -> tuple[float, ...]:
    costs = list(costs)
    for _ in range(4):
        for state in range(4):
            costs[state] = min(costs[state], INSERT + costs[TURN[state]])
    return tuple(costs)


#: Cheapest way to a legal end from each state once no row is left.
END = _with_inserts([0, float("inf"), float("inf"), 0])


def _choices(after: tuple[float, ...], symbol: str, state: int) -> dict[str, tuple[float, int]]:
    """Cost to the end and next state for each edit of the next row."""
    extra, found = TRUNCATED * symbol.isupper(), {"D": (DELETE + after[state], state)}
    if symbol != "x":
        kept = _kept(state, symbol)
        if kept is not None:
            found["K"] = (extra + after[kept], kept)
        found["R"] = (REROLE + extra + after[TURN[state]], TURN[state])
    return found


@dataclass
class Tables:
    """Normalised vectors of costs to the end, what each symbol and each block of symbols before them makes of them, and the edit
    that begins the ASCII-least cheapest audit for each (vector after the row, symbol, state)."""

    vectors: list[tuple[float, ...]]
    step: list[list[int]]
    block: list[list[int]]
    edit: list[list[list[tuple[str, int]]]]


@cache
def tables() -> Tables:
    vectors, number, step, edit = [END], {END: 0}, [], []
    while len(step) < len(vectors):
        after, row, edits = vectors[len(step)], [], []
        for symbol in SYMBOLS:
            choices = [_choices(after, symbol, state) for state in range(4)]
            raw = _with_inserts([min(cost for cost, _ in c.values()) for c in choices])
            normal = tuple(cost - min(raw) for cost in raw)
            if normal not in number:
                number[normal] = len(vectors)
                vectors.append(normal)
            row.append(number[normal])
            for state, c in enumerate(choices):
                c["I"] = (INSERT + raw[TURN[state]], TURN[state])
            edits.append([min((name, to) for name, (cost, to) in c.items() if cost == raw[state]) for state, c in enumerate(choices)])
        step.append(row)
        edit.append(edits)
    one = np.array(step)
    block = one
    for _ in range(BLOCK - 1):                         # the symbol on the left is read last
        block = one[block].transpose(0, 2, 1).reshape(len(vectors), -1)
    return Tables(vectors, step, block.tolist(), edit)


_WEIGHTS = len(SYMBOLS) ** np.arange(BLOCK - 1, -1, -1)
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))


def _blocks(symbols: str) -> tuple[list[int], list[int]]:
    """Codes of the single symbols on the left that fill no block, and of the blocks after them."""
    codes = _CODE[np.frombuffer(symbols.encode(), np.uint8)]
    odd = len(codes) % BLOCK
    return codes[:odd].tolist(), (codes[odd:].reshape(-1, BLOCK) @ _WEIGHTS).tolist()


def before(symbols: str, vector: int) -> int:
    """The vector in front of ``symbols``, given the one behind them."""
    t = tables()
    odd, blocks = _blocks(symbols)
    for code in reversed(blocks):
        vector = t.block[vector][code]
    for code in reversed(odd):
        vector = t.step[vector][code]
    return vector


@cache
def _expanded(vector: int, codes: tuple[int, ...], state: int) -> tuple[str, int]:
    """Edits of a few symbols and the state after them: the block's inner vectors backward, then its edits forward."""
    t, behind = tables(), [vector]
    for code in reversed(codes[1:]):
        behind.append(t.step[behind[-1]][code])
    edits = []
    for code, after in zip(codes, reversed(behind)):
        while True:
            name, state = t.edit[after][code][state]
            edits.append(name)
            if name != "I":
                break
    return "".join(edits), state


def trace(symbols: str, vector: int, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits of ``symbols`` from ``state`` on, given the vector behind them, and the state after them."""
    t = tables()
    odd, blocks = _blocks(symbols)
    behind = []
    for code in reversed(blocks):
        behind.append(vector)
        vector = t.block[vector][code]
    edits = []
    if odd:
        part, state = _expanded(vector, tuple(odd), state)
        edits.append(part)
    for code, after in zip(blocks, reversed(behind)):
        part, state = _expanded(after, tuple(code // int(w) % len(SYMBOLS) for w in _WEIGHTS), state)
        edits.append(part)
    return "".join(edits), state


def closing(state: int) -> str:
    """Edits once no row is left."""
    return {USER: "I", SYSTEM: "II"}.get(state, "")


# --- rows ------------------------------------------------------------------------------------------------------------

_ORDER = ["conv_id", "turn", "role", "digest"]


def _plain(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                text("role").alias("role"), text("text").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations(conv_id, turn, role, text)`` with faults put in by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 makes it the user's. A null counts as
    one space in the hashed key, in ``role`` and in ``text``; ``turn`` itself stays null. Repeated rows fare alike.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    marked = conversations.select("*", kind.alias("_kind")).filter("_kind <> 0")
    is_ = lambda k: F.col("_kind") == k
    text = F.when(is_(1), F.lit("")).when(is_(2), F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(is_(4), F.lit("user")).otherwise(part("role"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                         F.explode(F.array_repeat(F.lit(0), F.when(is_(3), 2).otherwise(1))).alias("_copy")).drop("_copy")


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _later(turn: str, first: str) -> Column:
    """Whether a turn comes after another; null turns come first."""
    return F.col(turn).isNotNull() & (F.col(first).isNull() | (F.col(turn) > F.col(first)))


def _symbols(rows: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text) with its symbol and number of copies ``n``; texts stay behind."""
    body = F.rtrim(F.col("text"), F.lit(_BLANKS))
    narrow = rows.select(*_ORDER, (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"))
    counted = materialize(narrow.groupBy(*_ORDER, "blank", "open").agg(F.count(F.lit(1)).alias("n")), "turns")
    first = counted.groupBy("conv_id", "role", "digest") \
        .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("at"), F.count(F.lit(1)).alias("turns")) \
        .filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                                    F.lit(True).alias("again"), F.col("at.turn").alias("first_turn"))
    met = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    gone = F.col("blank") | (F.col("again").isNotNull() & _later("turn", "first_turn"))
    return met.select(*_ORDER, "n", F.when(gone, "x").when(F.col("open"), F.upper(letter)).otherwise(letter).alias("symbol"))


_CHUNKS = "conv_id long, turn long, role string, digest binary, seq long, symbols string"


def _chunks(symbols: DataFrame) -> DataFrame:
    """Symbols of conversations in order, in pieces of at most ``CHUNK`` rows that know their first row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
                            ("seq", pa.int64()), ("symbols", pa.string())])
        seq, head, held, size = TaskContext.get().partitionId() << 40, None, [], 0
        for batch in batches:
            done = []
            for conv, turn, role, digest, n, symbol in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if head is not None and head[0] != conv:
                    done.append((*head, seq, "".join(held)))
                    seq, head, held, size = seq + 1, None, [], 0
                while n:
                    if head is None:
                        head = (conv, turn, role, digest)
                    take = min(n, CHUNK - size)
                    held.append(symbol + "x" * (take - 1))
                    symbol, n, size = "x", n - take, size + take
                    if size == CHUNK:
                        done.append((*head, seq, "".join(held)))
                        seq, head, held, size = seq + 1, None, [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
        if head is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*head, seq, "".join(held))))], schema)

    ordered = symbols.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select(*_ORDER, "n", "symbol")
    return ordered.mapInArrow(run, _CHUNKS)


def _behind(chunks: DataFrame) -> DataFrame:
    """Chunks with the vector behind each: one row per ``CHUNK`` rows is read, from a conversation's end to its beginning."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now, vector = False, None, 0
        for batch in batches:
            found = []
            for conv, symbols in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()):
                if not started or conv != now:
                    started, now, vector = True, conv, 0
                found.append(vector)
                vector = before(symbols, vector)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "behind"])

    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq"))
    return ordered.mapInArrow(run, _CHUNKS + ", behind int")


_REPAIRED = "conv_id long, place long, edit string, turn long, old_role string, fault string, role string, text string"


def repair(conversations: DataFrame) -> DataFrame:
    """Every row of ``conversations(conv_id, turn, role, text)`` and every inserted one, in order, with what is done to it.

    Columns ``conv_id``, ``place`` (from 0), ``edit`` (K keep, R other role, D delete, I insert), ``turn``, ``old_role`` (null for an
    inserted row), ``fault`` (blank: no visible character; duplicate: role and text stood earlier in the conversation; truncated: the
    last visible character ends no sentence; null: none), and ``role`` and ``text`` after the repair (null for a deleted row). Blank and
    duplicate rows are deleted. What is left reads ``(s?(ua)+)?`` by the initials of its roles, at the least
    cost; of the cheapest edits those whose initials make the ASCII-least string.

    Rows stand by turn (null turns first), within one turn by role and the SHA-256 of their text. A null role or text is one space; a
    null ``conv_id`` is a conversation of its own; an empty table gives an empty one; other columns are ignored. The rows of a
    conversation come out together and in order, in one partition. Only one byte per row goes through the tables, in chunks of
    ``CHUNK`` rows sorted over all tasks, so a very long conversation is never gathered; the last pass streams it.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    rows = _with_digest(_plain(conversations))
    chunks = _behind(materialize(_chunks(materialize(_symbols(rows), "symbols")), "chunks"))
    nothing = lambda kind: F.lit(None).cast(kind)
    mixed = chunks.select(*_ORDER, F.lit(0).alias("kind"), "seq", "symbols", "behind", nothing("string").alias("text")).unionByName(
        rows.select(*_ORDER, F.lit(1).alias("kind"), nothing("long").alias("seq"), nothing("string").alias("symbols"),
                    nothing("int").alias("behind"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
                            ("old_role", pa.string()), ("fault", pa.string()), ("role", pa.string()), ("text", pa.string())])
        started, now = False, None
        waiting: deque[tuple[str, str]] = deque()       # (edits, symbols) of chunks whose rows are still to come
        state = shown = START                           # after the last traced chunk, after the last row put out
        place = at = row_at = 0
        out: list[tuple] = []

        def insert() -> None:
            nonlocal shown, place
            shown = TURN[shown]
            out.append((now, place, "I", None, None, None, ROLES[shown], ""))
            place += 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (0, 1, 2, 4, 6, 7, 8)]
            for conv, turn, role, kind, symbols, behind, text in zip(*columns):
                if not started or conv != now:
                    for _ in closing(state):
                        insert()
                    started, now, state, shown, place, at, row_at = True, conv, START, START, 0, 0, 0
                if kind == 0:
                    edits, state = trace(symbols, behind, state)
                    waiting.append((edits, symbols))
                    continue
                edits, marks = waiting[0]
                while edits[at] == "I":
                    insert()
                    at += 1
                edit, mark = edits[at], marks[row_at]
                at, row_at = at + 1, row_at + 1
                if mark == "x":
                    fault = "duplicate" if text.strip(_BLANKS) else "blank"
                else:
                    fault = "truncated" if mark.isupper() else None
                if edit == "D":
                    out.append((conv, place, edit, turn, role, fault, None, None))
                else:
                    shown = _kept(shown, mark) if edit == "K" else TURN[shown]
                    out.append((conv, place, edit, turn, role, fault, role if edit == "K" else ROLES[shown], text))
                place += 1
                if at == len(edits):
                    waiting.popleft()
                    at = row_at = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        for _ in closing(state):
            insert()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ordered = mixed.repartition("conv_id").sortWithinPartitions(*_ORDER, "kind", "seq")
    return ordered.mapInArrow(run, _REPAIRED)


def report(repaired: DataFrame) -> DataFrame:
    """Faults, cost and digest per conversation of the rows of ``repair``, which are read in the order in which it puts them out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        now, held = None, None

        def row() -> dict:
            known = held["low"] is not None
            gaps = held["high"] - held["low"] + 1 - held["turns"] if known else 0
            return dict(zip(names, (now, gaps, held["blank"], held["duplicate"], held["truncated"], held["illegal"], held["cost"],
                                    "".join(held["audit"]), held["hash"].hexdigest())))

        schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in names[1:7]), ("audit", pa.string()),
                            ("repaired_sha256", pa.string())])
        for batch in batches:
            done = []
            for conv, _, edit, turn, old, fault, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or conv != now:
                    if held is not None:
                        done.append(row())
                    now = conv
                    held = {"low": None, "high": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0,
                            "audit": [], "hash": hashlib.sha256(), "last": None, "some": False}
                held["audit"].append(edit)
                held["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if edit != "I":
                    if turn is not None and turn != held["high"]:
                        held["low"] = turn if held["low"] is None else held["low"]
                        held["high"] = turn
                        held["turns"] += 1
                    if held["last"] is not None:
                        held["illegal"] += held["last"] + old[:1] not in ("su", "ua", "au")
                    held["last"] = old[:1]
                    if fault:
                        held[fault] += 1
                if edit != "D":
                    held["cost"] += TRUNCATED * (fault == "truncated")
                    held["hash"].update(("\n" if held["some"] else "").encode() + f"{role}:{text}".encode())
                    held["some"] = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([row()], schema)

    return repaired.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                                    "audit string, repaired_sha256 string")


@register("op11_conversation_repair")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    found = report(repair(damaged(whole)))
    every = whole.select(F.col("conv_id").alias("c")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
