"""Conversations brought into the form of turns that training needs, by the cheapest edits.

A conversation is sound if the initials of its roles read (s?(ua)+)?: nothing, or perhaps a system turn
and then user and assistant in turn. Rows are kept (0), given the role that is due (1), deleted (2) or
put in with an empty text (5). Blank rows and repetitions of a role and text must be deleted; a
truncated row (its text ends without . ! or ?) costs 5 if it stays.

Method (Four Russians): a row is one of 9 symbols, and the costs of the four states of the pattern
form a vector that, less its least entry, takes one of some 60 values. The transitions of every
vector by every block of BLOCK symbols are computed once in a task; blocks of rows are then
processed by lookup. For the edits, blocks are expanded backward, keeping every state that lies on a
cheapest path, so that ties are settled only when the path is read from the front: of all
cheapest edits those whose initials (D, I, K, R) sort first.

Long conversations: rows are dealt out by ranges of (conversation, turn), and consecutive rows are cut
into chunks of up to CHUNK. A chunk's blocks give a 4 by 4 table of costs from state to state; the tables
of a conversation give each chunk its first vector and the states it may end in; chunks are
then expanded apart. So no task needs a conversation whole: what meets in one row is a table for each
chunk, and the edits' letters, which the result asks for in one string. Only the hash over a
repaired conversation reads its rows in sequence, in batches, without gathering them.

Defined cases. Null conversation: one of its own. Null turn: before all others. Null role or text: one
space. Rows of one turn stand by role, then by text. Empty text: blank. Very long texts are only read, hashed
and passed on. Roles other than those that begin with s, u or a can't be kept. Repeated rows:
duplicates, also of one turn. Empty table: empty result. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursepulse.llm.common import SPACES, map_arrow, stored

#: Symbols of a block, and rows of a chunk as a power of two.
BLOCK = 4
CHUNK_BITS = 12
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Row symbols: the role's initial (s, u, a, other), plus 4 if truncated; or to be deleted.
KINDS, GONE, SYMBOLS = "sua", 8, 9
#: Faults, in the order in which they count.
BLANK, DUPLICATE, CUT = 1, 2, 3
#: States: start, after s, after u, after a; what an inserted row makes of them, and which one it is.
STATES = range(4)
NEXT, ROLE_DUE = (2, 2, 3, 2), "UUAU"
NEVER = 1 << 20
#: Cost and rows to put in after the last row, by state.
AT_END, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "UA", "A", "")
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Place of a row that is put in after the last one.
LAST = (1 << 63) - 1


def _closed(costs: Sequence[int]) -> tuple[tuple[int, ...], int]:
    """Costs with insertions allowed, less the least of them, which is returned too.

    From the state after a, everything can be done that the start can do, for DELETE more at most (a system
    turn goes), and all that the state after s can do. Dearer costs of these two are never part of a
    cheapest path, and stay so.
    """
    start, after_s, after_u, after_a = costs
    after_u = min(after_u, start + INSERT, after_s + INSERT, after_a + INSERT)
    after_a = min(after_a, after_u + INSERT)
    start = NEVER if start > after_a + DELETE else start
    after_s = NEVER if after_s > after_a else after_s
    least = min(start, after_s, after_u, after_a)
    return tuple(x - least if x < NEVER else NEVER for x in (start, after_s, after_u, after_a)), least


def _consuming(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row: D, K, or u and a for the role given."""
    yield "D", DELETE, state
    if symbol == GONE:
        return
    kind, extra = symbol % 4, TRUNCATED * (symbol // 4)
    if kind == 0 and state == 0:
        yield "K", extra, 1
    elif kind < 3 and kind == (2 if state == 2 else 1):
        yield "K", extra, NEXT[state]
    yield ROLE_DUE[state].lower(), REROLE + extra, NEXT[state]


#: Place of a letter among D, I, K, R.
_ORDER = {"D": 0, "U": 1, "A": 1, "K": 2, "u": 3, "a": 3}


@dataclass(frozen=True)
class Tables:
    """Vectors by number, and what a symbol or a block of symbols makes of each: the next one and the cost."""

    vectors: list[tuple[int, ...]]
    number: dict[tuple[int, ...], int]
    single: list[list[tuple[int, int]]]
    next_of: np.ndarray
    cost_of: np.ndarray


@cache
def tables() -> Tables:
    starts = [_closed([0 if i == s else NEVER for i in STATES])[0] for s in STATES]
    number = {v: i for i, v in enumerate(dict.fromkeys(starts))}
    vectors, single = list(number), []
    while len(single) < len(vectors):
        costs, row = vectors[len(single)], []
        for symbol in range(SYMBOLS):
            after = [NEVER] * 4
            for state in STATES:
                for _, cost, to in _consuming(state, symbol):
                    after[to] = min(after[to], costs[state] + cost)
            after, least = _closed([min(x, NEVER) for x in after])
            if after not in number:
                number[after] = len(vectors)
                vectors.append(after)
            row.append((number[after], least))
        single.append(row)
    steps = np.array(single)
    next_of, cost_of = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), int)
    for _ in range(BLOCK):
        cost_of = (cost_of[:, :, None] + steps[next_of, :, 1]).reshape(len(vectors), -1)
        next_of = steps[next_of, :, 0].reshape(len(vectors), -1)
    return Tables(vectors, number, single, next_of, cost_of)


def _blocks(symbols: Sequence[int]) -> list[tuple[int, ...]]:
    return [tuple(symbols[i : i + BLOCK]) for i in range(0, len(symbols), BLOCK)]


def _through(vector: int, block: tuple[int, ...]) -> tuple[int, int]:
    """The vector after a block, and its cost; what is left over at the end goes by single symbols."""
    t = tables()
    if len(block) == BLOCK:
        code = 0
        for symbol in block:
            code = code * SYMBOLS + symbol
        return int(t.next_of[vector, code]), int(t.cost_of[vector, code])
    total = 0
    for symbol in block:
        vector, cost = t.single[vector][symbol]
        total += cost
    return vector, total


def crossing(symbols: Sequence[int]) -> list[int]:
    """Costs of a chunk from every state (rows) to every state."""
    blocks, t = _blocks(symbols), tables()
    out = []
    for state in STATES:
        vector, total = t.number[_closed([0 if i == state else NEVER for i in STATES])[0]], 0
        for block in blocks:
            vector, cost = _through(vector, block)
            total += cost
        out += [x + total if x < NEVER else NEVER for x in t.vectors[vector]]
    return out


def joints(costs: Sequence[Sequence[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost of a conversation from the tables of its chunks; first vector and end states (as bits) of each."""
    t = tables()
    after = [AT_END]
    for m in reversed(costs):
        after.append(tuple(min(m[4 * s + x] + after[-1][x] for x in STATES) for s in STATES))
    after.reverse()
    total, out = after[0][0], []
    vector, base = _closed([0, NEVER, NEVER, NEVER])
    for k, m in enumerate(costs):
        first = t.number[vector]
        vector, more = _closed([min(min(vector[s] + m[4 * s + x] for s in STATES), NEVER) for x in STATES])
        base += more
        ends = sum(1 << s for s in STATES if vector[s] < NEVER and base + vector[s] + after[k + 1][s] == total)
        out.append((first, ends))
    return total, out


@lru_cache(1 << 16)
def _expanded(vector: int, block: tuple[int, ...], ends: int) -> tuple[int, tuple[tuple[str, int] | None, ...]]:
    """Walk a block backward from its end states: the states it may begin in, and from each its letters and end."""
    t = tables()
    chain = [vector]
    for symbol in block:
        chain.append(t.single[chain[-1]][symbol][0])
    rest: list[tuple[str, int] | None] = [("", s) if ends >> s & 1 else None for s in STATES]
    for at in range(len(block) - 1, -1, -1):
        symbol, costs = block[at], t.vectors[chain[at]]
        least = t.single[chain[at]][symbol][1]
        after = [x + least if x < NEVER else NEVER for x in t.vectors[chain[at + 1]]]

        def best(state: int) -> tuple[str, int] | None:
            if costs[state] == NEVER:
                return None
            found = [
                (letter + rest[to][0], rest[to][1])
                for letter, cost, to in _consuming(state, symbol)
                if rest[to] and costs[state] + cost == after[to]
            ]
            if costs[NEXT[state]] == costs[state] + INSERT and (later := best(NEXT[state])):
                found.append((ROLE_DUE[state] + later[0], later[1]))
            return min(found, key=lambda x: _ORDER[x[0][0]], default=None)

        rest = [best(state) for state in STATES]
    return sum(1 << s for s in STATES if rest[s]), tuple(rest)


def expanded(symbols: Sequence[int], vector: int, ends: int) -> list[tuple[str, int] | None]:
    """Letters and end state of a chunk from every state that a cheapest path may begin it in."""
    blocks = _blocks(symbols)
    firsts = [vector]
    for block in blocks[:-1]:
        firsts.append(_through(firsts[-1], block)[0])
    ways = []
    for block, first in zip(reversed(blocks), reversed(firsts)):
        ends, way = _expanded(first, block, ends)
        ways.append(way)
    ways.reverse()
    out: list[tuple[str, int] | None] = []
    for state in STATES:
        parts = []
        for way in ways:
            if way[state] is None:
                parts = None
                break
            letters, state = way[state]
            parts.append(letters)
        out.append(None if parts is None else ("".join(parts), state))
    return out


def _mapped(df: DataFrame, schema: str, each: Callable[[dict], dict]) -> DataFrame:
    """Rows made from rows, batch by batch."""
    made = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(made)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([each(row) for row in batch.to_pylist()], schema=out)

    return map_arrow(df, run, made)


def _symbol(value: int) -> int:
    kind, fault = value % 4, value // 4
    return GONE if fault in (BLANK, DUPLICATE) else kind + 4 * (fault == CUT)


def _crossed(row: dict) -> dict:
    values = row["values"]
    kinds = [v % 4 for v in values]
    faults = [v // 4 for v in values]
    return {
        "conv": row["conv"],
        "chunk": row["chunk"],
        "costs": crossing([_symbol(v) for v in values]),
        "ends": [kinds[0], kinds[-1]],
        "counts": [
            *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)),
            sum(pair not in LEGAL for pair in zip(kinds, kinds[1:])),
        ],
    }


def _joined(row: dict) -> dict:
    chunks = row["chunks"]
    cost, found = joints([c["costs"] for c in chunks])
    blank, duplicate, truncated, illegal = (sum(c["counts"][i] for c in chunks) for i in range(4))
    illegal += sum((a["ends"][1], b["ends"][0]) not in LEGAL for a, b in zip(chunks, chunks[1:]))
    return {
        "conv": row["conv"],
        "blank": blank,
        "duplicate": duplicate,
        "truncated": truncated,
        "illegal": illegal,
        "cost": cost,
        "joints": [{"chunk": c["chunk"], "vector": v, "ends": e} for c, (v, e) in zip(chunks, found)],
    }


def _opened(row: dict) -> dict:
    ways = expanded([_symbol(v) for v in row["values"]], row["vector"], row["ends"])
    return {
        "conv": row["conv"],
        "chunk": row["chunk"],
        "first": row["first"],
        "ways": [None if w is None else {"letters": w[0], "to": w[1]} for w in ways],
    }


def _read(row: dict) -> dict:
    state, parts = 0, []
    for chunk in row["chunks"]:
        way = chunk["ways"][state]
        parts.append({"first": chunk["first"], "letters": way["letters"]})
        state = way["to"]
    return {"conv": row["conv"], "parts": [*parts, {"first": LAST, "letters": TAIL[state]}]}


@dataclass(frozen=True)
class Repair:
    """found: conv, counts of faults, cost and audit. turns: the repaired rows (conv, at, i, role, text, edit)."""

    found: DataFrame
    turns: DataFrame


def key(conv_id: Column) -> Column:
    """A text for each conversation that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _placed(turns: DataFrame) -> DataFrame:
    """Rows with `at`, which numbers the rows of a conversation upward, and gaplessly within a range of rows."""
    rows = turns.select(
        key(F.col("conv_id")).alias("conv"),
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    # The beginning of the text splits a turn of very many rows, and agrees with the order of the texts.
    dealt = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32))
    placed = dealt.sortWithinPartitions("conv", "turn", "role", "text")
    return stored(placed.withColumn("at", F.monotonically_increasing_id()), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """(conv, at, value): initial and first fault of every row."""
    same = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    own = stored(
        rows.select(
            "conv",
            "at",
            same.alias("same"),
            (F.instr(F.lit(KINDS), F.substring("role", 1, 1)) - 1).alias("kind"),
            (F.col("role") == "").alias("nameless"),
            F.rtrim("text", F.lit(SPACES)).alias("end"),
        ).select(
            "conv",
            "at",
            "same",
            # An empty role, found at the first place, is no initial either.
            F.when((F.col("kind") < 0) | F.col("nameless"), 3).otherwise(F.col("kind")).alias("kind"),
            (F.col("end") == "").alias("blank"),
            (~F.substring("end", -1, 1).isin(".", "!", "?")).alias("cut"),
        ),
        "faults",
    )
    repeats = own.groupBy("conv", "same").agg(F.min("at").alias("earliest"), F.count(F.lit(1)).alias("n"))
    repeats = stored(repeats.where("n > 1").drop("n"), "repeats")
    fault = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("at") > F.col("earliest"), DUPLICATE)
        .when(F.col("cut"), CUT)
        .otherwise(0)
    )
    found = own.join(repeats, ["conv", "same"], "left")
    return found.select("conv", "at", (F.col("kind") + 4 * fault).cast("int").alias("value"))


def _chunks(values: DataFrame) -> DataFrame:
    """(conv, chunk, first, values): consecutive rows of a conversation in order."""
    chunk = F.shiftright("at", CHUNK_BITS)
    gathered = values.groupBy("conv", chunk.alias("chunk")).agg(
        F.min("at").alias("first"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("rows")
    )
    return stored(gathered.select("conv", "chunk", "first", F.col("rows.value").alias("values")), "chunks")


def _per_conversation(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("chunk", *columns))).alias("chunks"))


def _edited(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The repaired rows, from the letters of the chunks."""
    one = F.regexp_extract_all(F.col("letters"), F.lit("[UA]*[DKua]|[UA]+$"), F.lit(0))
    letters = parts.select("conv", "first", F.posexplode(one).alias("i", "edits"))
    edits = letters.select("conv", (F.col("first") + F.col("i")).alias("at"), "edits")
    joined = edits.join(rows.select("conv", "at", "role", "text"), ["conv", "at"], "left")

    def turn(role: Column | str, text: Column | str, edit: str) -> Column:
        value = {"role": role, "text": text, "edit": F.lit(edit)}
        return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in value.items()))

    def made(letter: Column) -> Column:
        return (
            F.when(letter == "U", turn("user", "", "I"))
            .when(letter == "A", turn("assistant", "", "I"))
            .when(letter == "K", turn(F.col("role"), F.col("text"), "K"))
            .when(letter == "u", turn("user", F.col("text"), "R"))
            .when(letter == "a", turn("assistant", F.col("text"), "R"))
        )

    turns = F.transform(F.regexp_extract_all(F.col("edits"), F.lit("."), F.lit(0)), made)
    out = joined.select("conv", "at", F.posexplode(F.filter(turns, lambda x: x.isNotNull())).alias("i", "turn"))
    return out.select("conv", "at", "i", "turn.*")


def repair(rows: DataFrame) -> Repair:
    """Cheapest edits of conversations in placed rows (conv, at, role, text)."""
    chunks = _chunks(_faults(rows))
    crossed = _mapped(
        chunks, "conv string, chunk long, costs array<int>, ends array<int>, counts array<long>", _crossed
    )
    counts = "blank long, duplicate long, truncated long, illegal long, cost long"
    known = stored(
        _mapped(
            _per_conversation(crossed, "costs", "ends", "counts"),
            f"conv string, {counts}, joints array<struct<chunk:long,vector:int,ends:int>>",
            _joined,
        ),
        "joints",
    )
    opened = _mapped(
        chunks.join(known.select("conv", F.inline("joints")), ["conv", "chunk"]),
        "conv string, chunk long, first long, ways array<struct<letters:string,to:int>>",
        _opened,
    )
    way = "conv string, parts array<struct<first:long,letters:string>>"
    read = stored(_mapped(_per_conversation(opened, "first", "ways"), way, _read), "letters")
    letters = F.array_join(F.transform("parts", lambda x: x["letters"]), "")
    audit = read.select("conv", F.translate(letters, "uaUA", "RRII").alias("audit"))
    parts = read.select("conv", F.inline("parts"))
    return Repair(known.drop("joints").join(audit, "conv"), _edited(rows, parts))


def _sequence_hash(turns: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) over role:text of the turns in order, read once in sequence."""
    lines = turns.select("conv", "at", "i", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "at", "i").select("conv", "line")
    schema = T.StructType.fromDDL("conv string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done = []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own == conv:
                    digest.update(b"\n")
                else:
                    if conv is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256()
                digest.update(line.encode())
            yield _pairs(done)
        if conv is not None:
            yield _pairs([(conv, digest.hexdigest())])

    def _pairs(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=schema.names
        )

    return map_arrow(lines, run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in, which the checksum of conv_id and turn chooses."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    choice = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(choice == 1, "").when(choice == 2, F.regexp_replace(shown("text"), "[.!?]", ""))
    copies = F.when(choice == 0, 0).when(choice == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(choice == 4, "user").otherwise(shown("role")).alias("role"),
        text.otherwise(shown("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def audit(conversations: DataFrame) -> DataFrame:
    """Faults, cost, edits and hash of the repaired rows of every conversation, after damage."""
    rows = _placed(damaged(conversations))
    fixed = repair(rows)
    turns = rows.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")
    )
    every = conversations.select("conv_id", key(F.col("conv_id")).alias("conv")).distinct()
    joined = every.join(turns, "conv", "left").join(fixed.found, "conv", "left")
    joined = joined.join(_sequence_hash(fixed.turns), "conv", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        "conv_id",
        *(F.coalesce(F.col(c).cast("long"), F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _sql_best(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _sql_way(state: str, cost: str, letter: str, line: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'lines': {state}.lines || {line}}} END"


def _sql_inserted(due: str, *states: str) -> str:
    role = {"u": "user:", "a": "assistant:"}[due]
    return _sql_best(*(_sql_way(s, str(INSERT), "I", f"['{role}']") for s in states))


def sql() -> str:
    """DuckDB SQL for audit: the cheapest ways to each state, row by row, ties by the letters so far.

    Of two ways to one place neither's letters can begin the other's, as an insertion costs; so the
    lesser beginning stays the lesser whatever follows.
    """
    last = {s: f"r.s{s}" for s in STATES}
    gone, kind, extra = "o.fault IN (1, 2)", "o.kind", f"CASE WHEN o.fault = 3 THEN {TRUNCATED} ELSE 0 END"

    def kept(state: int, of: str) -> str:
        way = _sql_way(last[state], f"({extra})", "K", "[o.role || ':' || o.text]")
        return f"CASE WHEN NOT {gone} AND {kind} = '{of}' THEN {way} END"

    def given(state: int, due: str) -> str:
        role = {"u": "user:", "a": "assistant:"}[due]
        way = _sql_way(last[state], f"{REROLE} + ({extra})", "R", f"['{role}' || o.text]")
        return f"CASE WHEN NOT {gone} THEN {way} END"

    def deleted(state: int) -> str:
        return _sql_way(last[state], str(DELETE), "D", "[]::VARCHAR[]")

    after_u = [x for s in (0, 1, 3) for x in (kept(s, "u"), given(s, "u"))]
    steps = {
        0: [deleted(0)],
        1: [deleted(1), kept(0, "s")],
        2: [deleted(2), *after_u],
        3: [deleted(3), kept(2, "a"), given(2, "a")],
    }
    start = "{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}"
    way = "STRUCT(cost INTEGER, audit VARCHAR, lines VARCHAR[])"
    return f"""
WITH RECURSIVE bytes AS (
    SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
    FROM (SELECT unnest(range(0, 256)) AS b)
), chosen AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(4294967295, list_reduce([4294967295] || list_transform(
               string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x:
               ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) % 20 AS choice
    FROM conversations, bytes
), damaged AS (
    SELECT conv_id, turn, CASE WHEN choice = 4 THEN 'user' ELSE role END AS role,
           CASE choice WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE choice WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM chosen)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS at_row,
           left(role, 1) AS kind, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM damaged
), faulty AS MATERIALIZED (
    SELECT *, CASE WHEN bare = '' THEN 1
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY at_row) > 1 THEN 2
                   WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
           lag(kind) OVER (PARTITION BY conv_id ORDER BY at_row) || kind AS pair
    FROM placed
), walked AS (
    SELECT conv_id, 0::BIGINT AS at_row, {start}::{way} AS s0, NULL::{way} AS s1,
           {{'cost': {INSERT}, 'audit': 'I', 'lines': ['user:']}}::{way} AS s2,
           {{'cost': {2 * INSERT}, 'audit': 'II', 'lines': ['user:', 'assistant:']}}::{way} AS s3
    FROM (SELECT DISTINCT conv_id FROM faulty)
    UNION ALL
    SELECT conv_id, at_row, s0, s1, s2, {_sql_best("s3", _sql_inserted("a", "s2"))}::{way}
    FROM (
        SELECT conv_id, at_row, s0, s1, {_sql_best("s2", _sql_inserted("u", "s0", "s1", "s3"))}::{way} AS s2, s3
        FROM (
            SELECT r.conv_id, o.at_row,
                   {", ".join(f"{_sql_best(*steps[s])}::{way} AS s{s}" for s in STATES)}
            FROM walked r JOIN faulty o ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.at_row = r.at_row + 1
        )
    )
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, max(at_row) AS n,
           count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
           count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faulty GROUP BY conv_id
), ended AS (
    SELECT c.*, {_sql_best("s0", "s3")} AS best
    FROM counted c JOIN walked w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.at_row = c.n
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
