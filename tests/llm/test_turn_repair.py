import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from coursepulse.llm import turn_repair as t

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()


def rows_of(symbols):
    """(initial, truncated or None if it must go) of row symbols."""
    return [("x", None) if s == t.GONE else ("suax"[s % 4], s >= 4) for s in symbols]


def all_edits(symbols):
    """Every row of edits that ends in a sound conversation, as (cost, letters); at most two insertions at a place."""
    rows = rows_of(symbols)
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    uses = []
    for initial, cut in rows:
        own = [("D", "", 2)]
        if cut is not None:
            own += [("K", initial, 5 * cut), ("R", "u", 1 + 5 * cut), ("R", "a", 1 + 5 * cut)]
        uses.append(own)
    for chosen in itertools.product(*uses):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            letters, initials, cost = "", "", 0
            for i in range(len(rows) + 1):
                letters, initials, cost = letters + "I" * len(put[i]), initials + "".join(put[i]), cost + 5 * len(put[i])
                if i < len(rows):
                    letters, initials, cost = letters + chosen[i][0], initials + chosen[i][1], cost + chosen[i][2]
            if re.fullmatch("(s?(ua)+)?", initials):
                yield cost, letters


def by_rows(symbols):
    """Least (cost, letters) by one pass over rows, state by state."""
    best = {0: (0, "")}

    def put_in(best):
        for state, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if state in best:
                way = (best[state][0] + 5, best[state][1] + "I")
                best[to] = min(best.get(to, way), way)
        return best

    best = put_in(best)
    for initial, cut in rows_of(symbols):
        after = {}

        def offer(state, cost, letter, to):
            way = (best[state][0] + cost, best[state][1] + letter)
            after[to] = min(after.get(to, way), way)

        for state in best:
            offer(state, 2, "D", state)
            if cut is None:
                continue
            due = "a" if state == 2 else "u"
            to = 3 if state == 2 else 2
            offer(state, 1 + 5 * cut, "R", to)
            if initial == due:
                offer(state, 5 * cut, "K", to)
            if initial == "s" and state == 0:
                offer(state, 5 * cut, "K", 1)
        best = put_in(after)
    return min(best[s] for s in (0, 3) if s in best)


def repaired(symbols, pieces):
    """Cost and letters as the operator finds them, the rows cut into pieces."""
    cuts = [symbols[a:b] for a, b in zip([0, *pieces], [*pieces, len(symbols)]) if a < b]
    cost, found = t.joints([t.crossing(c) for c in cuts])
    state, letters = 0, ""
    for chunk, (vector, ends) in zip(cuts, found):
        way = t.expanded(chunk, vector, ends)[state]
        letters, state = letters + way[0], way[1]
    return cost, (letters + t.TAIL[state]).translate(str.maketrans("uaUA", "RRII"))


def test_all_edits_of_short_rows():
    for n in range(3):
        for symbols in itertools.product(range(t.SYMBOLS), repeat=n):
            expected = min(all_edits(symbols))
            assert by_rows(symbols) == expected
            assert (repaired(symbols, []) if n else (0, "")) == expected, symbols


def test_blocks_and_chunks_against_single_rows():
    rnd = random.Random(5)
    for _ in range(1500):
        n = rnd.randint(1, 40)
        few = rnd.sample(range(t.SYMBOLS), rnd.randint(1, 5))
        symbols = [rnd.choice(few) for _ in range(n)]
        pieces = sorted(rnd.sample(range(1, n), min(n - 1, rnd.randint(0, 6))))
        assert repaired(symbols, pieces) == by_rows(symbols), (symbols, pieces)


def test_the_tables_hold_every_block():
    tables = t.tables()
    assert tables.next_of.shape == (len(tables.vectors), t.SYMBOLS**t.BLOCK) and len(tables.vectors) < 100
    rnd = random.Random(6)
    for _ in range(300):
        vector, block = rnd.randrange(len(tables.vectors)), tuple(rnd.choices(range(t.SYMBOLS), k=t.BLOCK))
        at, total = vector, 0
        for symbol in block:
            at, cost = tables.single[at][symbol]
            total += cost
        assert t._through(vector, block) == (at, total)


def conversations(spark):
    rnd = random.Random(7)
    texts = ["Yes.", "No!", "Why?", "an open end", "", " \t", "A. b", "é?", "\x0b.\x0c", None, "line\nline."]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rnd.randint(0, 14)):
            number = rnd.choice([turn, turn, turn, turn + 1, None])
            role = rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "ux"])
            rows.append((conv, number, role, rnd.choice([*texts, f"{turn}.", f"{turn} {rnd.random()}!"])))
    rows += [(500, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(90)]
    rows += [(501, None, "user", "same.")] * 40 + [(502, 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain(rows):
    """The contract's result for one conversation's rows before damage."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        shown = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        choice = zlib.crc32(shown.encode()) % 20
        text = "" if choice == 1 else re.sub("[.!?]", "", text) if choice == 2 else text
        kept += [(turn, "user" if choice == 4 else role, text)] * {0: 0, 3: 2}.get(choice, 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    if not kept:
        return (0, 0, 0, 0, 0, 0, "", EMPTY)
    turns = [r[0] for r in kept if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen, symbols = [], set(), []
    for _, role, text in kept:
        bare = text.rstrip(SPACE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(fault)
        kind = "sua".index(role[0]) if role[:1] in tuple("sua") else 3
        symbols.append(t.GONE if fault in (1, 2) else kind + 4 * (fault == 3))
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    cost, letters = by_rows(symbols)
    out, due, at = [], "u", 0
    for letter in letters:
        role, text = kept[at][1:] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter in "IR":
            role = {"u": "user", "a": "assistant"}[due]
        out.append(f"{role}:{text}")
        due = "a" if role[:1] == "u" else "u"
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, letters, digest)


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("bits", [t.CHUNK_BITS, 2])
def test_against_a_plain_version(spark, monkeypatch, bits):
    monkeypatch.setattr(t, "CHUNK_BITS", bits)
    given = conversations(spark)
    rows = {}
    for r in given.collect():
        rows.setdefault(r.conv_id, []).append(tuple(r))
    found = {r.conv_id: tuple(r[c] for c in NAMES) for r in t.audit(given).collect()}
    assert set(found) == set(rows)
    for conv, own in rows.items():
        assert found[conv] == plain(own), conv


def test_sql_agrees_where_rows_of_a_turn_differ(spark, tmp_path):
    given = conversations(spark)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [tuple(r) for r in given.collect()])
    expected = con.execute(t.sql())
    names = [c[0] for c in expected.description]
    ours = t.audit(given).select(names)
    assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r)) for r in ours.collect())


def test_repaired_turns_are_sound(spark):
    given = conversations(spark)
    turns = t.repair(t._placed(given)).turns
    by_conv = {}
    for r in turns.orderBy("conv", "at", "i").collect():
        by_conv[r.conv] = by_conv.get(r.conv, "") + r.role[:1]
    assert by_conv and all(re.fullmatch("s?(ua)+", x) for x in by_conv.values())
    # At these costs a deletion mends what an insertion would.
    assert {r.edit for r in turns.select("edit").distinct().collect()} == {"K", "R"}


def test_empty_table_and_other_columns(spark):
    given = conversations(spark)
    assert t.audit(given.where("conv_id = -1")).collect() == []
    clashing = given.where("conv_id < 9").select(
        "*", *(F.lit("own").alias(c) for c in ("conv", "at", "first", "chunk", "audit", "cost", "letters", "gaps"))
    )
    rows = sorted(map(str, t.audit(given.where("conv_id < 9")).collect()))
    assert sorted(map(str, t.audit(clashing).collect())) == rows


def test_a_long_text(spark):
    text = "word " * 400_000 + "."
    given = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text + "\n")], SCHEMA)
    row = t.audit(given).first()
    assert tuple(row[c] for c in NAMES) == plain([tuple(r) for r in given.collect()])
