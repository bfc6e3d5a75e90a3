import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from toroid.llm.structure import CHUNK, Part, contract, damage, damaged_and_repaired, repair, row_step, search

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """Faults of (role, text) rows in order: blank, duplicate, truncated or None."""
    seen, out = set(), []
    for row in rows:
        said = SPACE.findall(row[1])
        out.append("blank" if not said else "duplicate" if row in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add(row)
    return out


def plain(rows):
    """Cost, audit and repaired lines by trying every script: a table of least (cost, audit, lines) by row and by output."""
    kinds = faults(rows)
    best = {"": (0, "", ())}
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def put(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(4):
            for state, (cost, audit, lines) in list(table.items()):
                put(table, step[state], (cost + 2, audit + "I", (*lines, ("user:" if step[state] == "u" else "assistant:"))))
        return table

    best = inserted(best)
    for (role, text), kind in zip(rows, kinds):
        new = {}
        for state, (cost, audit, lines) in best.items():
            put(new, state, (cost + 3, audit + "D", lines))
            if kind not in ("blank", "duplicate"):
                extra = int(kind == "truncated")
                initial = role[:1]
                if state in {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}.get(initial, ()):
                    put(new, initial, (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                put(new, step[state], (cost + 2 + extra, audit + "R", (*lines, ("user:" if step[state] == "u" else "assistant:") + text)))
        best = inserted(new)
    return min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])


def counted(rows, turns):
    kinds = faults(rows)
    turns = [t for t in turns if t is not None]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
    )


def expected(rows):
    """All output columns for the (turn, role, text) rows of a conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    said = [r[1:] for r in rows]
    cost, audit, lines = plain(said)
    return (*counted(said, [r[0] for r in rows]), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def lattice(rows):
    return tuple(row_step(r[0][:1], k == "truncated", k in ("blank", "duplicate"), 1) for r, k in zip(rows, faults(rows)))


ROLES, TEXTS = ["system", "user", "assistant", "tool", ""], ["a.", "b", "", " \t", "c!", "d?  ", "e. f"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(TEXTS)), max_size=12))
def test_search_finds_the_least_of_the_cheapest_scripts(rows):
    cost, audit, lines = plain(rows)
    assert search(lattice(rows)) == (cost, audit)
    assert LEGAL.fullmatch("".join(line[:1] for line in lines))


def test_no_script_of_any_length_is_cheaper_or_less():
    """Every string of edits up to a length, applied to the letter."""
    rng = random.Random(4)
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    for _ in range(60):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(0, 3))]
        kinds, found = faults(rows), []
        for size in range(7):
            for audit in itertools.product("DIKR", repeat=size):
                if size - audit.count("I") != len(rows):
                    continue
                out, state, cost, at = "", "", 0, 0
                for edit in audit:
                    if edit == "I":
                        cost, state = cost + 2, step[state]
                        out += state
                        continue
                    kind, role, at = kinds[at], rows[at][0], at + 1
                    if edit == "D":
                        cost += 3
                        continue
                    cost += (kind == "truncated") + 2 * (edit == "R") + 1000 * (kind in ("blank", "duplicate") or not role and edit == "K")
                    state = (role[:1] or "?") if edit == "K" else step.get(state, "?")
                    state = state if state in step else "?"
                    out += state
                    if state == "?":
                        break
                if cost < 1000 and LEGAL.fullmatch(out):
                    found.append((cost, "".join(audit)))
        assert search(lattice(rows)) == min(found)


def test_contracted_conversations_give_the_same_script():
    rng = random.Random(5)
    for size in (CHUNK, CHUNK + 1, 300, 1500):
        rows = [(rng.choice(ROLES[:4]), rng.choice(["x.", "y", ""]) + str(rng.randint(0, 10**6)) + rng.choice(["", ".", "!"])) for _ in range(size)]
        part = Part()
        for step in lattice(rows):
            part.add_step(step)
        assert part.solved() == plain(rows)[:2]
        assert max(map(len, part.levels)) <= CHUNK + 1
    halves = tuple(contract(lattice(rows)[a:b]) for a, b in ((0, 40), (40, 41), (41, 100)))
    assert search(halves) == search(lattice(rows)[:100])


def got(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_conversations_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(ROLES), rng.choice(TEXTS)) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"turn {t % 700}{'.' * (t % 3)}") for t in range(1500)]  # spans several tasks
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    wanted = {c: expected([(t, r, x) for k, t, r, x in rows if k == c]) for c in {r[0] for r in rows}}
    assert got(repair(df)) == wanted
    assert got(repair(df, held=50)) == wanted  # hashed in a second pass


def test_damage_and_conversations_that_vanish(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(ROLES[:3]), rng.choice(["one. two? three!", "x", "é. ", None])) for c in range(80) for t in range(rng.randint(1, 4))] + [(c, 0, "user", "x") for c in range(80, 160)]
    rows += [(None, None, None, None), (7, None, None, "a."), (900, 0, "user", "z" * 300_000 + "."), (900, 1, "assistant", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, cost int")
    damaged = {}
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged.setdefault(c, []).extend([] if kind == 0 else [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    assert any(not v for v in damaged.values())
    assert got(damaged_and_repaired(df)) == {c: expected(v) for c, v in damaged.items()}
    assert damage(df).count() == sum(map(len, damaged.values()))


def test_a_hot_conversation_with_repeats_is_split(spark):
    rows = [(5, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(3000)] + [(5, None, "user", "again.")] * 400 + [(c, 0, "user", "hi.") for c in range(6, 200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert got(repair(df))[5] == expected([r[1:] for r in rows if r[0] == 5])


@pytest.mark.parametrize("f", [repair, damaged_and_repaired])
def test_an_empty_table_gives_an_empty_result(spark, f):
    out = f(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
