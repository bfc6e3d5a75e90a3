"""Repair of conversation structure: the cheapest edit script, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows consumed, state); a state is what the repaired conversation ends with: nothing, system,
user, assistant. Keep, Rerole and Delete consume a row, Insert does not. The forward heap starts at (0, nothing), the
reverse heap at the ends (n, nothing) and (n, assistant); the one with the smaller top moves. When the tops together exceed
the best crossing, every crossing edge of that cost is looked at, and the least concatenated audit wins. Of the scripts that lead
to one node at one cost only the least need be kept: two of them that consume the same rows differ at some
place (one that only went on with inserts would cost more), so what is appended to both never changes their order.

Long conversations are contracted: CHUNK rows become one step of the lattice (the best script for each pair of states), FAN
of those steps one step again. Conversations are ordered by range over all tasks, so one that holds a large share of all
rows is cut between tasks, each of which contracts its part; only contracted parts meet.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import broadcast_few, materialise

START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of a search, steps of a later one, and characters of one conversation that a task holds to hash its repair.
CHUNK, FAN, HELD = 64, 8, 1 << 24
#: Characters by which texts of one turn and role are ordered before their MD5.
LEFT = 64

#: (from state, to state, cost, audit)
Edge = tuple[int, int, int, str]
Step = tuple[Edge, ...]

#: State after a user or an assistant turn, by the state before it; others allow no such turn.
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_INSERTS: Step = tuple((s, t, INSERT, "I") for s, t in _NEXT.items())


@lru_cache(maxsize=4096)
def row_step(initial: str, truncated: bool, gone: bool, copies: int) -> Step:
    """Edges of a row that occurs `copies` times in a row; all but the first copy are deleted, the first too if gone."""
    last = copies if gone else copies - 1
    edges = [(s, s, DELETE * copies, "D" * copies) for s in range(4)]
    if not gone:
        extra, tail = TRUNCATED * truncated, "D" * last
        kept = {"s": {START: SYSTEM}, "u": {s: t for s, t in _NEXT.items() if t == USER}, "a": {USER: ASSISTANT}}.get(initial, {})
        edges += [(s, t, KEEP + extra + DELETE * last, "K" + tail) for s, t in kept.items()]
        edges += [(s, t, REROLE + extra + DELETE * last, "R" + tail) for s, t in _NEXT.items()]
    return tuple(edges)


def search(steps: tuple[Step, ...], start: int = START, ends: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest path from (0, start) to (n, end) for any end; None if there is none."""
    n = len(steps)
    if not n and start in ends:
        return 0, ""
    after: list[list[list[tuple[int, int, int, str]]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    before: list[list[list[tuple[int, int, int, str]]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    for i in range(n + 1):
        for j, step in ((i, _INSERTS), (i + 1, steps[i] if i < n else ())):
            for s, t, cost, audit in step:
                after[i][s].append((j, t, cost, audit))
                before[j][t].append((i, s, cost, audit))
    far = {(0, start): (0, "")}
    near = {(n, t): (0, "") for t in ends}
    ahead, behind = [(0, 0, start)], [(0, -n, t) for t in ends]
    done, met = set(), set()
    best = min((near[k][0] + far[k][0] for k in far if k in near), default=None)
    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best):
        if ahead[0][0] <= behind[0][0]:
            cost, i, s = heapq.heappop(ahead)
            if (i, s) in done:
                continue
            done.add((i, s))
            audit = far[i, s][1]
            for j, t, more, label in after[i][s]:
                own, old = (cost + more, audit + label), far.get((j, t))
                if old is None or own < old:
                    far[j, t] = own
                    heapq.heappush(ahead, (own[0], j, t))
                if (j, t) in near and (best is None or own[0] + near[j, t][0] < best):
                    best = own[0] + near[j, t][0]
        else:
            cost, i, s = heapq.heappop(behind)
            i = -i
            if (i, s) in met:
                continue
            met.add((i, s))
            audit = near[i, s][1]
            for j, t, more, label in before[i][s]:
                own, old = (cost + more, label + audit), near.get((j, t))
                if old is None or own < old:
                    near[j, t] = own
                    heapq.heappush(behind, (own[0], -j, t))
                if (j, t) in far and (best is None or own[0] + far[j, t][0] < best):
                    best = own[0] + far[j, t][0]
    if best is None:
        return None
    # whatever the two sides have met at is a script of its cost; all that could be least are among those of the settled nodes
    found = [
        far[i, s][1] + label + near[j, t][1]
        for i, s in done
        for j, t, more, label in after[i][s]
        if (j, t) in near and far[i, s][0] + more + near[j, t][0] == best
    ]
    found += [far[k][1] + near[k][1] for k in done | met if k in far and k in near and far[k][0] + near[k][0] == best]
    return best, min(found)


def contract(steps: tuple[Step, ...]) -> Step:
    """One step that stands for several: for each pair of states the cheapest script with its least audit."""
    found = ((s, t, search(steps, s, (t,))) for s in range(4) for t in range(4))
    return tuple((s, t, *r) for s, t, r in found if r is not None)


@lru_cache(maxsize=1 << 14)
def _short(steps: tuple[Step, ...]) -> tuple[int, str]:
    return search(steps)


@dataclass
class Part:
    """A run of rows of one conversation: what is counted, and its steps, contracted as they come."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None
    levels: list[list[Step]] = field(default_factory=lambda: [[]])

    def add_step(self, step: Step) -> None:
        own, level = step, 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(own)
            if len(self.levels[level]) <= (FAN if level else CHUNK):
                return
            own = contract(tuple(self.levels[level]))
            self.levels[level] = []
            level += 1

    @property
    def steps(self) -> tuple[Step, ...]:
        return tuple(s for level in reversed(self.levels) for s in level)

    def follow(self, other: Part) -> None:
        """Append what comes after this part (a row is a part too)."""
        if self.first is None:
            self.first = other.first
        elif other.first is not None:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        self.last = other.last if other.last is not None else self.last
        self.turns += other.turns - (other.low is not None and other.low == self.high)
        self.low = other.low if self.low is None else self.low
        self.high = other.high if other.high is not None else self.high
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else int(self.high - self.low) + 1 - self.turns

    def solved(self) -> tuple[int, str]:
        steps = self.steps
        return _short(steps) if len(self.levels) == 1 else search(steps)


def row_part(turn, role: str, copies: int, blank: bool, truncated: bool, repeated: bool) -> tuple[Part, Step]:
    initial = role[:1]
    gone = blank or repeated
    part = Part(
        blank=copies if blank else 0, duplicate=0 if blank else copies - (not repeated), truncated=int(truncated and not gone), illegal=copies - 1,
        turns=int(turn is not None), low=turn, high=turn, first=initial, last=initial,
    )
    return part, row_step(initial, truncated, gone, copies)


class Repaired:
    """SHA-256 of the repaired conversation, as rows (role, text, copies) come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.some = audit, 0, START, hashlib.sha256(), False

    def _say(self, line: str) -> None:
        self.hash.update((("\n" if self.some else "") + line).encode("utf-8", "surrogatepass"))
        self.some = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = _NEXT[self.state]
            self._say("user:" if self.state == USER else "assistant:")
            self.at += 1

    def row(self, role: str, text: str, copies: int) -> None:
        for _ in range(copies):
            self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = SYSTEM if role[0] == "s" else _NEXT[self.state]
                self._say(f"{role}:{text}")
            elif edit == "R":
                self.state = _NEXT[self.state]
                self._say(("user:" if self.state == USER else "assistant:") + text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
_PARTS = "part int, whole boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string, turns bigint, low bigint, high bigint, first string, last string, edges array<struct<s:int,t:int,cost:bigint,audit:string>>"


def _parts(held: int):
    """Rows sorted by conversation and turn to one line for each conversation of a task.

    A task's first and last conversations may go on in other tasks, and those of over `held` characters are not hashed
    here; their lines have `whole` false and the contracted edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        number, seen = TaskContext.get().partitionId(), 0
        conv, part, rows, size = None, None, None, 0

        def flush(inner: bool) -> None:
            own = (part.blank, part.duplicate, part.truncated, part.illegal)
            if inner and rows is not None:
                cost, audit = part.solved()
                said = Repaired(audit)
                for r in rows:
                    said.row(*r)
                out.append((conv, number, True, part.gaps, *own, cost, audit, said.digest(), part.turns, part.low, part.high, part.first, part.last, None))
            else:
                edges = [{"s": s, "t": t, "cost": c, "audit": a} for s, t, c, a in contract(part.steps)]
                out.append((conv, number, False, 0, *own, 0, "", "", part.turns, part.low, part.high, part.first, part.last, edges))

        for batch in batches:
            for key, turn, role, text, copies, blank, truncated, repeated in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None or key != conv:
                    if part is not None:
                        flush(seen > 1)
                    conv, part, rows, size, seen = key, Part(), [], 0, seen + 1
                own, step = row_part(turn, role, copies, blank, truncated, repeated)
                part.follow(own)
                part.add_step(step)
                size += len(text)
                if size > held:
                    rows = None
                if rows is not None:
                    rows.append((role, text, copies))
            if out:
                yield _table(out, batch.schema.field(0).type)
                out.clear()
        if part is not None:
            flush(False)
            yield _table(out, batch.schema.field(0).type)

    return run


_EDGES = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_TYPES = [pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.string(), _EDGES]
_NAMES = ["conv", *(x.split(" ")[0] for x in _PARTS.split("array")[0].split(", "))]


def _table(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [conv_type, *_TYPES])], _NAMES)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of cut conversations, sorted by conversation and task, to one solved line for each."""
    conv, part, kind = None, None, None

    def solved() -> pa.RecordBatch:
        cost, audit = part.solved()
        row = (conv, 0, True, part.gaps, part.blank, part.duplicate, part.truncated, part.illegal, cost, audit, None, part.turns, part.low, part.high, part.first, part.last, None)
        return _table([row], kind)

    for batch in batches:
        kind = batch.schema.field(0).type
        for row in batch.to_pylist():
            if part is None or row["conv"] != conv:
                if part is not None:
                    yield solved()
                conv, part = row["conv"], Part(levels=[[], []])
            part.follow(Part(**{k: row[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")}))
            part.levels[1].append(tuple((e["s"], e["t"], e["cost"], e["audit"]) for e in row["edges"]))
            if len(part.levels[1]) > FAN:
                part.levels[1] = [contract(tuple(part.levels[1]))]
    if part is not None:
        yield solved()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) from rows sorted by conversation; the first row of each brings the audit as its text."""
    conv, said, kind = None, None, None
    for batch in batches:
        kind, out = batch.schema.field(0).type, []
        for key, is_row, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if not is_row:
                if said is not None:
                    out.append((conv, said.digest()))
                conv, said = key, Repaired(text)
            else:
                said.row(role, text, copies)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out])], ["conv", "repaired_sha256"])
    if said is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([said.digest()])], ["conv", "repaired_sha256"])


def spoken(text: Column) -> Column:
    """text without the spaces at its end."""
    return F.rtrim(text, F.lit(SPACES))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns after damage by crc32("conv:turn") % 20: 0 drops the row, 1 empties its text, 2 removes its end marks
    (.!?), 3 repeats it, 4 makes the user speak. Nulls of the key, role and text are one space."""

    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", said(conv_col), said(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    rows = turns.select(
        F.col(conv_col), F.col(turn_col), F.when(kind == 4, "user").otherwise(said(role_col)).alias(role_col), text.alias(text_col), F.when(kind == 3, 2).otherwise(1).alias("_times"), kind.alias("_kind"),
    )
    return rows.where("_kind <> 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).drop("_times", "_kind", "_copy")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, null turns first; rows of one turn by role, the first 64 characters of the text and its MD5. Null roles and texts
    are one space, which no repaired role can be, and an empty role has no initial: such rows are reroled or deleted. Rows that
    repeat are duplicates. A null id is a conversation. Texts are read whole. An empty table gives an empty
    result. Columns other than the four named ones are not read, so their names do not matter. Turns are whole numbers.
    SHA-256 reads a conversation's repaired text in order, so that text passes through one task (not held there).
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    same = ["conv", "turn", "role", "text"]
    end = spoken(F.col("text"))
    rows = materialise(rows.groupBy(*same).agg(F.count("*").alias("copies")).select(
        *same, "copies", F.md5("text").alias("md5"), (end == "").alias("blank"), ((end != "") & ~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"),
    ))
    # Rows whose role and text an earlier turn has.
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = rows.groupBy("conv", "role", "md5").agg(F.count("*").alias("n"), F.min(place).alias("at")).where("n > 1").select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("md5").alias("_md5"), "at")
    again = broadcast_few(materialise(again))
    told = rows.join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("md5") == F.col("_md5")), "left")
    told = told.withColumn("repeated", F.coalesce(F.col("at") < place, F.lit(False))).withColumn("left", F.left("text", F.lit(LEFT))).drop("_conv", "_role", "_md5", "at")
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "left", "md5")]
    sorted_rows = told.repartitionByRange(*order).sortWithinPartitions(*order)
    conv_type = rows.schema["conv"].dataType.simpleString()
    lines = materialise(sorted_rows.select(*same, "copies", "blank", "truncated", "repeated").mapInArrow(_parts(held), f"conv {conv_type}, {_PARTS}"))

    # Conversations that were cut: their parts meet contracted, then their rows pass once more to be hashed.
    merged = materialise(lines.where("not whole").repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part").mapInArrow(_merge, f"conv {conv_type}, {_PARTS}"))
    cut = broadcast_few(merged.select(F.col("conv").alias("_conv")))
    texts = told.join(cut, F.col("conv").eqNullSafe(F.col("_conv")), "left_semi").select("conv", F.lit(True).alias("is_row"), "turn", "role", "left", "md5", "text", "copies")
    audits = merged.select("conv", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("left"), F.lit("").alias("md5"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"))
    stream = audits.unionByName(texts).repartition("conv").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv", "is_row", "turn", "role", "left", "md5")])
    hashed = stream.select("conv", "is_row", "role", "text", "copies").mapInArrow(_hash, f"conv {conv_type}, repaired_sha256 string").withColumnRenamed("conv", "_conv")
    merged = merged.drop("repaired_sha256").join(hashed, F.col("conv").eqNullSafe(F.col("_conv")))
    out = ["conv", *COUNTS, "cost", "audit", "repaired_sha256"]
    return lines.where("whole").select(*out).unionByName(merged.select(*out)).withColumnRenamed("conv", conv_col)


def damaged_and_repaired(turns: DataFrame, conv_col: str = "conv_id", **names: str) -> DataFrame:
    """repair() of damage() for every conversation of turns; those without a row left have zeros and empty texts."""
    every = turns.select(F.col(conv_col).alias("_every")).distinct()
    found = repair(damage(turns, conv_col, **names), conv_col, **names)
    joined = every.join(found, F.col("_every").eqNullSafe(F.col(conv_col)), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in [*COUNTS, "cost"]]
    return joined.select(
        F.col("_every").alias(conv_col), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
