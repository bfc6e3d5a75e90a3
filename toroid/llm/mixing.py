"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Each document of a source is to be taken rate = target / size of source times. The whole part is certain; the fraction p
is rounded by pivotal steps on pairs: words of expected mass move from one unit to the other at random until one of them
is 0 or 1. A unit that may gain g or lose l words gains with chance l / (g + l), so no document's expectation and no
source's expected words ever change, whatever the sizes and fractions.

All documents of a source start with one p, so any set of them can be the other unit of a step: what the set gains or
loses it shares in proportion to size, which leaves its members with one p again. That is used twice. First the few
documents that hold over 1 / GIANT of their source are decided, from large to small, each against all that is smaller.
Then the others are dealt at random into blocks of bounded size, and in each block the largest is decided against
the rest, the next against what is left, until one document is undecided. Those residuals have different p and are combined
pair by pair in a reduction tree, until a source has one undecided document, which is a small one. It is rounded to what is
nearer to the target; that is the only decision that can move an expectation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from toroid.llm.common import WORD, materialise

#: Documents in a block (on average), and the share of its source above which a document is decided before blocks are dealt.
BLOCK = 128
GIANT = 1000
#: What an item of the tree carries: p is its fraction, whole its certain copies.
FIELDS = ["key", "size", "p", "whole", "id", "source", "source_size", "target"]
#: Columns that take() adds to documents.
DECIDED = ("size", "source_size", "target", "copies", "taken")
#: Sources up to this number are broadcast (about 50 bytes each).
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source_col: str, weights: tuple[float, ...], most: float) -> DataFrame:
    """sizes (source, source_size; one row each) with target: shares of the total by weight, none above most * size.

    Sources in code-point order, null last, weigh weights[0], weights[1], ..., repeating. The excess of a source at
    its limit goes to the others by weight until none is above. With sources in order of limit / weight this is one
    running sum: the first source whose fair share is under its limit sets the level for all after it, and levels only
    fall from there on. The windows are one task's work and see one row for each source, never documents.
    """
    order = Window.orderBy(F.col(source_col).asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col(source_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(rising), F.lit(0.0)), "_light": F.coalesce(F.sum("_w").over(rising), F.lit(0.0)),
        "_all": F.sum("source_size").over(every).cast("double"), "_heavy": F.sum("_w").over(every),
    })
    ranked = ranked.withColumn("_level", (F.col("_all") - F.col("_before")) / (F.col("_heavy") - F.col("_light")))
    level = F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(every)
    return ranked.withColumn("target", F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))).drop("_w", "_cap", "_before", "_light", "_all", "_heavy", "_level")


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _with_p(item: str, p: str) -> str:
    return "named_struct(" + ", ".join(f"'{f}', {p if f == 'p' else f'{item}.{f}'}" for f in FIELDS) + ")"


def _snapped(p: str) -> str:
    """p, as exactly 0 or 1 where rounding errors left it beside."""
    return f"(case when {p} < 1e-12 then 0D when {p} > 1 - 1e-12 then 1D else {p} end)"


def _rises(gain: str, loss: str, seed: int, *keys: str) -> str:
    return f"(shiftrightunsigned(xxhash64({', '.join(keys)}, {seed}), 11) / 9007199254740992D * ({gain} + {loss}) < {loss})"


def _types(id_type: str) -> str:
    return f"struct<key:bigint,size:bigint,p:double,whole:int,id:{id_type},source:string,source_size:bigint,target:double>"


def pool_fold(items: str, rest: str, seed: int, id_type: str) -> str:
    """SQL that decides items (large to small, all with one p), each against the pool of all smaller ones.

    `rest` is how many words with the same p the pool has beyond items. Gives struct(p, held, out): the p that the pool
    has in the end, one undecided item or none, and the decided ones. Where the pool is used up before an item is decided,
    the pool is all 0 or all 1 and the item is held.
    """
    item = _types(id_type)

    def state(p: str, held: str, out: str) -> str:
        return f"named_struct('p', {p}, 'left', a.left - x.size, 'held', {held}, 'out', {out})"

    def decided(p: str) -> str:
        return f"array_append(a.out, {_with_p('x', p)})"

    up = f"if((1 - a.p) * x.size <= a.p * r, {state(_snapped('(a.p - s.g / r)'), 'a.held', decided('1D'))}, {state('0D', _with_p('x', 'a.p + s.g / x.size'), 'a.out')})"
    down = f"if(a.p * x.size <= (1 - a.p) * r, {state(_snapped('(a.p + s.l / r)'), 'a.held', decided('0D'))}, {state('1D', _with_p('x', 'a.p - s.l / x.size'), 'a.out')})"
    pair = _let("named_struct('g', least((1 - a.p) * x.size, a.p * r), 'l', least(a.p * x.size, (1 - a.p) * r))", "s", f"if({_rises('s.g', 's.l', seed, 'x.key')}, {up}, {down})")
    step = f"case when a.p in (0D, 1D) then {state('a.p', 'a.held', decided('a.p'))} when r <= 0 then {state('a.p', _with_p('x', 'a.p'), 'a.out')} else {pair} end"
    step = _let("cast(a.left - x.size as double)", "r", step)
    start = f"named_struct('p', {items}[0].p, 'left', {rest} + aggregate({items}, 0L, (z, y) -> z + y.size), 'held', cast(null as {item}), 'out', cast(array() as array<{item}>))"
    return f"aggregate({items}, {start}, (a, x) -> {step}, a -> named_struct('p', a.p, 'held', a.held, 'out', a.out))"


def pair_fold(items: str, seed: int, id_type: str) -> str:
    """SQL that combines items of any p, large to small: the undecided one meets the next. Gives struct(held, out)."""
    item = _types(id_type)

    def met(done: str, value: str, left: str, p: str) -> str:
        return f"named_struct('done', {_with_p(done, value)}, 'left', {_with_p(left, _snapped(p))})"

    up = f"if((1 - c.p) * c.size <= x.p * x.size, {met('c', '1D', 'x', '(x.p - s.g / x.size)')}, {met('x', '0D', 'c', '(c.p + s.g / c.size)')})"
    down = f"if(c.p * c.size <= (1 - x.p) * x.size, {met('c', '0D', 'x', '(x.p + s.l / x.size)')}, {met('x', '1D', 'c', '(c.p - s.l / c.size)')})"
    pair = _let("named_struct('g', least((1 - c.p) * c.size, x.p * x.size), 'l', least(c.p * c.size, (1 - x.p) * x.size))", "s", f"if({_rises('s.g', 's.l', seed, 'c.key', 'x.key')}, {up}, {down})")
    after = _let(_let("a.held", "c", pair), "m", f"if(m.left.p in (0D, 1D), named_struct('held', cast(null as {item}), 'out', concat(a.out, array(m.done, m.left))), named_struct('held', m.left, 'out', array_append(a.out, m.done)))")
    start = f"named_struct('held', cast(null as {item}), 'out', cast(array() as array<{item}>))"
    return f"aggregate({items}, {start}, (a, x) -> if(a.held is null, named_struct('held', x, 'out', a.out), {after}))"


#: Large to small; the key breaks ties, so that the order doesn't depend on partitions.
_SORT = "(l, r) -> case when l.size > r.size then -1 when l.size < r.size then 1 when l.key < r.key then -1 when l.key > r.key then 1 else 0 end"


def _folded(items: DataFrame, by: list[str], sql: str) -> DataFrame:
    """Column f, the fold of the items of each group (of bounded size), with source and the group's largest _n."""
    group = F.expr(f"array_sort(collect_list(struct({', '.join(FIELDS)})), {_SORT})").alias("items")
    return items.groupBy(*by).agg(F.max("_n").alias("_n"), F.first("source_size").alias("_all"), group).select("source", "_n", F.expr(sql).alias("f"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 42, block: int = BLOCK, giant: int = GIANT) -> DataFrame:
    """How often the mix takes each row of docs: id, size, source, source_size, target, copies, taken, and key for take().

    size is the number of words (null text: 0), taken = copies * size, copies <= most rounded up. Null is a source of
    its own. Every row is decided on its own, also rows that repeat an id; a row of no words takes its whole part only,
    which is 0 words. An empty table gives an empty result. Other columns of docs are not looked at. The same rows and
    seed give the same result whatever the partitions.
    """
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h")))
    id_type = sized.schema["id"].dataType.simpleString()
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sources = materialise(source_targets(sources, "source", weights, most))
    n_sources, largest = sources.agg(F.count("*"), F.max("_n")).first()

    def by_source(rows: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
        side = side.withColumnRenamed("source", "_s")
        return rows.join(F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = by_source(sized, sources).withColumn("_rate", F.least(rate, F.lit(float(most))))
    rows = rows.select("id", "source", "size", "source_size", "target", "_n", F.xxhash64("_h", F.lit(seed)).alias("key"), F.floor("_rate").cast("int").alias("whole"), (F.col("_rate") - F.floor("_rate")).alias("p"))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    is_giant = F.col("size") * giant > F.col("source_size")
    out = rows.where(~open_).withColumn("p", F.lit(0.0)).select(*FIELDS)

    first = materialise(_folded(rows.where(open_ & is_giant), ["source"], pool_fold("items", "_all - aggregate(items, 0L, (z, y) -> z + y.size)", seed, id_type)))
    out = out.unionByName(first.select(F.explode("f.out").alias("o")).select("o.*"))
    ends = first.where("f.held is not null").select("f.held.*")
    others = by_source(rows.where(open_ & ~is_giant), first.select("source", F.col("f.p").alias("_p")), "left").withColumn("p", F.coalesce("_p", "p"))
    out = out.unionByName(others.where("p in (0D, 1D)").select(*FIELDS))
    items, level = others.where("p not in (0D, 1D)").select("_n", *FIELDS), 0
    left = largest or 0
    while left > 1 or not level:
        level += 1
        blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(block) ** level)))
        dealt = items.withColumn("_block", F.pmod(F.xxhash64("key", F.lit(seed + level)), blocks))
        folded = materialise(_folded(dealt, ["source", "_block"], pool_fold("items", "0L", seed, id_type) if level == 1 else pair_fold("items", seed + level, id_type)))
        out = out.unionByName(folded.select(F.explode("f.out").alias("o")).select("o.*"))
        items = folded.where("f.held is not null").select("_n", "f.held.*")
        left = -(-left // block)
    # What is undecided now is one document of a source.
    ends = ends.unionByName(items.select(*FIELDS)).withColumn("p", F.when(F.col("p") * 2 > 1, 1.0).otherwise(0.0))
    copies = (F.col("whole") + F.col("p")).cast("int")
    out = out.unionByName(ends)
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


def take(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, repeat: bool = True) -> DataFrame:
    """docs as decided by mix() (same seed): every row copies times with copy_no from 1, or once with repeat=False.

    Rows that are not taken are gone. The join is by a hash of the row, which no source makes uneven, and both sides can
    spill; only where rows repeat an id and its text are such rows numbered (by their other columns) to match one to one.
    Columns of docs that are named like a decision (size, target, copies, taken, source_size) are replaced.
    """
    wanted = [c for c in decisions.columns if c not in (id_col, "key") and (c not in docs.columns or c in DECIDED)]
    chosen = decisions.select(F.col("key").alias("_key"), *[F.col(c).alias(f"_d_{c}") for c in wanted])
    rows = docs.withColumn("_row", F.xxhash64(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(seed)))
    if chosen.groupBy("_key").count().where("count > 1").limit(1).count():
        others = [c for c in docs.columns if c not in (id_col, text_col)]
        chosen = chosen.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_d_copies")))
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_row").orderBy(F.xxhash64(*others) if others else F.lit(0))))
        joined = rows.join(chosen, (F.col("_row") == F.col("_key")) & (F.col("_nth") == F.col("_n"))).drop("_n", "_nth")
    else:
        joined = rows.join(chosen, F.col("_row") == F.col("_key"))
    joined = joined.where("_d_copies > 0").drop("_row", "_key", *wanted).withColumnsRenamed({f"_d_{c}": c for c in wanted})
    return joined.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))) if repeat else joined
