"""Time-resolved shots to one row each, without looking past the leading part of a shot.

The window and the aggregation have the same key, so one exchange serves both. A shot of over GIANT rows does not fit one
task: its rows are dealt by ranges of the order into cells of bounded size, the cells' counts tell where its leading
part ends, and only rows of the cell in which it ends are ranked. Its medians are found the same way, over its different values and
their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from toroid import config as C
from toroid.functions.numbers import is_number, to_number
from toroid.sources.shared import materialise

#: Rows above which a shot is dealt into cells, and rows of a cell, about.
GIANT, CELL = 1_000_000, 250_000


def guard(df: DataFrame, shot: str = C.SHOT) -> DataFrame:
    """One row: row_count, shot_count and whether shots are collapsed (a missing shot makes the counts differ, too)."""
    counts = df.agg(F.count("*").alias("row_count"), F.count_distinct(shot).alias("shot_count"))
    return counts.withColumn("collapse", F.col("shot_count") != F.col("row_count"))


def _giants(df: DataFrame, shot: str, giant: int) -> DataFrame | None:
    """(_shot, _n) of the shots of over `giant` rows, to be broadcast (one in `giant` rows at most); None if there is none."""
    found = materialise(df.groupBy(F.col(shot).alias("_shot")).agg(F.count("*").alias("_n")).where(F.col("_n") > giant))
    return None if found.isEmpty() else F.broadcast(found)


def _is(shot: str) -> Column:
    return F.col(shot).eqNullSafe(F.col("_shot"))


def _in_cells(rows: DataFrame, order: list[Column], cell: int) -> DataFrame:
    """rows with _cell, numbered in the given order over all tasks and stored; no cell holds many more rows than `cell`."""
    parts = max(1, -(-rows.count() // cell))
    return materialise(rows.repartitionByRange(parts, *order).withColumn("_cell", F.spark_partition_id()))


def _offsets(cells: DataFrame, by: list[str], size: Column) -> DataFrame:
    """For each cell of each group its size and the sizes before it; one row for each cell, not for each row."""
    sizes = cells.groupBy(*by, "_cell").agg(F.sum(size).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def _giant_window(df: DataFrame, giants: DataFrame, ties: tuple[str, ...], shot: str, time: str, share: float, cell: int) -> DataFrame:
    """df of giant shots only, with in_pre_window."""
    columns = df.columns
    order = [F.col(shot).asc_nulls_first(), F.col(time).asc_nulls_last(), *[F.col(t) for t in ties], F.col("_any")]
    rows = _in_cells(df.join(giants, _is(shot)).withColumn("_any", F.xxhash64(*[F.col(c) for c in columns])), order, cell)
    cutoff = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(share)))
    ends = _offsets(rows.withColumnRenamed("_shot", "_s"), ["_s"], F.lit(1)).withColumnRenamed("_cell", "_c")
    placed = rows.join(ends, F.col("_shot").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    whole = F.col("_before") + F.col("_size") <= cutoff
    split = ~whole & (F.col("_before") < cutoff)  # one cell of each shot
    clear = placed.where(~split).withColumn("in_pre_window", whole)
    at = F.row_number().over(Window.partitionBy("_shot", "_cell").orderBy(F.col(time).asc_nulls_last(), *ties, "_any"))
    ranked = placed.where(split).withColumn("in_pre_window", at + F.col("_before") <= cutoff)
    return clear.unionByName(ranked).select(*columns, "in_pre_window")


def _usual_window(df: DataFrame, ties: tuple[str, ...], shot: str, time: str, share: float) -> DataFrame:
    """df with in_pre_window, each shot in one task."""
    of = Window.partitionBy(shot)
    at = F.row_number().over(of.orderBy(F.col(time).asc_nulls_last(), *ties))
    cutoff = F.greatest(F.lit(1), F.ceil(F.count("*").over(of) * F.lit(share)))
    return df.withColumn("in_pre_window", at <= cutoff)


def pre_window(df: DataFrame, ties: tuple[str, ...] = (), shot: str = C.SHOT, time: str = C.TIME, share: float = C.PRE_WINDOW_SHARE, giant: int = GIANT, cell: int = CELL) -> DataFrame:
    """df with in_pre_window: the row is among the first ceil(share * n) of its shot, at least one. ties order equal times."""
    giants = _giants(df, shot, giant)
    out = _usual_window(df if giants is None else df.join(giants, _is(shot), "left_anti"), ties, shot, time, share)
    return out if giants is None else out.unionByName(_giant_window(df, giants, ties, shot, time, share, cell))


def _textual_numbers(df: DataFrame, names: list[str]) -> set[str]:
    """Of text columns, those whose every value is a number (one pass; none if there is no text column)."""
    if not names:
        return set()
    row = df.agg(*[F.bool_and(is_number(F.col(c))).alias(c) for c in names]).first()
    return {c for c in names if row[c]}


def _counts(rows: DataFrame, values: dict[str, Column], shot: str) -> DataFrame:
    """(_shot, column, value, n): how often each value occurs in a shot; counted before anything is sent."""
    long = rows.select(F.col(shot).alias("_shot"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()])).alias("v"))
    return long.where("v.value is not null").groupBy("_shot", "v.column", "v.value").agg(F.count("*").alias("n"))


def _giant_medians(rows: DataFrame, values: dict[str, Column], shot: str, cell: int) -> DataFrame:
    """(_shot, column, value): interpolated medians of the columns in each shot."""
    key = ["_shot", "column"]
    cells = _in_cells(_counts(rows, values, shot), [F.col(c) for c in (*key, "value")], cell)
    ends = _offsets(cells, key, F.col("n"))
    total = F.sum("_size").over(Window.partitionBy(*key))
    ends = ends.withColumns({"_low": F.floor((total - 1) / 2), "_high": F.floor(total / 2)})
    ends = materialise(ends.where("_before <= _high and _before + _size > _low").drop("_size"))  # two cells of each at most
    run = F.sum("n").over(Window.partitionBy(*key, "_cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    near = cells.join(ends, [*key, "_cell"]).withColumn("_run", run)
    first, last = F.col("_run") - F.col("n"), F.col("_run") - 1
    of_low, of_high = (F.max(F.when((first <= F.col(r)) & (F.col(r) <= last), F.col("value"))) for r in ("_low", "_high"))
    return near.groupBy(*key).agg(of_low.alias("a"), of_high.alias("b")).select(*key, (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("value"))


def _giant_modes(rows: DataFrame, values: dict[str, Column], shot: str) -> DataFrame:
    """(_shot, column, value): the most frequent value of each column, the smallest of equally frequent ones."""
    return _counts(rows, values, shot).groupBy("_shot", "column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m")).select("_shot", "column", "m.value")


def _mapped(long: DataFrame, name: str) -> DataFrame:
    return long.groupBy("_shot").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias(name))


def collapse(df: DataFrame, ties: tuple[str, ...] = (), shot: str = C.SHOT, time: str = C.TIME, target: str = C.TARGET, giant: int = GIANT, cell: int = CELL) -> DataFrame:
    """One row for each shot: numbers as the median of the leading window, text as its most frequent value there (ties: the
    smallest), the target as its maximum over the whole shot. Rows without a shot are left out."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in (shot, time, target)]
    numeric = _textual_numbers(df, text)
    rows = df.where(F.col(shot).isNotNull())
    giants = _giants(rows, shot, giant)
    usual = rows if giants is None else rows.join(giants, _is(shot), "left_anti")
    inside, top, numbers, texts = F.col("in_pre_window"), {}, {}, {}
    for f in df.schema:
        value = F.col(f.name)
        if f.name == shot:
            continue
        if f.name == target:
            top[f.name] = to_number(value, f.dataType)
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)) or f.name in numeric:
            numbers[f.name] = to_number(value, f.dataType)
        else:
            texts[f.name] = value
    made = {c: F.max(v) for c, v in top.items()} | {c: F.median(F.when(inside, v)) for c, v in numbers.items()} | {c: F.mode(F.when(inside, v), True) for c, v in texts.items()}
    names = [c for c in df.columns if c != shot]
    out = _usual_window(usual, ties, shot, time, C.PRE_WINDOW_SHARE).groupBy(shot).agg(*[made[c].alias(c) for c in names])
    if giants is None:
        return out
    own = rows.join(giants, _is(shot), "left_semi")
    tops = own.groupBy(F.col(shot).alias("_shot")).agg(F.count("*").alias("_n"), *[F.max(v).alias(f"_t{i}") for i, v in enumerate(top.values())])
    lead = materialise(_giant_window(own, giants, ties, shot, time, C.PRE_WINDOW_SHARE, cell)).where(inside)
    if numbers:
        tops = tops.join(_mapped(_giant_medians(lead, numbers, shot, cell), "_m"), "_shot", "left")
    if texts:
        tops = tops.join(_mapped(_giant_modes(lead, {c: v.cast("string") for c, v in texts.items()}, shot), "_w"), "_shot", "left")
    types = {f.name: f.dataType for f in out.schema}
    found = {c: F.col(f"_t{i}") for i, c in enumerate(top)} | {c: F.try_element_at("_m", F.lit(c)) for c in numbers} | {c: F.try_element_at("_w", F.lit(c)).cast(types[c]) for c in texts}
    return out.unionByName(tops.select(F.col("_shot").alias(shot), *[found[c].alias(c) for c in names]))


def aggregate_shots(df: DataFrame, ties: tuple[str, ...] = (), shot: str = C.SHOT, time: str = C.TIME) -> DataFrame:
    """collapse() where it applies: shots and a time axis are there, and shots do not number as many as rows."""
    if shot not in df.columns or time not in df.columns or not guard(df, shot).first()["collapse"]:
        return df
    return collapse(df, ties, shot, time)
