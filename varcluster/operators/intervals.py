"""Intervals of a key as rows: their union, and the nearest one to each place.

What a place needs of the rows before it is found within cells of a fixed width, and carried from cell to cell over one
row a cell, so a key with a third of all rows spreads over as many tasks as it has cells, and none is ever one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 1 << 12


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out &= a[c].eqNullSafe(b[c])
    return out


def with_greatest_before(rows: DataFrame, by: str, at: str, value: str, name: str, cell: int = CELL) -> DataFrame:
    """rows with `name`, the greatest value of the key's rows at smaller places, null without one. Of rows at one place,
    some may count as before others."""
    celled = rows.withColumn("_cell", F.floor(F.col(at) / cell))
    own = Window.partitionBy(by, "_cell").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    cells = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = celled.groupBy(by, "_cell").agg(F.max(value).alias("_most")).select(by, "_cell", F.max("_most").over(cells).alias("_carried"))
    inside = celled.withColumn("_inside", F.max(value).over(own))
    both = inside.join(carried, _same(inside, carried, [by, "_cell"]), "left").drop(carried[by], carried["_cell"])
    return both.withColumn(name, F.greatest("_inside", "_carried")).drop("_cell", "_inside", "_carried")


def joined_intervals(intervals: DataFrame, by: str, cell: int = CELL) -> DataFrame:
    """(by, s, e): intervals of a key that overlap or touch as one. One without a start is none."""
    longest = intervals.where(F.col("s").isNotNull()).groupBy(by, "s").agg(F.max("e").alias("e"))
    rows = with_greatest_before(longest, by, "s", "e", "before", cell)
    rows = rows.withColumn("opens", F.when(F.col("before").isNull() | (F.col("s") > F.col("before") + 1), F.col("s")))
    rows = with_greatest_before(rows, by, "s", "opens", "opened", cell)
    return rows.groupBy(by, F.coalesce("opens", "opened").alias("first")).agg(F.max("e").alias("e")).select(by, F.col("first").alias("s"), "e")


def nearest_intervals(intervals: DataFrame, places: DataFrame, by: str, cell: int = CELL) -> DataFrame:
    """(by, at, gap, s, e): for each distinct place (by, at) of a key with intervals (by, s, e), the one that holds it or else
    whose border is nearest; ties go to the smaller s, then e. gap is 0 inside."""
    spans = intervals.where(F.col(by).isNotNull()).select(by, F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).distinct()
    wanted = places.where(F.col(by).isNotNull()).select(by, F.col("at").cast("long").alias("at")).distinct()
    # the last to end before a place, and in the other direction the first to start after it
    ends = spans.select(by, F.col("e").alias("at"), F.struct("e", (-F.col("s")).alias("s")).alias("end"))
    left = with_greatest_before(ends.unionByName(wanted, allowMissingColumns=True), by, "at", "end", "left", cell).where("end is null").select(by, "at", "left")
    starts = spans.select(by, (-F.col("s")).alias("back"), F.struct((-F.col("s")).alias("s"), (-F.col("e")).alias("e")).alias("start"))
    both = left.withColumn("back", -F.col("at")).unionByName(starts, allowMissingColumns=True)
    both = with_greatest_before(both, by, "back", "start", "right", cell).where("start is null").select(by, "at", "left", "right")
    # those that hold it share a cell with it
    held = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor(F.col("e") / cell))))
    at = wanted.withColumn("_cell", F.floor(F.col("at") / cell))
    holding = at.join(held, [by, "_cell"]).where("at between s and e").groupBy(by, "at").agg(F.min(F.struct("s", "e")).alias("held"))
    found = both.join(holding, [by, "at"], "left")
    choice = lambda is_there, gap, s, e: F.when(is_there.isNotNull(), F.struct(gap.alias("gap"), s.alias("s"), e.alias("e")))
    place, before, after, own = F.col("at"), F.col("left"), F.col("right"), F.col("held")
    near = F.least(choice(own, F.lit(0).cast("long"), own["s"], own["e"]), choice(before, F.abs(place - before["e"]), -before["s"], before["e"]), choice(after, F.abs(place + after["s"]), -after["s"], -after["e"]))
    return found.select(by, "at", near.alias("near")).where("near is not null").select(by, "at", "near.gap", "near.s", "near.e")
