"""The newest rows of groups of any size, without sorting a group.

The order (time, then id, newest first) is two integers, smallest first. Each group starts as one box around all its rows. A
round cuts every box that holds many rows into at most BINS bins of equal width, counts them and keeps the bin that holds the
wanted row, with the bounds of what is in it; a round is one partial aggregate and a join on one row per group. Only a box of
BIN_ROWS rows or fewer is ranked. All other rows are then compared with the row found.

Defined cases: rows without a time come last, those without an id last within their time; rows equal in both stay or go
together; null keys form groups of their own; groups of no more rows than wanted have no edge and stay whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline import session
from meterline.functions import timeparse as P

BINS = 1024
BIN_ROWS = 1 << 16
LAST = (1 << 63) - 1


def ordered(facts: DataFrame) -> DataFrame:
    """Adds ``o1`` and ``o2``: the place of a row, newest first; complements, as they reverse the order without overflow."""
    return facts.withColumns({"o1": F.coalesce(F.bitwise_not(P.ntz_to_micros(F.col("ts"))), F.lit(LAST)),
                              "o2": F.coalesce(F.bitwise_not("id"), F.lit(LAST))})


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the one row of their group; without keys that is one row for all."""
    if not keys:
        return rows.join(F.broadcast(groups), F.lit(True), how)
    named = groups.withColumnsRenamed({k: "g_" + k for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(named["g_" + k])
    return rows.join(named, same, how).drop(*["g_" + k for k in keys])


def _bounds() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[f(o).alias(name) for o in ("o1", "o2") for f, name in ((F.min, o + "_lo"), (F.max, o + "_hi"))]]


def _inside() -> Column:
    return F.col("o1").between(F.col("o1_lo"), F.col("o1_hi")) & F.col("o2").between(F.col("o2_lo"), F.col("o2_hi"))


def _cut(rows: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The bin of each box that holds its wanted row."""
    by_time = F.col("o1_lo") < F.col("o1_hi")
    width = {o: F.expr(f"{o}_hi div {BINS} - {o}_lo div {BINS} + 1") for o in ("o1", "o2")}
    told = _beside(rows, boxes.withColumns({"w1": width["o1"], "w2": width["o2"], "by_time": by_time}), keys).where(_inside())
    at = F.when(F.col("by_time"), F.expr("o1 div w1")).otherwise(F.expr("o2 div w2"))
    bins = told.groupBy(*keys, "want", at.alias("bin")).agg(*_bounds())
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    return (bins.withColumn("before", upto - F.col("n"))
            .where((F.col("before") < F.col("want")) & (F.col("before") + F.col("n") >= F.col("want")))
            .withColumn("want", F.col("want") - F.col("before")).drop("before", "bin"))


def edges(facts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, e1, e2): the place of the n-th newest row of each group of more than n rows; n is positive."""
    rows = ordered(facts).select(*keys, "o1", "o2")
    boxes = rows.groupBy(*keys).agg(*_bounds()).where(F.col("n") > n).withColumn("want", F.lit(n).cast("bigint"))
    names = [*keys, "want", "n", "o1_lo", "o1_hi", "o2_lo", "o2_hi"]
    single = (F.col("o1_lo") == F.col("o1_hi")) & (F.col("o2_lo") == F.col("o2_hi"))
    large = (F.col("n") > BIN_ROWS) & ~single
    boxes = session.checkpoint(boxes.select(*names))
    while not boxes.where(large).isEmpty():
        boxes = session.checkpoint(_cut(rows, boxes.where(large), keys).select(*names).unionByName(boxes.where(~large)))
    ranked = _beside(rows, boxes.where(~single), keys).where(_inside())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("o1", "o2"))
    found = ranked.withColumn("rank", rank).where(F.col("rank") == F.col("want"))
    return found.select(*keys, F.col("o1").alias("e1"), F.col("o2").alias("e2")).unionByName(
        boxes.where(single).select(*keys, F.col("o1_lo").alias("e1"), F.col("o2_lo").alias("e2")))


def _beyond() -> Column:
    return (F.col("o1") > F.col("e1")) | ((F.col("o1") == F.col("e1")) & (F.col("o2") > F.col("e2")))


def split(facts: DataFrame, keys: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """(newest n rows of each group, all others); a negative n keeps all, 0 none."""
    none = facts.where(F.lit(False))
    if n <= 0:
        return (facts, none) if n < 0 else (none, facts)
    found = edges(facts, keys, n)
    rows = ordered(facts)
    kept = _beside(rows, found, keys, "left").where(F.col("e1").isNull() | ~_beyond())
    gone = _beside(rows, found, keys).where(_beyond())
    return kept.select(*facts.columns), gone.select(*facts.columns)


def newest(facts: DataFrame, n: int) -> DataFrame:
    """The newest n rows of all, newest first, in as many ordered partitions as the sort makes.

    The edge is one row, so it becomes a literal bound that reaches the scan and prunes stored days.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    edge = edges(facts, [], n).first()
    rows = facts
    if edge is not None and edge.e1 == LAST:
        rows = facts.where(F.col("ts").isNotNull() | (F.bitwise_not("id") <= edge.e2 if edge.e2 < LAST else F.lit(True)))
    elif edge is not None:
        at = P.micros_to_ntz(F.lit(~edge.e1))
        rows = facts.where(F.col("ts") >= at)
        if "local_day" in facts.columns:
            rows = rows.where(F.col("local_day") >= P.local_day(at))
        if edge.e2 < LAST:
            rows = rows.where((F.col("ts") > at) | (F.col("id") >= ~edge.e2))
    return rows.orderBy(F.col("ts").desc_nulls_last(), F.col("id").desc_nulls_last())
