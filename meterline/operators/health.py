"""Quarter-hour success and failure counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.timeparse import health_slot
from meterline.schema import HEALTH_SLOTS, HEALTH_STEP_MINUTES


def health_counts(facts: DataFrame) -> DataFrame:
    """Counts per slot (seconds since 1970, UTC); rows without a time have no slot."""
    return (facts.where(F.col("ts").isNotNull())
            .groupBy(health_slot(F.col("ts")).alias("slot_start"))
            .agg(F.count_if(~F.col("failed")).alias("success"), F.count_if(F.col("failed")).alias("failure")))


def health_calendar(spark, now: Column) -> DataFrame:
    """The last 480 slots up to the next slot boundary."""
    step = HEALTH_STEP_MINUTES * 60
    end = health_slot(now) + F.lit(step)
    return (spark.range(HEALTH_SLOTS).select(
        F.col("id").cast("int").alias("slot"),
        (end + (F.col("id") - HEALTH_SLOTS) * step).cast("bigint").alias("slot_start")))


def health_grid(facts: DataFrame, now: Column) -> DataFrame:
    """Dense grid; only rows inside the window are counted."""
    step = HEALTH_STEP_MINUTES
    end = F.date_trunc("minute", now)  # slot bounds are whole minutes
    recent = facts.where((F.col("ts") >= end - F.expr(f"INTERVAL {HEALTH_SLOTS * step} MINUTES"))
                         & (F.col("ts") < end + F.expr(f"INTERVAL {step} MINUTES")))
    counts = health_counts(recent)
    zero = F.lit(0).cast("bigint")
    grid = health_calendar(facts.sparkSession, now).join(counts, "slot_start", "left")
    ok, bad = F.coalesce("success", zero), F.coalesce("failure", zero)
    return grid.select("slot", "slot_start", ok.alias("success"), bad.alias("failure"), (ok + bad).alias("total"))


def health_rate(grid: DataFrame) -> DataFrame:
    """Overall success share in percent over the grid; NULL without requests."""
    s, f = F.sum("success"), F.sum("failure")
    return grid.agg(s.alias("success"), f.alias("failure"),
                    F.when(s + f > 0, F.round(s / (s + f) * 100, 6)).alias("rate"))
