"""Retention, caps, rebuilds and migrations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.text import tidy
from meterline.functions.tokens import clamp
from meterline.operators import events as E
from meterline.operators import newest as N
from meterline.operators import rollup as R
from meterline.schema import LOCAL_OFFSET_HOURS


def expired(now: Column, days: int) -> Column:
    return F.coalesce(F.col("ts") < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def prune_retention(facts: DataFrame, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows older than ``days``; rows without a time survive."""
    if days <= 0:
        return facts, facts.where(F.lit(False))
    old = expired(now, days)
    return facts.where(~old), facts.where(old)


def prune_cap(facts: DataFrame, now: Column, limit: int, retention_days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): with a retention rows stay, without one each (api, model) keeps ``limit``."""
    if retention_days > 0 or limit < 0:
        return facts, facts.where(F.lit(False))
    return N.split(facts, E.GROUP, limit)


def rollup_rebuild(facts: DataFrame) -> DataFrame:
    return R.range_base(facts)


def rewrite_without(spark, path: str, now: Column, days: int, out: str) -> None:
    """Rewrite a fact folder without expired rows; whole expired days are never read.

    ``local_day`` is the partition column, so the filter on it prunes folders before the scan.
    """
    facts = spark.read.parquet(path)
    from meterline.functions.timeparse import local_day
    edge = local_day(now - F.expr(f"INTERVAL {days} DAYS"))
    fresh = (F.col("local_day") >= edge) | (F.col("local_day") == F.lit("0001-01-01"))
    kept, _ = prune_retention(facts.where(fresh), now, days)
    kept.write.mode("overwrite").partitionBy("local_day").parquet(out)


def migrate_hour_series(series: DataFrame, sums: list) -> DataFrame:
    """Hour keys written in UTC move to local hours; keys that are no hour are dropped."""
    hour = tidy(F.col("hour")).try_cast("int")
    rows = series.select(hour.alias("h"), *sums).where((F.col("h") >= 0) & (F.col("h") < 24))
    shifted = F.lpad(F.pmod(F.col("h") + LOCAL_OFFSET_HOURS, F.lit(24)).cast("string"), 2, "0")
    return rows.groupBy(shifted.alias("hour")).agg(*[F.sum(s).alias(s) for s in sums])


def migrate_cache_reads(rollup: DataFrame) -> DataFrame:
    """Old cached totals held reads and writes; keep the reads."""
    return rollup.withColumn("cached_tokens", clamp(clamp(F.col("cached_tokens")) - clamp(F.col("cache_write_tokens"))))


def origin_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("events"))
