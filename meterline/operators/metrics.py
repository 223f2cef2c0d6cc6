"""Ratios, shares, trends: arithmetic on small rollups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions import tokens as K
from meterline.schema import MISSING_DAY


def success_rate() -> Column:
    return F.when(F.col("requests") > 0, F.round(F.col("successes") / F.col("requests") * 100, 6)).otherwise(F.lit(100.0))


def ratio_success(rollup: DataFrame, keys: list) -> DataFrame:
    return rollup.select(*keys, success_rate().alias("success_rate"))


def ratio_cache(parts: DataFrame, keys: list) -> DataFrame:
    """Cache hit share over (keys, provider) parts, at most 100."""
    c = F.col
    hit = K.clamp(c("cache_read_tokens") - c("cache_write_tokens"))
    outside = K.exclusive(c("provider"), c("input_tokens"), c("output_tokens"), c("cache_read_tokens"), c("total_tokens"))
    seen = F.when(outside, c("input_tokens") + c("cache_read_tokens")).otherwise(c("input_tokens"))
    out = parts.groupBy(*keys).agg(F.sum(hit).alias("hit"), F.sum(seen).alias("seen"))
    rate = F.when(c("seen") > 0, F.least(F.lit(100.0), F.round(c("hit") / c("seen") * 100, 6))).otherwise(F.lit(0.0))
    return out.select(*keys, rate.alias("cache_rate"))


def cost_per_million(costs: DataFrame, totals: DataFrame, keys: list) -> DataFrame:
    rate = F.when(F.col("total_tokens") != 0, F.round(F.col("cost") / F.col("total_tokens") * 1e6, 6)).otherwise(F.lit(0.0))
    return costs.join(totals.select(*keys, "total_tokens"), keys).select(*keys, rate.alias("cost_per_million"))


def rpm(series: DataFrame, bucket: str) -> DataFrame:
    minutes = 60 if bucket == "hour" else 1440
    return series.select(bucket, F.round(F.col("requests") / minutes, 6).alias("rpm"))


def share(rollup: DataFrame, keys: list) -> DataFrame:
    """Share of all tokens in percent. The total is one row, joined as such."""
    whole = rollup.agg(F.sum("total_tokens").alias("all_tokens"))
    part = F.when(F.col("all_tokens") > 0, F.round(F.col("total_tokens") / F.col("all_tokens") * 100, 6)).otherwise(F.lit(0.0))
    return rollup.join(F.broadcast(whole), F.lit(True)).select(*keys, "total_tokens", part.alias("share"))


def day_over_day(daily: DataFrame, value: str) -> DataFrame:
    """Change of the last two present days in percent; NULL when the earlier one is not positive.

    ``daily`` has one row per day, so the single window partition is as long as the calendar.
    """
    w = Window.orderBy("day")
    prev, prev_day = F.lag(value).over(w), F.lag("day").over(w)
    steps = daily.select("day", F.col(value).alias("current"), prev.alias("previous"), prev_day.alias("previous_day"))
    last = steps.where(F.col("previous_day").isNotNull()).orderBy(F.desc("day")).limit(1)
    change = F.when(F.col("previous") > 0, F.round((F.col("current") - F.col("previous")) / F.col("previous") * 100, 6))
    return last.select("day", "previous_day", "current", "previous", change.alias("change_percent"))


def recent_hours(hourly: DataFrame, current_hour: Column) -> DataFrame:
    """Hours of the day ordered so that the current one comes last."""
    place = F.pmod(F.col("hour") - (current_hour + 1), F.lit(24))
    return hourly.withColumn("place", place.cast("int")).orderBy("place")


def last_days(daily: DataFrame, n: int = 30) -> DataFrame:
    return daily.orderBy(F.desc("day")).limit(n)


def trend_stats(series: DataFrame, costs: DataFrame, bucket: str, total_cost: DataFrame) -> DataFrame:
    """Peak and mean of requests, tokens and cost; buckets without a cost get the blended price.

    ``total_cost`` is one row (cost, total_tokens).
    """
    c = F.col
    blended = total_cost.select(F.when(c("total_tokens") > 0, c("cost") / c("total_tokens")).otherwise(F.lit(0.0)).alias("blended"))
    points = (series.join(costs.withColumnRenamed("cost", "known"), bucket, "left")
              .join(F.broadcast(blended), F.lit(True))
              .select("requests", "total_tokens", F.coalesce(c("known"), c("total_tokens") * c("blended")).alias("cost")))
    out = []
    for n in ("requests", "total_tokens", "cost"):
        out += [F.round(F.max(n).cast("double"), 6).alias("peak_" + n), F.round(F.avg(c(n).cast("double")), 4).alias("mean_" + n)]
    return points.agg(F.count(F.lit(1)).alias("points"), *out)


def present_days(daily: DataFrame) -> DataFrame:
    """Only real calendar days in the usual form."""
    return daily.where(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("day") != MISSING_DAY))
