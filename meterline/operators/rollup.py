"""Rollups: one set of additive measures over many groupings, and their algebra.

All aggregates are partial + final hash aggregates, so a hot group never lands whole in one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import identity as I
from meterline.functions import timeparse as P
from meterline.functions.text import tidy
from meterline.functions.tokens import clamp, with_effective
from meterline.schema import SUMS

BASE_KEYS = ["api", "model", "source", "provider", "auth_id", "auth_index", "auth_type", "api_key",
             "api_key_hash", "endpoint", "ts_missing", "day", "hour"]
PARTS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
TOKENS = ["total_tokens"] + PARTS


def row_measures() -> dict[str, Column]:
    """Measures of a fact row that carries effective_tokens and read_tokens."""
    c = F.col
    timed = c("latency_ms") > 0
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return {
        "requests": one,
        "successes": F.when(c("failed"), zero).otherwise(one),
        "failures": F.when(c("failed"), one).otherwise(zero),
        "total_tokens": c("effective_tokens"),
        "input_tokens": clamp(c("input_tokens")),
        "output_tokens": clamp(c("output_tokens")),
        "cache_read_tokens": c("read_tokens"),
        "cache_write_tokens": clamp(c("cache_write_tokens")),
        "reasoning_tokens": clamp(c("reasoning_tokens")),
        "latency_sum": F.when(timed, c("latency_ms")).otherwise(zero),
        "latency_count": F.when(timed, one).otherwise(zero),
    }


def average() -> Column:
    """Mean latency, 0 where nothing was timed."""
    return F.when(F.col("latency_count") > 0,
                  F.round(F.col("latency_sum") / F.col("latency_count"), 6)).otherwise(F.lit(0.0))


def with_dimensions(facts: DataFrame) -> DataFrame:
    """Fact rows with every label a rollup groups by; projections only."""
    c = F.col
    return facts.withColumns({
        "day": P.local_day(c("ts")), "hour": P.local_hour(c("ts")), "ts_missing": c("ts").isNull(),
        "model": I.norm_model(c("model")),
    })


def aggregate(rows: DataFrame, keys: list) -> DataFrame:
    """Fact rows (with effective tokens) grouped by keys; ``keys`` may be empty."""
    sums = [F.coalesce(F.sum(v), F.lit(0)).cast("bigint").alias(n) for n, v in row_measures().items()]
    out = rows.groupBy(*keys).agg(*sums)
    return out.withColumn("avg_latency_ms", average())


def regroup(rollup: DataFrame, keys: list, sums=SUMS) -> DataFrame:
    """A coarser rollup from a finer one."""
    out = rollup.groupBy(*keys).agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("bigint").alias(s) for s in sums])
    return out.withColumn("avg_latency_ms", average()) if "latency_sum" in sums else out


def prepared(facts: DataFrame) -> DataFrame:
    return with_dimensions(with_effective(facts))


def range_base(facts: DataFrame) -> DataFrame:
    """The finest rollup; every other dimension can be taken from it."""
    return aggregate(prepared(facts), BASE_KEYS)


# --- single dimensions ---------------------------------------------------------------------

def by(facts: DataFrame, **labels: Column) -> DataFrame:
    """Measures by named label columns, straight from the facts (one small shuffle)."""
    rows = prepared(facts)
    return aggregate(rows.withColumns(labels), list(labels)) if labels else aggregate(rows, [])


def total(facts):
    return by(facts)


def by_api(facts):
    return by(facts, api=F.col("api"))


def by_model(facts):
    return by(facts, model=F.col("model"))


def by_api_model(facts):
    return by(facts, api=F.col("api"), model=F.col("model"))


def by_credential(facts):
    return by(facts, credential=I.credential_key(F.col("auth_index")))


def _endpoint() -> Column:
    return I.endpoint_label(I.infer_endpoint(F.col("endpoint"), F.col("provider"), F.col("source")))


def by_endpoint(facts):
    return by(facts, endpoint=_endpoint())


def by_endpoint_model(facts):
    return by(facts, endpoint=_endpoint(), model=F.col("model"))


def by_model_provider(facts):
    return by(facts, model=F.col("model"), provider=F.lower(tidy(F.col("provider"))))


def by_source(facts: DataFrame) -> DataFrame:
    """Sources with the alphabetically first provider seen."""
    rows = prepared(facts).withColumns({"source": I.summary_source(F.col("source")),
                                        "provider": F.nullif(F.col("provider"), F.lit(""))})
    sums = [F.sum(v).cast("bigint").alias(n) for n, v in row_measures().items()]
    out = rows.groupBy("source").agg(F.coalesce(F.min("provider"), F.lit("")).alias("provider"), *sums)
    return out.withColumn("avg_latency_ms", average())


def with_remainder(parts: DataFrame, parents: DataFrame) -> DataFrame:
    """Provider rows plus one blank-provider row per model where the stored parent exceeds them."""
    names = [s for s in SUMS if not s.startswith("latency")]
    known = regroup(parts, ["model"], names)
    rest = (parents.select("model", *[F.col(n).alias("p_" + n) for n in names])
            .join(known, "model", "left")
            .select("model", F.lit("").alias("provider"),
                    *[clamp(F.col("p_" + n) - F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names]))
    some = F.lit(False)
    for n in names:
        if n not in ("successes", "failures"):
            some = some | (F.col(n) > 0)
    return parts.select("model", "provider", *names).unionByName(rest.where(some))


# --- time series ---------------------------------------------------------------------------

def series(facts: DataFrame, bucket: str) -> DataFrame:
    """Requests and tokens by local ``day`` or ``hour``."""
    rows = prepared(facts)
    m = row_measures()
    return rows.groupBy(bucket).agg(*[F.sum(m[n]).cast("bigint").alias(n) for n in ("requests", "total_tokens")])


def series_parts(facts: DataFrame, bucket: str) -> DataFrame:
    rows = prepared(facts)
    m = row_measures()
    return rows.groupBy(bucket).agg(*[F.sum(m[n]).cast("bigint").alias(n) for n in PARTS])


def series_model_tokens(facts: DataFrame, bucket: str) -> DataFrame:
    """The base that any new price table can be applied to without the facts."""
    rows = prepared(facts)
    m = row_measures()
    return rows.groupBy(bucket, F.lower(tidy(F.col("model"))).alias("model"),
                        F.lower(tidy(F.col("provider"))).alias("provider")).agg(
        *[F.sum(m[n]).cast("bigint").alias(n) for n in TOKENS])


# --- all dimensions at once ----------------------------------------------------------------

DIMENSIONS = {
    "total": [], "api": ["api"], "api_model": ["api", "model"], "model": ["model"],
    "model_provider": ["model", "provider"], "source": ["source_name"], "credential": ["credential"],
    "endpoint": ["endpoint_name"], "endpoint_model": ["endpoint_name", "model"],
    "client": ["client"], "client_model": ["client", "model"], "day": ["day"], "hour": ["hour"],
}


def summary_multi(facts: DataFrame) -> DataFrame:
    """Every dimension table in one pass: GROUPING SETS over the base rollup.

    Columns: dimension, key1, key2 and the measures. The base is read once; the expansion by the
    number of sets happens on the rollup, not on the facts.
    """
    c = F.col
    base = range_base(facts).withColumns({
        "source_name": I.summary_source(c("source")),
        "credential": I.credential_key(c("auth_index")),
        "endpoint_name": _endpoint(),
        "provider": F.lower(tidy(c("provider"))),
        "hour": F.lpad(c("hour").cast("string"), 2, "0"),
        "client": client_key(),
    })
    names = ["api", "model", "provider", "source_name", "credential", "endpoint_name", "client", "day", "hour"]
    base = base.select(*names, *SUMS)
    # bit i of grouping_id is set where names[i] is aggregated away
    ids = {d: sum(0 if n in keys else 1 << (len(names) - 1 - i) for i, n in enumerate(names))
           for d, keys in DIMENSIONS.items()}
    sets = [[c(k) for k in keys] for keys in DIMENSIONS.values()]
    out = base.groupingSets(sets, *names).agg(
        F.grouping_id().alias("gid"), *[F.coalesce(F.sum(s), F.lit(0)).cast("bigint").alias(s) for s in SUMS])
    dim, key1, key2 = F.lit(None), F.lit(""), F.lit("")
    for d, keys in DIMENSIONS.items():
        hit = c("gid") == ids[d]
        dim = F.when(hit, F.lit(d)).otherwise(dim)
        if keys:
            key1 = F.when(hit, c(keys[0])).otherwise(key1)
        if len(keys) > 1:
            key2 = F.when(hit, c(keys[1])).otherwise(key2)
    out = out.select(dim.alias("dimension"), key1.alias("key1"), key2.alias("key2"), *SUMS)
    # callers without a usable label have no group of their own
    return out.where(c("key1").isNotNull()).withColumn("avg_latency_ms", average())


def client_key() -> Column:
    """Caller group of a row or base group; NULL where no usable label exists."""
    from meterline.functions.text import is_unknown_key
    label, own = F.col("api_key"), F.col("api_key_hash")
    return F.when(~is_unknown_key(label),
                  F.when(own != "", F.concat(F.lit("api_key_hash:"), own)).otherwise(F.concat(F.lit("api_key:"), label)))


# --- algebra -------------------------------------------------------------------------------

def merge(left: DataFrame, right: DataFrame, keys: list) -> DataFrame:
    """Sum of two rollups of equal grain."""
    cols = [*keys, *SUMS]
    return regroup(left.select(*cols).unionByName(right.select(*cols)), keys)


def residual(stored: DataFrame, details: DataFrame, keys: list) -> DataFrame:
    """What stored totals hold beyond the rows still present, floored at 0."""
    d = details.select(*keys, *[F.col(s).alias("d_" + s) for s in SUMS])
    out = stored.select(*keys, *SUMS).join(d, keys, "left")
    return out.select(*keys, *[clamp(F.col(s) - F.coalesce(F.col("d_" + s), F.lit(0))).alias(s) for s in SUMS])


def retract(rollup: DataFrame, expired: DataFrame, keys: list) -> DataFrame:
    """Subtract the rollup of expired rows; groups left without requests disappear."""
    minus = expired.select(*keys, *[(-F.col(s)).alias(s) for s in SUMS])
    out = regroup(rollup.select(*keys, *SUMS).unionByName(minus), keys)
    return out.where(F.col("requests") > 0)
