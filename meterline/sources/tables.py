"""The request facts derived from the given ``events`` table, and inputs derived from them.

The two lists of expressions are plain SQL shared with the DuckDB checks, so that both sides start
from equal rows; ``{K}`` and ``{SHA}`` are the only parts that differ between the engines.
"""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.schema import PRICES

NOW = "2024-01-31 00:00:00"

BASE_EXPRESSIONS = [
    ("id", "event_id"),
    ("ts", "CASE WHEN event_id % 997 = 0 THEN NULL ELSE ts END"),
    ("user_id", "user_id"),
    ("k", "k"),
    ("provider", "CASE event_id % 6 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'claude-oauth' "
                 "WHEN 3 THEN 'gemini' WHEN 4 THEN 'DeepSeek' ELSE '' END"),
    ("model", "CASE k % 5 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' WHEN 2 THEN 'openai/model-c' "
              "WHEN 3 THEN ' ' ELSE 'Model-D' END"),
    ("source", "CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'prod' WHEN 2 THEN 'deadbeef01' ELSE 'staging' END"),
    ("auth_index", "CASE WHEN user_id % 9 = 0 THEN '' ELSE 'auth-' || lpad(CAST(user_id % 20 AS STRING), 2, '0') END"),
    ("raw_key", "CASE user_id % 11 WHEN 0 THEN '' ELSE CASE user_id % 5 WHEN 0 THEN 'alpha-' WHEN 1 THEN 'bravo-' "
                "WHEN 2 THEN 'carol-' WHEN 3 THEN 'delta-' ELSE 'sk-' END || lpad(CAST(user_id AS STRING), 6, '0') END"),
    ("endpoint", "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'POST /v1/responses?x=1' WHEN 2 THEN 'responses/' "
                 "WHEN 3 THEN 'https://h.example.com/v1/messages#top' WHEN 4 THEN '/v1/chat/completions' "
                 "ELSE 'v1/embeddings/' END"),
    ("stream", "event_id % 3 = 0"),
    ("input_tokens", "CAST(floor(value * 20) AS BIGINT)"),
    ("output_tokens", "CAST(k * 7 AS BIGINT)"),
    ("reasoning_tokens", "CAST(k AS BIGINT)"),
    ("cached_tokens", "CASE WHEN k % 3 = 0 THEN CAST(k AS BIGINT) ELSE CAST(0 AS BIGINT) END"),
    ("cache_write_tokens", "CASE WHEN k % 4 = 0 THEN CAST(k * 2 AS BIGINT) ELSE CAST(0 AS BIGINT) END"),
    ("latency_ms", "CAST(k * 37 - 300 AS BIGINT)"),
    ("ttft_ms", "CAST(k * 5 AS BIGINT)"),
    ("failed", "event_type = 'error'"),
]

CACHE_EXPRESSIONS = [
    ("cache_tokens", "CASE WHEN k % 2 = 0 THEN cached_tokens + cache_write_tokens ELSE CAST(0 AS BIGINT) END"),
    ("total_tokens", "CASE id % 4 WHEN 0 THEN CAST(0 AS BIGINT) "
                     "WHEN 1 THEN input_tokens + output_tokens + cached_tokens + cache_write_tokens "
                     "ELSE input_tokens + output_tokens END"),
]

FACT_EXPRESSIONS = [
    ("id", "id"), ("ts", "ts"),
    ("api", "CASE WHEN trim(provider) = '' THEN 'upstream' ELSE provider END || ' - ' || CAST(user_id % 3 AS STRING)"),
    ("model", "model"), ("source", "source"),
    ("source_key", "CASE WHEN source = '' THEN 'none' ELSE source END"),
    ("provider", "provider"),
    ("auth_id", "CASE WHEN auth_index = '' THEN '' ELSE 'codex:apikey:' || auth_index END"),
    ("auth_index", "auth_index"), ("auth_type", "'apikey'"),
    ("api_key", "CASE WHEN raw_key = '' THEN '' ELSE substr(raw_key, 1, 1) || '******' END"),
    ("api_key_hash", "CASE WHEN raw_key = '' OR user_id % 7 = 0 THEN '' ELSE substr({SHA}(':' || raw_key), 1, 56) END"),
    ("label_hash", "CASE WHEN raw_key = '' THEN '' ELSE substr({SHA}(':' || substr(raw_key, 1, 1) || '******'), 1, 56) END"),
    ("endpoint", "endpoint"), ("base_url", "''"), ("stream", "stream"),
    ("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"),
    ("reasoning_tokens", "reasoning_tokens"), ("cached_tokens", "cached_tokens"),
    ("cache_tokens", "cache_tokens"), ("cache_write_tokens", "cache_write_tokens"),
    ("total_tokens", "total_tokens"), ("latency_ms", "latency_ms"), ("ttft_ms", "ttft_ms"),
    ("failed", "failed"),
    ("status_code", "CASE WHEN NOT failed THEN 0 WHEN k % 3 = 0 THEN 429 WHEN k % 3 = 1 THEN 500 ELSE 401 END"),
    ("failure", "CASE WHEN NOT failed THEN '' ELSE CASE k % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' rate limited ' "
                "WHEN 2 THEN 'Authorization: sk-' || lpad(CAST(k AS STRING), 9, 'x') "
                "WHEN 3 THEN 'bad key=' || {SHA}(CAST(k AS STRING)) || '&a=1' ELSE 'timeout' END END"),
]

KEPT = [n for n, _ in BASE_EXPRESSIONS]
SPARK_K = "CAST(get_json_object(props, '$.k') AS BIGINT)"
DUCK_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

MANUAL = [("model-a", 3.0, 9.0, 0.3, 0.0), ("anthropic/model-a", 4.0, 20.0, 0.4, 5.0)]
CATALOG = [("openai/model-c", 1.25, 10.0, 0.125, 1.25), ("model-c", 2.0, 8.0, 0.2, 0.0),
           ("MODEL-D", 0.5, 1.5, 0.05, 0.0), ("model-a", 100.0, 100.0, 100.0, 100.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _select(df: DataFrame, pairs) -> DataFrame:
    return df.selectExpr(*[f"{_spark_sha(e)} AS {n}" for n, e in pairs])


def facts_from_events(events: DataFrame) -> DataFrame:
    """Works on batch and streaming input alike: projections only."""
    base = _select(events.selectExpr("*", f"{SPARK_K} AS k"), BASE_EXPRESSIONS)
    return _select(base.selectExpr("*", *[f"{e} AS {n}" for n, e in CACHE_EXPRESSIONS]), FACT_EXPRESSIONS)


def _spark_sha(expr: str) -> str:
    """Turn ``{SHA}(x)`` into ``sha2(x, 256)``, minding nested parentheses."""
    while "{SHA}(" in expr:
        start = expr.index("{SHA}(")
        depth, i = 1, start + len("{SHA}(")
        begin = i
        while depth:
            depth += {"(": 1, ")": -1}.get(expr[i], 0)
            i += 1
        expr = expr[:start] + f"sha2({expr[begin:i - 1]}, 256)" + expr[i:]
    return expr


def duck_facts() -> str:
    """The same rows as DuckDB text: a chain of WITH members ending in ``requests``."""
    def cols(pairs):
        return ", ".join(f"{e.replace('{SHA}', 'sha256')} AS {n}" for n, e in pairs)

    return (f"e AS (SELECT *, {DUCK_K} AS k FROM events), "
            f"a AS (SELECT {cols(BASE_EXPRESSIONS)} FROM e), "
            f"b AS (SELECT *, {cols(CACHE_EXPRESSIONS)} FROM a), "
            f"requests AS (SELECT {cols(FACT_EXPRESSIONS)} FROM b)")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_from_events(table(spark, sf_dir, "events"))


def prices(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, PRICES)


def manual_prices(spark: SparkSession) -> DataFrame:
    return prices(spark, MANUAL)


def catalog_prices(spark: SparkSession) -> DataFrame:
    return prices(spark, CATALOG)


def now() -> "F.Column":
    return F.expr(f"timestamp_ntz'{NOW}'")


# --- derived inputs ------------------------------------------------------------------------

def imported(facts: DataFrame) -> DataFrame:
    """An import: known rows, some twice, and changed ones; ``seq`` orders the copies."""
    known = facts.where("id % 10 < 3").withColumn("seq", F.lit(0))
    again = facts.where("id % 10 = 0").withColumn("seq", F.lit(1))
    changed = facts.where("id % 10 = 3").withColumn("seq", F.lit(0)).withColumn("latency_ms", F.col("latency_ms") + 1)
    return known.unionByName(again).unionByName(changed)


def updates(facts: DataFrame) -> DataFrame:
    """Late metadata for every fourth row; a third of it points at no row."""
    miss = F.col("id") % 12 == 1
    return facts.where("id % 4 = 1").select(
        F.col("id").alias("seq"), "fingerprint",
        F.when(miss, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts")).alias("ts"),
        F.lit("/v1/late").alias("endpoint"), F.lit("z******").alias("api_key"),
        F.lit("").alias("api_key_hash"), F.lit(True).alias("stream"))


def chunks(facts: DataFrame) -> DataFrame:
    """Three stream chunks per request; terminal ones may lack usage, some first chunks come last, some have no correlation id."""
    n = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("chunk_index")
    df = facts.select("id", "ts", "provider", "auth_id", "api_key_hash", n, "input_tokens", "output_tokens")
    idx = F.col("chunk_index")
    no_usage = (F.col("id") % 4 == 0) & (idx == 3)
    return df.select(
        F.when(F.col("id") % 97 == 0, F.lit(" ")).otherwise(F.col("id").cast("string")).alias("correlation_id"), "provider", "auth_id",
        F.col("api_key_hash").alias("api_key"), "chunk_index", (idx == 3).alias("terminal"),
        F.when((F.col("id") % 5 == 0) & (idx == 1), F.lit(4)).otherwise(idx).alias("seq"),
        F.when(no_usage, F.lit(0)).otherwise(F.col("input_tokens") * idx).cast("bigint").alias("input_tokens"),
        F.when(no_usage, F.lit(0)).otherwise(F.col("output_tokens") * idx).cast("bigint").alias("output_tokens"),
        F.coalesce(F.col("ts"), now()).alias("at"))


_FEED = ["id", "ts", "provider", "auth_id", "auth_index", "model", "api_key", "endpoint", "stream",
         "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]


def _feed(facts: DataFrame) -> DataFrame:
    none = F.lit(0).cast("bigint")
    return facts.withColumns({"input_tokens": F.col("id") + 1, "api_key": F.col("api_key_hash"),
                              "cache_read_tokens": none, "cache_creation_tokens": none})


def native_feed(facts: DataFrame) -> DataFrame:
    """Native rows, seen at their own time (rows without one at a fixed moment)."""
    seen = F.coalesce(F.col("ts"), now())
    return _feed(facts).where("id % 3 <> 0").select(
        *_FEED, F.lit("").alias("correlation_id"), seen.alias("observed_at"))


def fallback_feed(facts: DataFrame) -> DataFrame:
    """Fallback rows, seen one second later, stamped -2..1 seconds off; every seventh has a partial row of its stream a second before it."""
    c = F.col
    seen = F.coalesce(c("ts"), now())
    off = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (c("reasoning_tokens") % 4 - 2).cast("decimal(18,6)"))
    rows = _feed(facts).where("id % 2 = 0").withColumn("correlation_id", F.when(c("id") % 14 == 0, F.concat(F.lit("s"), c("id").cast("string"))).otherwise(""))
    whole = rows.withColumn("observed_at", seen + F.expr("INTERVAL 1 SECOND")).withColumn("ts", c("ts") + off)
    part = rows.where("id % 14 = 0").withColumn("observed_at", seen).withColumns({"id": -c("id") - 1, "output_tokens": c("output_tokens") + 1})
    return whole.unionByName(part).select(*_FEED, "correlation_id", "observed_at")
