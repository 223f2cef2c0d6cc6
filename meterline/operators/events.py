"""Event lists: pages, newest rows, drill-down, exports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.functions import text as X
from meterline.functions import timeparse as P
from meterline.functions import tokens as K
from meterline.functions.text import tidy
from meterline.operators import filters as Q
from meterline.operators import newest as N
from meterline.operators import rollup as R
from meterline.functions import identity as I
from meterline.schema import (CSV_HEADER, ERRORS_DEFAULT, ERRORS_MAX, PAGE_DEFAULT, PAGE_MAX, RECENT_DEFAULT,
                              RECENT_MAX, REQUESTS, STATUS_FAILED, STATUS_OK, UNKNOWN_FAILURE, UNKNOWN_SOURCE)


def newest_first() -> list:
    return [F.col("ts").desc_nulls_last(), F.col("id").desc()]


def events_page(facts: DataFrame, q: Q.Query, now: Column) -> DataFrame:
    """One page, newest first. Sort and limit become one bounded top-k per task."""
    limit = q.limit if 0 < q.limit <= PAGE_MAX else PAGE_DEFAULT
    return Q.apply(facts, q, now).orderBy(*newest_first()).offset(max(q.offset, 0)).limit(limit)


def after_cursor(ts: Column, row_id: int) -> Column:
    """Rows older than the cursor row; rows without a time come last."""
    col = F.col("ts")
    older = col.isNull() | (col < ts) | ((col == ts) & (F.col("id") < row_id))
    return F.when(ts.isNull(), col.isNull() & (F.col("id") < row_id)).otherwise(older)


def events_after(facts: DataFrame, q: Q.Query, now: Column) -> DataFrame:
    ts, row_id = q.cursor
    limit = q.limit if 0 < q.limit <= PAGE_MAX else PAGE_DEFAULT
    return Q.apply(facts, q, now).where(after_cursor(ts, row_id)).orderBy(*newest_first()).limit(limit)


def export_cap(requested: int, configured: int) -> int:
    """Effective record limit; 0 means none."""
    if configured <= 0:
        return max(requested, 0)
    return configured if requested <= 0 or requested > configured else requested


def export_window(facts: DataFrame, q: Q.Query, snapshot_at: Column, cap: int) -> DataFrame:
    """Rows of an export with a frozen upper bound, newest first, capped when asked to; any cap leaves several ordered files."""
    rows = Q.filter_before(Q.apply(facts, q, snapshot_at), snapshot_at)
    return N.newest(rows, cap) if cap > 0 else rows.orderBy(*newest_first())


def export_header(facts: DataFrame, q: Q.Query, snapshot_at: Column, cap: int) -> DataFrame:
    """Exact total, effective limit and the truncated flag."""
    rows = Q.filter_before(Q.apply(facts, q, snapshot_at), snapshot_at)
    total = F.count(F.lit(1))
    limit = F.when(F.lit(cap > 0) & (total > cap), F.lit(cap)).otherwise(total)
    return rows.agg(total.alias("total"), limit.cast("bigint").alias("limit"),
                    (F.lit(cap > 0) & (total > cap)).alias("truncated"))


def recent_top(facts: DataFrame, api: str, now: Column, limit: int = RECENT_DEFAULT, range_key: str = "all") -> DataFrame:
    n = limit if 0 < limit else RECENT_DEFAULT
    q = Q.Query(range=range_key, api=api)
    return Q.apply(facts, q, now).orderBy(*newest_first()).limit(min(n, RECENT_MAX))


def dim_order(rollup: DataFrame, name: str) -> DataFrame:
    return rollup.orderBy(F.desc("requests"), F.asc(name))


def failure_label() -> Column:
    return F.coalesce(F.nullif(F.trim(F.col("failure")), F.lit("")), F.lit(UNKNOWN_FAILURE))


def agg_errors(facts: DataFrame, limit: int = ERRORS_DEFAULT) -> DataFrame:
    """Most frequent failures by status and text."""
    n = min(limit if limit > 0 else ERRORS_DEFAULT, ERRORS_MAX)
    return (facts.where("failed").groupBy("status_code", failure_label().alias("failure"))
            .agg(F.count(F.lit(1)).alias("errors"))
            .orderBy(F.desc("errors"), F.asc("status_code"), F.asc("failure")).limit(n))


# --- drill-down into one upstream ----------------------------------------------------------

def detail_rows(facts: DataFrame, api: str, now: Column, range_key: str = "all", client: str = "") -> DataFrame:
    if not api.strip():
        return facts.where(F.lit(False))
    return Q.apply(facts, Q.Query(range=range_key, api=api.strip(), client=client), now)


def detail_summary(rows: DataFrame) -> DataFrame:
    return R.total(rows)


def detail_models(rows: DataFrame) -> DataFrame:
    return R.by_model(rows)


def detail_sources(rows: DataFrame) -> DataFrame:
    return R.by_source(rows.withColumn("source", F.col("source_key")))


# --- newest rows per group -----------------------------------------------------------------

GROUP = ["api", "model"]


def visible_details(facts: DataFrame, n: int) -> DataFrame:
    """The newest n rows per (api, model); a negative n means all, 0 none."""
    return N.split(facts, GROUP, n)[0]


def visible_count(facts: DataFrame, n: int) -> DataFrame:
    """How many rows stay visible: from group sizes alone, nothing is ranked."""
    sizes = facts.groupBy("api", "model").agg(F.count(F.lit(1)).alias("size"))
    shown = F.col("size") if n < 0 else F.least(F.col("size"), F.lit(n))
    return sizes.agg(F.coalesce(F.sum(shown), F.lit(0)).cast("bigint").alias("visible"))


def cap_overflow(facts: DataFrame, n: int) -> DataFrame:
    """Rows beyond the newest n per (api, model)."""
    return N.split(facts, GROUP, n)[1]


# --- exports -------------------------------------------------------------------------------

_LABELS = ["api", "source", "provider", "auth_id", "auth_index", "endpoint", "base_url", "failure"]


def sanitize_output(rows: DataFrame) -> DataFrame:
    """Redact every label, re-mask caller keys and clean header values."""
    cols = {n: X.sanitize_text(F.col(n)) for n in _LABELS if n in rows.columns}
    cols["api_key"] = X.mask_key(F.col("api_key"))
    if "headers" in rows.columns:
        cols["headers"] = F.transform_values("headers", lambda _, v: F.transform(v, X.sanitize_text))
    return rows.withColumns(cols)


def csv_rows(rows: DataFrame, header: bool = True) -> DataFrame:
    """The 15 export columns as text."""
    c = F.col
    tok = [c(t) for t in ("provider", "input_tokens", "output_tokens", "cached_tokens", "cache_tokens",
                          "cache_write_tokens", "total_tokens")]
    values = [
        P.local_timestamp(c("ts")), c("model"),
        X.first_text(c("api"), c("source"), c("provider"), F.lit(UNKNOWN_SOURCE)), c("auth_index"),
        F.when(c("failed"), F.lit(STATUS_FAILED)).otherwise(F.lit(STATUS_OK)),
        c("latency_ms"), c("ttft_ms"), K.uncached_input(*tok), c("output_tokens"), c("reasoning_tokens"),
        K.cache_read(*tok[3:6]), K.clamp(c("cache_write_tokens")), K.effective_total(*tok),
        F.when(c("status_code") == 0, F.lit("")).otherwise(c("status_code").cast("string")), c("failure"),
    ]
    return rows.select(*[v.cast("string").alias(n) for v, n in zip(values, CSV_HEADER)])


def write_csv(rows: DataFrame, path: str, gzip: bool = False) -> None:
    out = csv_rows(sanitize_output(rows)).write.options(
        header=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (out.option("compression", "gzip") if gzip else out).csv(path)


def write_jsonl(rows: DataFrame, path: str, gzip: bool = False) -> None:
    out = sanitize_output(rows).write
    (out.option("compression", "gzip") if gzip else out).json(path)


def write_json(facts: DataFrame, q: Q.Query, snapshot_at: Column, cap: int, path: str, gzip: bool = False) -> None:
    """Events as JSON lines under ``events`` and the one-row wrapper under ``header``."""
    write_jsonl(export_window(facts, q, snapshot_at, cap), path + "/events", gzip)
    export_header(facts, q, snapshot_at, cap).write.json(path + "/header")


def write_facts(rows: DataFrame, path: str) -> None:
    """Append fact rows, one folder per local day; adaptive execution sizes the files of a day."""
    (rows.withColumn("local_day", P.local_day(F.col("ts")))
     .hint("rebalance", "local_day")
     .write.mode("append").partitionBy("local_day").parquet(path))


def partitioned_schema(facts: DataFrame) -> T.StructType:
    return T.StructType([*facts.schema, T.StructField("local_day", T.StringType())])


def scan_facts(spark, path: str) -> DataFrame:
    """Facts as stored; filters on local_day prune folders."""
    return spark.read.schema(T.StructType([*REQUESTS, T.StructField("local_day", T.StringType())])).parquet(path)
