"""Column names, types and the fixed values the results depend on."""

from pyspark.sql import types as T

# --- fixed values: labels, limits, formats -------------------------------------------------
UNKNOWN_MODEL = "unknown"
UNKNOWN_ENDPOINT = "unknown"
UNKNOWN_SOURCE = "未知来源"
UNKNOWN_API = "未知接口"
EMPTY_CREDENTIAL = "(空)"
UNKNOWN_FAILURE = "unknown failure"
MASK = "******"
NAME_SEPARATOR = " · "
CHANNEL_PREFIX = "上游 "
CSV_HEADER = [
    "时间", "模型", "来源", "凭证", "结果", "延迟毫秒", "TTFT毫秒", "非缓存输入 token", "输出 token",
    "思考 token", "缓存 token", "缓存写入 token", "总 token", "状态码", "错误",
]
STATUS_OK = "成功"
STATUS_FAILED = "失败"

LOCAL_OFFSET_HOURS = 8
MISSING_DAY = "0001-01-01"
MISSING_HOUR = 8
HEALTH_SLOTS = 480
HEALTH_STEP_MINUTES = 15
RANGE_HOURS = {"7h": 7, "24h": 24, "7d": 168}
PAGE_DEFAULT, PAGE_MAX = 50, 500
RECENT_DEFAULT, RECENT_MAX = 50, 500
ERRORS_DEFAULT, ERRORS_MAX = 20, 100
FAILURE_LIMIT = 500

PENDING_SECONDS = 2
NATIVE_RECENT_SECONDS = 5
LATE_NATIVE_SECONDS = 30
CLOCK_SLACK_SECONDS = 1
STREAM_IDLE_SECONDS = 60
# --- end of fixed values -------------------------------------------------------------------

TOKEN_COLUMNS = [
    "input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens",
    "cache_tokens", "cache_write_tokens", "total_tokens",
]

THINKING = T.StructType([
    T.StructField("intensity", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("budget", T.LongType()),
])

REQUESTS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in (
        "api", "model", "source", "source_key", "provider", "auth_id", "auth_index", "auth_type",
        "api_key", "api_key_hash", "label_hash", "endpoint", "base_url")]
    + [T.StructField("stream", T.BooleanType())]
    + [T.StructField(c, T.LongType()) for c in TOKEN_COLUMNS]
    + [T.StructField("latency_ms", T.LongType()), T.StructField("ttft_ms", T.LongType()),
       T.StructField("failed", T.BooleanType()), T.StructField("status_code", T.IntegerType()),
       T.StructField("failure", T.StringType()), T.StructField("thinking", THINKING),
       T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType())))]
)

PRICES = T.StructType([T.StructField("price_key", T.StringType())]
                      + [T.StructField(c, T.DoubleType())
                         for c in ("prompt", "completion", "cache", "cache_write")])
PRICE_COLUMNS = ["prompt", "completion", "cache", "cache_write"]

SUMS = [
    "requests", "successes", "failures", "total_tokens", "input_tokens", "output_tokens",
    "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "latency_sum", "latency_count",
]
