"""Raw usage records: tolerant JSON lines to one flat, typed row each."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline import session
from meterline.functions import identity as I
from meterline.functions import text as X
from meterline.functions import timeparse as P
from meterline.functions import tokens as K
from meterline.functions.text import tidy
from meterline.schema import FAILURE_LIMIT

# --- fixed values: accepted spellings, best first ------------------------------------------
TEXT_FIELDS = {
    "provider": ["provider", "Provider"],
    "executor_type": ["executor_type", "ExecutorType"],
    "model": ["model", "Model"],
    "alias": ["alias", "Alias"],
    "api_key": ["api_key", "APIKey"],
    "auth_id": ["auth_id", "AuthID"],
    "auth_index": ["auth_index", "AuthIndex"],
    "auth_type": ["auth_type", "AuthType"],
    "endpoint": ["endpoint", "Endpoint"],
    "base_url": ["base_url", "baseURL", "baseUrl", "BaseURL", "BaseUrl"],
    "source": ["source", "Source"],
    "reasoning_effort": ["reasoning_effort", "ReasoningEffort"],
    "service_tier": ["service_tier", "ServiceTier"],
    "correlation_id": ["response_id", "responseId", "request_id", "requestId",
                       "ResponseID", "ResponseId", "RequestID", "RequestId"],
}
FLAG_FIELDS = {"stream": ["stream", "Stream", "streaming", "Streaming"], "failed": ["failed", "Failed"]}
TIME_FIELDS = ["requested_at", "requested_at_ms", "RequestedAt", "RequestedAtMs"]
DURATION_FIELDS = {"latency": ["latency", "latency_ms", "Latency", "LatencyMs"],
                   "ttft": ["ttft", "ttft_ms", "TTFT", "TTFTMs"]}
DETAIL_FIELDS = {
    "input_tokens": ["input_tokens", "prompt_tokens", "InputTokens"],
    "output_tokens": ["output_tokens", "completion_tokens", "OutputTokens"],
    "reasoning_tokens": ["reasoning_tokens", "completion_tokens_details.reasoning_tokens", "ReasoningTokens"],
    "cached_tokens": ["cached_tokens", "prompt_tokens_details.cached_tokens",
                      "input_tokens_details.cached_tokens", "CachedTokens"],
    "cache_read_tokens": ["cache_read_tokens", "cache_read_input_tokens", "prompt_tokens_details.cached_tokens",
                          "input_tokens_details.cached_tokens", "CacheReadTokens"],
    "cache_creation_tokens": ["cache_creation_tokens", "cache_creation_input_tokens",
                              "prompt_tokens_details.cache_write_tokens",
                              "prompt_tokens_details.cache_creation_tokens",
                              "input_tokens_details.cache_write_tokens",
                              "input_tokens_details.cache_creation_tokens", "CacheCreationTokens"],
    "total_tokens": ["total_tokens", "TotalTokens"],
}
# --- end of fixed values -------------------------------------------------------------------

# Names that differ only in case cannot share a schema, so lines are read with two of them;
# the few names that collide even then are read as a map, and only where a line holds one.
_RARE = ["baseUrl", "BaseUrl", "ResponseId", "RequestId", "Streaming"]
_NESTED = ["prompt_tokens_details", "input_tokens_details", "completion_tokens_details"]
_BAD = "_unreadable"


def _is_pascal(name: str) -> bool:
    return name[0].isupper()


def _schema(pascal: bool) -> str:
    """All leaves as text: numbers, flags and times come in either form."""
    def leaves(names):
        return [f"{n}:string" for n in dict.fromkeys(names) if n not in _RARE and _is_pascal(n) == pascal]

    flat = [n for group in (*TEXT_FIELDS.values(), *FLAG_FIELDS.values(), TIME_FIELDS, *DURATION_FIELDS.values()) for n in group]
    paths = [p for group in DETAIL_FIELDS.values() for p in group]
    detail = leaves(p for p in paths if "." not in p)
    if not pascal:
        for n in _NESTED:
            inner = dict.fromkeys(p.split(".")[1] for p in paths if p.startswith(n + "."))
            detail.append(f"{n}:struct<" + ",".join(f"{x}:string" for x in inner) + ">")
    failure = "StatusCode:string,Body:string" if pascal else "status_code:string,body:string"
    names = {"detail": "Detail", "failure": "Failure", "response_headers": "ResponseHeaders"} if pascal else {}
    return "struct<" + ",".join(leaves(flat) + [
        f"{names.get('detail', 'detail')}:struct<{','.join(detail)}>", f"{names.get('failure', 'failure')}:struct<{failure}>",
        f"{names.get('response_headers', 'response_headers')}:map<string,array<string>>", f"{_BAD}:string"]) + ">"


def _first_number(*cols: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.coalesce(*[F.nullif(c.try_cast("bigint"), zero) for c in cols], zero)


def parse_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """One flat row per JSON line; unreadable lines are dropped."""
    c = F.col
    options = {"columnNameOfCorruptRecord": _BAD}
    # dropping unreadable lines inside the generator keeps the parse from being repeated by a filter
    good = F.filter(F.array(F.from_json(column, _schema(False), options)), lambda r: r[_BAD].isNull())
    rare = F.when(c(column).rlike('"(?:' + "|".join(_RARE) + ')"'), F.from_json(column, "map<string,string>"))
    df = lines.select(column, F.explode(good).alias("s")).select(
        "s", F.from_json(column, _schema(True)).alias("p"), rare.alias("r"))

    def get(name: str) -> Column:
        return F.try_element_at("r", F.lit(name)) if name in _RARE else c(("p." if _is_pascal(name) else "s.") + name)

    def detail(path: str) -> Column:
        return c(("p.Detail." if _is_pascal(path) else "s.detail.") + path)

    def flag(keys) -> Column:
        out = F.lit(False)
        for k in keys:
            out = out | F.coalesce(get(k) == "true", F.lit(False))
        return out

    def duration(keys) -> Column:
        """(text, unit) of the first key that holds a duration."""
        return F.coalesce(*[F.when(P.is_duration(tidy(get(k))), F.struct(
            get(k).alias("raw"), F.lit(1e6 if k.lower().endswith("ms") else 1.0).alias("unit"))) for k in keys])

    cols = {name: X.first_text(*[get(k) for k in keys]) for name, keys in TEXT_FIELDS.items()}
    cols |= {name: flag(keys) for name, keys in FLAG_FIELDS.items()}
    cols["requested_at"] = F.coalesce(*[F.when(P.is_time(tidy(get(k))), get(k)) for k in TIME_FIELDS])
    cols |= {name: duration(keys) for name, keys in DURATION_FIELDS.items()}
    cols["status_code"] = _first_number(c("s.failure.status_code"), c("p.Failure.StatusCode")).cast("int")
    cols["failure_body"] = F.coalesce(F.nullif(c("s.failure.body"), F.lit("")), c("p.Failure.Body"), F.lit(""))
    cols |= {name: _first_number(*[detail(p) for p in keys]) for name, keys in DETAIL_FIELDS.items()}
    cols["response_headers"] = F.coalesce(c("s.response_headers"), c("p.ResponseHeaders"))
    flat = df.select(*[v.alias(k) for k, v in cols.items()])
    return flat.withColumn("requested_at", P.norm_time(c("requested_at"))).withColumns({
        name + "_ms": (P.norm_duration(c(name + ".raw"), c(name + ".unit")) / 1000000).cast("bigint")
        for name in DURATION_FIELDS}).drop(*DURATION_FIELDS)


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, reason, copies): the lines that ``parse_records`` leaves out, each text once."""
    c = F.col
    bad = F.from_json(column, "struct<_x:string, " + f"{_BAD}:string>", {"columnNameOfCorruptRecord": _BAD})[_BAD].isNotNull()
    typed = F.from_json(column, _schema(False), {"columnNameOfCorruptRecord": _BAD})[_BAD].isNotNull()
    reason = F.when(bad, F.lit("no JSON object")).when(typed, F.lit("field of another kind"))
    found = lines.select(c(column).alias("line"), F.explode(F.filter(F.array(reason), lambda r: r.isNotNull())).alias("reason"))
    return found.groupBy("line", "reason").agg(F.count(F.lit(1)).alias("copies"))


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(spark.read.text(path))


IDENTITY = ["provider", "executor_type", "source", "base_url", "api_key", "auth_index", "auth_id"]


def identities(raw: DataFrame, salt: str = "") -> DataFrame:
    """Every combination of identity fields once, with its labels: ``api``, ``source_label``, ``key_label`` and the hashes.

    A table in the shared folder: its size is known when it is joined, so Spark broadcasts it below its own threshold.
    The chain of patterns is too long to compile as one stage; it runs without, on these few rows only.
    """
    c = F.col
    few = session.checkpoint(raw.select(*IDENTITY).distinct())
    df = I.with_source_labels(I.with_upstream_key(few))
    df = df.withColumn("key_label", X.mask_key(I.client_key_canonical(c("api_key"))))
    named = df.select(*IDENTITY, "api", "source_label", "key_label", I.client_key_hash(c("api_key"), salt).alias("api_key_hash"),
                      I.client_key_hash(c("key_label"), salt).alias("label_hash"))
    spark, compiled = raw.sparkSession, "spark.sql.codegen.wholeStage"
    path, old = session.fresh_path(spark, "identities"), spark.conf.get(compiled, "true")
    spark.conf.set(compiled, "false")
    try:
        named.write.parquet(path)
    finally:
        spark.conf.set(compiled, old)
    return spark.read.schema(named.schema).parquet(path)


def normalize_requests(raw: DataFrame, ingest_time: Column, salt: str = "", allow_headers: str = "") -> DataFrame:
    """Raw records to fact rows.

    The label heuristics are long chains of patterns, and requests share few identities: labels are made once per
    combination and come back by a join on it. Failure texts are only searched where there is one.
    """
    c = F.col
    raw = raw.withColumns({n: F.coalesce(c(n), F.lit("")) for n in IDENTITY})
    df = K.raw_tokens(raw.withColumn("model", X.first_text(c("model"), F.lit("unknown")))).join(identities(raw, salt), IDENTITY)
    body = tidy(c("failure_body"))
    return df.select(
        F.coalesce(c("requested_at"), ingest_time).alias("ts"), "api", "model",
        c("source_label").alias("source"), I.source_key(c("source_label")).alias("source_key"),
        tidy(c("provider")).alias("provider"), tidy(c("auth_id")).alias("auth_id"),
        tidy(c("auth_index")).alias("auth_index"), tidy(c("auth_type")).alias("auth_type"),
        c("key_label").alias("api_key"), "api_key_hash", "label_hash",
        I.infer_endpoint(c("endpoint"), c("provider"), c("source"), c("executor_type")).alias("endpoint"),
        tidy(c("base_url")).alias("base_url"), "stream",
        "input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens", "cache_tokens",
        "cache_write_tokens", "total_tokens", "latency_ms", "ttft_ms", "failed", "status_code",
        F.when(F.coalesce(body, F.lit("")) == "", F.lit("")).otherwise(X.shorten(X.redact_text(body), FAILURE_LIMIT)).alias("failure"),
        I.thinking_struct(c("reasoning_effort")).alias("thinking"),
        X.headers_filter(c("response_headers"), allow_headers).alias("headers"))
