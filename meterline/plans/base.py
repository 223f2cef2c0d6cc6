"""Query registry and the SQL fragments shared by the DuckDB twins."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.schema import SUMS
from meterline.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result types every client reads alike: bigint, double, text for times."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) -> DataFrame under ``name`` with its SQL twin."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def facts_query(name: str, sql: str | None = None):
    """Register fn(facts) -> DataFrame over the request facts."""
    def add(fn):
        query(name, sql)(lambda spark, sf_dir: fn(S.requests(spark, sf_dir)))
        return fn
    return add


# --- DuckDB text ---------------------------------------------------------------------------

REQ = "WITH " + S.duck_facts()
NOW = f"TIMESTAMP '{S.NOW}'"
TS = "coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '')"
METHODS = "GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS"


def d_family(p: str) -> str:
    v = f"lower(trim({p}))"
    return (f"CASE WHEN {v} IN ('openai','openai-response','openai-responses') OR starts_with({v},'openai-compatib') "
            f"THEN 'openai-compatible' WHEN regexp_matches({v}, '^(anthropic|claude)(-.*)?$') THEN 'claude' "
            f"WHEN regexp_matches({v}, '^(gemini|aistudio|vertex|google|geminicli|antigravity)$') "
            f"OR regexp_matches({v}, '^(gemini|aistudio|vertex|geminicli)-') "
            f"OR regexp_matches({v}, '^antigravity[-._]') THEN 'gemini' ELSE {v} END")


def d_endpoint(x: str) -> str:
    v = f"regexp_replace(trim({x}), '^(?i:{METHODS})\\s+(\\S+).*$', '\\1')"
    v = f"regexp_replace({v}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/|$)', '\\1')"
    v = f"regexp_replace({v}, '[?#].*$', '')"
    v = f"'/' || trim({v}, '/')"
    return f"CASE {v} WHEN '/' THEN '' WHEN '/responses' THEN '/v1/responses' ELSE {v} END"


def d_secret(x: str) -> str:
    return (f"(regexp_matches({x}, '^(sk-|AIza|hf_|pk_|rk_)') OR (strlen({x}) >= 40 AND NOT regexp_matches({x}, '[ /._-]')) "
            f"OR (strlen({x}) >= 80 AND NOT contains({x}, ' ')))")


def d_credential(x: str) -> str:
    s = f"replace({x}, '-', '')"
    h = f"strlen(regexp_replace({s}, '[^0-9a-fA-F]', '', 'g'))"
    return (f"(regexp_matches({x}, '^[0-9a-fA-F]{{8,}}$') OR (contains({x}, '-') AND strlen({x}) >= 30 AND strlen({s}) >= 30 "
            f"AND ({h} >= 30 OR {h} * 5 >= strlen({s}) * 4)) OR (strlen({x}) >= 32 AND NOT regexp_matches({x}, '[ /._-]')))")


def d_redact(x: str) -> str:
    t = "[A-Za-z0-9_-]"
    v = f"coalesce({x}, '')"
    for p in ("sk-", "AIza", "hf_", "pk_", "rk_"):
        v = f"regexp_replace({v}, '{p}{t}*({t}{{2}})', '{p[:2]}******\\1', 'g')"
        if p == "AIza":
            v = f"regexp_replace({v}, 'AIza({t})', 'AI******a\\1', 'g')"
        v = f"regexp_replace({v}, '{p}{t}*', '******', 'g')"
    m = "Authorization:|authorization:|Bearer |bearer |X-API-Key:|x-api-key:|Api-Key:|api-key:"
    v = f"regexp_replace({v}, '((?:{m})[ \\t]*)([^ ,\\n\\r;]{{2}})[^ ,\\n\\r;]{{28,}}([^ ,\\n\\r;]{{2}})', '\\1\\2******\\3', 'g')"
    return (f"regexp_replace({v}, '((?:key|token|api_key|apikey)(?:=| %3D |%3D))([^ &;\\n\\r])[^ &;\\n\\r]{{31,}}', "
            f"'\\1\\2******', 'g')")


def d_sanitize(x: str) -> str:
    t = "[A-Za-z0-9_-]"
    return f"regexp_replace({d_redact(x)}, '({t}){t}\\*{{6}}{t}{{2}}', '\\1******', 'g')"


_NC = ("CASE WHEN cache_tokens > 0 THEN greatest(cache_tokens, cached_tokens, cache_write_tokens, 0) "
       "ELSE greatest(cached_tokens, 0) + greatest(cache_write_tokens, 0) END")

MODELLED = (
    f"m0 AS (SELECT *, {d_family('provider')} = 'claude' AS claude, {_NC} AS nc, "
    "greatest(input_tokens, 0) AS i0, greatest(output_tokens, 0) AS o0 FROM requests), "
    "m1 AS (SELECT *, claude OR (trim(provider) = '' AND total_tokens > 0 AND total_tokens >= i0 + o0 + nc) AS excl FROM m0), "
    "m AS (SELECT id, ts, api, source, source_key, provider AS provider_raw, auth_id, auth_index, auth_type, api_key, "
    "api_key_hash, label_hash, endpoint AS endpoint_raw, stream, failed, status_code, failure, latency_ms, ttft_ms, "
    "total_tokens AS total_given, cached_tokens, cache_tokens, excl, nc, model AS model_raw, "
    "coalesce(strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d'), '0001-01-01') AS day, "
    "coalesce(CAST(hour(ts + INTERVAL 8 HOUR) AS BIGINT), 8) AS hour, ts IS NULL AS ts_missing, "
    "CASE WHEN trim(model) = '' THEN 'unknown' ELSE trim(model) END AS model, "
    "lower(trim(provider)) AS provider, "
    "greatest(total_tokens, i0 + o0, CASE WHEN excl THEN i0 + o0 + nc ELSE 0 END) AS total_tokens, "
    "i0 AS input_tokens, o0 AS output_tokens, "
    "CASE WHEN excl THEN i0 ELSE greatest(i0 - nc, 0) END AS uncached, "
    "CASE WHEN cached_tokens > 0 THEN cached_tokens ELSE greatest(cache_tokens - greatest(cache_write_tokens, 0), 0) END AS cache_read_tokens, "
    "greatest(cache_write_tokens, 0) AS cache_write_tokens, greatest(reasoning_tokens, 0) AS reasoning_tokens, "
    "CASE WHEN auth_index = '' THEN '(空)' ELSE auth_index END AS credential, "
    f"CASE WHEN source = '' OR {d_secret('source')} OR {d_credential('source')} THEN '未知来源' ELSE source END AS source_name, "
    f"CASE WHEN {d_endpoint('endpoint')} = '' THEN 'unknown' ELSE {d_endpoint('endpoint')} END AS endpoint, "
    "CASE WHEN api_key = '' THEN NULL WHEN api_key_hash <> '' THEN 'api_key_hash:' || api_key_hash ELSE 'api_key:' || api_key END AS client "
    "FROM m1)")
FACTS = f"{REQ}, {MODELLED}"

_D_SUMS = {
    "requests": "count(*)", "successes": "count(*) FILTER (WHERE NOT failed)", "failures": "count(*) FILTER (WHERE failed)",
    **{n: f"sum({n})" for n in SUMS[3:9]},
    "latency_sum": "sum(CASE WHEN latency_ms > 0 THEN latency_ms ELSE 0 END)",
    "latency_count": "count(*) FILTER (WHERE latency_ms > 0)",
}
D_AVG = "CASE WHEN latency_count > 0 THEN round(latency_sum / latency_count, 6) ELSE 0.0 END AS avg_latency_ms"


def d_sums(names=SUMS) -> str:
    return ", ".join(f"CAST(coalesce({_D_SUMS[n]}, 0) AS BIGINT) AS {n}" for n in names)


def d_group(labels: dict, source: str = "m", names=SUMS, extra: str = "") -> str:
    """SELECT of labels and measures grouped by the labels (no WITH)."""
    keys = "".join(f"{e} AS {n}, " for n, e in labels.items())
    group = f" GROUP BY {', '.join(labels.values())}" if labels else ""
    inner = f"SELECT {keys}{extra}{d_sums(names)} FROM {source}{group}"
    return f"SELECT *, {D_AVG} FROM ({inner})" if "latency_sum" in names else inner


def d_by(labels: dict, source: str = "m", names=SUMS, extra: str = "") -> str:
    return f"{FACTS} {d_group(labels, source, names, extra)}"


def d_values(rows, names) -> str:
    vals = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {vals}) AS t({', '.join(names)}))"


_P = ["price_key", "prompt", "completion", "cache", "cache_write"]


def d_cost(parts: str) -> str:
    """WITH members pricing ``parts`` (…, model, provider, token sums) into ``costed`` with micro_cost."""
    return (
        f"manual AS {d_values(S.MANUAL, _P)}, catalog AS {d_values(S.CATALOG, _P)}, "
        "offers AS (SELECT 0 AS tier, lower(trim(price_key)) AS k, * FROM manual UNION ALL "
        "SELECT 1, lower(trim(price_key)), * FROM catalog), "
        f"pairs AS (SELECT DISTINCT model, provider FROM {parts}), "
        "tries AS (SELECT model, provider, 0 AS pos, lower(trim(provider) || '/' || trim(model)) AS k FROM pairs "
        "WHERE trim(provider) <> '' AND trim(model) <> '' UNION ALL SELECT model, provider, 1, lower(trim(model)) FROM pairs "
        "UNION ALL SELECT model, provider, 2, lower(regexp_extract(trim(model), '^[^/]+/(.+)$', 1)) FROM pairs), "
        "ranked AS (SELECT t.model, t.provider, o.*, row_number() OVER (PARTITION BY t.model, t.provider ORDER BY o.tier, t.pos) AS rn "
        "FROM tries t JOIN offers o ON t.k = o.k WHERE t.k <> ''), "
        "chosen AS (SELECT * FROM ranked WHERE rn = 1), "
        f"costed0 AS (SELECT p.*, c.prompt, c.completion, c.cache, c.cache_write, {d_family('p.provider')} = 'claude' OR (trim(p.provider) = '' "
        "AND p.total_tokens > 0 AND p.total_tokens >= p.input_tokens + p.output_tokens + p.cache_read_tokens + p.cache_write_tokens) AS px "
        f"FROM {parts} p LEFT JOIN chosen c ON p.model = c.model AND p.provider = c.provider), "
        "costed AS (SELECT *, coalesce("
        "CAST(CASE WHEN px THEN input_tokens ELSE greatest(input_tokens - cache_read_tokens - cache_write_tokens, 0) END AS DECIMAL(18,0)) * CAST(prompt AS DECIMAL(12,6)) "
        "+ CAST(output_tokens AS DECIMAL(18,0)) * CAST(completion AS DECIMAL(12,6)) "
        "+ CAST(cache_read_tokens AS DECIMAL(18,0)) * CAST(cache AS DECIMAL(12,6)) "
        "+ CAST(cache_write_tokens AS DECIMAL(18,0)) * CAST(cache_write AS DECIMAL(12,6)), 0) AS micro_cost FROM costed0)")


D_USD = "round(CAST(sum(micro_cost) AS DOUBLE) / 1e6, 6)"
