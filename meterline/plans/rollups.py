"""Queries over filters, rollups, series, prices, ratios and health."""

from pyspark.sql import functions as F

from meterline.functions import identity as I
from meterline.operators import clients as L
from meterline.operators import filters as Q
from meterline.operators import health as H
from meterline.operators import metrics as N
from meterline.operators import pricing as C
from meterline.operators import rollup as R
from meterline.plans import base as B
from meterline.plans.base import facts_query, query
from meterline.schema import SUMS
from meterline.sources import prices as PR
from meterline.sources import tables as S

c = F.col
API, MODEL, SOURCE, AUTH = "gemini - 1", "model-a", "prod", "auth-05"


def _prices(facts):
    spark = facts.sparkSession
    return S.manual_prices(spark), S.catalog_prices(spark)


# --- scan and filters ----------------------------------------------------------------------

@facts_query("scan_requests", f"""{B.REQ} SELECT id, {B.TS} AS ts, api, model, source, provider, auth_index, api_key, api_key_hash, endpoint,
  stream, input_tokens, output_tokens, total_tokens, latency_ms, failed, CAST(status_code AS BIGINT) AS status_code, failure FROM requests""")
def scan_requests(facts):
    return facts.select("id", "ts", "api", "model", "source", "provider", "auth_index", "api_key", "api_key_hash", "endpoint", "stream",
                        "input_tokens", "output_tokens", "total_tokens", "latency_ms", "failed", "status_code", "failure")


_RANGES = ["7h", "24h", "7d", "all"]


@facts_query("filter_range", B.REQ + " " + " UNION ALL ".join(
    f"SELECT '{r}' AS range, id FROM requests WHERE " + (
        "true" if r == "all" else f"ts >= {B.NOW} - INTERVAL {Q.RANGE_HOURS[r]} HOUR") for r in _RANGES))
def filter_range(facts):
    out = None
    for r in _RANGES:
        part = Q.filter_range(facts, r, S.now()).select(F.lit(r).alias("range"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@facts_query("filter_before", f"{B.REQ} SELECT id, {B.TS} AS ts FROM requests WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-15 12:00:00'")
def filter_before(facts):
    return Q.filter_before(facts, F.expr("timestamp_ntz'2024-01-15 12:00:00'")).select("id", "ts")


@facts_query("filter_dims", f"""{B.REQ} SELECT id FROM requests WHERE model = '{MODEL}' AND source_key = '{SOURCE}'
  AND auth_index = '{AUTH}' AND api = '{API}' UNION ALL SELECT id FROM requests WHERE model = '{MODEL}' AND source_key = '{SOURCE}'""")
def filter_dims(facts):
    return Q.filter_dims(facts, MODEL, SOURCE, AUTH, API).select("id").unionByName(
        Q.filter_dims(facts, MODEL, SOURCE).select("id"))


def _sha(text: str) -> str:
    import hashlib
    return hashlib.sha256(text.encode()).hexdigest()[:56]


_OWN, _LABEL, _PLAIN = _sha(":bravo-000001"), _sha(":b******"), _sha(":s******")
_SELECTORS = {
    "u": "api_key_hash = '' AND api_key = ''",
    f"m.{_PLAIN}": f"api_key <> '' AND label_hash = '{_PLAIN}'",
    f"h.{_OWN}": f"api_key <> '' AND api_key_hash = '{_OWN}'",
    f"h.{_OWN}.{_LABEL}": f"api_key <> '' AND (api_key_hash = '{_OWN}' OR (api_key_hash = '' AND label_hash = '{_LABEL}'))",
    "h.nonsense": "false",
}


@facts_query("filter_client", B.REQ + " " + " UNION ALL ".join(
    f"SELECT '{k}' AS selector, id FROM requests WHERE {w}" for k, w in _SELECTORS.items()))
def filter_client(facts):
    out = None
    for k in _SELECTORS:
        part = Q.filter_client(facts, k).select(F.lit(k).alias("selector"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@facts_query("count_filtered", f"{B.REQ} SELECT count(*) AS total FROM requests WHERE ts >= {B.NOW} - INTERVAL 7 DAY AND model = '{MODEL}' AND api = '{API}'")
def count_filtered(facts):
    return Q.count_filtered(facts, Q.Query(range="7d", model=MODEL, api=API), S.now())


# --- dimensions ----------------------------------------------------------------------------

_BASE = ["api", "model", "source", "provider_raw AS provider", "auth_id", "auth_index", "auth_type", "api_key", "api_key_hash",
         "endpoint_raw AS endpoint", "ts_missing", "day", "hour"]
_BASE_SQL = (f"SELECT *, {B.D_AVG} FROM (SELECT {', '.join(_BASE)}, {B.d_sums()} FROM m GROUP BY api, model, source, provider_raw, auth_id, "
             "auth_index, auth_type, api_key, api_key_hash, endpoint_raw, ts_missing, day, hour)")

facts_query("agg_range_base", f"{B.FACTS} {_BASE_SQL}")(R.range_base)
facts_query("rollup_rebuild", f"{B.FACTS} {_BASE_SQL}")(R.range_base)
facts_query("agg_total", B.d_by({}))(R.total)
facts_query("agg_api", B.d_by({"api": "api"}))(R.by_api)
facts_query("agg_api_model", B.d_by({"api": "api", "model": "model"}))(R.by_api_model)
facts_query("agg_model", B.d_by({"model": "model"}))(R.by_model)
facts_query("agg_credential", B.d_by({"credential": "credential"}))(R.by_credential)
facts_query("agg_endpoint", B.d_by({"endpoint": "endpoint"}))(R.by_endpoint)
facts_query("agg_endpoint_model", B.d_by({"endpoint": "endpoint", "model": "model"}))(R.by_endpoint_model)
facts_query("agg_source", B.d_by({"source": "source_name"}, extra="coalesce(min(nullif(provider_raw, '')), '') AS provider, "))(R.by_source)

_NO_LATENCY = SUMS[:9]


@facts_query("agg_model_provider", f"""{B.FACTS}, p AS ({B.d_group({'model': 'model', 'provider': 'provider'}, names=_NO_LATENCY)})
  SELECT * FROM p UNION ALL SELECT model, '' AS provider, {', '.join(f"CAST(greatest(sum({s}) + max(CASE WHEN provider = 'gemini' THEN {s} ELSE 0 END) - sum({s}), 0) AS BIGINT) AS {s}" for s in _NO_LATENCY)}
  FROM p GROUP BY model HAVING max(CASE WHEN provider = 'gemini' THEN requests ELSE 0 END) > 0""")
def agg_model_provider(facts):
    """Provider parts beside stored parents that know the gemini history twice."""
    parts = R.by_model_provider(facts)
    extra = parts.where("provider = 'gemini'")
    parents = R.regroup(parts.unionByName(extra), ["model"])
    return R.with_remainder(parts, parents)


facts_query("agg_client", f"""{B.FACTS} SELECT * FROM (SELECT *, {B.D_AVG} FROM (SELECT client, min(api_key) AS api_key,
  max(api_key_hash) AS api_key_hash, {B.d_sums()} FROM m WHERE client IS NOT NULL GROUP BY client))""")(L.client_groups)
facts_query("agg_client_model", f"{B.FACTS}, n AS (SELECT * FROM m WHERE client IS NOT NULL) {B.d_group({'client': 'client', 'model': 'model'}, 'n')}")(L.client_models)

_GROUPS = (f"g AS (SELECT client, min(api_key) AS api_key, max(api_key_hash) AS api_key_hash, {B.d_sums()} FROM m WHERE client IS NOT NULL GROUP BY client), "
           "l AS (SELECT api_key AS label, count(DISTINCT nullif(api_key_hash, '')) AS hashes, bool_or(api_key_hash = '') AS plain, count(*) AS n, max(api_key_hash) AS one FROM g GROUP BY 1), "
           "j AS (SELECT g.*, n > 1 AND (hashes <= 1 OR plain) AS merge, CASE WHEN hashes = 1 THEN one ELSE '' END AS merged FROM g JOIN l ON g.api_key = l.label), "
           "k AS (SELECT * REPLACE (CASE WHEN merge THEN merged ELSE api_key_hash END AS api_key_hash), CASE WHEN merge THEN api_key ELSE client END AS grp FROM j), "
           f"cg AS (SELECT *, {B.D_AVG} FROM (SELECT min(api_key) AS api_key, max(api_key_hash) AS api_key_hash, "
           + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in SUMS) + " FROM k GROUP BY grp))")
facts_query("client_coalesce", f"{B.FACTS}, {_GROUPS} SELECT * FROM cg")(lambda facts: L.coalesce_masked(L.client_groups(facts)))
facts_query("client_coalesce_models", f"""{B.FACTS}, {_GROUPS}, cm AS (SELECT client, model, {B.d_sums()} FROM m WHERE client IS NOT NULL GROUP BY 1, 2)
  SELECT *, {B.D_AVG} FROM (SELECT min(k.api_key) AS api_key, max(k.api_key_hash) AS api_key_hash, cm.model AS model, {", ".join(f"CAST(sum(cm.{s}) AS BIGINT) AS {s}" for s in SUMS)}
  FROM cm JOIN k ON cm.client = k.client GROUP BY k.grp, cm.model)""")(L.coalesced_models)
facts_query("client_selector", f"""{B.FACTS}, {_GROUPS} SELECT api_key, api_key_hash, requests,
  CASE WHEN api_key_hash <> '' THEN 'h.' || api_key_hash || '.' || substr(sha256(':' || api_key), 1, 56)
  ELSE 'm.' || substr(sha256(':' || api_key), 1, 56) END AS selector FROM cg""")(
    lambda facts: L.with_selector(L.coalesce_masked(L.client_groups(facts)), "", 256).select("api_key", "api_key_hash", "requests", "selector"))

_SETS = {"total": ("''", "''"), "api": ("api", "''"), "api_model": ("api", "model"), "model": ("model", "''"), "model_provider": ("model", "provider"),
         "source": ("source_name", "''"), "credential": ("credential", "''"), "endpoint": ("endpoint", "''"), "endpoint_model": ("endpoint", "model"),
         "client": ("client", "''"), "client_model": ("client", "model"), "day": ("day", "''"), "hour": ("lpad(CAST(hour AS VARCHAR), 2, '0')", "''")}


@facts_query("summary_multi", f"{B.FACTS} SELECT *, {B.D_AVG} FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {a} AS key1, {b} AS key2, {B.d_sums()} FROM m {'WHERE client IS NOT NULL ' if a == 'client' else ''}GROUP BY 1, 2, 3"
    for d, (a, b) in _SETS.items()) + ")")
def summary_multi(facts):
    return R.summary_multi(facts)


@facts_query("dim_order", f"SELECT row_number() OVER (ORDER BY requests DESC, api) AS place, api, requests FROM ({B.d_by({'api': 'api'})})")
def dim_order(facts):
    from pyspark.sql import Window
    from meterline.operators.events import dim_order as order
    ranked = order(R.by_api(facts), "api").select("api", "requests")
    # the place is added on the (small) ordered rollup so that the order can be checked
    return ranked.select(F.row_number().over(Window.orderBy(F.desc("requests"), "api")).alias("place"), "api", "requests")


# --- series --------------------------------------------------------------------------------

for _b in ("day", "hour"):
    facts_query(f"series_{_b}", f"{B.FACTS} {B.d_group({_b: _b}, names=['requests', 'total_tokens'])}")(
        lambda facts, b=_b: R.series(facts, b))
    facts_query(f"series_cost_{_b}", f"""{B.FACTS}, parts AS ({B.d_group({_b: _b, 'model': 'lower(model)', 'provider': 'provider'}, names=R.TOKENS)}),
      {B.d_cost('parts')} SELECT {_b}, {B.D_USD} AS cost FROM costed GROUP BY {_b}""")(
        lambda facts, b=_b: C.series_cost(R.series_model_tokens(facts, b), b, *_prices(facts)))

_TOK = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in R.PARTS)


@facts_query("series_tokens_parts", f"""{B.FACTS} SELECT 'day' AS kind, day AS bucket, {_TOK} FROM m GROUP BY 1, 2
  UNION ALL SELECT 'hour', lpad(CAST(hour AS VARCHAR), 2, '0'), {_TOK} FROM m GROUP BY 1, 2""")
def series_tokens_parts(facts):
    out = None
    for b in ("day", "hour"):
        part = R.series_parts(facts, b).select(F.lit(b).alias("kind"), F.lpad(c(b).cast("string"), 10 if b == "day" else 2, "0").alias("bucket"), *R.PARTS)
        out = part if out is None else out.unionByName(part)
    return out


@facts_query("series_model_tokens", f"{B.FACTS} {B.d_group({'day': 'day', 'model': 'lower(model)', 'provider': 'provider'}, names=R.TOKENS)}")
def series_model_tokens(facts):
    return R.series_model_tokens(facts, "day")


# --- prices and cost -----------------------------------------------------------------------

@facts_query("price_lookup", f"""{B.FACTS}, parts AS (SELECT model, provider_raw AS provider, 0 AS total_tokens, 0 AS input_tokens, 0 AS output_tokens,
  0 AS cache_read_tokens, 0 AS cache_write_tokens FROM m), {B.d_cost('parts')} SELECT model, provider, k AS matched_key, CAST(tier AS BIGINT) AS tier,
  prompt, completion, cache, cache_write FROM chosen""")
def price_lookup(facts):
    return C.price_lookup(R.with_dimensions(facts), *_prices(facts))


facts_query("cost_rows", f"""{B.FACTS}, parts AS (SELECT id, model, provider_raw AS provider, total_tokens, input_tokens, output_tokens, cache_read_tokens,
  cache_write_tokens FROM m), {B.d_cost('parts')} SELECT id, model, provider, round(CAST(micro_cost AS DOUBLE) / 1e6, 9) AS cost FROM costed""")(
    lambda facts: C.cost_rows(facts, *_prices(facts)))

for _name, _col, _sql in (("model", lambda: c("model"), "model"), ("api", lambda: c("api"), "api"), ("endpoint", lambda: R._endpoint(), "endpoint")):
    facts_query(f"cost_{_name}", f"""{B.FACTS}, parts AS ({B.d_group({'label': _sql, 'model': 'model', 'provider': 'provider'}, names=R.TOKENS)}),
      {B.d_cost('parts')} SELECT label AS {_name}, {B.D_USD} AS cost FROM costed GROUP BY 1""")(
        lambda facts, n=_name, f=_col: C.cost_by(facts, {n: f()}, *_prices(facts)))

_NEW = [("model-a", 7.0, 21.0, 0.7, 0.0), ("MODEL-B", 1.0, 2.0, 0.1, 0.3)]


@facts_query("reprice", f"""{B.FACTS}, parts AS ({B.d_group({'day': 'day', 'model': 'lower(model)', 'provider': 'provider'}, names=R.TOKENS)}),
  {B.d_cost('parts').replace(B.d_values(S.MANUAL, B._P), B.d_values(_NEW, B._P))} SELECT day, {B.D_USD} AS cost FROM costed GROUP BY day""")
def reprice(facts):
    """New manual prices over the token rollup written once; the facts are not read again."""
    from meterline import session
    spark = facts.sparkSession
    path = session.fresh_path(spark, "tokens-by-day")
    R.series_model_tokens(facts, "day").write.parquet(path)
    return C.series_cost(spark.read.parquet(path), "day", S.prices(spark, _NEW), S.catalog_prices(spark))


def _part_prices(spark, sf_dir, manual: bool):
    p = S.table(spark, sf_dir, "part")
    key = F.expr("CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || '/' || p_partkey")
    keep = "p_partkey % 4 = 0" if manual else "p_partkey % 2 = 0"
    key = F.lower(key) if manual else key
    v = c("p_retailprice") / (50 if manual else 100)
    return p.where(keep).select(key.alias("price_key"), v.alias("prompt"), (v * 2).alias("completion"), (v / 10).alias("cache"), F.lit(0.0).alias("cache_write"))


_PART_KEY = "CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || '/' || p_partkey"


@query("price_effective", f"""SELECT CASE WHEN p_partkey % 4 = 0 THEN lower({_PART_KEY}) ELSE {_PART_KEY} END AS price_key,
  round(p_retailprice / CASE WHEN p_partkey % 4 = 0 THEN 50 ELSE 100 END, 6) AS prompt FROM part WHERE p_partkey % 2 = 0""")
def price_effective(spark, sf_dir):
    out = C.price_effective(_part_prices(spark, sf_dir, True), _part_prices(spark, sf_dir, False))
    return out.select("price_key", F.round("prompt", 6).alias("prompt"))


@query("price_delete", f"SELECT {_PART_KEY} AS price_key, round(p_retailprice / 100, 6) AS prompt FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 4 <> 0")
def price_delete(spark, sf_dir):
    out = C.price_delete(_part_prices(spark, sf_dir, False), _part_prices(spark, sf_dir, True))
    return out.select("price_key", F.round("prompt", 6).alias("prompt"))


_OWNER = "CASE p_partkey % 4 WHEN 0 THEN 'openrouter' WHEN 1 THEN 'openai' WHEN 2 THEN 'zeta' ELSE 'anthropic' END"
_KEY = "'m-' || CAST(p_partkey {DIV} 4 AS {S})"


@query("src_price_catalog", f"""WITH r AS (SELECT {_OWNER} AS owner, {_KEY.replace('{DIV}', '//').replace('{S}', 'VARCHAR')} AS mk, p_retailprice / 100 AS prompt,
    p_retailprice / 25 AS completion, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 100 ELSE p_retailprice / 1000 END AS cache,
    CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE p_retailprice / 80 END AS cache_write FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 19 <> 0),
  k AS (SELECT *, mk AS price_key, 0 AS pos FROM r UNION ALL SELECT *, owner || '/' || mk, 1 FROM r UNION ALL
    SELECT *, upper(mk) || '-id', 2 FROM r UNION ALL SELECT *, owner || '/' || upper(mk) || '-id', 3 FROM r),
  b AS (SELECT *, row_number() OVER (PARTITION BY lower(price_key) ORDER BY CASE owner WHEN 'openai' THEN 1 WHEN 'anthropic' THEN 2
    WHEN 'openrouter' THEN 14 ELSE 15 END, mk, pos) AS rn FROM k)
  SELECT price_key, round(prompt, 6) AS prompt, round(completion, 6) AS completion, round(cache, 6) AS cache, round(cache_write, 6) AS cache_write FROM b WHERE rn = 1""")
def src_price_catalog(spark, sf_dir):
    """Catalog documents (one provider and model each) made from ``part``, read back through JSON."""
    p = c("p_retailprice")
    cost = F.struct(
        F.when(c("p_partkey") % 17 != 0, p / 100).alias("input"), F.when(c("p_partkey") % 19 != 0, p / 25).alias("output"),
        F.when(c("p_partkey") % 3 != 0, p / 1000).alias("cache_read"), F.when(c("p_partkey") % 2 != 0, p / 80).alias("cache_write"))
    key = F.expr(_KEY.replace("{DIV}", "div").replace("{S}", "STRING"))
    model = F.struct(F.concat(F.upper(key), F.lit("-id")).alias("id"), cost.alias("cost"))
    doc = F.create_map(F.expr(_OWNER), F.struct(F.expr(_OWNER).alias("id"), F.create_map(key, model).alias("models")))
    docs = S.table(spark, sf_dir, "part").select(F.to_json(doc).alias("value"))
    out = PR.catalog_prices(docs.select(F.from_json("value", PR.CATALOG_SCHEMA).alias("doc")))
    return out.select("price_key", *[F.round(x, 6).alias(x) for x in PR.PRICE_COLUMNS])


_MKEY = "CASE WHEN p_partkey % 10 = 0 THEN '  ' WHEN p_partkey % 2 = 0 THEN 'M-' || CAST(p_partkey % 300 AS {S}) ELSE ' m-' || CAST((p_partkey + 1) % 300 AS {S}) END"


@query("src_price_manual", f"""WITH r AS (SELECT p_partkey AS seq, trim({_MKEY.replace('{S}', 'VARCHAR')}) AS price_key, CASE WHEN p_partkey % 23 = 0 THEN -1.0 ELSE p_retailprice / 100 END AS prompt,
    CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_retailprice / 90 END AS cache_write FROM part),
  b AS (SELECT *, row_number() OVER (PARTITION BY lower(price_key) ORDER BY seq DESC) AS rn FROM r WHERE price_key <> '' AND prompt >= 0)
  SELECT price_key, round(prompt, 6) AS prompt, round(prompt, 6) AS completion, round(prompt, 6) AS cache, round(cache_write, 6) AS cache_write FROM b WHERE rn = 1""")
def src_price_manual(spark, sf_dir):
    v = F.when(c("p_partkey") % 23 == 0, F.lit(-1.0)).otherwise(c("p_retailprice") / 100)
    entries = S.table(spark, sf_dir, "part").select(
        c("p_partkey").alias("seq"), F.expr(_MKEY.replace("{S}", "STRING")).alias("price_key"), v.alias("prompt"), v.alias("completion"), v.alias("cache"),
        F.when(c("p_partkey") % 3 != 0, c("p_retailprice") / 90).alias("cache_write"))
    return PR.manual_prices(entries).select("price_key", *[F.round(x, 6).alias(x) for x in PR.PRICE_COLUMNS])


# --- ratios and trends ---------------------------------------------------------------------

facts_query("ratio_success", f"SELECT model, CASE WHEN requests > 0 THEN round(successes * 100 / requests, 6) ELSE 100.0 END AS success_rate FROM ({B.d_by({'model': 'model'})})")(
    lambda facts: N.ratio_success(R.by_model(facts), ["model"]))


@facts_query("ratio_cache", f"""{B.FACTS}, p AS ({B.d_group({'model': 'model', 'provider': 'provider'}, names=R.TOKENS)}),
  q AS (SELECT model, sum(greatest(cache_read_tokens - cache_write_tokens, 0)) AS hit, sum(CASE WHEN {B.d_family('provider')} = 'claude' OR (provider = ''
    AND total_tokens > 0 AND total_tokens >= input_tokens + output_tokens + cache_read_tokens) THEN input_tokens + cache_read_tokens ELSE input_tokens END) AS seen FROM p GROUP BY model)
  SELECT model, CASE WHEN seen > 0 THEN least(100.0, round(hit * 100 / seen, 6)) ELSE 0.0 END AS cache_rate FROM q""")
def ratio_cache(facts):
    return N.ratio_cache(R.by_model_provider(facts), ["model"])


@facts_query("cost_per_million", f"""{B.FACTS}, parts AS ({B.d_group({'model': 'model', 'provider': 'provider'}, names=R.TOKENS)}),
  {B.d_cost('parts')} SELECT model, CASE WHEN sum(total_tokens) <> 0 THEN round({B.D_USD} / sum(total_tokens) * 1e6, 6) ELSE 0.0 END AS cost_per_million FROM costed GROUP BY model""")
def cost_per_million(facts):
    return N.cost_per_million(C.cost_by(facts, {"model": c("model")}, *_prices(facts)), R.by_model(facts), ["model"])


@facts_query("rpm", f"{B.FACTS} SELECT 'hour' AS kind, lpad(CAST(hour AS VARCHAR), 2, '0') AS bucket, round(count(*) / 60, 6) AS rpm FROM m GROUP BY 1, 2 "
             "UNION ALL SELECT 'day', day, round(count(*) / 1440, 6) FROM m GROUP BY 1, 2")
def rpm(facts):
    h = N.rpm(R.series(facts, "hour"), "hour").select(F.lit("hour").alias("kind"), F.lpad(c("hour").cast("string"), 2, "0").alias("bucket"), "rpm")
    return h.unionByName(N.rpm(R.series(facts, "day"), "day").select(F.lit("day").alias("kind"), c("day").alias("bucket"), "rpm"))


facts_query("share", f"SELECT model, total_tokens, round(total_tokens * 100 / sum(total_tokens) OVER (), 6) AS share FROM ({B.d_by({'model': 'model'})})")(
    lambda facts: N.share(R.by_model(facts), ["model"]))

_DAILY = f"{B.FACTS}, d AS ({B.d_group({'day': 'day'}, names=['requests', 'total_tokens'])} )"
_REAL = "d WHERE day <> '0001-01-01'"


@facts_query("day_over_day", f"""{_DAILY}, w AS (SELECT day, requests AS current, lag(requests) OVER (ORDER BY day) AS previous,
  lag(day) OVER (ORDER BY day) AS previous_day FROM {_REAL}) SELECT day, previous_day, current, previous,
  CASE WHEN previous > 0 THEN round((current - previous) * 100 / previous, 6) END AS change_percent FROM w ORDER BY day DESC LIMIT 1""")
def day_over_day(facts):
    return N.day_over_day(N.present_days(R.series(facts, "day")), "requests")


@facts_query("recent_hours", f"{B.FACTS}, d AS ({B.d_group({'hour': 'hour'}, names=['requests', 'total_tokens'])}) SELECT *, (hour - 9 + 24) % 24 AS place FROM d")
def recent_hours(facts):
    from meterline.functions.timeparse import local_hour
    return N.recent_hours(R.series(facts, "hour"), local_hour(S.now()))


@facts_query("last_30_days", f"{_DAILY} SELECT * FROM d ORDER BY day DESC LIMIT 30")
def last_30_days(facts):
    return N.last_days(R.series(facts, "day"))


@facts_query("trend_stats", f"""{B.FACTS}, d AS ({B.d_group({'hour': 'hour'}, names=['requests', 'total_tokens'])}),
  parts AS ({B.d_group({'hour': 'hour', 'model': 'lower(model)', 'provider': 'provider'}, names=R.TOKENS)}), {B.d_cost('parts')},
  ch AS (SELECT hour, {B.D_USD} AS cost FROM costed GROUP BY hour HAVING hour % 5 <> 0),
  mp AS (SELECT sum(cost) AS cost FROM (SELECT hour, {B.D_USD} AS cost FROM costed GROUP BY hour)),
  p AS (SELECT d.requests, d.total_tokens, coalesce(ch.cost, d.total_tokens * (SELECT cost FROM mp) / (SELECT sum(total_tokens) FROM d)) AS cost FROM d LEFT JOIN ch ON d.hour = ch.hour)
  SELECT count(*) AS points, CAST(max(requests) AS DOUBLE) AS peak_requests, round(avg(requests), 4) AS mean_requests, CAST(max(total_tokens) AS DOUBLE) AS peak_total_tokens,
  round(avg(total_tokens), 4) AS mean_total_tokens, round(max(cost), 6) AS peak_cost, round(avg(cost), 4) AS mean_cost FROM p""")
def trend_stats(facts):
    """Every fifth hour lacks its own cost and takes the blended price."""
    series = R.series(facts, "hour")
    costs = C.series_cost(R.series_model_tokens(facts, "hour"), "hour", *_prices(facts))
    total = costs.agg(F.sum("cost").alias("cost")).join(F.broadcast(series.agg(F.sum("total_tokens").alias("total_tokens"))), F.lit(True))
    return N.trend_stats(series, costs.where(c("hour") % 5 != 0), "hour", total)


# --- health --------------------------------------------------------------------------------

_GRID = (f"{B.REQ}, w AS (SELECT CAST(epoch(time_bucket(INTERVAL 15 MINUTE, {B.NOW})) AS BIGINT) + 900 AS fin), "
         "h AS (SELECT CAST(floor(epoch_us(ts) / 900000000) AS BIGINT) * 900 AS slot_start, count(*) FILTER (WHERE NOT failed) AS success, "
         "count(*) FILTER (WHERE failed) AS failure FROM requests WHERE ts IS NOT NULL GROUP BY 1), "
         "cal AS (SELECT range AS slot, fin + (range - 480) * 900 AS slot_start FROM w, range(480)), "
         "g AS (SELECT slot, cal.slot_start, coalesce(success, 0) AS success, coalesce(failure, 0) AS failure, "
         "coalesce(success, 0) + coalesce(failure, 0) AS total FROM cal LEFT JOIN h ON cal.slot_start = h.slot_start)")
facts_query("health_grid", f"{_GRID} SELECT * FROM g")(lambda facts: H.health_grid(facts, S.now()))
facts_query("health_calendar", f"{_GRID} SELECT slot, slot_start, total > 0 AS used FROM g")(
    lambda facts: H.health_grid(facts, S.now()).select("slot", "slot_start", (c("total") > 0).alias("used")))
facts_query("health_rate", f"{_GRID} SELECT CAST(sum(success) AS BIGINT) AS success, CAST(sum(failure) AS BIGINT) AS failure, round(sum(success) * 100 / sum(total), 6) AS rate FROM g")(
    lambda facts: H.health_rate(H.health_grid(facts, S.now())))

# --- rollup algebra ------------------------------------------------------------------------

_KEYS = ["api", "model"]


def _half(facts, odd):
    return R.by_api_model(facts.where(f"id % 2 = {int(odd)}"))


facts_query("rollup_merge", B.d_by({"api": "api", "model": "model"}))(
    lambda facts: R.merge(_half(facts, False), _half(facts, True), _KEYS))
_D_HALF = f"{B.FACTS}, o AS (SELECT * FROM m WHERE id % 2 = 1), sa AS ({B.d_group({'api': 'api', 'model': 'model'})}), sb AS ({B.d_group({'api': 'api', 'model': 'model'}, 'o')})"
facts_query("rollup_residual", f"{_D_HALF} SELECT sa.api, sa.model, {', '.join(f'greatest(sa.{s} - coalesce(sb.{s}, 0), 0) AS {s}' for s in SUMS)} FROM sa LEFT JOIN sb ON sa.api = sb.api AND sa.model = sb.model")(
    lambda facts: R.residual(R.by_api_model(facts), _half(facts, True), _KEYS))

_OLD = f"ts IS NOT NULL AND ts < {B.NOW} - INTERVAL 20 DAY"


@facts_query("rollup_retract", f"{B.FACTS}, k AS (SELECT * FROM m WHERE NOT ({_OLD}) OR ts IS NULL) {B.d_group({'api': 'api', 'model': 'model', 'day': 'day'}, 'k')}")
def rollup_retract(facts):
    from meterline.operators.maintain import prune_retention
    _, gone = prune_retention(facts, S.now(), 20)
    keys = ["api", "model", "day"]
    return R.retract(R.aggregate(R.prepared(facts), keys), R.aggregate(R.prepared(gone), keys), keys)
