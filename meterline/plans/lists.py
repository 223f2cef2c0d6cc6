"""Queries over event lists, drill-down, newest rows per group and exports."""

from pyspark.sql import functions as F

from meterline import session
from meterline.functions import timeparse as P
from meterline.operators import events as E
from meterline.operators import filters as Q
from meterline.operators import rollup as R
from meterline.operators.maintain import prune_cap, prune_retention
from meterline.plans import base as B
from meterline.plans.base import facts_query
from meterline.sources import snapshot as SN
from meterline.sources import tables as S
from meterline.sources.store import FactStore

c = F.col
API = "gemini - 1"
ROW = ["id", "ts", "api", "model", "input_tokens", "total_tokens", "latency_ms", "failed"]
D_ROW = f"id, {B.TS} AS ts, api, model, input_tokens, total_tokens, latency_ms, failed"
NEWEST = "ORDER BY ts DESC NULLS LAST, id DESC"
AT = "TIMESTAMP '2024-01-20 10:00:00'"


def _at():
    return F.expr("timestamp_ntz'2024-01-20 10:00:00'")


# --- pages ---------------------------------------------------------------------------------

@facts_query("events_page", f"""{B.REQ}, w AS (SELECT * FROM requests WHERE ts >= {B.NOW} - INTERVAL 7 DAY AND model = 'model-a'),
  p AS (SELECT * FROM w {NEWEST} LIMIT 500 OFFSET 20) SELECT {D_ROW}, (SELECT count(*) FROM w) AS total FROM p""")
def events_page(facts):
    """Page and total: the count is one row, so joining it is cheap."""
    q = Q.Query(range="7d", model="model-a", limit=500, offset=20)
    total = Q.count_filtered(facts, q, S.now())
    return E.events_page(facts, q, S.now()).select(*ROW).join(F.broadcast(total), F.lit(True))


@facts_query("events_after", f"""{B.REQ}, cur AS (SELECT max(ts) AS ts FROM requests WHERE ts <= {AT}),
  k AS (SELECT r.ts, max(id) AS id FROM requests r JOIN cur ON r.ts = cur.ts GROUP BY r.ts)
  SELECT {D_ROW} FROM (SELECT requests.* FROM requests, k WHERE requests.model = 'model-a' AND (requests.ts IS NULL OR requests.ts < k.ts
  OR (requests.ts = k.ts AND requests.id < k.id)) {NEWEST.replace('ts', 'requests.ts').replace('id D', 'requests.id D')} LIMIT 200)""")
def events_after(facts):
    """The page behind the newest row up to a moment: the cursor is looked up first."""
    last = Q.filter_before(facts, _at()).where("ts is not null").orderBy(*E.newest_first()).select("ts", "id").first()
    if last is None:
        return facts.select(*ROW).limit(0)
    ts = F.lit(last["ts"]).cast("timestamp_ntz")
    return E.events_after(facts, Q.Query(model="model-a", limit=200, cursor=(ts, last["id"])), S.now()).select(*ROW)


@facts_query("export_window", f"""{B.REQ}, w AS (SELECT * FROM requests WHERE (ts IS NULL OR ts <= {AT}) AND ts >= {AT} - INTERVAL 7 DAY)
  SELECT {D_ROW} FROM (SELECT * FROM w {NEWEST} LIMIT 1000)""")
def export_window(facts):
    return E.export_window(facts, Q.Query(range="7d"), _at(), E.export_cap(5000, 1000)).select(*ROW)


@facts_query("export_json", f"""{B.REQ}, w AS (SELECT * FROM requests WHERE (ts IS NULL OR ts <= {AT}))
  SELECT count(*) AS total, least(count(*), 1000) AS "limit", count(*) > 1000 AS truncated, least(count(*), 1000) AS events FROM w""")
def export_json(facts):
    """The JSON export: wrapper row, and events counted as read back."""
    spark = facts.sparkSession
    path = session.fresh_path(spark, "export-json")
    E.write_json(facts, Q.Query(), _at(), 1000, path)
    events = spark.read.schema("id long").json(path + "/events").agg(F.count(F.lit(1)).alias("events"))
    head = spark.read.schema("total long, limit long, truncated boolean").json(path + "/header")
    return head.join(F.broadcast(events), F.lit(True))


_EXPORTED = f"w AS (SELECT * FROM requests WHERE ts >= {B.NOW} - INTERVAL 7 DAY)"


@facts_query("export_jsonl", f"""{B.REQ}, {_EXPORTED} SELECT id, api_key, {B.d_sanitize('failure')} AS failure, total_tokens FROM w""")
def export_jsonl(facts):
    path = session.fresh_path(facts.sparkSession, "export-jsonl")
    E.write_jsonl(E.export_window(facts, Q.Query(range="7d"), S.now(), 0), path)
    return facts.sparkSession.read.schema("id long, api_key string, failure string, total_tokens long").json(path)


@facts_query("export_gzip", f"""{B.REQ}, {_EXPORTED} SELECT id, api_key, {B.d_sanitize('failure')} AS failure, total_tokens FROM w""")
def export_gzip(facts):
    path = session.fresh_path(facts.sparkSession, "export-gzip")
    E.write_jsonl(E.export_window(facts, Q.Query(range="7d"), S.now(), 0), path, gzip=True)
    return facts.sparkSession.read.schema("id long, api_key string, failure string, total_tokens long").json(path)


_CSV_COLS = ["at", "model", "source", "credential", "result", "latency", "ttft", "uncached", "output", "reasoning", "cache", "cache_write",
             "total", "status", "failure"]


@facts_query("export_csv", f"""{B.FACTS} SELECT CASE WHEN ts IS NULL THEN '' ELSE regexp_replace(strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || '+08:00' END AS at,
  model_raw AS model, api AS source, auth_index AS credential, CASE WHEN failed THEN '失败' ELSE '成功' END AS result, CAST(latency_ms AS VARCHAR) AS latency,
  CAST(ttft_ms AS VARCHAR) AS ttft, CAST(uncached AS VARCHAR) AS uncached, CAST(output_tokens AS VARCHAR) AS output, CAST(reasoning_tokens AS VARCHAR) AS reasoning,
  CAST(cache_read_tokens AS VARCHAR) AS cache, CAST(cache_write_tokens AS VARCHAR) AS cache_write, CAST(total_tokens AS VARCHAR) AS total,
  CASE WHEN status_code = 0 THEN '' ELSE CAST(status_code AS VARCHAR) END AS status, {B.d_sanitize('failure')} AS failure FROM m""")
def export_csv(facts):
    """Written as CSV with the 15-column header, then read back."""
    path = session.fresh_path(facts.sparkSession, "export-csv")
    E.write_csv(E.export_window(facts, Q.Query(), S.now(), 0), path)
    back = facts.sparkSession.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path).na.fill("")
    return back.toDF(*_CSV_COLS)


# --- one upstream --------------------------------------------------------------------------

_ONE = f"one AS (SELECT * FROM m WHERE api = '{API}' AND ts >= {B.NOW} - INTERVAL 7 DAY)"


def _one(facts):
    return E.detail_rows(facts, API, S.now(), "7d")


facts_query("detail_summary", f"{B.FACTS}, {_ONE} {B.d_group({}, 'one')}")(lambda f: E.detail_summary(_one(f)))
facts_query("detail_models", f"{B.FACTS}, {_ONE} {B.d_group({'model': 'model'}, 'one')}")(lambda f: E.detail_models(_one(f)))
facts_query("detail_sources", f"{B.FACTS}, {_ONE} " + B.d_group(
    {"source": f"CASE WHEN {B.d_secret('source_key')} OR {B.d_credential('source_key')} THEN '未知来源' ELSE source_key END"},
    "one", extra="coalesce(min(nullif(provider_raw, '')), '') AS provider, "))(lambda f: E.detail_sources(_one(f)))
facts_query("recent_top", f"{B.REQ} SELECT {D_ROW} FROM (SELECT * FROM requests WHERE api = '{API}' {NEWEST} LIMIT 120)")(
    lambda f: E.recent_top(f, API, S.now(), 120).select(*ROW))
_ERR = "CASE WHEN trim(failure) = '' THEN 'unknown failure' ELSE trim(failure) END"
facts_query("agg_errors", f"""{B.REQ} SELECT CAST(status_code AS BIGINT) AS status_code, {_ERR} AS failure, count(*) AS errors FROM requests WHERE failed
  GROUP BY 1, 2 ORDER BY errors DESC, status_code, failure LIMIT 20""")(lambda f: E.agg_errors(f))

# --- newest per group ----------------------------------------------------------------------

_RANKED = "k AS (SELECT *, row_number() OVER (PARTITION BY api, model ORDER BY ts DESC NULLS LAST, id DESC) AS rn FROM requests)"
facts_query("visible_details", f"{B.REQ}, {_RANKED} SELECT {D_ROW} FROM k WHERE rn <= 25")(lambda f: E.visible_details(f, 25).select(*ROW))
facts_query("visible_count", f"{B.REQ}, {_RANKED} SELECT count(*) AS visible FROM k WHERE rn <= 60")(lambda f: E.visible_count(f, 60))
facts_query("cap_overflow", f"{B.REQ}, {_RANKED} SELECT {D_ROW} FROM k WHERE rn > 60")(lambda f: E.cap_overflow(f, 60).select(*ROW))


def _both(pair):
    kept, gone = pair
    return kept.select(F.lit("kept").alias("part"), *ROW).unionByName(gone.select(F.lit("removed").alias("part"), *ROW))


facts_query("prune_cap", f"{B.REQ}, {_RANKED} SELECT CASE WHEN rn <= 60 THEN 'kept' ELSE 'removed' END AS part, {D_ROW} FROM k")(
    lambda f: _both(prune_cap(f, S.now(), 60, 0)))
facts_query("prune_retention", f"{B.REQ} SELECT CASE WHEN ts IS NULL OR ts >= {B.NOW} - INTERVAL 20 DAY THEN 'kept' ELSE 'removed' END AS part, {D_ROW} FROM requests")(
    lambda f: _both(prune_retention(f, S.now(), 20)))


# --- fact folders and snapshots ------------------------------------------------------------

@facts_query("sink_requests", f"{B.FACTS} SELECT day AS local_day, count(*) AS requests, CAST(sum(latency_ms) AS BIGINT) AS latency FROM m GROUP BY 1")
def sink_requests(facts):
    path = session.fresh_path(facts.sparkSession, "facts")
    E.write_facts(facts, path)
    back = facts.sparkSession.read.option("basePath", path).schema(E.partitioned_schema(facts)).parquet(path)
    return back.groupBy("local_day").agg(F.count(F.lit(1)).alias("requests"), F.sum("latency_ms").alias("latency"))


def _store(facts):
    """A fact store filled in two batches."""
    store = FactStore(facts.sparkSession, session.fresh_path(facts.sparkSession, "store"), facts.schema).create()
    store.append(facts.where("id % 3 = 0"))
    store.append(facts.where("id % 3 <> 0"))
    return store


@facts_query("store_scan", f"{B.REQ} SELECT {D_ROW} FROM requests WHERE ts >= {B.NOW} - INTERVAL 7 DAY AND model = 'model-a'")
def store_scan(facts):
    """A filtered list from stored facts: only the folders of seven days are read."""
    return Q.apply(_store(facts).read(), Q.Query(range="7d", model="model-a"), S.now()).select(*ROW)


@facts_query("store_expire", f"{B.REQ} SELECT {D_ROW} FROM requests WHERE ts IS NULL OR ts >= {B.NOW} - INTERVAL 20 DAY")
def store_expire(facts):
    store = _store(facts)
    store.expire(S.now(), 20)
    return store.read().select(*ROW)


@facts_query("store_compact", f"{B.FACTS} SELECT day AS local_day, count(*) AS requests, 1 AS batches, CAST(sum(latency_ms) AS BIGINT) AS latency FROM m GROUP BY 1")
def store_compact(facts):
    store = _store(facts)
    store.compact()
    folder = F.regexp_extract(F.input_file_name(), "batch=([^/]*)", 1)
    return store.read().withColumn("batch", folder).groupBy("local_day").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("batch").alias("batches"), F.sum("latency_ms").alias("latency"))


_TOP = "k AS (SELECT *, row_number() OVER (PARTITION BY api, model ORDER BY ts DESC NULLS LAST, id DESC) AS rn FROM m)"
_EDGE = "CASE WHEN ts IS NULL THEN '' ELSE regexp_replace(strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || '+08:00' END"


@facts_query("export_snapshot", f"""{B.FACTS}, {_TOP}, a2 AS (SELECT api, model, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  least(count(*), 40) AS details FROM k GROUP BY 1, 2), z AS (SELECT api, model, max(CASE WHEN rn = 1 THEN {_EDGE} END) AS newest, max(CASE WHEN rn = 1 THEN id END) AS newest_id FROM k GROUP BY 1, 2)
  SELECT a2.*, newest, newest_id FROM a2 JOIN z ON a2.api = z.api AND a2.model = z.model""")
def export_snapshot(facts):
    rows = SN.snapshot_rows(facts, 40)
    last = F.element_at("details", -1)
    return rows.select("api", "model", "requests", "total_tokens", F.size("details").cast("bigint").alias("details"),
                       last["timestamp"].alias("newest"), last["id"].alias("newest_id"))


@facts_query("src_export_snapshot", f"""{B.FACTS}, {_TOP} SELECT api, model, ts2 AS ts, input_raw AS input_tokens, total_given AS total_tokens, latency_ms, failed, failure FROM
  (SELECT k.*, {B.TS.replace('ts,', 'k.ts,')} AS ts2, r.input_tokens AS input_raw FROM k JOIN requests r ON k.id = r.id WHERE rn <= 40)""")
def src_export_snapshot(facts):
    """Documents of the snapshot export, through JSON and flattened again."""
    docs = SN.snapshot_documents(facts, 40, S.NOW).select(F.to_json(F.struct("version", "exported_at", "usage")).alias("value"))
    parsed = docs.select(F.from_json("value", SN.SNAPSHOT_SCHEMA).alias("d")).select("d.*")
    return SN.flatten_snapshot(parsed).select("api", "model", "ts", "input_tokens", "total_tokens", "latency_ms", "failed", "failure")


@facts_query("validate_import", f"""{B.FACTS} SELECT api, model, id AS detail_index, 'negative token count' AS reason FROM m WHERE id % 1000 = 999
  ORDER BY api, model, id LIMIT 1""")
def validate_import(facts):
    flat = R.with_dimensions(facts).withColumns({
        "version": F.lit(1), "detail_index": c("id"), "input_tokens": F.when(c("id") % 1000 == 999, F.lit(-1)).otherwise(c("input_tokens"))})
    return SN.validate_import(flat)
