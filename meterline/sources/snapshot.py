"""Export documents (api -> model -> details) in and out."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.functions import identity as I
from meterline.functions import timeparse as P
from meterline.functions.text import first_text, tidy
from meterline.functions.tokens import with_effective
from meterline.operators import events as E
from meterline.operators import rollup as R
from meterline.schema import SUMS, TOKEN_COLUMNS

_DETAIL = ("struct<timestamp:string, model:string, latency_ms:bigint, ttft_ms:bigint, source:string, "
           "provider:string, auth_id:string, auth_index:string, auth_type:string, api_key:string, "
           "api_key_hash:string, endpoint:string, base_url:string, stream:boolean, "
           "thinking:struct<intensity:string,mode:string,level:string,budget:bigint>, "
           "headers:map<string,array<string>>, tokens:struct<"
           + ", ".join(f"{c}:bigint" for c in TOKEN_COLUMNS)
           + ">, failed:boolean, status_code:int, failure:string>")
SNAPSHOT_SCHEMA = (f"version int, exported_at string, usage struct<apis:map<string, struct<models:map<string, "
                   f"struct<details:array<{_DETAIL}>>>>>>")
#: Names of the counters in documents.
EXPORTED = {"total_requests": "requests", "success_count": "successes", "failure_count": "failures",
            "total_tokens": "total_tokens", "input_tokens": "input_tokens", "output_tokens": "output_tokens",
            "cached_tokens": "cache_read_tokens", "cache_write_tokens": "cache_write_tokens",
            "reasoning_tokens": "reasoning_tokens"}
_TEXT = ["source", "provider", "auth_id", "auth_index", "auth_type", "api_key", "api_key_hash", "endpoint",
         "base_url", "failure"]


def read_snapshot(spark: SparkSession, path: str, indented: bool = False) -> DataFrame:
    """One document per line, or with ``indented`` one per file. What is not such a document fails the read."""
    return flatten_snapshot(spark.read.schema(SNAPSHOT_SCHEMA).json(path, mode="FAILFAST", multiLine=indented))


def flatten_snapshot(docs: DataFrame) -> DataFrame:
    """One row per detail; the detail's model wins, blank upstream names are dropped."""
    c = F.col
    rows = (docs.select("version", F.explode("usage.apis").alias("api", "a"))
            .select("version", tidy(c("api")).alias("api"), F.explode("a.models").alias("outer_model", "m"))
            .where("api <> ''")
            .select("version", "api", "outer_model", F.posexplode("m.details").alias("detail_index", "d")))
    model = I.norm_model(first_text(c("d.model"), c("outer_model")))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "version", "api", model.alias("model"), "detail_index", P.norm_time(c("d.timestamp")).alias("ts"),
        *[F.coalesce(c("d." + t), F.lit("")).alias(t) for t in _TEXT],
        F.coalesce(c("d.stream"), F.lit(False)).alias("stream"),
        F.coalesce(c("d.failed"), F.lit(False)).alias("failed"),
        F.coalesce(c("d.status_code"), F.lit(0)).alias("status_code"),
        *[F.coalesce(c("d." + t), zero).alias(t) for t in ("latency_ms", "ttft_ms")],
        *[F.coalesce(c("d.tokens." + t), zero).alias(t) for t in TOKEN_COLUMNS],
        c("d.thinking").alias("thinking"), c("d.headers").alias("headers"))


def validate_import(flat: DataFrame) -> DataFrame:
    """First offending row (unsupported version or a negative count); empty when the import is fine."""
    negative = F.lit(False)
    for t in TOKEN_COLUMNS:
        negative = negative | (F.col(t) < 0)
    reason = (F.when(~F.coalesce(F.col("version"), F.lit(0)).isin(0, 1), F.lit("unsupported version"))
              .when(negative, F.lit("negative token count")))
    return (flat.select("api", "model", "detail_index", reason.alias("reason")).where("reason is not null")
            .orderBy("api", "model", "detail_index", "reason").limit(1))


def _detail_struct() -> Column:
    c = F.col
    return F.struct(
        P.local_timestamp(c("ts")).alias("timestamp"), c("id").alias("id"), "model", "latency_ms", "ttft_ms",
        "source", "provider", "auth_id", "auth_index", "auth_type", "api_key", "api_key_hash", "endpoint",
        "base_url", "stream", F.struct(*TOKEN_COLUMNS).alias("tokens"), "failed", "status_code", "failure")


def snapshot_rows(facts: DataFrame, details_per_model: int) -> DataFrame:
    """One row per (api, model): all counters, those of the whole api, and the newest details in time order.

    The detail arrays are bounded by ``details_per_model``; counters cover every row.
    """
    facts = facts.withColumn("model", I.norm_model(F.col("model")))
    whole = Window.partitionBy("api")  # over the rollup: one row per model of an upstream
    totals = R.aggregate(with_effective(facts), ["api", "model"]).withColumn(
        "api_totals", F.struct(*[F.sum(s).over(whole).alias(s) for s in SUMS]))
    newest = E.visible_details(facts, details_per_model)
    nested = (newest.select("api", "model", F.struct(F.coalesce(P.ntz_to_micros(F.col("ts")), F.lit(-2**62)).alias("at"),
                                                     "id", _detail_struct().alias("d")).alias("x"))
              .groupBy("api", "model").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]).alias("details")))
    return totals.join(nested, ["api", "model"], "left")


def _counters(at: str) -> list[Column]:
    """Counters under their names in documents."""
    count = F.col(at + "latency_count")
    mean = F.when(count > 0, F.round(F.col(at + "latency_sum") / count, 6)).otherwise(F.lit(0.0))
    return [*[F.col(at + s).cast("bigint").alias(n) for n, s in EXPORTED.items()], mean.alias("avg_latency_ms")]


def snapshot_documents(facts: DataFrame, details_per_model: int, exported_at: str) -> DataFrame:
    """Self-contained documents, one per (api, model), ready for ``write.json``; the reader takes them all."""
    rows = snapshot_rows(facts, details_per_model)
    model = F.struct(*_counters(""), "details")
    api = F.struct(*_counters("api_totals."), F.create_map(F.col("model"), model).alias("models"))
    return rows.select(F.lit(1).alias("version"), F.lit(exported_at).alias("exported_at"),
                       F.struct(F.create_map(F.col("api"), api).alias("apis")).alias("usage"))
