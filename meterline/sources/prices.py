"""Price tables from files: the nested catalog and the manual list."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.text import tidy
from meterline.schema import PRICE_COLUMNS

# --- fixed values: providers whose catalog entries come first, in this order ----------------
PROVIDER_PRIORITY = ["openai", "anthropic", "google", "google-vertex", "xai", "deepseek", "alibaba",
                     "moonshotai", "mistral", "cohere", "perplexity", "groq", "cerebras", "openrouter"]
CATALOG_SCHEMA = ("map<string, struct<id:string, name:string, models:map<string, struct<id:string, name:string, "
                  "last_updated:string, cost:struct<input:double, output:double, cache_read:double, "
                  "cache_write:double>>>>>")
MANUAL_SCHEMA = ("updated_at string, prices map<string, struct<prompt:double, completion:double, "
                 "cache:double, cache_write:double>>")
# --- end of fixed values -------------------------------------------------------------------


def price_key(c: Column) -> Column:
    return F.lower(tidy(c))


def valid_price(df: DataFrame) -> Column:
    ok = F.lit(True)
    for c in PRICE_COLUMNS:
        v = F.col(c)
        ok = ok & v.isNotNull() & (v >= 0) & ~F.isnan(v) & (v < float("inf"))
    return ok


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True)
    return catalog_prices(docs.select(F.from_json("value", CATALOG_SCHEMA).alias("doc")))


def catalog_prices(docs: DataFrame) -> DataFrame:
    """Flatten provider -> models -> cost; the best-placed provider owns each key."""
    c = F.col
    rows = docs.select(F.explode("doc").alias("owner", "p")).select(
        "owner", F.explode("p.models").alias("model_key", "m"))
    rows = rows.select(
        "owner", "model_key", c("m.id").alias("model_id"),
        c("m.cost.input").alias("prompt"), c("m.cost.output").alias("completion"),
        F.coalesce(c("m.cost.cache_read"), c("m.cost.input")).alias("cache"),
        F.coalesce(c("m.cost.cache_write"), F.lit(0.0)).alias("cache_write"))
    # spread first: the aggregate below sorts, and a small file of many models is read by one task
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where(valid_price(rows)).repartition(spread, "owner", "model_key", "model_id", *PRICE_COLUMNS)
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in PROVIDER_PRIORITY]), c("owner")),
                                F.lit(0)), F.lit(len(PROVIDER_PRIORITY) + 1))
    prefix = F.concat(tidy(c("owner")), F.lit("/"))
    names = F.array(tidy(c("model_key")), F.concat(prefix, tidy(c("model_key"))),
                    tidy(c("model_id")), F.concat(prefix, tidy(c("model_id"))))
    blank = F.array(*[tidy(c(n)) == "" for n in ("model_key", "model_key", "model_id", "model_id")])
    rows = rows.select("*", place.alias("place"), blank.alias("blank"),
                       F.posexplode(names).alias("pos", "price_key"))
    rows = rows.where(~F.get(c("blank"), c("pos")))
    best = F.min_by(F.struct("price_key", *PRICE_COLUMNS), F.struct("place", "owner", "model_key", "pos"))
    return rows.groupBy(price_key(c("price_key")).alias("k")).agg(best.alias("b")).select("b.*")


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(MANUAL_SCHEMA).json(path, multiLine=True)
    entries = docs.select(F.posexplode(F.map_entries("prices")).alias("seq", "e"))
    return manual_prices(entries.select("seq", F.col("e.key").alias("price_key"), "e.value.*"))


def manual_prices(entries: DataFrame) -> DataFrame:
    """Entries (seq, price_key, prices): blank or invalid ones go, the last spelling of a key wins."""
    c = F.col
    rows = entries.select("seq", tidy(c("price_key")).alias("price_key"),
                          *[F.coalesce(c(p), F.lit(0.0)).alias(p) for p in PRICE_COLUMNS])
    rows = rows.where((c("price_key") != "") & valid_price(rows))
    last = F.max_by(F.struct("price_key", *PRICE_COLUMNS), c("seq"))
    return rows.groupBy(price_key(c("price_key")).alias("k")).agg(last.alias("b")).select("b.*")
