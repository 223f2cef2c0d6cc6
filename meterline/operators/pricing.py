"""Price selection and cost."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions import tokens as K
from meterline.functions.text import tidy
from meterline.operators import rollup as R
from meterline.schema import PRICE_COLUMNS
from meterline.sources.prices import price_key


def lookup_keys(model: Column, provider: Column) -> Column:
    """Keys to try, best first; blank ones are ''."""
    m, p = tidy(model), tidy(provider)
    both = F.when((p != "") & (m != ""), F.concat(p, F.lit("/"), m)).otherwise(F.lit(""))
    rest = F.regexp_extract(m, "(?s)^[^/]+/(.+)$", 1)
    return F.array(*[price_key(k) for k in (both, m, rest)])


def price_lookup(pairs: DataFrame, manual: DataFrame, catalog: DataFrame) -> DataFrame:
    """One price per distinct (model, provider); pairs without a price are left out.

    All keys are tried in the manual prices before the catalog. The price side is as large as the
    price list, so its broadcast is left to the size check of Spark (static or adaptive).
    """
    c = F.col
    keys = (pairs.select("model", "provider").distinct()
            .select("model", "provider", F.posexplode(lookup_keys(c("model"), c("provider"))).alias("pos", "k"))
            .where("k <> ''"))
    tiers = None
    for tier, table in enumerate((manual, catalog)):
        t = table.select(F.lit(tier).alias("tier"), price_key(c("price_key")).alias("k"), *PRICE_COLUMNS)
        tiers = t if tiers is None else tiers.unionByName(t)
    best = F.min_by(F.struct(c("k").alias("matched_key"), "tier", *PRICE_COLUMNS), F.struct("tier", "pos"))
    return (keys.join(tiers, "k").groupBy("model", "provider").agg(best.alias("b"))
            .select("model", "provider", "b.*"))


def with_cost(rows: DataFrame, manual: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with (model, provider) and token sums get ``micro_cost`` (exact decimal)."""
    c = F.col
    priced = price_lookup(rows, manual, catalog).drop("matched_key", "tier")
    out = rows.join(priced, ["model", "provider"], "left")
    cost = K.micro_cost(c("provider"), c("input_tokens"), c("output_tokens"), c("cache_read_tokens"),
                        c("cache_write_tokens"), c("total_tokens"), *[c(p) for p in PRICE_COLUMNS])
    return out.withColumn("micro_cost", cost).drop(*PRICE_COLUMNS)


def cost_rows(facts: DataFrame, manual: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cost of every single request."""
    m = R.row_measures()
    rows = R.prepared(facts).select("id", "model", "provider", *[m[n].alias(n) for n in R.TOKENS])
    return with_cost(rows, manual, catalog).select("id", "model", "provider", K.dollars(F.col("micro_cost"), 9).alias("cost"))


def sum_cost(priced: DataFrame, keys: list) -> DataFrame:
    return priced.groupBy(*keys).agg(K.dollars(F.sum("micro_cost")).alias("cost"))


def series_cost(base: DataFrame, bucket: str, manual: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cost by bucket from (bucket, model, provider) token sums; also the repricing path."""
    return sum_cost(with_cost(base, manual, catalog), [bucket])


def cost_by(facts: DataFrame, labels: dict, manual: DataFrame, catalog: DataFrame) -> DataFrame:
    """Cost by label, summed over its (model, provider) parts."""
    m = R.row_measures()
    rows = R.prepared(facts)
    rows = rows.withColumns({"label_" + k: v for k, v in labels.items()})
    parts = rows.groupBy(*["label_" + k for k in labels], "model",
                         F.lower(tidy(F.col("provider"))).alias("provider")).agg(
        *[F.sum(m[n]).cast("bigint").alias(n) for n in R.TOKENS])
    priced = with_cost(parts, manual, catalog).select(*[F.col("label_" + k).alias(k) for k in labels], "micro_cost")
    return sum_cost(priced, list(labels))


def price_effective(manual: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog overlaid by the manual prices."""
    left, right = manual.withColumn("k", price_key(F.col("price_key"))), catalog.withColumn("k", price_key(F.col("price_key")))
    return right.join(left.select("k"), "k", "left_anti").unionByName(left).drop("k")


def price_delete(prices: DataFrame, names: DataFrame) -> DataFrame:
    """Drop the named prices (column ``price_key``), ignoring case."""
    gone = names.select(price_key(F.col("price_key")).alias("k")).distinct()
    return prices.withColumn("k", price_key(F.col("price_key"))).join(gone, "k", "left_anti").drop("k")
