"""Caller groups."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions import identity as I
from meterline.operators import rollup as R
from meterline.schema import MASK, SUMS


def _named(facts: DataFrame) -> DataFrame:
    rows = R.prepared(facts).withColumn("client", R.client_key())
    return rows.where(F.col("client").isNotNull())


def client_groups(facts: DataFrame) -> DataFrame:
    """Measures by caller; a group shows its alphabetically first label."""
    sums = [F.sum(v).cast("bigint").alias(n) for n, v in R.row_measures().items()]
    out = _named(facts).groupBy("client").agg(
        F.min("api_key").alias("api_key"), F.max("api_key_hash").alias("api_key_hash"), *sums)
    return out.withColumn("avg_latency_ms", R.average())


def client_models(facts: DataFrame) -> DataFrame:
    return R.aggregate(_named(facts), ["client", "model"])


def _merge_groups(groups: DataFrame) -> DataFrame:
    """Adds the merged ``group`` of each caller and the hash it shows.

    Labels with two or more hashes and no hash-less group stay apart. Decided from per-label counts,
    so a label shared by millions of callers needs no collected set.
    """
    c = F.col
    masked = c("api_key").contains(MASK)
    per_label = groups.where(masked).groupBy("api_key").agg(
        F.count_if(c("api_key_hash") != "").alias("hashes"),
        F.count_if(c("api_key_hash") == "").alias("plain"),
        F.max("api_key_hash").alias("only_hash"))
    joined = groups.join(per_label, ["api_key"], "left")
    merge = F.coalesce((c("hashes") + c("plain") > 1) & ((c("hashes") <= 1) | (c("plain") > 0)), F.lit(False))
    return joined.withColumns({
        "group": F.when(merge, F.concat(F.lit("label:"), c("api_key"))).otherwise(c("client")),
        "api_key_hash": F.when(merge, F.when(c("hashes") == 1, c("only_hash")).otherwise(F.lit("")))
        .otherwise(c("api_key_hash")),
    })


def coalesce_masked(groups: DataFrame) -> DataFrame:
    """Merge groups that share a masked label."""
    out = _merge_groups(groups).groupBy("group").agg(
        F.min("api_key").alias("api_key"), F.max("api_key_hash").alias("api_key_hash"),
        *[F.sum(s).cast("bigint").alias(s) for s in SUMS])
    return out.drop("group").withColumn("avg_latency_ms", R.average())


def coalesced_models(facts: DataFrame) -> DataFrame:
    """Models of each merged caller: their rows add up to those of ``coalesce_masked``."""
    owner = _merge_groups(client_groups(facts)).select("client", "group", "api_key", "api_key_hash")
    out = client_models(facts).join(owner, "client").groupBy("group", "model").agg(
        F.min("api_key").alias("api_key"), F.max("api_key_hash").alias("api_key_hash"),
        *[F.sum(s).cast("bigint").alias(s) for s in SUMS])
    return out.drop("group").withColumn("avg_latency_ms", R.average())


def with_selector(groups: DataFrame, salt: str = "", bits: int = 224) -> DataFrame:
    label = I.client_key_hash(F.col("api_key"), salt, bits)
    own = F.col("api_key_hash")
    selector = (F.when((own != "") & (F.col("api_key") == ""), F.concat(F.lit("h."), own))
                .when(own != "", F.concat(F.lit("h."), own, F.lit("."), label))
                .when(F.col("api_key") == "", F.lit("u"))
                .otherwise(F.concat(F.lit("m."), label)))
    return groups.withColumn("selector", selector)
