"""Row filters of the query form: range, snapshot bound, dimensions, caller selector."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.identity import HASH_HEX_LENGTH
from meterline.functions.timeparse import local_day
from meterline.schema import RANGE_HOURS


@dataclass(frozen=True)
class Query:
    """What an event query may ask for; empty text means no restriction."""
    range: str = "all"
    model: str = ""
    source: str = ""
    auth_index: str = ""
    api: str = ""
    client: str = ""
    limit: int = 0
    offset: int = 0
    before: Column | None = None
    cursor: tuple | None = None


def filter_range(df: DataFrame, range_key: str, now: Column) -> DataFrame:
    """A bounded range drops rows without a time; any other key keeps all."""
    hours = RANGE_HOURS.get(range_key)
    if hours is None:
        return df
    since = now - F.expr(f"INTERVAL {hours} HOURS")
    return _by_day(df, lambda day: day >= local_day(since)).where(F.col("ts") >= since)


def filter_before(df: DataFrame, bound: Column) -> DataFrame:
    return _by_day(df, lambda day: day <= local_day(bound)).where(F.col("ts").isNull() | (F.col("ts") <= bound))


def _by_day(df: DataFrame, test) -> DataFrame:
    """The same bound on the stored day, so that folders are pruned; missing times stay in the folder of the first day."""
    return df.where(test(F.col("local_day"))) if "local_day" in df.columns else df


def filter_dims(df: DataFrame, model="", source="", auth_index="", api="") -> DataFrame:
    for name, value in (("model", model), ("source_key", source), ("auth_index", auth_index), ("api", api)):
        if value:
            df = df.where(F.col(name) == value)
    return df


def _is_hash(v: str) -> bool:
    return len(v) == HASH_HEX_LENGTH and not set(v) - set("0123456789abcdef")


def client_condition(selector: str) -> Column:
    """u | m.<label hash> | h.<hash> | h.<hash>.<label hash>; anything else matches nothing."""
    kind, *hashes = [p.strip() for p in selector.strip().split(".")]
    key, own, label = F.col("api_key"), F.col("api_key_hash"), F.col("label_hash")
    if kind == "u" and not hashes:
        return (own == "") & (key == "")
    if kind in ("m", "h") and 1 <= len(hashes) <= (2 if kind == "h" else 1) and all(map(_is_hash, hashes)):
        if kind == "m":
            return (key != "") & (label == hashes[0])
        if len(hashes) == 1:
            return (key != "") & (own == hashes[0])
        return (key != "") & ((own == hashes[0]) | ((own == "") & (label == hashes[1])))
    return F.lit(False)


def filter_client(df: DataFrame, selector: str) -> DataFrame:
    return df if not selector.strip() else df.where(client_condition(selector))


def apply(df: DataFrame, q: Query, now: Column) -> DataFrame:
    df = filter_range(df, q.range, now)
    if q.before is not None:
        df = filter_before(df, q.before)
    return filter_client(filter_dims(df, q.model, q.source, q.auth_index, q.api), q.client)


def count_filtered(df: DataFrame, q: Query, now: Column) -> DataFrame:
    return apply(df, q, now).agg(F.count(F.lit(1)).alias("total"))
