"""Fingerprints, import cleaning, duplicate removal and late metadata."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline import session
from meterline.functions import identity as I
from meterline.functions import text as X
from meterline.functions import tokens as K
from meterline.functions.text import tidy
from meterline.functions.timeparse import ntz_to_micros
from meterline.schema import TOKEN_COLUMNS


NEGATIVE, NAMELESS, FOREIGN = "negative token count", "no upstream", "unsupported version"


def fingerprint() -> Column:
    """Equal for equal requests; field borders cannot be forged because the fields are JSON."""
    c = F.col
    own = tidy(c("api_key_hash"))
    fields = [c("api"), c("model"), ntz_to_micros(c("ts")).alias("at"), c("source"), c("auth_index"),
              own.alias("own"), F.when(own == "", tidy(c("api_key"))).otherwise(F.lit("")).alias("label"),
              c("failure"), c("failed"), c("latency_ms"), c("ttft_ms"), c("status_code"), c("input_tokens"),
              c("output_tokens"), c("reasoning_tokens"), c("cached_tokens"), c("cache_tokens"),
              c("cache_write_tokens"), c("total_tokens")]
    # never NULL, and said so: else a join on it filters the scan by the whole expression, all its parts repeated
    return F.coalesce(F.sha2(F.to_json(F.struct(*fields)), 256), F.lit(""))


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint())


def clean_numbers(rows: DataFrame, now: Column) -> DataFrame:
    """Missing time becomes now, negative durations 0, totals are recomputed."""
    c = F.col
    total = K.effective_total(*[c(t) for t in ("provider", "input_tokens", "output_tokens", "cached_tokens",
                                               "cache_tokens", "cache_write_tokens", "total_tokens")])
    return rows.withColumns({"ts": F.coalesce(c("ts"), now), "latency_ms": K.clamp(c("latency_ms")),
                             "ttft_ms": K.clamp(c("ttft_ms")), "total_tokens": total})


def clean_labels(rows: DataFrame, salt: str = "") -> DataFrame:
    """Source, upstream key and caller identity of imported history."""
    df = rows.withColumn("model", I.norm_model(F.col("model")))
    df = I.with_source_labels(df.withColumn("executor_type", F.lit("")), imported=True).drop("executor_type")
    df = df.withColumn("source", F.col("source_label")).drop("source_label")
    df = I.with_imported_upstream_key(df)
    label, own = I.client_identity(F.col("api_key"), F.col("api_key_hash"), salt, imported=True)
    return df.withColumns({"api_key": label, "api_key_hash": own,
                           "source_key": I.source_key(F.col("source"))})


def inside_retention(now: Column, days: int) -> Column:
    return F.lit(True) if days <= 0 else F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")


def has_upstream() -> Column:
    return F.coalesce(tidy(F.col("api")) != "", F.lit(False))


def import_antijoin(existing: DataFrame, imported: DataFrame, order: list) -> DataFrame:
    """Imported rows not yet known, one per fingerprint (the first by ``order``).

    Copies collapse before the shuffle on both sides, so a fingerprint repeated without bound
    reaches the join as one row.
    """
    cols = imported.columns
    unique = imported.groupBy("fingerprint").agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select("r.*")
    known = existing.select("fingerprint").distinct()
    return unique.join(known, "fingerprint", "left_anti").select(*cols)


def fault() -> Column:
    """Why a row must not be imported; NULL where it may. Rows without a ``version`` column come from no document."""
    negative = F.lit(False)
    for t in TOKEN_COLUMNS:
        negative = negative | (F.col(t) < 0)
    return (F.when(negative, F.lit(NEGATIVE)).when(~has_upstream(), F.lit(NAMELESS)))


def judged(imported: DataFrame) -> DataFrame:
    """Adds ``reason`` (NULL for good rows)."""
    reason = fault()
    if "version" in imported.columns:
        reason = F.when(~F.coalesce(F.col("version"), F.lit(0)).isin(0, 1), F.lit(FOREIGN)).otherwise(reason)
    return imported.withColumn("reason", reason)


def quarantine(imported: DataFrame) -> DataFrame:
    """(reason, rows): what an import leaves out or fails for."""
    return judged(imported).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def admitted(imported: DataFrame, now: Column, salt: str = "") -> DataFrame:
    """Rows of an import after the gate, repaired and with their fingerprint, and ``refused`` for those left out.

    A negative count or a foreign version refuses the whole import, a blank upstream its own row. Numbers, labels and
    caller identity are repaired before the fingerprint, so history with raw labels meets the rows it once was.
    """
    rows = judged(imported)
    closed = rows.agg(F.coalesce(F.bool_or(F.col("reason").isin(NEGATIVE, FOREIGN)), F.lit(False)).alias("closed"))
    rows = rows.crossJoin(F.broadcast(closed)).withColumn("refused", F.col("closed") | F.col("reason").isNotNull())
    # cut here: inlined into the fingerprint, the label patterns would be repeated many times over
    return with_fingerprint(session.checkpoint(clean_labels(clean_numbers(rows.drop("closed", "reason"), now), salt)))


def merge_snapshots(existing: DataFrame, imported: DataFrame, now: Column, retention_days: int = 0,
                    order: list | None = None, salt: str = "") -> DataFrame:
    """Existing rows and the new ones of an import inside the retention.

    ``existing`` is only fingerprinted where it does not carry a stored ``fingerprint``.
    """
    fresh = admitted(imported, now, salt).where(~F.col("refused") & inside_retention(now, retention_days))
    stored = existing if "fingerprint" in existing.columns else with_fingerprint(existing)
    added = import_antijoin(stored, fresh, order or ["id"])
    return existing.unionByName(added.select(*existing.columns))


def import_counts(existing: DataFrame, imported: DataFrame, now: Column, retention_days: int = 0, salt: str = "") -> DataFrame:
    """One row: input, accepted, rejected (refused rows), added, skipped, ignored by retention."""
    c = F.col
    keep = ~c("refused") & inside_retention(now, retention_days)
    per_fp = admitted(imported, now, salt).groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(keep).alias("kept"), F.count_if("refused").alias("refused"))
    stored = existing if "fingerprint" in existing.columns else with_fingerprint(existing)
    known = stored.select("fingerprint", F.lit(1).alias("known")).distinct()
    added = F.when((c("kept") > 0) & c("known").isNull(), 1).otherwise(0)
    total = lambda x, name: F.coalesce(F.sum(x), F.lit(0)).alias(name)
    out = per_fp.join(known, "fingerprint", "left").agg(
        total(c("n"), "input"), total(c("refused"), "rejected"), total(added, "added"), total(c("kept") - added, "skipped"),
        total(c("n") - c("kept") - c("refused"), "ignored"))
    return out.select("input", (c("input") - c("rejected")).alias("accepted"), "rejected", "added", "skipped", "ignored")


def fold_updates(updates: DataFrame) -> DataFrame:
    """All updates of one (fingerprint, ts) as one: the first usable value of each field."""
    def first(name, usable):
        return F.min_by(F.when(usable, F.col(name)), F.when(usable, F.col("seq"))).alias("u_" + name)

    c = F.col
    end = I.norm_endpoint(c("endpoint"))
    df = updates.withColumn("endpoint", end)
    return df.groupBy("fingerprint", "ts").agg(
        first("endpoint", c("endpoint") != ""), first("api_key", ~X.is_unknown_key(c("api_key"))),
        first("api_key_hash", tidy(c("api_key_hash")) != ""), F.bool_or("stream").alias("u_stream"))


def enriched(c_end: Column, key: Column, own: Column, stream: Column, u: str = "u_") -> dict[str, Column]:
    """Fill only what is missing; counters never change."""
    def fill(old, blank, new):
        return F.when(blank, F.coalesce(F.col(u + new), old)).otherwise(old)

    return {
        "endpoint": fill(c_end, c_end == "", "endpoint"),
        "api_key": fill(key, X.is_unknown_key(key), "api_key"),
        "api_key_hash": fill(own, tidy(own) == "", "api_key_hash"),
        "stream": stream | F.coalesce(F.col(u + "stream"), F.lit(False)),
    }


def enrich_metadata(facts: DataFrame, updates: DataFrame) -> DataFrame:
    """Late metadata joined on (fingerprint, ts), missing times included, newest row only.

    Facts collapse to one id per (fingerprint, ts) before they meet the updates; the way back to
    the rows is by the unique id.
    """
    c = F.col
    changes = fold_updates(updates)
    newest = facts.groupBy(c("fingerprint").alias("fp"), c("ts").alias("at")).agg(F.max("id").alias("id"))
    target = changes.join(newest, (c("fingerprint") == c("fp")) & c("ts").eqNullSafe(c("at"))).select(
        "id", "u_endpoint", "u_api_key", "u_api_key_hash", "u_stream")
    rows = facts.join(target, "id", "left")
    before = rows.withColumn("endpoint", I.norm_endpoint(c("endpoint")))
    new = enriched(c("endpoint"), c("api_key"), c("api_key_hash"), c("stream"))
    return before.withColumns(new).drop("u_endpoint", "u_api_key", "u_api_key_hash", "u_stream").select(*facts.columns)


def _with_plain(rows: DataFrame) -> DataFrame:
    """Adds ``plain``: the credential name readable from the auth_id alone."""
    out = rows.withColumn("plain", X.credential_identity(F.col("auth_id")))
    out = out.withColumn("plain", X.prefer(F.col("plain"), F.col("auth_id")))
    return out.withColumn("plain", X.printable(F.col("plain")))


def learn_auth_index(rows: DataFrame, learned_from: DataFrame) -> DataFrame:
    """Latest real auth_index per auth_id fills rows that only carry the id."""
    c = F.col
    key = F.lower(tidy(c("auth_id")))
    index = tidy(c("auth_index"))
    taught = _with_plain(learned_from).select(key.alias("auth_key"), index.alias("index"), "ts", "id", "plain")
    # the test sits inside the aggregate: as a filter it would be pushed down and repeat the label expressions
    real = (c("auth_key") != "") & (c("index") != "") & (c("index") != c("plain"))
    when = F.struct(F.coalesce(ntz_to_micros(c("ts")), F.lit(-2**62)), c("id"))
    latest = taught.groupBy("auth_key").agg(F.max_by(c("index"), F.when(real, when)).alias("learned"))
    bare = (tidy(c("auth_index")) == "") | (c("auth_index") == c("plain"))
    out = _with_plain(rows).withColumn("auth_key", key).join(latest, ["auth_key"], "left")
    return out.withColumn("auth_index", F.when(bare, F.coalesce(c("learned"), c("auth_index")))
                          .otherwise(c("auth_index"))).drop("auth_key", "learned", "plain")
