"""One-to-one matching of two feeds that report the same requests.

A *native* row and a *fallback* row describe one request when they share the match key, their
callers and correlation ids do not contradict each other, and they were seen close together.
"""

import hashlib
from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline import session
from meterline.functions import identity as I
from meterline.functions.text import first_text, is_unknown_key, tidy
from meterline.functions.timeparse import ntz_to_micros
from meterline.operators.imports import enriched
from meterline.schema import (CLOCK_SLACK_SECONDS, LATE_NATIVE_SECONDS, NATIVE_RECENT_SECONDS,
                              PENDING_SECONDS)

MICRO = 1000000
PENDING = PENDING_SECONDS * MICRO
RECENT = NATIVE_RECENT_SECONDS * MICRO
LATE = LATE_NATIVE_SECONDS * MICRO
SLACK = CLOCK_SLACK_SECONDS * MICRO
HORIZON = PENDING + LATE  # nothing older can still be matched

MAX_CORRELATION = 256  # longer correlation ids name no stream


def has_tokens() -> Column:
    c = F.col
    return ((c("input_tokens") != 0) | (c("output_tokens") != 0) | (c("cache_read_tokens") != 0)
            | (c("cache_creation_tokens") != 0))


def match_key() -> Column:
    """Who answered, which model, how many tokens. Rows without tokens are never matched."""
    c = F.col
    family = I.provider_family(c("provider"))
    auth = F.lower(tidy(c("auth_id")))
    who = F.when((auth != "") & (I.provider_from_auth(auth) == ""), F.concat(F.lit("auth:"), auth)).otherwise(family)
    extra = c("cache_read_tokens") + c("cache_creation_tokens")
    inp = c("input_tokens") + F.when(I.is_claude(c("provider")), extra).otherwise(F.lit(0))
    out = c("output_tokens")
    return F.concat_ws("\u001f", who, F.lower(tidy(c("model"))), inp.cast("string"), out.cast("string"),
                       (inp + out).cast("string"))


def _caller() -> Column:
    key = I.client_key_canonical(F.col("api_key"))
    return F.when(is_unknown_key(key), F.lit("")).otherwise(key)


def _slim(feed: DataFrame, kind: int) -> DataFrame:
    """Only what matching needs. A row without a request time was asked when it was seen."""
    if "alias" in feed.columns:
        feed = feed.withColumn("model", first_text(F.col("alias"), F.col("model")))
    seen = ntz_to_micros(F.col("observed_at"))
    return feed.where(has_tokens()).select(
        match_key().alias("key"), F.lit(kind).alias("kind"), "id", seen.alias("seen"),
        F.coalesce(ntz_to_micros(F.col("ts")), seen).alias("asked"), _caller().alias("caller"), tidy(F.col("correlation_id")).alias("corr"),
        (_stream(feed) if kind else F.lit(None).cast("string")).alias("stream"))


# --- replay of one match key ----------------------------------------------------------------

_NEVER = float("inf")


class Row:
    __slots__ = ("kind", "id", "seen", "asked", "caller", "corr", "cancel", "order", "spots")

    def __init__(self, kind, id, seen, asked, caller, corr, cancel=None) -> None:
        self.kind, self.id, self.seen, self.asked, self.caller, self.corr = kind, id, seen, asked, caller, corr
        self.cancel, self.order, self.spots = cancel, 0, None

    def fields(self) -> tuple:
        return self.kind, self.id, self.seen, self.asked, self.caller, self.corr, self.cancel


class Line:
    """Rows in order of arrival under a bound each; finds the first whose bound is at most x (a tree of minima)."""

    def __init__(self) -> None:
        self.size, self.rows, self.least = 1, [], [_NEVER, _NEVER]

    def add(self, row: Row, bound: float) -> int:
        at = len(self.rows)
        if at == self.size:
            leaves = self.least[self.size:] + [_NEVER] * self.size
            self.size *= 2
            self.least = [_NEVER] * self.size + leaves
            for i in range(self.size - 1, 0, -1):
                self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])
        self.rows.append(row)
        i = self.size + at
        while i and self.least[i] > bound:
            self.least[i] = bound
            i //= 2
        return at

    def drop(self, at: int) -> None:
        self.rows[at] = None
        i = self.size + at
        self.least[i] = _NEVER
        while i > 1:
            i //= 2
            self.least[i] = min(self.least[2 * i], self.least[2 * i + 1])

    def first(self, x: float) -> Row | None:
        if self.least[1] > x:
            return None
        i = 1
        while i < self.size:
            i = 2 * i if self.least[2 * i] <= x else 2 * i + 1
        return self.rows[i - self.size]


class Pool:
    """Unmatched rows of one kind, found by what a partner may carry: a blank caller or correlation fits any."""

    def __init__(self) -> None:
        self.lines: dict[tuple, Line] = {}

    def add(self, row: Row, bound: float) -> None:
        row.spots = []
        for name in ((row.caller, row.corr), (row.caller, None), (None, row.corr), (None, None)):
            line = self.lines.setdefault(name, Line())
            row.spots.append((line, line.add(row, bound)))

    def drop(self, row: Row) -> None:
        for line, at in row.spots:
            line.drop(at)
        row.spots = None

    def first(self, caller: str, corr: str, x: float) -> Row | None:
        found = None
        for a in (caller, "") if caller else (None,):
            for b in (corr, "") if corr else (None,):
                row = self.lines[a, b].first(x) if (a, b) in self.lines else None
                if row is not None and (found is None or row.order < found.order):
                    found = row
        return found


class Replay:
    """Rows of one match key in order of observation (natives first at equal times); one-to-one, oldest first.

    Results are (native_id, fallback_id, how, seen): recent, pending and late pairs, superseded fallbacks, and lone
    rows once their time is over. Each step costs the logarithm of the open rows, whatever a burst holds.
    """

    def __init__(self) -> None:
        self.natives, self.pending, self.late = Pool(), Pool(), Pool()
        self.queues = {"natives": deque(), "pending": deque(), "late": deque()}
        self.cancels: list[tuple] = []
        self.count = 0
        self.out: list[tuple] = []

    def open_rows(self) -> list[Row]:
        rows = [r for q in self.queues.values() for r in q if r.spots is not None]
        return sorted(rows, key=lambda r: (r.seen, r.kind, r.id))

    def hold(self, row: Row) -> None:
        """Keep an unmatched row."""
        self.count += 1
        row.order = self.count
        if row.kind == 0:
            self.natives.add(row, row.asked)
            self.queues["natives"].append(row)
            return
        self.pending.add(row, 0)
        self.queues["pending"].append(row)
        if row.cancel is not None:
            heappush(self.cancels, (row.cancel, row.order, row))

    def advance(self, now: int) -> None:
        """Settle what no row observed from ``now`` on can match."""
        while self.cancels and self.cancels[0][0] < now:
            at, _, row = heappop(self.cancels)
            if row.spots is not None:
                self.pending.drop(row)
                self.out.append((None, row.id, "superseded", at))
        natives, pending, late = self.queues.values()
        while natives and (natives[0].spots is None or now - natives[0].seen > RECENT):
            row = natives.popleft()
            if row.spots is not None:
                self.natives.drop(row)
                self.out.append((row.id, None, "native", row.seen))
        while pending and (pending[0].spots is None or now - pending[0].seen > PENDING):
            row = pending.popleft()
            if row.spots is not None:
                self.pending.drop(row)
                self.late.add(row, -max(row.asked + SLACK, row.seen + PENDING + RECENT))
                late.append(row)
        while late and (late[0].spots is None or now - late[0].seen > HORIZON):
            row = late.popleft()
            if row.spots is not None:
                self.late.drop(row)
                self.out.append((None, row.id, "fallback", row.seen))

    def arrive(self, row: Row) -> None:
        self.advance(row.seen)
        if row.kind == 1:
            n = self.natives.first(row.caller, row.corr, row.asked + SLACK)
            if n is None:
                self.hold(row)
            else:
                self.natives.drop(n)
                self.out.append((n.id, row.id, "recent", row.seen))
            return
        for pool, how, x in ((self.pending, "pending", 0), (self.late, "late", -row.asked)):
            f = pool.first(row.caller, row.corr, x)
            if f is not None:
                pool.drop(f)
                self.out.append((row.id, f.id, how, row.seen))
                return
        self.hold(row)


# --- slices of the sorted feeds ---------------------------------------------------------------

_ROW = ["kind", "id", "seen", "asked", "caller", "corr", "cancel"]
_TOLD = ("slice int, key string, head boolean, native_id bigint, fallback_id bigint, how string, kind int, id bigint, seen bigint, asked bigint, "
         "caller string, corr string, cancel bigint, first_key string, last_key string, digest string")
_PAIRED = ("recent", "pending", "late", "superseded")


def _told(slice_: int, rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split(" ")[0] for f in _TOLD.split(", ")][1:]
    types = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 3, *[pa.string()] * 2, pa.int64(), *[pa.string()] * 3]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([slice_] * len(rows), pa.int32())] + [pa.array(c, t) for c, t in zip(cols, types)], ["slice", *names])


def _replay_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays the keys of a slice one after the other, holding the open rows of one key only.

    Rows come by key and observation; those with carried = true, if any, come first and are only held. The last key's
    open rows leave as carry: its next row, if there is one, is in the next slice.
    """
    key, first_key, replay, slice_, out = None, None, Replay(), 0, []

    def take(head: bool) -> None:
        out.extend((key, head, n, f, how, *[None] * 10) for n, f, how, _ in replay.out if how in _PAIRED)
        replay.out.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_pylist()
        kinds = batch.column("kind").to_numpy()
        slice_ = batch.column("slice")[0].as_py()
        cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        rows = None
        for a, b in zip(cut, cut[1:]):
            fresh = keys[a] != key
            if fresh:
                if key is not None:
                    replay.advance(_END)
                    take(key == first_key)
                key, replay = keys[a], Replay()
                first_key = first_key if first_key is not None else key
            whole = fresh and key != first_key and b < len(keys)  # all rows of the key are here: none in the batch before or after
            if whole and kinds[a] == 1 and b - a == 1 and batch.column("cancel")[a].as_py() is None:
                continue  # one lone fallback
            if whole and not kinds[a:b].any():
                continue  # natives only
            rows = rows or list(zip(*[batch.column(c).to_pylist() for c in (*_ROW, "carried")]))
            for r in rows[a:b]:
                row = Row(*r[:7])
                replay.hold(row) if r[7] else replay.arrive(row)
            if len(replay.out) > 10000:
                take(key == first_key)
        if len(out) > 10000:
            yield _told(slice_, out)
            out = []
    if key is None:
        return
    take(key == first_key)
    carry = [r.fields() for r in replay.open_rows()]
    out.extend((key, key == first_key, None, None, "carry", *r, None, None, None) for r in carry)
    digest = hashlib.sha256(repr(carry).encode()).hexdigest() if carry else ""
    yield _told(slice_, [*out, (None, None, None, None, "slice", *[None] * 7, first_key, key, digest)])


_END = 1 << 62


def replayed(rows: DataFrame) -> DataFrame:
    """(key, native_id, fallback_id, how) of all keys: pairs and superseded fallbacks, equal to one sequential replay per key.

    The rows are range-partitioned by key and time, so a slice has about the same size whatever a key holds, and a key
    may run through many slices. Every slice is first replayed as if nothing were open at its start. A slice whose first
    key goes on from the slice before starts again with what that one left open, until no slice was started wrong; only
    rows of that key run again. The driver holds one short entry per slice.
    """
    spark = rows.sparkSession
    session.ship(spark)
    order = ["key", "seen", "kind", "id"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.select("key", *_ROW, F.lit(False).alias("carried")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = session.checkpoint(cut.withColumn("slice", F.spark_partition_id()))

    def run(part: DataFrame) -> DataFrame:
        return session.checkpoint(part.mapInArrow(_replay_slice, _TOLD))

    rounds = [run(cut)]
    ends = sorted(rounds[0].where("how = 'slice'").select("slice", "first_key", "last_key", "digest").collect())
    before = {b[0]: a for a, b in zip(ends, ends[1:]) if a[2] == b[1]}  # slice that starts inside a key: the one before it
    left = {e[0]: e[3] for e in ends}
    keys = {e[0]: (e[1], e[2]) for e in ends}
    used = {i: 0 for i in left}  # round whose results count for the first key of a slice
    started = dict.fromkeys(before, "")
    while wrong := [i for i, a in before.items() if started[i] != left[a[0]]]:
        wanted = spark.createDataFrame([(before[i][0], i, keys[i][0], used[before[i][0]]) for i in wrong], "prev int, slice int, first_key string, round int")
        told = None
        for k, r in enumerate(rounds):
            told = r.withColumn("round", F.lit(k)) if told is None else told.unionByName(r.withColumn("round", F.lit(k)))
        # what a slice left open: from its last run, unless its first key is not its last (then that key never ran again)
        carry = (told.where("how = 'carry'").withColumnRenamed("slice", "prev").join(F.broadcast(wanted), "prev")
                 .where(F.when(F.col("head"), told["round"] == wanted["round"]).otherwise(told["round"] == 0)).select("slice", "key", *_ROW, F.lit(True).alias("carried")))
        again = cut.join(F.broadcast(wanted.select("slice", "first_key")), "slice").where("key = first_key").select("slice", "key", *_ROW, "carried")
        part = carry.unionByName(again).repartition(min(n, len(wrong)), "slice").sortWithinPartitions("slice", F.desc("carried"), "seen", "kind", "id")
        rounds.append(session.checkpoint(part.groupBy("slice").applyInArrow(_replay_group, _TOLD)))
        for i in wrong:
            started[i], used[i] = left[before[i][0]], len(rounds) - 1
        for i, _, _, digest in rounds[-1].where("how = 'slice'").select("slice", "first_key", "last_key", "digest").collect():
            if keys[i][0] == keys[i][1]:
                left[i] = digest
    latest = spark.createDataFrame([(i, k) for i, k in used.items()] or [(-1, 0)], "slice int, latest int")
    closed = spark.createDataFrame([(e[0],) for e in ends if e[0] not in {a[0] for a in before.values()}] or [(-1,)], "last int")
    result = None
    for k, r in enumerate(rounds):
        r = r.join(F.broadcast(latest), "slice").where((F.col("head") & (F.col("latest") == k)) | (~F.col("head") & F.lit(k == 0)))
        pairs = r.where(F.col("how").isin(*_PAIRED)).select("key", "native_id", "fallback_id", "how")
        over = r.where("how = 'carry' and cancel is not null").join(F.broadcast(closed), F.col("slice") == F.col("last")).select(
            "key", "native_id", F.col("id").alias("fallback_id"), F.lit("superseded").alias("how"))
        both = pairs.unionByName(over)
        result = both if result is None else result.unionByName(both)
    return result


def _replay_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("carried", "descending"), ("seen", "ascending"), ("kind", "ascending"), ("id", "ascending")])
    return pa.Table.from_batches(list(_replay_slice(iter(rows.to_batches(10000)))))


# --- fallbacks that a newer one of their stream replaces ---------------------------------------

def _stream(feed: DataFrame) -> Column:
    c = F.col
    corr = tidy(c("correlation_id"))
    parts = [I.provider_family(c("provider")), F.lower(tidy(c("auth_id"))), _caller(), corr]
    return F.when((corr != "") & (F.length(corr) <= MAX_CORRELATION), F.concat_ws("\u001f", *parts))


def _next_of_stream(rows: DataFrame) -> DataFrame:
    """Adds ``cancel``: when the next fallback of the stream was seen, if the row was still held then.

    Rows meet in slots of the holding time, each also in the slot before its own, so a stream of any length is spread.
    """
    slot = F.floor(F.col("seen") / PENDING)
    both = rows.withColumn("slot", slot).withColumn("at", F.explode(F.array("slot", F.col("slot") - 1)))
    follow = F.lead("seen").over(Window.partitionBy("stream", "at").orderBy("seen", "id"))
    cancel = F.when(follow - F.col("seen") <= PENDING, follow)
    return both.withColumn("cancel", cancel).where(F.col("at") == F.col("slot")).drop("slot", "at")


def _matched(native: DataFrame, fallback: DataFrame) -> DataFrame:
    """(key, native_id, fallback_id, how).

    A fallback that no recent native took replaces the one held for its stream, whatever its key. Whether it was taken
    is only known after the replay: at first none counts as taken, and keys whose replaced rows turn out different run
    again. An outcome only bears on later ones, so this ends; most feeds need one round.
    """
    c = F.col
    natives, fallbacks = _slim(native, 0), _slim(fallback, 1)
    none = F.lit(None).cast("bigint")
    streamed = _next_of_stream(fallbacks.where("stream is not null"))
    rows = session.checkpoint(natives.withColumn("cancel", none).unionByName(fallbacks.where("stream is null").withColumn("cancel", none))
                              .unionByName(streamed))
    out = session.checkpoint(replayed(rows))
    # only keys with a row that replaces or is replaced can ever run again: the rest is settled and read no more
    fallen = rows.where("stream is not null")
    chained = session.checkpoint(fallen.join(rows.where("cancel is not null").select("stream").distinct(), "stream", "left_semi"))
    keys = session.checkpoint(chained.select("key").distinct())
    settled = out.join(keys, "key", "left_anti")
    live, open_ = session.checkpoint(rows.join(keys, "key", "left_semi")), session.checkpoint(out.join(keys, "key", "left_semi"))
    while True:
        taken = open_.where("how = 'recent'").select(c("fallback_id").alias("id"))
        fresh = _next_of_stream(chained.drop("cancel").join(taken, "id", "left_anti"))
        changed = session.checkpoint(chained.join(fresh.select("id", c("cancel").alias("now")), "id").where(~c("cancel").eqNullSafe(c("now"))))
        if changed.isEmpty():
            return settled.unionByName(open_)
        keys = changed.select("key").distinct()
        new = changed.select("id", F.lit(1).alias("kind"), "now", F.lit(True).alias("new"))
        latest = F.when(c("new"), c("now")).otherwise(c("cancel"))
        live = session.checkpoint(live.join(new, ["id", "kind"], "left").withColumn("cancel", latest).drop("now", "new"))
        chained = session.checkpoint(chained.join(new.drop("kind"), "id", "left").withColumn("cancel", latest).drop("now", "new"))
        again = replayed(live.join(keys, "key", "left_semi"))
        open_ = session.checkpoint(open_.join(keys, "key", "left_anti").unionByName(again))


# --- whole feeds ---------------------------------------------------------------------------

def match_feeds(native: DataFrame, fallback: DataFrame) -> DataFrame:
    """(native_id, fallback_id, how): matched pairs, and superseded fallbacks with a NULL native_id."""
    return _matched(native, fallback).select("native_id", "fallback_id", "how")


def _extra(feed: DataFrame, id_name: str) -> DataFrame:
    return feed.select(F.col("id").alias(id_name), F.col("endpoint").alias("u_endpoint"),
                       F.col("api_key").alias("u_api_key"), F.lit("").alias("u_api_key_hash"),
                       F.col("stream").alias("u_stream"))


def _fill(rows: DataFrame) -> DataFrame:
    c = F.col
    new = enriched(I.norm_endpoint(c("endpoint")), c("api_key"), F.lit(""), c("stream"))
    new.pop("api_key_hash")
    return rows.withColumns(new).drop("u_endpoint", "u_api_key", "u_api_key_hash", "u_stream")


def reconcile_feeds(native: DataFrame, fallback: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per request: (columns of the feeds) plus ``origin`` and ``how``.

    Natives always count unless a counted fallback met them late; fallbacks count when unmatched or
    when matched late, and not when superseded. Either way the other row only adds missing metadata.
    """
    pairs = session.checkpoint(match_feeds(native, fallback)) if pairs is None else pairs
    early, late = pairs.where("how <> 'late'"), pairs.where("how = 'late'")
    for_native = early.where("native_id is not null").join(_extra(fallback, "fallback_id"), "fallback_id").drop("fallback_id")
    for_fallback = late.join(_extra(native, "native_id"), "native_id").drop("native_id")
    base = [x for x in native.columns]
    kept_native = native.join(late.select(F.col("native_id").alias("id")), "id", "left_anti").select(base)
    kept_fallback = fallback.join(early.select(F.col("fallback_id").alias("id")), "id", "left_anti").select(base)
    left = _fill(kept_native.join(for_native.withColumnRenamed("native_id", "id"), "id", "left"))
    right = _fill(kept_fallback.join(for_fallback.withColumnRenamed("fallback_id", "id"), "id", "left"))
    how = F.coalesce(F.col("how"), F.lit(""))
    return (left.withColumns({"origin": F.lit("native"), "how": how})
            .unionByName(right.withColumns({"origin": F.lit("fallback"), "how": how})))


def union_feeds(native: DataFrame, fallback: DataFrame, pairs: DataFrame) -> DataFrame:
    """Native rows and the fallback rows that were neither matched nor superseded."""
    alone = fallback.join(pairs.select(F.col("fallback_id").alias("id")), "id", "left_anti")
    return native.withColumn("origin", F.lit("native")).unionByName(
        alone.select(native.columns).withColumn("origin", F.lit("fallback")))
