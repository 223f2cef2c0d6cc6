"""Feed matching against a brute-force replay, with and without chunked hot keys."""

import random
import time
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from meterline.operators import reconcile as C

SCHEMA = ("id long, ts timestamp_ntz, provider string, auth_id string, model string, api_key string, endpoint string, stream boolean, "
          "input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, correlation_id string, observed_at timestamp_ntz")


def feeds(spark, seed, n, span, keys=3, streams=0):
    """Rows of two equal-looking kinds of requests, crowded in time, some with caller or correlation id."""
    rnd, t0, out = random.Random(seed), datetime(2024, 1, 1), []
    for kind in (0, 1):
        rows = []
        for i in range(n):
            seen = t0 + timedelta(milliseconds=rnd.randrange(span * 1000))
            asked = None if rnd.random() < 0.1 else seen - timedelta(milliseconds=rnd.randrange(-4000, 4000))
            corr = f"c{rnd.randrange(streams)}" if streams and rnd.random() < 0.6 else rnd.choice(["", "", "", f"c{i % 7}"])
            rows.append((i, asked, "openai", "", "m", rnd.choice(["", "", "k1", "k2"]), "" if kind == 0 else "/v1/x", kind == 1, 5, rnd.randrange(1, keys + 1), 0, 0, corr, seen))
        out.append(spark.createDataFrame(rows, SCHEMA))
    return out


def brute(native, fallback):
    """One replay of all rows in order of observation, natives first: everything held is kept in plain lists."""
    rows = []
    for kind, df in ((0, native), (1, fallback)):
        for r in C._slim(df, kind).collect():
            rows.append((r["seen"], kind, r["id"], r["asked"], r["caller"], r["corr"], r["key"], r["stream"]))
    natives, fallbacks, out = [], [], set()
    ok = lambda a, b: a[6] == b[6] and (not a[4] or not b[4] or a[4] == b[4]) and (not a[5] or not b[5] or a[5] == b[5])
    early = lambda n, f: n[3] <= f[3] + 1_000_000
    for row in sorted(rows, key=lambda r: r[:3]):
        seen, kind, i, asked, *_ = row
        if kind == 0:
            hit = next(((f, "pending") for f in fallbacks if seen - f[0] <= 2_000_000 and ok(row, f)), None) or next(
                ((f, "late") for f in fallbacks if 2_000_000 < seen - f[0] <= 32_000_000 and ok(row, f) and (early(row, f) or asked <= f[0] + 7_000_000)), None)
            if hit:
                fallbacks.remove(hit[0])
                out.add((i, hit[0][2], hit[1]))
            else:
                natives.append(row)
            continue
        hit = next((n for n in natives if seen - n[0] <= 5_000_000 and ok(n, row) and early(n, row)), None)
        if hit:
            natives.remove(hit)
            out.add((hit[2], i, "recent"))
            continue
        held = [f for f in fallbacks if row[7] and f[7] == row[7] and seen - f[0] <= 2_000_000]
        for f in held:
            fallbacks.remove(f)
            out.add((None, f[2], "superseded"))
        fallbacks.append(row)
    return out


def pairs(df):
    return {tuple(r) for r in df.select("native_id", "fallback_id", "how").collect()}


def test_crowded_keys(spark):
    native, fallback = feeds(spark, 1, 120, 200)
    want = brute(native, fallback)
    assert {h for _, _, h in want} >= {"pending", "late", "recent"}
    assert pairs(C.match_feeds(native, fallback)) == want


def test_one_key_over_many_slices(spark):
    """Keys that run through many slices, with state open at every border."""
    for seed, n, span, keys in ((12, 400, 20, 1), (13, 300, 60, 2)):
        native, fallback = feeds(spark, seed, n, span, keys)
        want = brute(native, fallback)
        for parts in (9,):
            with_parts(spark, parts, lambda: pairs(C.match_feeds(native, fallback)) == want)


def with_parts(spark, n, check):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        assert check()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_spread_keys(spark):
    """Mostly one row of each kind per key."""
    native, fallback = feeds(spark, 3, 150, 300, keys=120)
    assert pairs(C.match_feeds(native, fallback)) == brute(native, fallback)


def test_superseded_fallbacks(spark):
    """Streams across keys: whether a row replaces the one before it depends on natives of its own key."""
    for seed, n, span, keys, streams in ((7, 150, 20, 2, 3), (9, 200, 30, 5, 2)):
        native, fallback = feeds(spark, seed, n, span, keys, streams)
        want = brute(native, fallback)
        assert {h for _, _, h in want} >= {"superseded", "recent"}
        assert pairs(C.match_feeds(native, fallback)) == want
        left = {r["id"] for r in C.union_feeds(native, fallback, C.match_feeds(native, fallback)).where("origin = 'fallback'").collect()}
        assert left == {r["id"] for r in fallback.collect()} - {f for _, f, _ in want}


def test_a_burst_in_one_second(spark):
    """Many rows of one key within a second: cost per row must not grow with what is open."""
    n = 30000
    base = spark.range(n).selectExpr("id", "'openai' AS provider", "'' AS auth_id", "'m' AS model", "'' AS api_key", "'' AS endpoint", "false AS stream", "5L AS input_tokens",
                                     "2L AS output_tokens", "0L AS cache_read_tokens", "0L AS cache_creation_tokens", "'' AS correlation_id",
                                     "CAST(timestamp_micros(1704067200000000 + (id * 7919) % 1000000) AS timestamp_ntz) AS observed_at")
    # natives that claim to have been asked much later than most fallbacks stay open
    native = base.withColumn("ts", F.expr("observed_at + make_dt_interval(0, 0, 0, id % 5)"))
    fallback = base.withColumn("ts", F.col("observed_at"))
    start = time.time()
    got = C.match_feeds(native, fallback).groupBy("how").count().collect()
    assert sum(r["count"] for r in got) <= n and time.time() - start < 90
    few = [df.where("id < 400") for df in (native, fallback)]
    assert pairs(C.match_feeds(*few)) == brute(*few)


def test_edges(spark):
    native, fallback = feeds(spark, 5, 20, 10)
    assert pairs(C.match_feeds(native.limit(0), fallback.limit(0))) == set()
    assert pairs(C.match_feeds(native, fallback.limit(0))) == set()
    assert pairs(C.match_feeds(native.limit(0), fallback)) == brute(native.limit(0), fallback)


def test_ambiguous_pair(spark):
    """Two natives and two fallbacks with equal tokens: callers and correlation ids tell them apart."""
    native, fallback = feeds(spark, 4, 2, 1)
    same = [df.withColumns({"observed_at": F.expr(f"timestamp_ntz'2024-01-01 00:00:0{k}'"), "ts": F.lit(None).cast("timestamp_ntz"), "output_tokens": F.lit(1),
                            "correlation_id": F.lit("")}) for k, df in enumerate((native, fallback))]
    n = same[0].withColumn("api_key", F.when(F.col("id") == 0, "a").otherwise("b"))
    f = same[1].withColumn("api_key", F.when(F.col("id") == 0, "b").otherwise("a"))
    assert pairs(C.match_feeds(n, f)) == {(0, 1, "recent"), (1, 0, "recent")}
    one = C.reconcile_feeds(n, f)
    assert one.count() == 2 and {r["endpoint"] for r in one.collect()} == {"/v1/x"}


def test_late_native_only_enriches(spark):
    native, fallback = feeds(spark, 5, 1, 1)
    n = native.withColumns({"observed_at": F.expr("timestamp_ntz'2024-01-01 00:00:20'"), "ts": F.expr("timestamp_ntz'2024-01-01 00:00:03'"),
                            "api_key": F.lit("k9"), "correlation_id": F.lit(""), "output_tokens": F.lit(1)})
    f = fallback.withColumns({"observed_at": F.expr("timestamp_ntz'2024-01-01 00:00:00'"), "api_key": F.lit(""), "correlation_id": F.lit(""),
                              "output_tokens": F.lit(1)})
    got = C.reconcile_feeds(n, f).collect()
    assert len(got) == 1 and (got[0]["origin"], got[0]["how"], got[0]["api_key"]) == ("fallback", "late", "k9")
    # without a request time it was asked when it was seen, too late for this fallback
    assert C.reconcile_feeds(n.withColumn("ts", F.lit(None).cast("timestamp_ntz")), f).count() == 2


def test_keys_cut_by_batches():
    """A key whose rows lie in two Arrow batches is no lone row in the second one."""
    s = C.MICRO
    native = lambda k, i, at: (0, k, 0, i, at, at, "", "", None, False)
    fallback = lambda k, i, at: (0, k, 1, i, at, at, "", "", None, False)
    types = [pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 3, *[pa.string()] * 2, pa.int64(), pa.bool_()]
    rows = [native("a", 1, s), native("b", 2, s), fallback("b", 3, 2 * s), fallback("c", 4, s), native("c", 5, 2 * s), native("d", 6, s)]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["slice", "key", *C._ROW, "carried"])
    for at in range(len(rows) + 1):
        out = [r for b in C._replay_slice(iter([batch.slice(0, at), batch.slice(at)])) for r in b.to_pylist() if r["how"] in C._PAIRED]
        assert {(r["native_id"], r["fallback_id"], r["how"]) for r in out} == {(2, 3, "recent"), (5, 4, "pending")}
