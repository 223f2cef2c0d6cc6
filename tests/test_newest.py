"""The n-th newest row by refinement, against plain sorting."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from meterline import session
from meterline.functions import timeparse as P
from meterline.operators import newest as N

SCHEMA = "id bigint, ts timestamp_ntz, api string, model string"
DAY = datetime.datetime(2024, 1, 1)


def _rows(kind):
    r = random.Random(5)
    if kind == "burst":  # one second, one group: times tie, ids decide
        return [(i - 700, DAY, "a", "m") for i in r.sample(range(2000), 1500)]
    if kind == "far":  # extreme ids and times
        ids = [-(1 << 63) + 1, (1 << 63) - 1, 0, -1, 1, None] + [r.randrange(-(1 << 62), 1 << 62) for _ in range(400)]
        return [(i, r.choice([None, DAY, datetime.datetime(1950, 1, 1), datetime.datetime(2900, 1, 1)]), r.choice(["a", None]), "m") for i in ids]
    return [(i, None if i % 17 == 0 else DAY + datetime.timedelta(seconds=r.randrange(90)), "hot" if i % 3 else r.choice("bcd"), r.choice(["m", None]))
            for i in range(2500)]


def _want(rows, n, keyed=True):
    groups = {}
    for x in rows:
        groups.setdefault((x[2], x[3]) if keyed else 0, []).append(x)
    low = -(1 << 70)
    place = lambda x: (x[1] is not None, x[1] or DAY, x[0] if x[0] is not None else low)
    return sorted([x[0] for g in groups.values() for x in sorted(g, key=place, reverse=True)[:n]], key=str)


@pytest.mark.parametrize("kind", ["mixed", "burst", "far"])
@pytest.mark.parametrize("n", [1, 140])
def test_newest_of_groups(spark, monkeypatch, kind, n):
    monkeypatch.setattr(N, "BINS", 32)
    monkeypatch.setattr(N, "BIN_ROWS", 20)
    rows = _rows(kind)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("local_day", P.local_day(F.col("ts")))
    kept, gone = N.split(df, ["api", "model"], n)
    want = _want(rows, n)
    assert sorted([r.id for r in kept.collect()], key=str) == want
    assert sorted([r.id for r in gone.collect()] + want, key=str) == sorted([x[0] for x in rows], key=str)
    top = [r.id for r in N.newest(df, n).collect()]
    assert sorted(top, key=str) == _want(rows, n, keyed=False)


def test_equal_rows_stay_together_and_edges_of_n(spark, monkeypatch):
    monkeypatch.setattr(N, "BIN_ROWS", 2)
    df = spark.createDataFrame([(1, DAY, "a", "m")] * 5 + [(2, DAY, "a", "m")], SCHEMA)
    assert N.split(df, ["api", "model"], 3)[0].count() == 6 and N.split(df, ["api", "model"], 1)[0].count() == 1
    assert N.split(df, ["api", "model"], 0)[0].isEmpty() and N.split(df, ["api", "model"], -1)[0].count() == 6
    assert N.split(df.limit(0), ["api", "model"], 3)[0].isEmpty() and N.newest(df.limit(0), 3).isEmpty()


def test_a_capped_export_has_several_ordered_files(spark):
    df = spark.range(200_000).selectExpr("id", "timestampadd(SECOND, int(id % 5000), timestamp_ntz'2024-01-01') AS ts", "'a' AS api", "'m' AS model")
    path = session.fresh_path(spark, "capped")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few bytes would be made one file
    N.newest(df, 100_000).write.parquet(path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).orderBy(F.desc("hi")).collect()
    assert sum(f.n for f in files) == 100_000 and len(files) > 1 and max(f.n for f in files) < 50_000
    assert all(a.lo >= b.hi for a, b in zip(files, files[1:]))


def test_the_overflow_of_a_hot_group_is_never_sorted(spark):
    df = spark.range(300_000).selectExpr("id", "timestamp_ntz'2024-01-01' AS ts", "'a' AS api", "'m' AS model")
    kept, gone = N.split(df, ["api", "model"], 1000)
    assert kept.agg(F.min("id")).first()[0] == 299_000 and kept.count() == 1000 and gone.count() == 299_000
