"""Streams over several batches equal their batch twins."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterline.operators import health, payloads, reconcile
from meterline.operators import imports as M
from meterline.operators import rollup as R
from meterline.sources import tables as S
from meterline.streaming import jobs as J

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    events = S.table(spark, SF, "events")
    for lo, hi in ((0, 300), (300, 650), (650, 10**9)):
        events.where(f"event_id >= {lo} and event_id < {hi}").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return S.facts_from_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_health(spark, events_dir):
    want = health.health_counts(S.requests(spark, SF))
    assert rows(J.drain(J.st_health(stream(spark, events_dir), "1 day"), "h", ["slot_start"])) == rows(want)


def test_rollup_and_replay(spark, events_dir, tmp_path):
    want = R.range_base(S.requests(spark, SF))
    path = str(tmp_path / "rollup")
    J.st_rollup(stream(spark, events_dir), path, str(tmp_path / "c1")).awaitTermination()
    assert rows(J.read_rollup(spark, path)) == rows(want)
    # a lost checkpoint repeats every batch: the folders are replaced, nothing counts twice
    J.st_rollup(stream(spark, events_dir), path, str(tmp_path / "c2")).awaitTermination()
    assert rows(J.read_rollup(spark, path)) == rows(want)
    J.compact_rollup(spark, path, str(tmp_path / "small"), 1)
    assert rows(J.read_rollup(spark, str(tmp_path / "small"))) == rows(want)


def test_settle_over_batches_and_idle(spark, tmp_path):
    """Chunks of a stream spread over batches; one stream never ends and settles by idling."""
    schema = ("correlation_id string, provider string, auth_id string, api_key string, chunk_index int, terminal boolean, seq int, "
              "input_tokens long, output_tokens long, at timestamp_ntz")
    def ch(cid, n, term, tok, sec):
        return (cid, "openai", "", "k", n, term, n, tok, tok, sec)
    t = "2024-01-01 00:%s"
    batches = [[ch("a", 1, False, 5, "00:00"), ch("idle", 1, False, 6, "00:01"), ch("stale", 7, False, 8, "00:01")],
               [ch("a", 2, False, 9, "00:02"), ch("stale", 3, False, 1, "00:03")],
               [ch("a", 3, True, 0, "00:04"), ch("stale", 8, True, 0, "00:05"), ch("late", 1, True, 3, "09:00")],
               [ch("z", 1, True, 2, "20:00"), ch(" ", 1, False, 7, "20:00"), ch(" ", 1, False, 4, "20:01"), ch("", 1, True, 0, "20:01")]]
    path = str(tmp_path / "chunks")
    for b in batches:
        df = spark.createDataFrame(b, schema.replace("timestamp_ntz", "string"))
        df.withColumn("at", F.concat(F.lit("2024-01-01 00:"), "at").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(path)
    chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = rows(J.drain(J.st_settle(chunks), "s", conf=J.ROCKS).select("correlation", "output_tokens"))
    assert got == [("", 4), ("", 7), ("a", 9), ("idle", 6), ("late", 3), ("stale", 8), ("z", 2)]
    want = rows(payloads.settle_stream(spark.read.schema(schema).parquet(path)).select("correlation", "output_tokens"))
    assert got == want


def test_reconcile_over_batches(spark, events_dir):
    facts, end = stream(spark, events_dir), J.Ending(spark)
    feeds = [end.closing(f, "observed_at") for f in (S.native_feed(facts), S.fallback_feed(facts))]
    done = J.run_to_end(J.st_reconcile(*feeds, late="90 days"), "r", conf=J.ROCKS, ending=end)
    batch = S.requests(spark, SF)
    native, fallback = S.native_feed(batch), S.fallback_feed(batch)
    want = [r for r in rows(reconcile.match_feeds(native, fallback).select("native_id", "fallback_id", "how")) if r[2] is not None and "superseded" not in r]
    got = done.rows
    assert rows(got.where("how not in ('native', 'fallback')").select("native_id", "fallback_id", "how")) == want
    # every row left: in a pair or alone
    assert got.where("native_id is not null").count() == native.where(reconcile.has_tokens()).count()
    assert got.where("fallback_id is not null").count() == fallback.where(reconcile.has_tokens()).count()
    assert done.late() == 0


FACT = ["id", "ts", "fingerprint", "endpoint", "api_key", "api_key_hash", "stream"]


def test_enrich_folds_and_ends(spark, tmp_path):
    """Updates before and after their fact, twice, in parts; copies of a fact; a fact without a time; a late one."""
    def fact(i, at, fp, end="", key="", own="", s=False):
        return (i, at and f"2024-01-01 {at}", fp, end, key, own, s)
    facts = [[fact(1, "00:00:00", "a"), fact(2, "00:01:00", "b"), fact(7, None, "a")], [fact(3, "00:01:00", "b"), fact(4, "00:20:00", "c", "/x", "k")],
             [fact(5, "09:00:00", "d"), fact(6, "00:00:30", "late")], [fact(9, "09:01:00", "e")], [fact(8, "00:00:30", "later")]]
    upd = [[(1, "00:01:00", "b", "/u", "", "", True)], [(2, "00:00:00", "a", "", "q", "", False), (2, "00:00:00", "a", "", "q", "", False), (3, "00:00:00", "a", "/v", "r", "h", False),
            (4, "00:20:00", "c", "/y", "z", "h", True)], [(5, "00:01:00", "b", "/u", "", "", True)], [(7, "09:01:00", "e", "/e", "", "", False)], [(6, "00:02:00", "b", "/w", "", "", True)]]
    types = "id long, ts string, fingerprint string, endpoint string, api_key string, api_key_hash string, stream boolean"
    paths = [str(tmp_path / "facts"), str(tmp_path / "updates")]
    for batch in zip(facts, upd):
        for k, part in enumerate(batch):
            part = [(r[0], r[1] and f"2024-01-01 {r[1]}", *r[2:]) for r in part] if k else part
            df = spark.createDataFrame(part, types).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
            (df.withColumnRenamed("id", "seq") if k else df).coalesce(1).write.mode("append").parquet(paths[k])
    end = J.Ending(spark)
    sources = [end.closing(spark.readStream.schema(spark.read.parquet(p).schema).option("maxFilesPerTrigger", 1).parquet(p)) for p in paths]
    done = J.run_to_end(J.st_enrich(*sources), "enrich", conf=J.ROCKS, ending=end)
    got = {r["id"]: tuple(r[n] for n in FACT[3:]) for r in done.rows.collect()}
    assert got == {1: ("/v", "q", "h", False), 2: ("", "", "", False), 3: ("/u", "", "", True), 4: ("/x", "k", "h", True), 5: ("", "", "", False), 6: ("", "", "", False),
                   7: ("", "", "", False), 9: ("/e", "", "", False)}
    assert done.rows.count() == 8 and done.late() == 2  # fact 8 and update 6 came when the watermark had passed them


def test_late_rows_are_counted(spark, tmp_path):
    """Three batches; the last one is behind the watermark by days."""
    path = str(tmp_path / "events")
    events = S.table(spark, SF, "events").where("ts is not null")
    edge = events.agg(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0]
    late = events.where(F.unix_micros(F.col("ts").cast("timestamp")) < edge - 3 * 86400 * 1000000)
    rest = events.join(late.select("event_id"), "event_id", "left_anti").select(events.columns)
    for part in (rest.where("event_id % 2 = 0"), rest.where("event_id % 2 = 1"), late):
        part.coalesce(1).write.mode("append").parquet(path)
    n, facts = late.count(), S.facts_from_events(events)
    undated = facts.where("ts is null").count()
    n -= S.facts_from_events(late).where("ts is null").count()
    assert n > 0
    wide = "40 days"
    for job, totals, keys in ((J.st_health, ("success", "failure"), ["slot_start"]), (J.st_series_hour, ("requests",), ["hour_start", "model", "provider"])):
        assert J.run_to_end(job(stream(spark, path), "1 hour"), "late", keys).late(*totals) >= n
        assert J.run_to_end(job(stream(spark, path), wide), "late", keys).late(*totals) == 0
    with_fp = lambda: M.with_fingerprint(stream(spark, path))
    some = J.run_to_end(J.st_dedup(with_fp(), "1 hour"), "late", conf=J.ROCKS)
    assert some.late() >= n and some.rows.count() == facts.count() - some.late()
    assert some.rows.where("ts is null").count() == undated
    assert J.run_to_end(J.st_dedup(with_fp(), wide), "late", conf=J.ROCKS).late() == 0


def test_undated_hours(spark, events_dir, tmp_path):
    path = str(tmp_path / "hours")
    J.st_undated_hours(stream(spark, events_dir), path, str(tmp_path / "c")).awaitTermination()
    assert J.read_undated_hours(spark, path).agg(F.sum("requests")).first()[0] == S.requests(spark, SF).where("ts is null").count()


def test_enrich_without_python(spark, events_dir):
    """One aggregate over all keys: no call of Python and no timer for each fact."""
    facts = M.with_fingerprint(stream(spark, events_dir))
    plan = J.st_enrich(facts, S.updates(facts))._jdf.queryExecution().analyzed().toString()
    assert "collect_list" in plan and "InPandas" not in plan and "InPySpark" not in plan


class Group:
    """State of one group, kept between calls."""

    def __init__(self):
        self.get, self.exists, self.mark, self.timeout = None, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.mark

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutTimestamp(self, at):
        assert at > self.mark
        self.timeout = at

    def call(self, fn, mark, *parts):
        self.mark = mark
        return sorted(tuple(r) for pdf in fn((0,), iter(parts), self) for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False))


def test_match_keys_of_one_group():
    """Many match keys in one call: each is replayed alone, open rows stay for the next call."""
    names, s, g = list(J._OPEN_ROW), 1_000_000, Group()
    rows = lambda *r: pd.DataFrame(r, columns=names)
    first = [rows(("a", 0, 1, 10 * s, 10 * s, "", ""), ("b", 0, 2, 10 * s, 10 * s, "", "")), rows(("b", 1, 7, 11 * s, 11 * s, "", ""), ("c", 1, 8, 11 * s, 11 * s, "", ""))]
    assert g.call(J._match, 0, *first) == [(2, 7, "recent", 11 * s)]
    assert sorted(zip(g.get[0], g.get[2])) == [("a", 1), ("c", 8)] and g.timeout == 15001
    assert g.call(J._match, 12_000, rows(("a", 1, 9, 12 * s, 12 * s, "", ""))) == [(1, 9, "recent", 12 * s)]
    assert g.call(J._match, 60_000, rows()) == [(None, 8, "fallback", 11 * s)] and not g.exists


def test_streams_of_one_group():
    """Many streams in one call: each ends alone, copies of a chunk count by arrival, others stay open until they idle."""
    names, g = [*J._STREAM, *J._USED, "seq", "terminal", "at_ms"], Group()
    rows = lambda *r: pd.DataFrame(r, columns=names)
    a, b, c = [("f", "", "k", x) for x in "ab"] + [("f", None, "k", "c")]
    assert g.call(J._settle, 0, rows((*a, 1, 5, 5, 2, False, 1000), (*b, 2, 1, 1, 9, False, 1000)), rows((*a, 1, 4, 4, 1, True, 1000), (*c, 1, 8, 8, 1, False, 2000))) == [(*a, 1, 5, 5)]
    assert g.timeout == 61_000
    assert g.call(J._settle, 1500, rows((*b, 2, 3, 3, 1, False, 9000), (*c, 2, 0, 0, 2, False, 3000))) == []
    assert g.call(J._settle, 63_001, rows()) == [(*c, 1, 8, 8)]
    assert g.call(J._settle, 63_002, rows((*b, 3, 0, 0, 3, True, 64_000))) == [(*b, 2, 3, 3)] and not g.exists
