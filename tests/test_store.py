"""The fact store: what is live, what is rewritten, what a crash leaves."""

import os

import pytest
from pyspark.sql import functions as F

from meterline import session
from meterline.operators import filters, imports
from meterline.sources import tables
from meterline.sources.store import FactStore

SF = "/root/testdata/sf0.001"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


@pytest.fixture
def facts(spark):
    return tables.requests(spark, SF)


@pytest.fixture
def store(spark, facts):
    s = FactStore(spark, session.fresh_path(spark, "store"), facts.schema).create()
    s.append(facts.where("id % 2 = 0"))
    s.append(facts.where("id % 2 = 1"))
    return s


def _files(store):
    return {(r.f, r.d) for r in store.read().select(F.input_file_name().alias("f"), F.col("local_day").alias("d")).distinct().collect()}


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_reads_all_batches_and_prunes_days(store, facts):
    assert _ids(store.read()) == _ids(facts)
    plan = filters.filter_range(store.read(), "7d", _now())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in text and "local_day" in text.split("PartitionFilters")[1]
    assert _ids(plan) == _ids(filters.filter_range(facts, "7d", _now()))
    one = imports.with_fingerprint(facts.where("id = 5")).first().fingerprint
    assert 5 in _ids(store.find(one)) and "EqualTo(fingerprint" in store.find(one)._jdf.queryExecution().executedPlan().toString()


def test_expired_days_go_and_other_files_stay(store, facts):
    before = _files(store)
    store.expire(_now(), 20)
    edge = "2024-01-11"
    assert _ids(store.read()) == _ids(facts.where("ts is null or ts >= timestamp_ntz'2024-01-11'"))
    after = _files(store)
    assert {x for x in after if x[1] != edge} == {x for x in before if x[1] > edge or x[1] == "0001-01-01"}
    assert store.vacuum() > 0 and _files(store) == after
    version = store.version()
    store.expire(_now(), 0)
    assert store.version() == version


def test_compaction_swaps_days_in_several_batches_only(store, facts):
    store.append(facts.limit(0))
    version = store.version()
    alone = facts.where("id = 1").withColumn("ts", F.expr("timestamp_ntz'2031-05-05 00:00:00'"))
    store.append(alone)
    lone = {x for x in _files(store) if x[1] == "2031-05-05"}
    rows = sorted(map(str, store.read().select("id", "ts", "fingerprint").collect()))
    store.compact()
    assert sorted(map(str, store.read().select("id", "ts", "fingerprint").collect())) == rows
    assert lone <= _files(store) and store.version() == version + 2
    days = [d for _, d in store.live()]
    assert len(days) == len(set(days))


@pytest.mark.parametrize("step", ["expire", "compact", "append"])
def test_a_crash_before_the_list_loses_nothing(store, facts, monkeypatch, step):
    rows, files = _ids(store.read()), _files(store)

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(FactStore, "_write_list", crash)
        with pytest.raises(RuntimeError):
            {"expire": lambda: store.expire(_now(), 20), "compact": store.compact, "append": lambda: store.append(facts)}[step]()
    assert _ids(store.read()) == rows and _files(store) == files
    store.vacuum()
    assert _ids(store.read()) == rows and _files(store) == files
    assert all(os.path.isdir(f"{store.root}/data/batch={b}/local_day={d}") for b, d in store.live())


def test_import_reads_touched_days_and_adds_each_row_once(spark, facts):
    store = FactStore(spark, session.fresh_path(spark, "store"), facts.schema).create()
    clean = imports.clean_labels(imports.clean_numbers(facts, _now()))
    store.append(clean.where("id % 3 > 0"))
    some = facts.where("ts >= timestamp_ntz'2024-01-20' and ts < timestamp_ntz'2024-01-22'")
    admitted = imports.admitted(some, _now())
    days = {r.d for r in store.known(admitted).select(F.input_file_name().alias("f")).distinct().select(
        F.regexp_extract("f", "local_day=([^/]*)", 1).alias("d")).collect()}
    assert days == {"2024-01-20", "2024-01-21", "2024-01-22"}
    assert "sha2" not in store.known(admitted)._jdf.queryExecution().executedPlan().toString()
    want = {r.fingerprint for r in store.read().select("fingerprint").unionByName(admitted.select("fingerprint")).collect()}
    for _ in range(2):
        store.merge(some, _now())
        got = [r.fingerprint for r in store.read().collect()]
        assert set(got) == want
        assert len(got) == len(clean.where("id % 3 > 0").collect()) + len(want) - len({r.fingerprint for r in imports.with_fingerprint(clean.where("id % 3 > 0")).collect()})
