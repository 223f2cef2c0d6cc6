"""Every registered query against its SQL twin at the smallest scale."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterline.plans import ORACLES, QUERIES
from meterline.sources import prices as PR
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_bodies_of_requests_without_tokens(spark, tmp_path):
    """Every shape of body for a request that used nothing at all, or next to nothing."""
    for name in ("events", "conversations"):
        rows = spark.read.parquet(f"{SF}/{name}.parquet").limit(24)
        if name == "events":
            at = F.row_number().over(Window.orderBy("event_id"))
            rows = rows.withColumn("event_id", at).withColumns({"value": F.floor(at / 12) * 0.05 + 0.01, "props": F.lit('{"k": 0}')}).withColumn("event_id", at.cast("bigint"))
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = QUERIES["decode_payload_usage"](spark, str(tmp_path))
    assert compare(got, duck(str(tmp_path)), ORACLES["decode_payload_usage"]) == "" and got.count() == 13


def test_quarantine_repairs_no_labels(spark, monkeypatch):
    """Refused rows are counted from the import alone: stored history is neither repaired nor written."""
    def never(*_):
        raise AssertionError("not needed")
    monkeypatch.setattr("meterline.operators.imports.clean_labels", never)
    monkeypatch.setattr("meterline.session.checkpoint", never)
    assert QUERIES["import_quarantine"](spark, SF).count() == 2


def test_catalog_is_spread_before_its_sort(spark):
    """The names of all models in one file are not sorted in the one task that reads it."""
    docs = spark.range(0, 500, 1, 1).select(F.create_map(F.lit("openai"), F.from_json(F.concat(F.lit('{"models":{"m'), "id", F.lit('":{"id":"x","cost":{"input":1,"output":2}}}}')),
                                            PR.CATALOG_SCHEMA[len("map<string, "):-1])).alias("doc"))
    assert PR.catalog_prices(docs).count() == 1002
    plan = PR.catalog_prices(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") > plan.index("Aggregate")


def test_fingerprint_is_not_tested_in_the_scan(spark):
    """A join on the fingerprint must not push its whole expression down as a filter."""
    plan = QUERIES["enrich_metadata"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "sha2" in x]
