from pyspark.sql import functions as F

from meterline import session
from meterline.operators import events, filters
from meterline.sources import tables

SF = "/root/testdata/sf0.001"


def test_range_filters_prune_day_folders(spark):
    facts = tables.requests(spark, SF)
    path = session.fresh_path(spark, "facts")
    events.write_facts(facts, path)
    stored, now = events.scan_facts(spark, path), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    for plan, plain in ((filters.filter_range(stored, "7d", now), filters.filter_range(facts, "7d", now)),
                        (filters.filter_before(stored, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")),
                         filters.filter_before(facts, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: []" not in text and "local_day" in text.split("PartitionFilters")[1]
        assert {r.id for r in plan.select("id").collect()} == {r.id for r in plain.select("id").collect()}


def test_exports_are_newest_first(spark):
    facts = tables.requests(spark, SF)
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    for cap in (0, 50):
        path = session.fresh_path(spark, "export")
        events.write_jsonl(events.export_window(facts, filters.Query(), now, cap), path)
        ids = [r.id for r in spark.read.json(path).select("id").collect()]
        want = [r.id for r in facts.orderBy(F.col("ts").desc_nulls_last(), F.desc("id")).select("id").collect()]
        assert ids == (want[:cap] if cap else want)
