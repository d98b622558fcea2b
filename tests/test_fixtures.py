"""The derived tables the queries run on."""

from checks import fixtures


def test_more_rows_make_more_tasks_not_longer_ones(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 50, raising=False)
    fixtures._view(spark, "/root/testdata/sf0.001", "events")
    events = spark.table("events")
    assert events.rdd.getNumPartitions() == events.count() // 50 > spark.sparkContext.defaultParallelism
