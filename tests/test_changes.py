import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from quaestor.operators import cdc
from quaestor.streaming.sync import sync_offers


def df(spark, data, schema="k string, v string, seen string"):
    return spark.createDataFrame(data, schema)


def test_upsert_overwrites_with_nulls_and_keeps_first_seen(spark):
    old = df(spark, [("a", "1", "t0"), ("b", "2", "t0"), (None, "n", "t0")])
    new = df(spark, [("a", None, "t1"), ("c", "3", "t1"), (None, "m", "t1")])
    assert rows(cdc.upsert(old, new, ["k"], ["seen"])) == sorted([("a", None, "t0"), ("b", "2", "t0"), ("c", "3", "t1"), (None, "m", "t0")], key=repr)
    assert rows(cdc.upsert(old.limit(0), new, ["k"], ["seen"])) == rows(new)


def test_sweep_diff_cascade_replace(spark):
    old = df(spark, [("a", "1", "r1"), ("b", "2", "r2"), ("c", "3", None)])
    assert rows(cdc.sweep(old, "r2", "seen")) == [("b", "2", "r2")]
    now = df(spark, [("a", "1", "x"), ("b", "9", "x"), ("d", "4", "x")])
    assert rows(cdc.diff_actions(now, old, ["k"], "v")) == [("a", "skip"), ("b", "update"), ("c", "delete"), ("d", "insert")]
    assert rows(cdc.stale(old, now, ["k"])) == [("c",)]
    assert rows(cdc.cascade(old, now, ["k"]).select("k")) == [("a",), ("b",)]
    assert rows(cdc.replace_partition(old, df(spark, [("a", "7", "x"), ("a", "8", "x")]), ["k"]).select("k", "v")) == [("a", "7"), ("a", "8"), ("b", "2"), ("c", "3")]


def test_newest_and_retention_break_ties_by_key(spark):
    t = df(spark, [("a", "1", "s"), ("a", "2", "s"), ("b", "1", "s")])
    assert rows(cdc.newest_per_key(t, ["k"], ["v"])) == [("a", "2", "s"), ("b", "1", "s")]
    assert rows(cdc.retain(t, ["seen"], 2, [F.desc("v"), F.col("k")], F.lit(None).cast("boolean"))) == [("a", "1", "s"), ("a", "2", "s")]


@pytest.mark.parametrize("attempted, error, due", [(None, "e", True), ("2026-01-15 11:59:00", "e", False), ("2026-01-15 11:45:00", "e", True), ("junk", "e", True), ("2026-01-15 11:59:00", None, True)])
def test_retry(spark, attempted, error, due):
    t = spark.createDataFrame([(attempted, error)], "a string, e string")
    assert t.select(cdc.retry_due(F.col("a"), F.col("e"), "2026-01-15 12:00:00")).collect()[0][0] is due


def test_stream_upserts_new_files_only(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "consultation_id string, org_acronyme string, objet string, categorie string, date_limite string, first_seen_at string, ingested_at timestamp, swept_at timestamp"
    first = [("1", "A", "old", None, None, "t0", at("2025-01-01"), None), ("2", "A", "two", None, None, "t0", at("2025-01-01"), None)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(source)
    assert sync_offers(spark, source, target).count() == 2
    spark.createDataFrame([("1", "A", "new", None, None, "t1", at("2025-02-01"), None)], schema).coalesce(1).write.mode("append").parquet(source)
    got = rows(sync_offers(spark, source, target).select("consultation_id", "objet", "first_seen_at"))
    assert got == [("1", "new", "t0"), ("2", "two", "t0")]
    assert rows(sync_offers(spark, source, target).select("consultation_id", "objet", "first_seen_at")) == got


def test_periodic_sync_goes_on_after_a_failure(spark, tmp_path):
    from quaestor.streaming.sync import ready, sync_periodically

    source, target, problems = str(tmp_path / "in"), str(tmp_path / "out"), []
    assert not ready(spark, target)
    sync_periodically(spark, source, target, 0, rounds=1, report=problems.append)
    schema = "consultation_id string, org_acronyme string, objet string, categorie string, date_limite string, first_seen_at string, ingested_at timestamp, swept_at timestamp"
    spark.createDataFrame([("1", "A", "old", None, None, "t0", at("2025-01-01"), None)], schema).coalesce(1).write.parquet(source)
    sync_periodically(spark, source, target, 0, rounds=2, report=problems.append)
    assert len(problems) == 1 and ready(spark, target)


def test_written_tables_are_dropped(spark):
    import os

    from quaestor.runtime import drop_written, tables_dir, written

    df = written(spark.createDataFrame([(1, "a"), (2, None)], "n int, k string"), by="k")
    assert rows(df.select("n", "k")) == [(1, "a"), (2, None)] and os.path.exists(tables_dir(spark).removeprefix("file:"))
    drop_written(spark)
    assert not os.path.exists(tables_dir(spark).removeprefix("file:"))
