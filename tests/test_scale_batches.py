"""The two-batch jobs: a record is standardised once, in its own batch."""
from conftest import rows
from pyspark.sql import functions as F

from leadframe.operators import runs
from leadframe.plans import inputs, q_batches, q_ops
from leadframe.plans.catalog import records_of
from leadframe.sources import snapshots

EVENTS = [(1, "2024-01-01 00:00:00", 1, "click", 1.5), (1, "2024-01-20 00:00:00", 2, "view", 2.5),    # one id, both halves
          (1, "2024-01-20 00:00:00", 2, "view", 2.5), (2, None, 3, "click", 3.5), (None, "2024-01-02 00:00:00", 4, "view", None),
          (5, "2024-01-16 00:00:00", 5, "click", 0.5), (7, "2024-01-15 23:59:59", None, None, 9.5)]


def events(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "event_id long, ts string, user_id long, event_type string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("props", F.lit(None).cast("string")).write.parquet(
        f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_halves_have_the_rows_of_the_join_with_times(spark, tmp_path):
    sf = events(spark, tmp_path)
    ts = inputs.table(spark, sf, "events").select(F.col("event_id").alias("ingest_seq"), "ts")
    both = records_of(inputs.raw_profiles(spark, sf)).join(ts, "ingest_seq")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    for half, wanted in zip(inputs.halves(spark, sf, "2024-01-16"), (both.filter(early), both.filter(~early)), strict=True):
        got = sorted(map(str, rows(records_of(inputs.profiles_of(half)))))
        assert got == sorted(map(str, rows(wanted.drop("ts")))) and got


def test_two_ingests_standardise_a_record_in_its_own_batch(spark, tmp_path, monkeypatch):
    batches = []
    monkeypatch.setattr(runs, "commit_people", lambda store, rec, *a, **k: batches.append(rec))
    q_batches.two_ingests(spark, events(spark, tmp_path))
    for rec in batches:
        plan = rec._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("ArrowEvalPython") < plan.index("Join")      # the rules run above the join, on the half's rows
    assert len(batches) == 2


def test_snapshot_upsert_standardises_a_batch_once(spark, tmp_path, monkeypatch):
    plans, touched = [], snapshots.SnapshotStore.touched

    def seen(store, table, *frames):
        plans.extend(f._jdf.queryExecution().optimizedPlan().toString() for f in frames)
        return touched(store, table, *frames)
    monkeypatch.setattr(snapshots.SnapshotStore, "touched", seen)
    assert q_ops.s8_snapshot_upsert(spark, events(spark, tmp_path)).count() == 3
    assert len(plans) == 2 and not any("ArrowEvalPython" in p for p in plans)
