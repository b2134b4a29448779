"""The ingest and usage jobs on streams (Structured Streaming).

Nothing here is a new operator: a micro-batch of landed profiles goes
through the same N rules and K13 ingest as a batch run (``foreachBatch``),
and the usage report (R5) is the same aggregate over a stream of log lines.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe import schemas
from leadframe.operators import reports, runs, standardise
from leadframe.sources.readers import parse_call_log
from leadframe.sources.snapshots import SnapshotStore

PROFILE_STREAM_SCHEMA = T.StructType(list(schemas.RAW_PROFILE.fields) + [
    T.StructField("source_name", T.StringType()), T.StructField("source_query", T.StringType()),
    T.StructField("ingest_seq", T.LongType())])


def _utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def ingest_batch(store: SnapshotStore, batch: DataFrame, batch_id: str, now: str | None = None) -> bool:
    """One micro-batch of raw profiles: N1 mapping, N rules, K13 against the
    stored tables, one commit. A batch id already committed is skipped, so a
    replayed batch (after a failure at any step) is not applied twice.
    Returns whether the batch was applied."""
    if store.committed(batch_id):
        return False
    now = now or _utc_now()
    mapped = standardise.map_to_person_schema(batch, now[:10])
    runs.commit_people(store, standardise.standardise_people(mapped), now, batch_id)
    return True


def start_people_ingest(spark: SparkSession, landing_dir: str, store_root: str, checkpoint: str,
                        trigger: dict | None = None, name: str = "people"):
    """Stream JSON-lines profiles from ``landing_dir`` into the snapshot
    store; returns the running query. ``checkpoint`` must be shared storage
    and belong to ``name``: its epochs are the stream's batch ids."""
    store = SnapshotStore(spark, store_root)
    stream = spark.readStream.schema(PROFILE_STREAM_SCHEMA).json(landing_dir)
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, epoch: ingest_batch(store, df, f"stream:{name}:{epoch}"))
    return w.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def usage_stream(spark: SparkSession, log_dir: str, run_id: str | None = None) -> DataFrame:
    """R5 over a stream of call-log lines (complete-mode aggregate)."""
    return reports.usage_by_provider(parse_call_log(spark.readStream.text(log_dir)), run_id)
