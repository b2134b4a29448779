"""Outreach table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe import fixed, schemas
from leadframe.sources.readers import align_schema

SEQ = "ingest_seq"


def _ts(now: str):
    return F.to_timestamp_ntz(F.lit(now))


def add_templates(templates: DataFrame | None, new: DataFrame, now: str, batch_id: str) -> DataFrame:
    """O1: append templates (``name, channel, body_md, variables_json,
    ingest_seq``), active, created now. ``batch_id`` must not have been used
    before: ids are hashes of it and ``ingest_seq``."""
    rows = new.select(
        F.xxhash64(F.lit("template"), F.lit(batch_id), F.col(SEQ)).alias("id"), "name", "channel", "body_md",
        F.col("variables_json").cast("string"), F.lit(1).alias("is_active"), _ts(now).alias("created_at"))
    rows = align_schema(rows, schemas.OUTREACH_TEMPLATES)
    return rows if templates is None else align_schema(templates, schemas.OUTREACH_TEMPLATES).unionByName(rows)


def schedule_messages(messages: DataFrame | None, new: DataFrame, now: str, batch_id: str) -> DataFrame:
    """O2: append rendered messages (``linkedin_profile, channel,
    template_id, stage_no, rendered_md, scheduled_at, ingest_seq``) with
    status 'scheduled' (stage 1 when not given) to the stored ones, which
    stay as they are. ``batch_id`` as in ``add_templates``."""
    rows = new.select(
        F.xxhash64(F.lit("message"), F.lit(batch_id), F.col(SEQ)).alias("id"), "linkedin_profile", "channel",
        F.col("template_id").cast("long"), F.coalesce(F.col("stage_no").cast("int"), F.lit(1)).alias("stage_no"),
        "rendered_md", F.lit(fixed.MESSAGE_STATUS_SCHEDULED).alias("status"),
        F.col("scheduled_at").cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz").alias("sent_at"),
        F.lit(None).cast("timestamp_ntz").alias("replied_at"), _ts(now).alias("created_at"))
    rows = align_schema(rows, schemas.OUTREACH_MESSAGES)
    return rows if messages is None else align_schema(messages, schemas.OUTREACH_MESSAGES).unionByName(rows)


def apply_status_events(messages: DataFrame, events: DataFrame) -> DataFrame:
    """O3: events (``message_id, kind ('sent'|'replied'), ts, ingest_seq``)
    applied by id without a state check: the last event sets the status,
    the last 'sent' sets sent_at, the last 'replied' sets replied_at.
    Events are reduced per id with partial aggregation before the join."""
    e = events.filter(F.col("kind").isin(fixed.MESSAGE_STATUS_SENT, fixed.MESSAGE_STATUS_REPLIED))
    agg = e.groupBy("message_id").agg(
        F.max_by("kind", SEQ).alias("_status"),
        F.max_by("ts", F.when(F.col("kind") == fixed.MESSAGE_STATUS_SENT, F.col(SEQ))).alias("_sent"),
        F.max_by("ts", F.when(F.col("kind") == fixed.MESSAGE_STATUS_REPLIED, F.col(SEQ))).alias("_replied"))
    j = messages.join(agg, messages["id"] == agg["message_id"], "left")
    return (j.withColumn("status", F.coalesce("_status", "status"))
            .withColumn("sent_at", F.coalesce(F.col("_sent").cast("timestamp_ntz"), F.col("sent_at")))
            .withColumn("replied_at", F.coalesce(F.col("_replied").cast("timestamp_ntz"), F.col("replied_at")))
            .drop("message_id", "_status", "_sent", "_replied"))


def due_messages(messages: DataFrame, now: str) -> DataFrame:
    """Scheduled messages whose time has come, oldest first; a message
    without a time is never due."""
    return (messages.filter((F.col("status") == fixed.MESSAGE_STATUS_SCHEDULED)
                            & (F.col("scheduled_at") <= _ts(now)))
            .orderBy("scheduled_at", "id")
            .select("id", "linkedin_profile", "stage_no", "channel", "rendered_md", "scheduled_at"))
