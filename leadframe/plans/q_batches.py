"""Two-batch queries: the keyed and appending jobs on a store that already has
rows. Every run is a commit of its own (batch ids ``one`` and ``two``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadframe.operators import reports, runs
from leadframe.plans import inputs
from leadframe.plans.q_ops import _BOTH, _NQ, LOG_SQL, SQL_TS, part_templates, written_call_log
from leadframe.plans.q_people import ORDER_QUERIES_SQL, _NORMQ, order_queries
from leadframe.plans.registry import NOW, register
from leadframe.session import materialize, scratch_dir
from leadframe.sources.snapshots import SnapshotStore

SPLIT = "2024-01-16"
LATER = "2024-03-01 00:00:00"


def two_ingests(spark, sf, reuse_by_name=False, between=None) -> SnapshotStore:
    """Person records of events before and after SPLIT, ingested (K13) one after the other; ``between`` runs after the first."""
    from leadframe.plans.catalog import records_of
    store = SnapshotStore(spark, scratch_dir(spark, "two-batches"))
    one, two = (records_of(inputs.profiles_of(e)) for e in inputs.halves(spark, sf, SPLIT))
    runs.commit_people(store, one, NOW, "one", reuse_by_name=reuse_by_name)
    if between is not None:
        between(store)
    runs.commit_people(store, two, LATER, "two", reuse_by_name=reuse_by_name)
    return store


# records with their batch and place over both (``o``)
_REC = f"""rec0 AS ({inputs.PERSON_RECORDS_SQL}),
rec AS (SELECT r.*, CASE WHEN e.ts < TIMESTAMP '{SPLIT}' THEN 1 ELSE 2 END AS bno,
          CASE WHEN e.ts < TIMESTAMP '{SPLIT}' THEN 1 ELSE 2 END * 1099511627776 + ingest_seq AS o
        FROM rec0 r JOIN events e ON e.event_id = r.ingest_seq WHERE linkedin_profile IS NOT NULL)"""
_COMPANIES = """comp AS (SELECT company_domain AS domain,
    arg_max_null(coalesce(nullif(company_name, ''), company_domain), o) AS name, arg_max(company_website, o) AS website,
    arg_max(nullif(source_name, ''), o) AS source_name, arg_max(nullif(source_query, ''), o) AS source_query,
    arg_min(ingest_seq, o) AS created_seq, min(bno) AS created_batch
  FROM rec WHERE nullif(company_domain, '') IS NOT NULL GROUP BY company_domain),
stubs AS (SELECT company_name AS name, nullif(source_name, '') AS source_name, nullif(source_query, '') AS source_query,
    ingest_seq AS created_seq, bno AS created_batch
  FROM rec WHERE nullif(company_domain, '') IS NULL AND nullif(company_name, '') IS NOT NULL)"""
_PEOPLE = """ppl AS (SELECT linkedin_profile, arg_max(first_name, o) AS first_name, arg_max(email, o) AS email,
    arg_max(followers_linkedin, o) AS followers_linkedin, arg_max(connections_linkedin, o) AS connections_linkedin,
    arg_max(info_raw, o) AS info_raw, min(o) AS created, arg_min(ingest_seq, o) AS created_seq, min(bno) AS created_batch
  FROM rec GROUP BY linkedin_profile)"""
_PEOPLE_LASTC = """lastc AS (SELECT linkedin_profile, arg_max_null(nullif(company_domain, ''), o) AS dom,
    arg_max_null(nullif(company_name, ''), o) AS cname
  FROM rec WHERE nullif(company_domain, '') IS NOT NULL OR nullif(company_name, '') IS NOT NULL GROUP BY linkedin_profile)"""
_PEOPLE = f"{_PEOPLE}, {_PEOPLE_LASTC}"


@register("k2_two_batches", f"""WITH {_REC}, {_COMPANIES}
SELECT domain, name, website, source_name, source_query, created_seq, created_batch FROM comp
UNION ALL SELECT NULL, name, NULL, source_name, source_query, created_seq, created_batch FROM stubs""")
def k2_two_batches(spark, sf):
    """K2/K3 twice: domains merged over both batches, stubs of both kept."""
    return two_ingests(spark, sf).read("companies").select(
        "domain", "name", "website", "source_name", "source_query", "created_seq", "created_batch")


@register("k3_stub_ids_two_batches", f"""WITH {_REC}, {_COMPANIES}
SELECT count(*) AS stubs, count(*) AS stub_ids FROM stubs""")
def k3_stub_ids_two_batches(spark, sf):
    """K3: stubs of different batches never share an id."""
    c = two_ingests(spark, sf).read("companies").filter(F.col("domain").isNull())
    return c.agg(F.count("*").alias("stubs"), F.countDistinct("id").alias("stub_ids"))


@register("k3_reuse_by_name_two_batches", f"""WITH {_REC}, {_COMPANIES}, {_PEOPLE_LASTC},
named AS (SELECT name, arg_max(source_name, created_batch * 1099511627776 + created_seq) AS source_name,
    arg_max(source_query, created_batch * 1099511627776 + created_seq) AS source_query,
    arg_min(created_seq, created_batch * 1099511627776 + created_seq) AS created_seq, min(created_batch) AS created_batch
  FROM stubs GROUP BY name)
SELECT domain, name, source_name, source_query, created_seq, created_batch, (SELECT count(*) FROM lastc WHERE dom = domain) AS people FROM comp
UNION ALL SELECT NULL, name, source_name, source_query, created_seq, created_batch,
  (SELECT count(*) FROM lastc WHERE dom IS NULL AND cname = name) FROM named""")
def k3_reuse_by_name_two_batches(spark, sf):
    """K3 with ``reuse_by_name`` twice: one stub per name over both batches, linked by its people."""
    store = two_ingests(spark, sf, reuse_by_name=True)
    n = store.read("people").groupBy("company_id").agg(F.count("*").alias("people"))
    c = store.read("companies").alias("c")
    return c.join(n, F.col("c.id") == n["company_id"], "left").select(
        "domain", "name", "source_name", "source_query", "created_seq", "created_batch",
        F.coalesce("people", F.lit(0)).cast("long").alias("people"))


@register("k13_two_batches", f"""WITH {_REC}, {_COMPANIES}, {_PEOPLE}
SELECT p.linkedin_profile, p.first_name, p.email, p.followers_linkedin, p.connections_linkedin, p.info_raw,
  p.created_seq, p.created_batch, l.dom AS domain,
  CASE WHEN l.dom IS NOT NULL THEN c.name ELSE l.cname END AS company_name
FROM ppl p LEFT JOIN lastc l USING (linkedin_profile) LEFT JOIN comp c ON c.domain = l.dom""")
def k13_two_batches(spark, sf):
    """K13 twice, seen through the S9 view: every person once, with the company of its newest record."""
    store = two_ingests(spark, sf)
    created = store.read("people").select("linkedin_profile", "created_seq", "created_batch")
    view = reports.people_with_company(store.read("people"), store.read("companies"))
    return view.join(created, "linkedin_profile").select(
        "linkedin_profile", "first_name", "email", "followers_linkedin", "connections_linkedin", "info_raw",
        "created_seq", "created_batch", "domain", "company_name")


@register("r2_recent_two_batches", f"""WITH {_REC}, {_PEOPLE}
SELECT linkedin_profile, followers_linkedin FROM ppl ORDER BY created DESC LIMIT 50""")
def r2_recent_two_batches(spark, sf):
    """R2 by arrival (top 50): the second batch's new people before all of the first's."""
    store = two_ingests(spark, sf)
    return reports.report_recent(store.read("people"), store.read("companies"), limit=50, stored=True).select(
        "linkedin_profile", "followers_linkedin")


@register("k7_two_batches", f"""WITH q AS (SELECT *, CASE WHEN ingest_seq % 3 = 0 THEN 1 ELSE 2 END AS bno FROM ({ORDER_QUERIES_SQL}))
SELECT coalesce(source, '') AS source, entity_type, {_NORMQ} AS normalized_query,
  arg_min(coalesce(query_text, ''), bno * 1099511627776 + ingest_seq) AS query_text,
  strftime(CASE WHEN min(bno) = 1 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{LATER}' END, {SQL_TS}) AS created_at,
  strftime(CASE WHEN max(bno) = 1 THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{LATER}' END, {SQL_TS}) AS last_executed_at
FROM q GROUP BY ALL""")
def k7_two_batches(spark, sf):
    """K7 twice: a known query keeps its first text and creation time."""
    from leadframe.operators import upsert
    q = order_queries(spark, sf)
    first = F.col("ingest_seq") % 3 == 0
    dim = materialize(upsert.upsert_queries(None, q.filter(first), NOW), "dim")
    dim = upsert.upsert_queries(dim, q.filter(~first), LATER)
    stamp = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "last_executed_at")]
    return dim.select("source", "entity_type", "normalized_query", "query_text", *stamp)


@register("o1_two_batches", f"""SELECT p_name AS name, 'Hi {{{{first_name}}}}, ' || p_type AS body_md,
  CASE WHEN p_partkey % 2 = 0 THEN '{NOW}' ELSE '{LATER}' END AS created_at,
  (SELECT count(*) FROM part) AS ids FROM part""")
def o1_two_batches(spark, sf):
    """O1 twice with the same sequence numbers in both batches: ids stay apart."""
    store = SnapshotStore(spark, scratch_dir(spark, "templates"))
    t = part_templates(spark, sf)
    t = t.withColumn("batch", F.col("ingest_seq") % 2 == 0).withColumn("ingest_seq", F.floor(F.col("ingest_seq") / 2))
    runs.add_templates(store, t.filter("batch").drop("batch"), NOW, "one")
    runs.add_templates(store, t.filter("NOT batch").drop("batch"), LATER, "two")
    rows = store.read("outreach_templates")
    n = rows.agg(F.countDistinct("id").alias("ids"))        # one row
    return rows.select("name", "body_md", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                       F.lit(1).alias("one")).join(F.broadcast(n.withColumn("one", F.lit(1))), "one").drop("one")


@register("o2_two_batches", f"""SELECT linkedin_profile, channel, rendered_md,
  strftime(scheduled_at, {SQL_TS}) AS scheduled_at, CASE WHEN id % 3 = 0 THEN '{NOW}' ELSE '{LATER}' END AS created_at
FROM ({inputs.MESSAGES_SQL})""")
def o2_two_batches(spark, sf):
    """O2 twice: the stored messages stay, the new ones are added."""
    store = SnapshotStore(spark, scratch_dir(spark, "messages"))
    m = inputs.messages(spark, sf).withColumnRenamed("id", "ingest_seq")
    runs.schedule_messages(store, m.filter("ingest_seq % 3 = 0"), NOW, "one")
    runs.schedule_messages(store, m.filter("ingest_seq % 3 <> 0"), LATER, "two")
    fmt = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("scheduled_at", "created_at")]
    return store.read("outreach_messages").select("linkedin_profile", "channel", "rendered_md", *fmt)


@register("r4_people_per_query_two_batches", f"""WITH {_REC},
both_ AS (SELECT *, {_NQ} AS nq FROM rec WHERE {_BOTH}),
dim AS (SELECT source_name AS source, nq, arg_min(source_query, o) AS query_text FROM both_ GROUP BY ALL),
pq AS (SELECT linkedin_profile, arg_max(source_name, o) AS s, arg_max(nq, o) AS nq FROM both_ GROUP BY linkedin_profile),
cnt AS (SELECT s, nq, count(*) AS c FROM pq GROUP BY ALL)
SELECT d.source, d.query_text, coalesce(cnt.c, 0) AS people_count
FROM dim d LEFT JOIN cnt ON cnt.s = d.source AND cnt.nq = d.nq""")
def r4_people_per_query_two_batches(spark, sf):
    """R4 from stored counts, refreshed after each of two ingests: the second adds its difference alone."""
    store = two_ingests(spark, sf, between=runs.refresh_query_counts)
    runs.refresh_query_counts(store)
    return reports.people_per_query(store.read("search_queries"), counts=store.read("query_people")).select(
        "source", "query_text", "people_count")


@register("r5_usage_two_batches", f"""SELECT coalesce(provider, 'unknown') AS provider, count(*) AS calls,
  CAST(sum(tokens) AS BIGINT) AS tokens FROM ({LOG_SQL}) WHERE run_id = 'run-1' GROUP BY ALL""")
def r5_usage_two_batches(spark, sf):
    """R5 from stored totals: the call log lands in two parts, each added once."""
    store = SnapshotStore(spark, scratch_dir(spark, "two-logs"))
    early = F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz")
    for batch, part in (("one", early), ("two", ~early)):
        runs.add_call_log(store, written_call_log(spark, sf, part), batch)
    return reports.usage_by_provider(store.read("usage"), run_id="run-1", stored=True)
