"""Outreach (O), report (R) and source/sink (S) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadframe import schemas
from leadframe.operators import extract, outreach, reports, responses, standardise, upsert, validate
from leadframe.plans import inputs
from leadframe.plans.q_people import (ORDER_QUERIES_SQL, SUPPLIER_COMPANIES_SQL, _K7_SQL, _R2_PARTS,
                                      order_queries, supplier_companies)
from leadframe.plans.registry import BATCH, NOW, register
from leadframe.plans.sqlparts import K1_AGG
from leadframe.session import materialize, scratch_dir
from leadframe.sources import export, readers
from leadframe.sources.snapshots import SnapshotStore

TS = "yyyy-MM-dd HH:mm:ss"
SQL_TS = "'%Y-%m-%d %H:%M:%S'"


def _records(spark, sf):
    from leadframe.plans.catalog import person_records
    return person_records(spark, sf)


def _ingest(spark, sf):
    from leadframe.plans.catalog import ingest
    return ingest(spark, sf)


def _fmt(c):
    return F.date_format(F.col(c), TS).alias(c)


# ====================================================================== O
def part_templates(spark, sf):
    p = inputs.table(spark, sf, "part")
    return p.select(F.col("p_name").alias("name"),
                    F.when(F.col("p_partkey") % 2 == 0, F.lit("linkedin")).otherwise(F.lit("email")).alias("channel"),
                    F.concat(F.lit("Hi {{first_name}}, "), F.col("p_type")).alias("body_md"),
                    F.lit('["first_name"]').alias("variables_json"), F.col("p_partkey").alias("ingest_seq"))


@register("o1_add_templates", """SELECT p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'linkedin' ELSE 'email' END
  AS channel, 'Hi {{first_name}}, ' || p_type AS body_md, CAST(1 AS INTEGER) AS is_active FROM part""")
def o1_add_templates(spark, sf):
    t = outreach.add_templates(None, part_templates(spark, sf), NOW, BATCH)
    return t.select("name", "channel", "body_md", "is_active")


@register("o2_schedule_messages", f"""SELECT linkedin_profile, channel,
  CAST(CASE WHEN id % 13 = 0 THEN 1 ELSE stage_no END AS INTEGER) AS stage_no, 'scheduled' AS status,
  strftime(scheduled_at, {SQL_TS}) AS scheduled_at, rendered_md FROM ({inputs.MESSAGES_SQL})""")
def o2_schedule_messages(spark, sf):
    new = inputs.messages(spark, sf).withColumn("stage_no", F.when(F.col("id") % 13 != 0, F.col("stage_no"))) \
                                    .withColumnRenamed("id", "ingest_seq")
    m = outreach.schedule_messages(None, new, NOW, BATCH)
    return m.select("linkedin_profile", "channel", "stage_no", "status", _fmt("scheduled_at"), "rendered_md")


def status_events(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("message_id"),
                     F.when(F.col("l_linenumber") % 2 == 1, F.lit("sent")).otherwise(F.lit("replied")).alias("kind"),
                     F.col("l_shipdate").alias("ts"),
                     # (order, line) repeats in this data: the ship day breaks ties
                     ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000
                      + F.datediff(F.col("l_shipdate"), F.lit("1970-01-01").cast("date"))).alias("ingest_seq"))


_O3_SQL = f"""WITH e AS (SELECT l_orderkey AS message_id,
    CASE WHEN l_linenumber % 2 = 1 THEN 'sent' ELSE 'replied' END AS kind, l_shipdate AS ts,
    (l_orderkey * 10 + l_linenumber) * 100000 + date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS seq
    FROM lineitem),
a AS (SELECT message_id, arg_max(kind, seq) AS st,
        arg_max(ts, seq) FILTER (WHERE kind = 'sent') AS sent, arg_max(ts, seq) FILTER (WHERE kind = 'replied') AS rep
      FROM e GROUP BY message_id),
m AS ({inputs.MESSAGES_SQL}),
o AS (SELECT m.id, m.linkedin_profile, m.stage_no, m.channel, m.rendered_md, m.scheduled_at,
        coalesce(a.st, m.status) AS status, coalesce(a.sent, m.sent_at) AS sent_at,
        coalesce(a.rep, m.replied_at) AS replied_at FROM m LEFT JOIN a ON a.message_id = m.id)"""


@register("o3_apply_status_events", f"""{_O3_SQL}
SELECT id, status, strftime(sent_at, {SQL_TS}) AS sent_at, strftime(replied_at, {SQL_TS}) AS replied_at FROM o""")
def o3_apply_status_events(spark, sf):
    m = outreach.apply_status_events(inputs.messages(spark, sf), status_events(spark, sf))
    return m.select("id", "status", _fmt("sent_at"), _fmt("replied_at"))


DUE_NOW = "1995-06-17 00:00:00"


@register("o4_due_messages", f"""{_O3_SQL}
SELECT id, strftime(scheduled_at, {SQL_TS}) AS scheduled_at FROM o
WHERE status = 'scheduled' AND scheduled_at <= TIMESTAMP '{DUE_NOW}'""")
def o4_due_messages(spark, sf):
    """O4 after the status events: still scheduled and due at DUE_NOW."""
    m = outreach.apply_status_events(inputs.messages(spark, sf), status_events(spark, sf))
    return outreach.due_messages(m, DUE_NOW).select("id", _fmt("scheduled_at"))


# ====================================================================== R
PERSON_URL = "https://www.linkedin.com/in/User-7/"


@register("r1_report_person", f"""WITH {_R2_PARTS}, ppl AS ({K1_AGG})
SELECT p.first_name, p.last_name, p.linkedin_profile, p.title_current, p.email, p.location_text,
  p.connections_linkedin, p.followers_linkedin,
  CASE WHEN l.dom IS NOT NULL THEN c.name ELSE l.cname END AS company_name, l.dom AS domain,
  CAST(NULL AS VARCHAR) AS website, CAST(NULL AS BIGINT) AS size_employees, CAST(NULL AS VARCHAR) AS legal_form,
  CAST(NULL AS VARCHAR[]) AS industries, CAST(NULL AS VARCHAR[]) AS locations_de,
  CAST(NULL AS INTEGER) AS multinational, CAST(NULL AS VARCHAR) AS last_enriched
FROM ppl p LEFT JOIN lastc l ON l.linkedin_profile = p.linkedin_profile LEFT JOIN comp c ON c.domain = l.dom
WHERE p.linkedin_profile = 'https://linkedin.com/in/user-7'""")
def r1_report_person(spark, sf):
    """The whole report but its two hash-derived ids."""
    people, companies, _ = _ingest(spark, sf)
    view = reports.people_with_company(people, companies)
    return reports.report_person(view, PERSON_URL).drop("person_id", "company_id")


@register("r3_report_queries", f"""SELECT source, entity_type, query_text,
  strftime(TIMESTAMP '{NOW}', {SQL_TS}) AS last_executed_at FROM ({_K7_SQL})""")
def r3_report_queries(spark, sf):
    dim = upsert.upsert_queries(None, order_queries(spark, sf), NOW)
    return reports.report_queries(dim).select("source", "entity_type", "query_text", _fmt("last_executed_at"))


_NQ = "lower(trim(regexp_replace(source_query, '\\s+', ' ', 'g')))"
_BOTH = "linkedin_profile IS NOT NULL AND nullif(source_name, '') IS NOT NULL AND nullif(source_query, '') IS NOT NULL"


@register("r4_people_per_query", f"""WITH rec AS ({inputs.PERSON_RECORDS_SQL}),
dim AS (SELECT source_name AS source, {_NQ} AS nq, arg_min(source_query, ingest_seq) AS query_text
        FROM rec WHERE {_BOTH} GROUP BY ALL),
pq AS (SELECT linkedin_profile, arg_max(source_name, ingest_seq) AS s, arg_max({_NQ}, ingest_seq) AS nq
       FROM rec WHERE {_BOTH} GROUP BY linkedin_profile),
cnt AS (SELECT s, nq, count(*) AS c FROM pq GROUP BY ALL)
SELECT d.source, d.query_text, coalesce(cnt.c, 0) AS people_count
FROM dim d LEFT JOIN cnt ON cnt.s = d.source AND cnt.nq = d.nq""")
def r4_people_per_query(spark, sf):
    people, _, queries = _ingest(spark, sf)
    return reports.people_per_query(queries, people).select("source", "query_text", "people_count")


def call_log_lines(spark, sf, part=None):
    """Call-log lines from events (``part``: a condition on them): providers (some null or empty), usage
    counts as int, text, float, junk or missing; malformed and non-object
    lines mixed in."""
    e = inputs.table(spark, sf, "events")
    e = e if part is None else e.filter(part)
    eid = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    prov = (F.when(eid % 10 == 0, F.lit("null")).when(eid % 10 == 1, F.lit('""'))
            .otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))))
    usage = (F.when(eid % 7 == 0, F.lit("null"))
             .when(eid % 7 == 1, F.concat(F.lit('{"total_tokens": "'), k, F.lit('"}')))
             .when(eid % 7 == 2, F.concat(F.lit('{"total_tokens": '), k, F.lit('.7}')))
             .when(eid % 7 == 3, F.lit('{"total_tokens": "n/a"}'))
             .when(eid % 7 == 4, F.lit("{}"))
             .otherwise(F.concat(F.lit('{"total_tokens": '), k, F.lit("}"))))
    line = (F.when(eid % 97 == 0, F.lit("not json {")).when(eid % 89 == 0, F.lit("[1, 2]"))
            .otherwise(F.concat(F.lit('{"ts": "'), F.date_format("ts", TS), F.lit('", "caller": "events", "provider": '),
                                prov, F.lit(', "run_id": "run-'), (F.col("user_id") % 3).cast("string"),
                                F.lit('", "usage": '), usage, F.lit("}"))))
    return e.select(line.alias("value"))


def written_call_log(spark, sf, part=None):
    path = scratch_dir(spark, "calllog")
    call_log_lines(spark, sf, part).write.text(path)
    return readers.read_call_log(spark, path)


LOG_SQL = """SELECT CASE WHEN event_id % 10 IN (0, 1) THEN NULL ELSE event_type END AS provider,
  'run-' || (user_id % 3) AS run_id,
  CAST(CASE event_id % 7 WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 0
       ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS BIGINT) AS tokens
FROM events WHERE event_id % 97 <> 0 AND event_id % 89 <> 0"""


@register("s4_read_call_log", LOG_SQL)
def s4_read_call_log(spark, sf):
    """The call log written as JSON lines, read back (bad lines dropped)."""
    return written_call_log(spark, sf).select("provider", "run_id", "tokens")


@register("r5_usage_by_provider", f"""SELECT coalesce(provider, 'unknown') AS provider, count(*) AS calls,
  CAST(sum(tokens) AS BIGINT) AS tokens FROM ({LOG_SQL}) WHERE run_id = 'run-1' GROUP BY ALL""")
def r5_usage_by_provider(spark, sf):
    """R5 for run 'run-1'."""
    return reports.usage_by_provider(written_call_log(spark, sf), run_id="run-1")


def _r6_sql():
    from leadframe.plans import sqlrules as R
    from leadframe.plans.q_text import _CANON_SQL, _CUSTN, _TITLE_SQL, _X4_SQL
    name = f"""coalesce(CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Anna' || c_custkey || ' Kunde' END,
      CASE WHEN length(n4) > 2 AND length(n4) < 200 THEN n4 END)"""
    return f"""WITH it AS (SELECT c_custkey AS k, {_CANON_SQL} AS url, {name} AS nm
      FROM (SELECT *, {_X4_SQL.format(t=_TITLE_SQL)} AS n4 {_CUSTN})),
s AS (SELECT url, min(k) AS k, count(*) AS n FROM it WHERE url IS NOT NULL GROUP BY url),
j AS (SELECT s.n, it.nm FROM s JOIN it ON it.k = s.k)
SELECT 'site:linkedin.com/in customers' AS search_query,
  count(*) FILTER (WHERE nm IS NOT NULL) AS successful_extractions,
  count(*) FILTER (WHERE nm IS NULL) + (SELECT count(*) FROM it WHERE url IS NULL) AS failed_extractions,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_profiles_removed,
  count(*) FILTER (WHERE nm IS NOT NULL) AS total_profiles,
  count(*) FILTER (WHERE nm IS NOT NULL AND {R.v3('nm')}) AS valid_profiles,
  count(*) FILTER (WHERE nm IS NOT NULL AND NOT {R.v3('nm')}) AS invalid_profiles
FROM j"""


@register("r6_run_summary", _r6_sql())
def r6_run_summary(spark, sf):
    """True counts of one run: extraction (X21) and validation (V6)."""
    from leadframe.plans.q_text import extracted
    profiles, metrics = extracted(spark, sf)
    checked = profiles.withColumn("errors", validate.profile_errors(profiles))
    totals, _ = validate.validation_metrics(checked)
    return reports.run_summary("site:linkedin.com/in customers", metrics, totals)


# ====================================================================== S
_JSON_FIELDS = ["name", "profile_url", "summary", "current_position", "company", "location", "follower_count",
                "connection_count", "company_domain", "email", "phone", "source_name", "source_query"]


def write_people_json(rows, g, as_object, path):
    """Profiles as JSON files, one per value of ``g`` (a fixed-width text): a bare array, or an
    object holding ``profiles``. Each file is streamed by its task, element by element."""
    p = rows.select(g.alias("g"), as_object.alias("o"), F.col("ingest_seq").alias("at"), F.to_json(F.struct(*_JSON_FIELDS)).alias("t"))
    first = p.groupBy("g", "o").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    lines = p.join(first, ["g", "o"]).select("g", "at", F.when(F.col("at") == F.col("first"), F.col("t"))
                                             .otherwise(F.concat(F.lit(","), F.col("t"))).alias("value"))
    heads = first.select("g", (F.col("first") - 1).alias("at"), F.when(F.col("o"), '{"profiles": [').otherwise("[").alias("value"))
    feet = first.select("g", (F.col("last") + 1).alias("at"), F.when(F.col("o"), "]}").otherwise("]").alias("value"))
    (lines.unionByName(heads).unionByName(feet).repartition("g").sortWithinPartitions("g", "at").drop("at")
     .write.partitionBy("g").text(path))


_JSON_FILE_ROWS = 20000


@register("s1_read_people_json", f"""SELECT {", ".join(_JSON_FIELDS)} FROM ({inputs.RAW_PROFILES_SQL})""")
def s1_read_people_json(spark, sf):
    """Raw profiles written as JSON documents of both shapes (an object
    holding ``profiles``, or a bare array), as many files as their bytes ask for, read back."""
    from leadframe.session import plan_bytes
    raw = inputs.raw_profiles(spark, sf)
    n = max(64, plan_bytes(spark.read.parquet(f"{sf}/events.parquet")) // (1 << 20))
    g = F.col("ingest_seq") % n
    path = scratch_dir(spark, "people-json")
    write_people_json(raw, F.lpad(g.cast("string"), 12, "0"), g % 2 == 0, path)
    return readers.read_people_json(spark, path).select(*_JSON_FIELDS)


@register("s1_split_people_json", f"""SELECT {", ".join(_JSON_FIELDS)}, ingest_seq // {_JSON_FILE_ROWS} AS file_no,
    row_number() OVER (PARTITION BY ingest_seq // {_JSON_FILE_ROWS} ORDER BY ingest_seq) - 1 AS pos FROM ({inputs.RAW_PROFILES_SQL})""")
def s1_split_people_json(spark, sf):
    """S1 on large files: the same profiles, {_JSON_FILE_ROWS} to a file, each file read by
    several tasks; with every profile's file and place."""
    raw = inputs.raw_profiles(spark, sf)
    g = F.floor(F.col("ingest_seq") / _JSON_FILE_ROWS)
    path = scratch_dir(spark, "people-json")
    write_people_json(raw, F.lpad(g.cast("string"), 12, "0"), g % 2 == 0, path)
    people = readers.read_people_json(spark, path, whole_bytes=1 << 16)
    return people.select(*_JSON_FIELDS, F.shiftright("ingest_seq", 32).alias("file_no"),
                         (F.col("ingest_seq") % (1 << 32)).alias("pos"))


def landed_pages(spark, sf):
    """Result pages from customers: a query per 97 customers, ten pages each
    of at most ten items (some shorter), pages missing for some queries, few
    total results for others, and an older empty landing of some first pages."""
    from leadframe.plans.q_text import search_items
    it = search_items(spark, sf).filter((F.col("ingest_seq") % 7 != 0) & (F.col("ingest_seq") % 10 != 3))
    q, k = (F.col("ingest_seq") / 97).cast("long"), F.col("ingest_seq") % 97
    pages = (it.withColumn("q", q).withColumn("page_no", (k / 10).cast("int"))
             .groupBy("q", "page_no")
             .agg(F.array_sort(F.collect_list(F.struct("ingest_seq", "google_result")),      # at most 10 rows
                               lambda a, b: F.when(a["ingest_seq"] < b["ingest_seq"], -1)
                               .when(a["ingest_seq"] > b["ingest_seq"], 1).otherwise(0)).alias("items"))
             .filter(~((F.col("q") % 6 == 1) & (F.col("page_no") == 2))))
    total = F.when(F.col("q") % 5 == 3, 15).otherwise(1000).cast("long")
    pages = pages.select(
        F.concat(F.lit("query-"), F.col("q").cast("string")).alias("query"),
        (F.col("page_no") * 10 + 1).cast("int").alias("start"), total.alias("total_results"),
        F.transform("items", lambda x: x["google_result"]).alias("items"),
        (F.col("q") * 100 + F.col("page_no") + 20).cast("long").alias("landed_seq"))
    older = pages.filter((F.col("start") == 1) & (F.col("landed_seq") % 400 == 20)).select(
        "query", "start", F.lit(0).cast("long").alias("total_results"), F.slice("items", 1, 0).alias("items"),
        (F.col("landed_seq") - 10).alias("landed_seq"))
    return pages.unionByName(older)


def _s2_sql():
    from leadframe.plans.q_text import _LINK_SQL
    return f"""WITH it AS (SELECT c_custkey AS k, c_custkey // 97 AS q, CAST((c_custkey % 97) // 10 AS INTEGER) AS page_no,
    {_LINK_SQL} AS link FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 10 <> 3),
pg AS (SELECT q, page_no, page_no * 10 + 1 AS start, CASE WHEN q % 5 = 3 THEN 15 ELSE 1000 END AS total, count(*) AS n
       FROM it WHERE NOT (q % 6 = 1 AND page_no = 2) GROUP BY ALL),
pg2 AS (SELECT *, (page_no = row_number() OVER w - 1) AND n > 0
           AND NOT coalesce(lag(start + 10 > total) OVER w, false) AS ok,
         coalesce(sum(n) OVER (PARTITION BY q ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS before,
         min(q * 100 + page_no + CASE WHEN page_no = 0 AND q % 4 = 0 THEN 10 ELSE 20 END) OVER (PARTITION BY q) AS qs
        FROM pg WINDOW w AS (PARTITION BY q ORDER BY page_no)),
pg3 AS (SELECT *, min(CAST(ok AS INTEGER)) OVER (PARTITION BY q ORDER BY page_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_ok FROM pg2),
items AS (SELECT q, page_no, link, row_number() OVER (PARTITION BY q, page_no ORDER BY k) - 1 AS i FROM it)
SELECT 'query-' || p.q AS query, CAST(p.start + i AS INTEGER) AS position, CAST(p.page_no + 1 AS INTEGER) AS page,
  CAST(p.before + i AS BIGINT) AS item_index, CAST(qs * 1048576 + p.before + i AS BIGINT) AS ingest_seq, items.link
FROM pg3 p JOIN items USING (q, page_no) WHERE p.run_ok = 1 AND p.before + i < 40"""


@register("s2_flatten_search_pages", _s2_sql())
def s2_flatten_search_pages(spark, sf):
    """Short pages, gaps and repeated landings; 40 results at most per query."""
    items = readers.flatten_search_pages(landed_pages(spark, sf), max_results=40)
    return items.select(F.col("search_metadata.query_used").alias("query"), "search_metadata.position",
                        "search_metadata.page", "item_index", "ingest_seq", F.col("google_result.link").alias("link"))


@register("s3_build_search_queries", """SELECT n_nationkey,
  'site:linkedin.com/in "' || n_name || '" "' || r_name || '"' AS query
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def s3_build_search_queries(spark, sf):
    n = inputs.table(spark, sf, "nation")
    r = inputs.table(spark, sf, "region")
    t = n.join(r, n["n_regionkey"] == r["r_regionkey"], "left").select(
        "n_nationkey", F.array("n_name", "r_name").alias("terms"))
    return readers.build_search_queries(t).select("n_nationkey", "query")


@register("s5_union_sources", f"""SELECT 'events' AS source_name, 'all events' AS source_query, profile_url
FROM ({inputs.RAW_PROFILES_SQL}) UNION ALL
SELECT 'customers', 'all customers', profile_url FROM ({inputs.CUSTOMER_PROFILES_SQL})""")
def s5_union_sources(spark, sf):
    a = inputs.raw_profiles(spark, sf).drop("source_name", "source_query")
    b = inputs.customer_profiles(spark, sf)
    u = readers.union_sources([(a, "events", "all events"), (b, "customers", "all customers")])
    return u.select("source_name", "source_query", "profile_url")


@register("s6_read_landed_companies", f"""SELECT Company, Company_Website, Company_Domain, address
FROM ({SUPPLIER_COMPANIES_SQL})""")
def s6_read_landed_companies(spark, sf):
    """Company rows landed as JSON lines, read back with the fixed schema."""
    path = scratch_dir(spark, "companies-json")
    supplier_companies(spark, sf).select("Company", "Company_Website", "Company_Domain", "address") \
        .write.json(path)
    return readers.read_landed_companies(spark, path).select("Company", "Company_Website", "Company_Domain",
                                                             "address")


@register("s7_align_schema", f"""SELECT name, profile_url, CAST(NULL AS VARCHAR) AS company_website,
  CAST(NULL AS VARCHAR) AS company_domain, 'unknown' AS source_name FROM ({inputs.CUSTOMER_PROFILES_SQL})""")
def s7_align_schema(spark, sf):
    """Customer profiles given every raw-profile column (missing -> NULL
    or default); applying it twice changes nothing."""
    from pyspark.sql import types as T
    target = T.StructType(list(schemas.RAW_PROFILE.fields) + [T.StructField("source_name", T.StringType())])
    a = readers.align_schema(inputs.customer_profiles(spark, sf), target, {"source_name": "unknown"})
    a = readers.align_schema(a, target, {"source_name": "unknown"})
    return a.select("name", "profile_url", "company_website", "company_domain", "source_name")


# JSON text by the customer's number: texts, mixed values, none, blank, null, broken, an object, nested
_LEGACY_JSON = ["""'["a ' || c_custkey || '", "ü\\"x"]'""", """'[1, "two", null, true, 2.5]'""", "NULL", "'  '", "'null'", "'[\"open'",
                "'{\"a\": 1}'", "'[{\"k\":\"v\"},[]]'", "'[]'"]
_LEGACY_ARRAY = ["['a ' || c_custkey, 'ü\"x']", "['1', 'two', 'true', '2.5']", "NULL", "NULL", "NULL", "NULL", "NULL",
                 "['{\"k\":\"v\"}', '[]']", "[]"]


def _by_customer(values, shift=0):
    return f"CASE (c_custkey + {shift}) % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _legacy_companies(spark, sf):
    """Companies of customers as an old table had them: lists as JSON text."""
    def text(shift):        # the oracle's string literals double no backslash
        return F.expr(_by_customer(_LEGACY_JSON, shift).replace("\\", "\\\\"))
    return inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), text(0).alias("industries_json"),
        text(4).alias("products_json"))


@register("s7_migrate_json_text", f"""SELECT c_custkey::BIGINT AS id, c_name AS name, {_by_customer(_LEGACY_ARRAY)}::VARCHAR[] AS industries,
  {_by_customer(_LEGACY_ARRAY, 4)}::VARCHAR[] AS products FROM customer""")
def s7_migrate_json_text(spark, sf):
    """An old companies table's JSON text becomes arrays."""
    return readers.migrate_json_text(_legacy_companies(spark, sf))[0].select("id", "name", "industries", "products")


@register("s7_migration_rejects", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT c_custkey::BIGINT AS id, '{c}' AS "column", {_by_customer(_LEGACY_JSON, shift)} AS "value",
    CASE (c_custkey + {shift}) % {len(_LEGACY_JSON)} WHEN 5 THEN 'not JSON' WHEN 6 THEN 'not an array' END AS reason FROM customer"""
    for c, shift in (("industries_json", 0), ("products_json", 4))) + ") WHERE reason IS NOT NULL")
def s7_migration_rejects(spark, sf):
    """The values that could not be migrated, with the reason."""
    return readers.migrate_json_text(_legacy_companies(spark, sf))[1]


_PEOPLE_OUT = ["linkedin_profile", "first_name", "last_name", "title_current", "email", "location_text",
               "connections_linkedin", "followers_linkedin", "website_info", "phone_info", "info_raw",
               "insights_text", "lookup_date", "is_hot", "source_name", "source_query", "created_seq"]


@register("s8_snapshot_upsert", f"WITH rec AS ({inputs.PERSON_RECORDS_SQL}) {K1_AGG}")
def s8_snapshot_upsert(spark, sf):
    """People upserted in two batches (first half of January, then the
    rest) through versioned snapshots; the result equals one upsert of all."""
    store = SnapshotStore(spark, scratch_dir(spark, "snapshots"))
    from leadframe.plans.catalog import records_of
    for i, events in enumerate(inputs.halves(spark, sf, "2024-01-16")):
        batch = materialize(records_of(inputs.profiles_of(events)), "half")     # read twice
        touched = store.touched("people", batch.filter(F.col("linkedin_profile").isNotNull()))
        people = upsert.upsert_people(store.read("people", buckets=touched), batch, NOW, batch_no=store.next_batch())
        store.commit({"people": (people, touched)}, f"half-{i}")
    return store.read("people").select(*_PEOPLE_OUT)


_VIEW_TEXT = ["first_name", "last_name", "linkedin_profile", "title_current", "email", "location_text",
              "connections_linkedin", "followers_linkedin", "website_info", "phone_info", "info_raw", "insights_text",
              "lookup_date", "is_hot"]
_VIEW_NULL = {"status": "VARCHAR", "notes": "VARCHAR", "last_interaction_date": "VARCHAR", "website": "VARCHAR",
              "size_employees": "BIGINT", "legal_form": "VARCHAR", "industries": "VARCHAR[]", "locations_de": "VARCHAR[]",
              "multinational": "INTEGER", "last_enriched_at": "TIMESTAMP"}


@register("s9_people_with_company", f"""WITH {_R2_PARTS}, ppl AS ({K1_AGG})
SELECT {", ".join("p." + c for c in _VIEW_TEXT)},
  CASE WHEN l.dom IS NOT NULL THEN c.name ELSE l.cname END AS company_name, l.dom AS domain,
  {", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in _VIEW_NULL.items())}
FROM ppl p LEFT JOIN lastc l ON l.linkedin_profile = p.linkedin_profile LEFT JOIN comp c ON c.domain = l.dom""")
def s9_people_with_company(spark, sf):
    """The whole view but its two hash-derived ids."""
    people, companies, _ = _ingest(spark, sf)
    return reports.people_with_company(people, companies).drop("person_id", "company_id")


def _s10_sql():
    return f"""SELECT search_query, 'customers' AS search_terms, successful_extractions AS total_results,
  '{NOW}' AS generated_at, '2.0' AS extraction_version, CAST(0 AS BIGINT) AS api_calls_used,
  successful_extractions, failed_extractions, duplicate_profiles_removed, total_profiles, valid_profiles,
  invalid_profiles FROM ({_r6_sql()})"""


@register("s10_export_run_document", _s10_sql())
def s10_export_run_document(spark, sf):
    """A run's metadata and profiles exported as JSON and the metadata
    read back."""
    from leadframe.plans.q_text import extracted
    profiles, metrics = extracted(spark, sf)
    checked = profiles.withColumn("errors", validate.profile_errors(profiles))
    totals, _ = validate.validation_metrics(checked)
    stats = metrics.withColumn("_one", F.lit(1)).join(totals.withColumn("_one", F.lit(1)), "_one").drop("_one")
    meta = export.run_metadata(profiles, stats, "site:linkedin.com/in customers", ["customers"], NOW)
    paths = export.export_run_document(profiles, meta, scratch_dir(spark, "export"))
    back = spark.read.json(paths["metadata"])
    return back.select("search_query", F.array_join("search_terms", ",").alias("search_terms"), "total_results",
                       "generated_at", "extraction_version", "api_calls_used", "successful_extractions",
                       "failed_extractions", "duplicate_profiles_removed", "total_profiles", "valid_profiles",
                       "invalid_profiles")


def _s10_profiles_sql():
    from leadframe.plans.q_text import _SURV_SQL
    return f"""{_SURV_SQL} SELECT it.k AS ingest_seq, s.url AS profile_url FROM s JOIN it ON it.k = s.k WHERE NOT it.nameless"""


@register("s10_exported_profiles", _s10_profiles_sql())
def s10_exported_profiles(spark, sf):
    """The exported profiles, read back from their JSON lines."""
    from leadframe.plans.q_text import extracted
    profiles, metrics = extracted(spark, sf)
    meta = export.run_metadata(profiles, metrics, "site:linkedin.com/in customers", ["customers"], NOW)
    paths = export.export_run_document(profiles, meta, scratch_dir(spark, "export"))
    return spark.read.schema("ingest_seq long, profile_url string").json(paths["profiles"])
