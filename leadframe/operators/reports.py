"""Reports (S9, R1-R6). Filters sit on the people side, so they reach the
Parquet scan; top-n reports end in ``orderBy().limit()`` (TakeOrderedAndProject:
each task keeps n rows, no global sort)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.urls import profile_key

VIEW_COLUMNS = ["person_id", "first_name", "last_name", "linkedin_profile", "title_current", "email",
                "location_text", "connections_linkedin", "followers_linkedin", "website_info",
                "phone_info", "info_raw", "insights_text", "lookup_date", "is_hot", "status", "notes",
                "last_interaction_date", "company_id", "company_name", "domain", "website",
                "size_employees", "legal_form", "industries", "locations_de", "multinational",
                "last_enriched_at"]


def people_with_company(people: DataFrame, companies: DataFrame) -> DataFrame:
    """The 28-column people ⟕ companies view."""
    p, c = people.alias("p"), companies.alias("c")
    j = p.join(c, F.col("p.company_id") == F.col("c.id"), "left")
    return j.select(
        F.col("p.id").alias("person_id"), "p.first_name", "p.last_name", "p.linkedin_profile",
        "p.title_current", "p.email", "p.location_text", "p.connections_linkedin",
        "p.followers_linkedin", "p.website_info", "p.phone_info", "p.info_raw", "p.insights_text",
        "p.lookup_date", "p.is_hot", "p.status", "p.notes", "p.last_interaction_date",
        F.col("c.id").alias("company_id"), F.col("c.name").alias("company_name"),
        F.col("c.domain").alias("domain"), F.col("c.website").alias("website"), "c.size_employees",
        "c.legal_form", "c.industries", "c.locations_de", "c.multinational", "c.last_enriched_at")


def report_person(view: DataFrame, profile_url: str, tz: str = "UTC") -> DataFrame:
    """One person by URL (N7-normalised first) with company context;
    ``last_enriched`` shown as ``yyyy-MM-dd HH:mm`` in zone ``tz``. The key is
    a literal in the plan, so the filter reaches the scan of the people."""
    key = view.sparkSession.range(1).select(profile_key(F.lit(profile_url))).first()[0]     # one value
    return (view.filter(F.col("linkedin_profile") == F.lit(key).cast("string"))
            .select("person_id", "first_name", "last_name", "linkedin_profile", "title_current", "email",
                    "location_text", "connections_linkedin", "followers_linkedin", "company_id",
                    "company_name", "domain", "website", "size_employees", "legal_form", "industries",
                    "locations_de", "multinational",
                    F.date_format(F.from_utc_timestamp("last_enriched_at", tz),
                                  fixed.REPORT_TS_FORMAT).alias("last_enriched")))


TOP_BROADCAST = 10_000      # rows of a top list that are broadcast


def report_recent(people: DataFrame, companies: DataFrame, sort_by: str = "recent",
                  min_connections: int | None = None, min_followers: int | None = None,
                  limit: int | None = 5, stored: bool = False) -> DataFrame:
    """R2: people with company context; optional ``>=`` filters; newest
    first, or by connections / followers (DESC NULLS LAST, then newest).
    ``limit=None`` returns the whole ordered list.

    ``stored``: ``people`` is a table of files, not a computation. Then the
    top rows come from a scan of the key and sort columns alone, and the wide
    columns and the companies are looked up for those ``limit`` rows (ids are
    unique, so the left join can't change which rows win)."""
    if stored and limit is not None:
        top = report_recent(people.select("id", "connections_linkedin", "followers_linkedin", "company_id", "created_seq",
                                          "created_batch"), None, sort_by, min_connections, min_followers, limit)
        few = limit <= TOP_BROADCAST
        top = F.broadcast(top) if few else top        # at most ``limit`` narrow rows
        wide = people.join(top.select("id"), "id", "left_semi")
        return report_recent(F.broadcast(wide) if few else wide, companies, sort_by, limit=limit)
    p = people
    if min_connections is not None:
        p = p.filter(F.col("connections_linkedin") >= min_connections)
    if min_followers is not None:
        p = p.filter(F.col("followers_linkedin") >= min_followers)
    key = "id" if companies is None else "person_id"
    recent = [F.col("created_batch").desc(), F.col("created_seq").desc(), F.col(key).desc()]
    order = {"recent": recent,
             "connections": [F.col("connections_linkedin").desc_nulls_last()] + recent,
             "followers": [F.col("followers_linkedin").desc_nulls_last()] + recent}[sort_by]
    if companies is None:
        return p.orderBy(*order).limit(limit)
    c = companies.select(F.col("id").alias("c_id"), F.col("name").alias("company_name"), "domain")
    j = p.join(c, p["company_id"] == c["c_id"], "left")
    out = j.select(F.col("id").alias("person_id"), "first_name", "last_name", "linkedin_profile",
                   "title_current", "connections_linkedin", "followers_linkedin",
                   F.col("c_id").alias("company_id"), "company_name", "domain", "created_seq", "created_batch")
    out = out.orderBy(*order)
    return (out.limit(limit) if limit is not None else out).drop("created_seq", "created_batch")


def report_queries(dim: DataFrame) -> DataFrame:
    """Queries, last executed first (NULLs last), then newest."""
    return dim.select("id", "source", "entity_type", "query_text", "last_executed_at", "created_at") \
        .orderBy(F.col("last_executed_at").desc_nulls_last(), F.col("created_at").desc()) \
        .drop("created_at")


def query_counts(people: DataFrame) -> DataFrame:
    """R4's partial: people per query id (combined map-side), for any part of the people."""
    return people.filter(F.col("search_query_id").isNotNull()) \
        .groupBy("search_query_id").agg(F.count(F.lit(1)).alias("people_count"))


def merge_query_counts(*parts: DataFrame) -> DataFrame:
    """Sum of partials of R4; a part of rows that left counts negative. Ids without people have no row."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("search_query_id").agg(F.sum("people_count").alias("people_count")).filter("people_count <> 0")


def people_per_query(dim: DataFrame, people: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Person queries with their people count (0 kept), largest first.
    People are counted per query id first (partial aggregation), then the
    small per-query result is joined to the dimension. ``counts``: the stored
    counts (``runs.refresh_query_counts``) in place of the people."""
    counts = query_counts(people) if counts is None else counts
    q = dim.filter(F.col("entity_type") == "person")
    return (q.join(counts, q["id"] == counts["search_query_id"], "left")
            .select("id", "source", "query_text",
                    F.coalesce("people_count", F.lit(0)).cast("long").alias("people_count"))
            .orderBy(F.col("people_count").desc(), F.col("id")))


def usage_totals(log: DataFrame) -> DataFrame:
    """R5's partial: calls and tokens per run, caller and provider of a part of the log."""
    return (log.groupBy("run_id", "caller", F.coalesce("provider", F.lit(fixed.DEFAULT_PROVIDER)).alias("provider"))
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").cast("long").alias("tokens")))


def merge_usage(totals: DataFrame, *keys: str) -> DataFrame:
    """Sum of partials of R5 by ``keys`` (none: run, caller and provider)."""
    return totals.groupBy(*(keys or ("run_id", "caller", "provider"))).agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))


def usage_by_provider(log: DataFrame, run_id: str | None = None, caller: str | None = None,
                      stored: bool = False) -> DataFrame:
    """Calls and tokens per provider for one run (all runs when
    ``run_id`` is None); falsy provider -> 'unknown'; a line whose tokens are
    not a number still counts as a call. ``stored``: ``log`` is the stored
    totals (``runs.add_call_log``) in place of the lines."""
    lg = log
    if run_id is not None:
        lg = lg.filter(F.col("run_id") == run_id)
    if caller is not None:
        lg = lg.filter(F.col("caller") == caller)
    if stored:
        return merge_usage(lg, "provider")
    return (lg.groupBy(F.coalesce("provider", F.lit(fixed.DEFAULT_PROVIDER)).alias("provider"))
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").cast("long").alias("tokens")))


def run_summary(query: str, extraction_metrics: DataFrame, validation_totals: DataFrame) -> DataFrame:
    """One row: query, total, successful / failed / duplicate, valid /
    invalid — the true counts of this run."""
    def one(d):
        return d.withColumn("_one", F.lit(1))
    return (one(extraction_metrics).join(one(validation_totals), "_one").drop("_one")
            .select(F.lit(query).alias("search_query"), "*"))
