"""Registered queries: one per inventory line (``<id>_<short name>``), each
``(spark, sf_dir) -> DataFrame`` over the whole given tables, with the DuckDB
oracle SQL for the same result where SQL can state it.

Hash-derived ids are left out of compared outputs (DuckDB has no xxhash64);
keys are compared instead, which identifies the same rows exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from leadframe.operators import reports, standardise, upsert
from leadframe.plans import inputs

from leadframe.plans.registry import BATCH, NOW, ORACLES, QUERIES, register  # noqa: F401


def person_records(spark, sf):
    """Raw profiles -> N1 mapping (run date) -> N2-N9 records, as an ingest run does."""
    return records_of(inputs.raw_profiles(spark, sf))


def records_of(profiles):
    """N1 and N2-N9 on raw profiles."""
    return standardise.standardise_people(standardise.map_to_person_schema(profiles, inputs.LOOKUP_DATE))


def ingest(spark, sf):
    """K13 over the whole events-derived batch: (people, companies, queries)."""
    people, companies, queries, _ = upsert.person_ingest(person_records(spark, sf), None, None, None,
                                                         NOW, BATCH)
    return people, companies, queries


PEOPLE_OUT = ["linkedin_profile", "first_name", "last_name", "title_current", "email", "location_text",
              "connections_linkedin", "followers_linkedin", "website_info", "phone_info", "info_raw",
              "insights_text", "lookup_date", "is_hot", "source_name", "source_query", "created_seq"]

from leadframe.plans.sqlparts import K1_AGG as _K1_AGG  # noqa: E402


# ------------------------------------------------------------------ K1
@register("k1_upsert_people", f"WITH rec AS ({inputs.PERSON_RECORDS_SQL}) {_K1_AGG}")
def k1_upsert_people(spark, sf):
    """K1: standardised records from events, upserted into an empty table."""
    return upsert.upsert_people(None, person_records(spark, sf), NOW).select(*PEOPLE_OUT)


# ------------------------------------------------------------------ K2/K3
_K2_SQL = f"""
WITH rec AS ({inputs.PERSON_RECORDS_SQL}),
b AS (SELECT * FROM rec WHERE linkedin_profile IS NOT NULL
      AND coalesce(nullif(company_domain, ''), nullif(company_name, '')) IS NOT NULL)
SELECT company_domain AS domain,
  arg_max_null(coalesce(nullif(company_name, ''), company_domain), ingest_seq) AS name,
  arg_max(company_website, ingest_seq) AS website,
  arg_max(nullif(source_name, ''), ingest_seq) AS source_name,
  arg_max(nullif(source_query, ''), ingest_seq) AS source_query,
  min(ingest_seq) AS created_seq
FROM b WHERE nullif(company_domain, '') IS NOT NULL GROUP BY company_domain
UNION ALL
SELECT CAST(NULL AS VARCHAR), company_name, CAST(NULL AS VARCHAR), nullif(source_name, ''),
  nullif(source_query, ''), ingest_seq
FROM b WHERE nullif(company_domain, '') IS NULL
"""


@register("k2_upsert_companies", _K2_SQL)
def k2_upsert_companies(spark, sf):
    """K2+K3: companies named by the same batch (domain rows merged, stubs appended)."""
    _, companies, _ = ingest(spark, sf)
    return companies.select("domain", "name", "website", "source_name", "source_query", "created_seq")


# ------------------------------------------------------------------ R2 (flagship)
_R2_SQL = f"""
WITH rec AS ({inputs.PERSON_RECORDS_SQL}),
ppl AS ({_K1_AGG}),
lastc AS (SELECT linkedin_profile, arg_max_null(company_domain, ingest_seq) AS dom,
                 arg_max_null(company_name, ingest_seq) AS cname
          FROM rec WHERE linkedin_profile IS NOT NULL
            AND (nullif(company_domain, '') IS NOT NULL OR nullif(company_name, '') IS NOT NULL)
          GROUP BY linkedin_profile),
comp AS (SELECT company_domain AS domain,
                arg_max_null(coalesce(nullif(company_name, ''), company_domain), ingest_seq) AS name
         FROM rec WHERE linkedin_profile IS NOT NULL AND nullif(company_domain, '') IS NOT NULL
         GROUP BY company_domain)
SELECT p.linkedin_profile, p.first_name, p.last_name, p.title_current, p.connections_linkedin,
  p.followers_linkedin, CASE WHEN l.dom IS NOT NULL THEN c.name ELSE l.cname END AS company_name,
  l.dom AS domain
FROM ppl p LEFT JOIN lastc l ON l.linkedin_profile = p.linkedin_profile
LEFT JOIN comp c ON c.domain = l.dom
ORDER BY p.followers_linkedin DESC NULLS LAST, p.created_seq DESC LIMIT 100
"""

R2_OUT = ["linkedin_profile", "first_name", "last_name", "title_current", "connections_linkedin",
          "followers_linkedin", "company_name", "domain"]


def report_recent_by_followers(spark, sf, limit=None):
    people, companies, _ = ingest(spark, sf)
    return reports.report_recent(people, companies, sort_by="followers", limit=limit).select(*R2_OUT)


@register("r2_report_recent", _R2_SQL)
def r2_report_recent(spark, sf):
    """R2 over the K13 result: the 100 people with most followers, with company."""
    return report_recent_by_followers(spark, sf, limit=100)


# the other query families register themselves on import
from leadframe.plans import q_people, q_companies, q_text, q_ops, q_batches  # noqa: E402,F401
