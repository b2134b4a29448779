"""Table schemas (the persistent tables and the standardised person record)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, I, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
# outreach times are wall-clock times without a zone, like the input tables' dates
NTZ = T.TimestampNTZType()
ARR = T.ArrayType(T.StringType())


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Arrival order over all runs is (created_batch, created_seq): the number of the
# commit that first stored the row, and the row's place in that batch.

# Fields of a person that an upsert merges "new non-NULL over old".
PERSON_MERGE_FIELDS = [
    ("first_name", S), ("last_name", S), ("title_current", S), ("email", S),
    ("location_text", S), ("connections_linkedin", L), ("followers_linkedin", L),
    ("website_info", S), ("phone_info", S), ("info_raw", S), ("insights_text", S),
    ("source_name", S), ("source_query", S), ("search_query_id", L),
]

PEOPLE = _st(("id", L), ("linkedin_profile", S), *PERSON_MERGE_FIELDS[:11],
             ("lookup_date", S), ("is_hot", I), ("status", S), ("notes", S),
             ("last_interaction_date", S), *PERSON_MERGE_FIELDS[11:13],
             ("company_id", L), ("search_query_id", L), ("created_seq", L), ("created_batch", L))

COMPANIES = _st(("id", L), ("name", S), ("domain", S), ("website", S), ("legal_form", S),
                ("industries", ARR), ("locations_de", ARR), ("multinational", I),
                ("size_employees", L), ("business_model", ARR), ("products", ARR),
                ("recent_news", ARR), ("source_name", S), ("source_query", S),
                ("search_query_id", L), ("last_enriched_at", TS), ("created_seq", L), ("created_batch", L))

# K3 reuse_by_name: the stub that holds a name.
COMPANY_NAMES = _st(("name", S), ("id", L))

# Running totals of R4 and R5.
QUERY_PEOPLE = _st(("search_query_id", L), ("people_count", L))
USAGE = _st(("run_id", S), ("caller", S), ("provider", S), ("calls", L), ("tokens", L))

SEARCH_QUERIES = _st(("id", L), ("source", S), ("entity_type", S), ("query_text", S),
                     ("normalized_query", S), ("created_at", TS), ("last_executed_at", TS))

OUTREACH_TEMPLATES = _st(("id", L), ("name", S), ("channel", S), ("body_md", S),
                         ("variables_json", S), ("is_active", I), ("created_at", NTZ))

OUTREACH_MESSAGES = _st(("id", L), ("linkedin_profile", S), ("channel", S), ("template_id", L),
                        ("stage_no", I), ("rendered_md", S), ("status", S), ("scheduled_at", NTZ),
                        ("sent_at", NTZ), ("replied_at", NTZ), ("created_at", NTZ))

# A standardised person record (output of the N rules, input of K13).
PERSON_RECORD = _st(("ingest_seq", L), ("linkedin_profile", S), *PERSON_MERGE_FIELDS[:11],
                    ("lookup_date", S), ("source_name", S), ("source_query", S),
                    ("company_name", S), ("company_domain", S), ("company_website", S))

PERSON_RECORD_Q = T.StructType(list(PERSON_RECORD.fields) + [T.StructField("search_query_id", L, True)])

# Profile as extracted from search items (raw shape) — also the JSON input shape.
RAW_PROFILE = _st(("name", S), ("profile_url", S), ("summary", S), ("current_position", S),
                  ("company", S), ("location", S), ("follower_count", S),
                  ("connection_count", S), ("company_website", S), ("company_domain", S),
                  ("email", S), ("website", S), ("phone", S), ("experience_years", L),
                  ("summary_other", ARR))

# Mapped person shape: JSON keys as written (capitalised) and the column
# names we use for them ("mapped_" + lower key), because Spark resolves
# names case-insensitively and "Email" would collide with the raw "email".
MAPPED_KEYS = [("Contact_Name", S), ("LinkedIn_Profile", S), ("Company", S),
               ("Company_Website", S), ("Company_Domain", S), ("Location", S),
               ("Position", S), ("Connections_LinkedIn", L), ("Followers_LinkedIn", L),
               ("Website_Info", S), ("Phone_Info", S), ("Info_raw", S), ("Insights", ARR),
               ("Email", S), ("Lookup_Date", S), ("Hot", B), ("Last_Interaction_Date", S),
               ("Status", S), ("Notes", ARR)]


def mapped(key: str) -> str:
    return "mapped_" + key.lower()


MAPPED_PROFILE = _st(*[(mapped(k), t) for k, t in MAPPED_KEYS])

COMPANY_INPUT = _st(("Company", S), ("name", S), ("Company_Website", S), ("website", S),
                    ("Company_Domain", S), ("domain", S), ("address", S), ("phone", S),
                    ("place_id", S))


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
