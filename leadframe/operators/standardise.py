"""Standardisation jobs (N1-N9): map profiles to the person shape and turn
raw or mapped profiles into standardised person records for K13."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe import schemas
from leadframe.functions.names import degree_prefix, split_name, strip_degree, title_with_degree
from leadframe.functions.numbers import parse_connections, parse_int_shorthand
from leadframe.functions.text import first_truthy, nonempty, strip
from leadframe.functions.urls import with_profile_key
from leadframe.sources.readers import align_schema


def with_profile_columns(df: DataFrame) -> DataFrame:
    """Add any raw or mapped profile column that is missing, as NULL."""
    target = T.StructType(list(schemas.RAW_PROFILE.fields) + list(schemas.MAPPED_PROFILE.fields)
                          + [T.StructField("source_name", T.StringType()),
                             T.StructField("source_query", T.StringType()),
                             T.StructField("ingest_seq", T.LongType())])
    return align_schema(df, target, keep_extra=True)


def map_to_person_schema(profiles: DataFrame, lookup_date: str | None) -> DataFrame:
    """Raw profiles -> the mapped person shape (capitalised columns).

    '' / [] / NULL defaults as in the reference; ``Company_Website`` and
    ``Website_Info`` are always NULL; ``Hot`` false.
    """
    p = with_profile_columns(profiles)
    arr = T.ArrayType(T.StringType())
    return p.select(
        F.coalesce(nonempty("name"), F.lit("")).alias("mapped_contact_name"),
        nonempty("profile_url").alias("mapped_linkedin_profile"),
        nonempty("company").alias("mapped_company"),
        F.lit(None).cast("string").alias("mapped_company_website"),
        nonempty("company_domain").alias("mapped_company_domain"),
        nonempty("location").alias("mapped_location"),
        nonempty("current_position").alias("mapped_position"),
        parse_connections("connection_count").alias("mapped_connections_linkedin"),
        parse_int_shorthand("follower_count").alias("mapped_followers_linkedin"),
        F.lit(None).cast("string").alias("mapped_website_info"),
        F.coalesce(nonempty("phone"), F.lit("")).alias("mapped_phone_info"),
        F.coalesce(nonempty("summary"), F.lit("")).alias("mapped_info_raw"),
        F.coalesce(F.col("summary_other"), F.array().cast(arr)).alias("mapped_insights"),
        nonempty("email").alias("mapped_email"),
        F.lit(lookup_date or None).cast("string").alias("mapped_lookup_date"),
        F.lit(False).alias("mapped_hot"),
        F.lit(None).cast("string").alias("mapped_last_interaction_date"),
        F.lit(None).cast("string").alias("mapped_status"),
        F.array().cast(arr).alias("mapped_notes"),
        "source_name", "source_query", "ingest_seq",
    )


def _truthy_num(c: str):
    """Python truthiness for a number column: NULL and 0 are missing."""
    return F.when(F.col(c) != 0, F.col(c))


def standardise_people(profiles: DataFrame, normalize_key: bool = True) -> DataFrame:
    """Profiles (raw and/or mapped columns) -> person records
    (``schemas.PERSON_RECORD``).

    Mapped names win over raw ones per field; N7 key; degree prefix moved
    from the name into the title; name split; counts parsed; insights joined
    with '; '; company website Company_Website -> company_website ->
    Website_Info -> website. ``normalize_key=False`` keeps the URL as given
    (tables written before N7 existed, which K10 merges).
    """
    p = with_profile_columns(profiles)
    # staged projections: every intermediate is computed once per row
    p = p.withColumns({
        "_raw_name": strip(F.coalesce(first_truthy("mapped_contact_name", "name"), F.lit(""))),
        "_url": first_truthy("mapped_linkedin_profile", "profile_url"),
        "_title": first_truthy("mapped_position", "current_position"),
        "_conn": F.coalesce(_truthy_num("mapped_connections_linkedin").cast("string"), F.col("connection_count")),
        "_foll": F.coalesce(_truthy_num("mapped_followers_linkedin").cast("string"), F.col("follower_count"))})
    p = p.withColumns({"_deg": degree_prefix("_raw_name"), "_clean": strip_degree("_raw_name")})
    p = with_profile_key(p, "_url", "_key") if normalize_key else p.withColumn("_key", F.col("_url"))
    first, last = split_name("_clean")
    # Python: Insights or summary_other -- an empty list is falsy
    ins_list = F.when(F.size("mapped_insights") > 0, F.col("mapped_insights")).otherwise(
        F.col("summary_other"))
    insights = F.when(ins_list.isNotNull(),
                      F.array_join(F.filter(ins_list, lambda x: x.isNotNull() & (x != "")), "; "))
    return p.select(
        F.col("ingest_seq").cast("long").alias("ingest_seq"),
        F.col("_key").alias("linkedin_profile"),
        first.alias("first_name"), last.alias("last_name"),
        title_with_degree("_title", "_deg").alias("title_current"),
        first_truthy("mapped_email", "email").alias("email"),
        first_truthy("mapped_location", "location").alias("location_text"),
        parse_connections("_conn").alias("connections_linkedin"),
        parse_int_shorthand("_foll").alias("followers_linkedin"),
        first_truthy("mapped_website_info", "company_website", "website").alias("website_info"),
        first_truthy("mapped_phone_info", "phone").alias("phone_info"),
        first_truthy("mapped_info_raw", "summary").alias("info_raw"),
        insights.alias("insights_text"),
        F.col("mapped_lookup_date").alias("lookup_date"),
        nonempty("source_name").alias("source_name"),
        nonempty("source_query").alias("source_query"),
        first_truthy("mapped_company", "company").alias("company_name"),
        nonempty("mapped_company_domain").alias("company_domain"),
        first_truthy("mapped_company_website", "company_website", "mapped_website_info", "website").alias("company_website"),
    )
