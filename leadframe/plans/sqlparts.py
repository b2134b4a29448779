"""SQL fragments shared by several oracle queries."""

from leadframe.plans.registry import NOW

# K1 over a CTE named ``rec`` of person records.
K1_AGG = """
SELECT linkedin_profile,
  arg_max(first_name, ingest_seq) AS first_name, arg_max(last_name, ingest_seq) AS last_name,
  arg_max(title_current, ingest_seq) AS title_current, arg_max(email, ingest_seq) AS email,
  arg_max(location_text, ingest_seq) AS location_text,
  arg_max(connections_linkedin, ingest_seq) AS connections_linkedin,
  arg_max(followers_linkedin, ingest_seq) AS followers_linkedin,
  arg_max(website_info, ingest_seq) AS website_info, arg_max(phone_info, ingest_seq) AS phone_info,
  arg_max(info_raw, ingest_seq) AS info_raw, arg_max(insights_text, ingest_seq) AS insights_text,
  coalesce(arg_max_null(lookup_date, ingest_seq), '{now}') AS lookup_date,
  CAST(0 AS INTEGER) AS is_hot,
  arg_max(source_name, ingest_seq) AS source_name, arg_max(source_query, ingest_seq) AS source_query,
  min(ingest_seq) AS created_seq
FROM rec WHERE linkedin_profile IS NOT NULL GROUP BY linkedin_profile
""".replace("{now}", NOW)
