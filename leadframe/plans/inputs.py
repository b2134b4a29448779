"""Contact-like inputs derived from the driver's tables.

No table of the test data holds search hits or contact records, so each
input is built from a real table with plain column expressions. Every
builder has a twin SQL text (``*_SQL``) that states the same table for the
DuckDB oracle; both read the whole table, so the work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from leadframe.session import spread
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def _s(c):
    return F.col(c).cast("string")


# ------------------------------------------------------------ raw profiles
# One raw profile per event: URL spelling varies by event_id % 4 (case,
# www./de. host, query string, locale segment), fields are missing on some
# events, counts arrive as shorthand text, some names carry a degree.
def raw_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles_of(table(spark, sf_dir, "events"))


def profiles_of(e: DataFrame) -> DataFrame:
    """The raw profile of each event."""
    eid, uid = F.col("event_id"), F.col("user_id")
    v = eid % 4
    url = (F.when(v == 0, F.concat(F.lit("https://www.linkedin.com/in/User-"), _s("user_id"), F.lit("/")))
           .when(v == 1, F.concat(F.lit("http://de.linkedin.com/in/user-"), _s("user_id"), F.lit("?trk="),
                                  _s("event_id")))
           .when(v == 2, F.concat(F.lit("https://linkedin.com/in/USER-"), _s("user_id"), F.lit("/en")))
           .otherwise(F.concat(F.lit("https://www.linkedin.com/in/user-"), _s("user_id"))))
    blank = (eid % 3) == 0
    base_name = F.concat(F.lit("First"), _s("user_id"), F.lit(" Last"), _s("user_id"))
    name = (F.when(blank, F.lit(None))
            .when(uid % 5 == 0, F.concat(F.lit("Dr. "), base_name))
            .otherwise(base_name))
    return e.select(
        eid.alias("ingest_seq"),
        name.alias("name"),
        url.alias("profile_url"),
        F.when(eid % 7 != 0, F.concat(F.lit("Summary of "), _s("user_id"), F.lit(" at "),
                                      F.col("event_type"))).alias("summary"),
        F.when(~blank, F.concat(F.initcap(F.col("event_type")), F.lit(" Lead "),
                                (eid % 7).cast("string"))).alias("current_position"),
        F.concat(F.lit("Company "), (uid % 37).cast("string")).alias("company"),
        F.when(eid % 2 == 0, F.concat(F.lit("City "), (uid % 11).cast("string"))).alias("location"),
        F.when(~blank, F.concat(F.floor(F.col("value")).cast("long").cast("string"), F.lit("."),
                                (eid % 10).cast("string"), F.lit("K"))).alias("follower_count"),
        F.when(eid % 5 != 0, F.concat((eid % 700).cast("string"), F.lit("+"))).alias("connection_count"),
        F.when(uid % 9 != 0, F.concat(F.lit("company"), (uid % 37).cast("string"), F.lit(".com")))
         .alias("company_domain"),
        F.when(eid % 6 == 1, F.concat(F.lit("user"), _s("user_id"), F.lit("@mail.example.com"))).alias("email"),
        F.when(eid % 8 == 3, F.concat(F.lit("+49 711 "), (1000000 + eid).cast("string"))).alias("phone"),
                F.concat(F.lit("events_"), F.col("event_type")).alias("source_name"),
        F.when(eid % 11 != 0, F.concat(F.lit("Query  "), (uid % 13).cast("string"))).alias("source_query"),
    )


RAW_PROFILES_SQL = """
SELECT event_id AS ingest_seq,
  CASE WHEN event_id % 3 = 0 THEN NULL
       WHEN user_id % 5 = 0 THEN 'Dr. First' || user_id || ' Last' || user_id
       ELSE 'First' || user_id || ' Last' || user_id END AS name,
  CASE event_id % 4 WHEN 0 THEN 'https://www.linkedin.com/in/User-' || user_id || '/'
       WHEN 1 THEN 'http://de.linkedin.com/in/user-' || user_id || '?trk=' || event_id
       WHEN 2 THEN 'https://linkedin.com/in/USER-' || user_id || '/en'
       ELSE 'https://www.linkedin.com/in/user-' || user_id END AS profile_url,
  CASE WHEN event_id % 7 <> 0 THEN 'Summary of ' || user_id || ' at ' || event_type END AS summary,
  CASE WHEN event_id % 3 <> 0 THEN upper(substr(event_type, 1, 1)) || substr(event_type, 2)
       || ' Lead ' || (event_id % 7) END AS current_position,
  'Company ' || (user_id % 37) AS company,
  CASE WHEN event_id % 2 = 0 THEN 'City ' || (user_id % 11) END AS location,
  CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.' || (event_id % 10) || 'K'
       END AS follower_count,
  CASE WHEN event_id % 5 <> 0 THEN (event_id % 700) || '+' END AS connection_count,
  CASE WHEN user_id % 9 <> 0 THEN 'company' || (user_id % 37) || '.com' END AS company_domain,
  CASE WHEN event_id % 6 = 1 THEN 'user' || user_id || '@mail.example.com' END AS email,
  CASE WHEN event_id % 8 = 3 THEN '+49 711 ' || (1000000 + event_id) END AS phone,
  'events_' || event_type AS source_name,
  CASE WHEN event_id % 11 <> 0 THEN 'Query  ' || (user_id % 13) END AS source_query
FROM events
"""

LOOKUP_DATE = "2024-02-01"


def halves(spark: SparkSession, sf_dir: str, at: str) -> tuple[DataFrame, DataFrame]:
    """The events before ``at`` and the others. An event meets the times of all events of its id, and
    goes with each (as the oracles join records with events): narrow rows, before any rule runs on them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    ts = table(spark, sf_dir, "events").select("event_id", "ts")
    early = F.col("ts") < F.lit(at).cast("timestamp_ntz")
    return tuple(e.join(ts.filter(x).select("event_id"), "event_id") for x in (early, ~early))

# The standardised records of RAW_PROFILES_SQL after N1 (mapping with the
# run's lookup date) and N2-N9, in SQL for these ASCII inputs: key, degree
# moved into the title, name split, counts parsed (a parsed 0 is falsy in the
# mapped-over-raw precedence, so it ends as NULL).
PERSON_RECORDS_SQL = f"""
WITH r AS ({RAW_PROFILES_SQL})
SELECT ingest_seq,
  {{KEY}} AS linkedin_profile,
  CASE WHEN name IS NULL THEN NULL WHEN name LIKE 'Dr. %' THEN split_part(substr(name, 5), ' ', 1)
       ELSE split_part(name, ' ', 1) END AS first_name,
  CASE WHEN name IS NULL THEN NULL ELSE split_part(name, ' ', -1) END AS last_name,
  CASE WHEN name LIKE 'Dr. %' THEN CASE WHEN current_position IS NOT NULL
         THEN current_position || ' (Dr.)' ELSE '(Dr.)' END
       ELSE current_position END AS title_current,
  email, location AS location_text,
  nullif(CASE WHEN connection_count IS NULL THEN NULL
       ELSE least(CAST(regexp_extract(connection_count, '^([0-9]+)', 1) AS BIGINT), 500) END, 0)
       AS connections_linkedin,
  nullif(CASE WHEN follower_count IS NULL THEN NULL
       ELSE CAST(round_even(CAST(rtrim(follower_count, 'K') AS DOUBLE) * 1000, 0) AS BIGINT) END, 0)
       AS followers_linkedin,
  CAST(NULL AS VARCHAR) AS website_info, phone AS phone_info, summary AS info_raw,
  CAST(NULL AS VARCHAR) AS insights_text, '{LOOKUP_DATE}' AS lookup_date, source_name, source_query,
  company AS company_name, company_domain, CAST(NULL AS VARCHAR) AS company_website
FROM r
"""
# records keyed by the N7 key, and by the URL as given (legacy tables)
RAW_KEY_RECORDS_SQL = PERSON_RECORDS_SQL.replace("{KEY}", "profile_url")
PERSON_RECORDS_SQL = PERSON_RECORDS_SQL.replace(
    "{KEY}", "'https://linkedin.com/in/' || lower(regexp_extract(profile_url, '/in/([^/?#]+)', 1))")


# ------------------------------------------------------- customer profiles
# Raw profiles from customer ⟕ nation with the cases validation and name
# rules must handle: invalid and missing URLs, bad names, degree prefixes,
# blank summaries, malformed e-mails and phones, implausible years.
def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    k = F.col("c_custkey")
    ks = k.cast("string")
    def kunde(prefix):
        return F.concat(F.lit(prefix), ks)
    name = (F.when(k % 12 == 0, F.lit(None)).when(k % 12 == 1, kunde("http://spam"))
            .when(k % 12 == 2, F.lit("X")).when(k % 12 == 3, kunde("Prof. Dr. Anna Kunde"))
            .when(k % 12 == 4, kunde("Dr.-Ing. Bernd Kunde")).when(k % 12 == 5, kunde("dipl.-ing. Carl Kunde"))
            .when(k % 12 == 6, kunde("Mag. Dora Kunde")).when(k % 12 == 7, kunde("MBA Emil Kunde"))
            .when(k % 12 == 8, kunde("Prof. Dr. med. Fritz Kunde")).when(k % 12 == 9, kunde("pd Gerd Kunde"))
            .when(k % 12 == 10, F.concat(kunde("  Hanna  Maria   Kunde"), F.lit(" ")))
            .otherwise(F.lit("Ida")))
    slug = (k % 499).cast("string")
    url = (F.when(k % 7 == 0, F.concat(F.lit("https://example.com/in/c-"), ks))
           .when(k % 7 == 1, F.concat(F.lit("linkedin.com/in/c-"), ks))
           .when(k % 7 == 2, F.lit(None))
           .when(k % 7 == 3, F.concat(F.lit("http://www.linkedin.com/in/c-"), slug, F.lit("/")))
           .otherwise(F.concat(F.lit("https://de.linkedin.com/in/C-"), slug, F.lit("?x=1"))))
    return j.select(
        k.alias("ingest_seq"), name.alias("name"), url.alias("profile_url"),
        F.when(k % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Buyer in "), F.col("c_mktsegment"), F.lit(" at "), F.col("n_name"), F.lit(".")))
        .alias("summary"),
        F.when(k % 4 != 0, F.concat(F.col("c_mktsegment"), F.lit(" lead"))).alias("current_position"),
        F.col("n_name").alias("company"),
        F.when(k % 3 != 0, F.concat(F.lit("City "), (k % 17).cast("string"))).alias("location"),
        F.when(k % 4 == 0, F.concat(F.lit("c"), ks, F.lit("@example.com")))
         .when(k % 4 == 1, F.lit("bad-email@")).alias("email"),
        F.when(k % 6 == 0, F.lit("12-345"))
         .when(k % 6 == 1, F.concat(F.lit("+49 711 "), (k + 1000000).cast("string"))).alias("phone"),
        F.when(k % 3 == 0, F.concat(F.lit("www.c"), ks, F.lit(".com")))
         .when(k % 3 == 1, F.concat(F.lit("https://c"), ks, F.lit(".com"))).alias("website"),
        (k % 70).cast("long").alias("experience_years"),
        F.when(k % 2 == 0, F.floor(F.col("c_acctbal")).cast("long").cast("string")).alias("follower_count"),
        F.when(k % 3 == 1, F.lit("500+")).when(k % 3 == 2, F.lit("1.2K")).alias("connection_count"),
        F.array(F.col("c_mktsegment"), F.lit(""), F.col("n_name")).alias("summary_other"),
    )


CUSTOMER_PROFILES_SQL = """
SELECT c_custkey AS ingest_seq,
  CASE c_custkey % 12 WHEN 0 THEN NULL WHEN 1 THEN 'http://spam' || c_custkey WHEN 2 THEN 'X'
    WHEN 3 THEN 'Prof. Dr. Anna Kunde' || c_custkey WHEN 4 THEN 'Dr.-Ing. Bernd Kunde' || c_custkey
    WHEN 5 THEN 'dipl.-ing. Carl Kunde' || c_custkey WHEN 6 THEN 'Mag. Dora Kunde' || c_custkey
    WHEN 7 THEN 'MBA Emil Kunde' || c_custkey WHEN 8 THEN 'Prof. Dr. med. Fritz Kunde' || c_custkey
    WHEN 9 THEN 'pd Gerd Kunde' || c_custkey WHEN 10 THEN '  Hanna  Maria   Kunde' || c_custkey || ' '
    WHEN 11 THEN 'Ida' END AS name,
  CASE c_custkey % 7 WHEN 0 THEN 'https://example.com/in/c-' || c_custkey
    WHEN 1 THEN 'linkedin.com/in/c-' || c_custkey WHEN 2 THEN NULL
    WHEN 3 THEN 'http://www.linkedin.com/in/c-' || (c_custkey % 499) || '/'
    ELSE 'https://de.linkedin.com/in/C-' || (c_custkey % 499) || '?x=1' END AS profile_url,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'Buyer in ' || c_mktsegment || ' at ' || n_name || '.' END AS summary,
  CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment || ' lead' END AS current_position,
  n_name AS company,
  CASE WHEN c_custkey % 3 <> 0 THEN 'City ' || (c_custkey % 17) END AS location,
  CASE c_custkey % 4 WHEN 0 THEN 'c' || c_custkey || '@example.com' WHEN 1 THEN 'bad-email@' END AS email,
  CASE c_custkey % 6 WHEN 0 THEN '12-345' WHEN 1 THEN '+49 711 ' || (c_custkey + 1000000) END AS phone,
  CASE c_custkey % 3 WHEN 0 THEN 'www.c' || c_custkey || '.com' WHEN 1 THEN 'https://c' || c_custkey || '.com'
    END AS website,
  CAST(c_custkey % 70 AS BIGINT) AS experience_years,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS follower_count,
  CASE c_custkey % 3 WHEN 1 THEN '500+' WHEN 2 THEN '1.2K' END AS connection_count,
  c_mktsegment AS seg, n_name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
"""


# ---------------------------------------------------------------- messages
# Outreach messages from orders: each names a user by one of the URL
# spellings of the events-derived profiles.
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    u = (F.col("o_custkey") % 150).cast("string")
    v = k % 4
    url = (F.when(v == 0, F.concat(F.lit("https://www.linkedin.com/in/User-"), u, F.lit("/")))
           .when(v == 1, F.concat(F.lit("http://de.linkedin.com/in/user-"), u, F.lit("?trk=m")))
           .when(v == 2, F.concat(F.lit("https://linkedin.com/in/USER-"), u, F.lit("/en")))
           .otherwise(F.concat(F.lit("https://www.linkedin.com/in/user-"), u)))
    return o.select(
        k.alias("id"), url.alias("linkedin_profile"),
        F.when(k % 2 == 0, F.lit("linkedin")).otherwise(F.lit("email")).alias("channel"),
        F.when(k % 5 != 0, k % 5).cast("long").alias("template_id"),
        ((k % 3) + 1).cast("int").alias("stage_no"),
        F.concat(F.lit("Hello "), F.col("o_custkey").cast("string")).alias("rendered_md"),
        F.when(F.col("o_orderstatus") == "F", F.lit("sent")).otherwise(F.lit("scheduled")).alias("status"),
        F.when(k % 9 != 0, F.col("o_orderdate")).alias("scheduled_at"),
        F.lit(None).cast("timestamp_ntz").alias("sent_at"),
        F.lit(None).cast("timestamp_ntz").alias("replied_at"),
        F.col("o_orderdate").alias("created_at"),
    )


MESSAGES_SQL = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://www.linkedin.com/in/User-' || (o_custkey % 150) || '/'
    WHEN 1 THEN 'http://de.linkedin.com/in/user-' || (o_custkey % 150) || '?trk=m'
    WHEN 2 THEN 'https://linkedin.com/in/USER-' || (o_custkey % 150) || '/en'
    ELSE 'https://www.linkedin.com/in/user-' || (o_custkey % 150) END AS linkedin_profile,
  CASE WHEN o_orderkey % 2 = 0 THEN 'linkedin' ELSE 'email' END AS channel,
  CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 END AS BIGINT) AS template_id,
  CAST((o_orderkey % 3) + 1 AS INTEGER) AS stage_no, 'Hello ' || o_custkey AS rendered_md,
  CASE WHEN o_orderstatus = 'F' THEN 'sent' ELSE 'scheduled' END AS status,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS scheduled_at,
  CAST(NULL AS TIMESTAMP) AS sent_at, CAST(NULL AS TIMESTAMP) AS replied_at, o_orderdate AS created_at
FROM orders
"""
