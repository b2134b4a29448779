"""People-side queries: N (standardise), V (validate), K (keys and merges)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadframe.functions import names, numbers, urls
from leadframe.operators import standardise, upsert, validate
from leadframe.plans import inputs
from leadframe.plans import sqlrules as R
from leadframe.plans.registry import BATCH, NOW, register
from leadframe.plans.sqlparts import K1_AGG

CP = f"WITH cp AS ({inputs.CUSTOMER_PROFILES_SQL})"


def cust(spark, sf):
    return inputs.customer_profiles(spark, sf)


def _records(spark, sf):
    from leadframe.plans.catalog import person_records
    return person_records(spark, sf)


# ====================================================================== N
@register("n1_map_person_schema", f"""{CP}
SELECT ingest_seq, coalesce(nullif(name, ''), '') AS mapped_contact_name,
  nullif(profile_url, '') AS mapped_linkedin_profile, nullif(company, '') AS mapped_company,
  nullif(location, '') AS mapped_location, nullif(current_position, '') AS mapped_position,
  {R.n3('connection_count')} AS mapped_connections_linkedin,
  {R.n2('follower_count')} AS mapped_followers_linkedin,
  coalesce(nullif(phone, ''), '') AS mapped_phone_info, coalesce(nullif(summary, ''), '') AS mapped_info_raw,
  CAST(len([seg, '', n_name]) AS INTEGER) AS n_insights,
  nullif(email, '') AS mapped_email, '{inputs.LOOKUP_DATE}' AS mapped_lookup_date
FROM cp""")
def n1_map_person_schema(spark, sf):
    """N1 on the customer profiles."""
    m = standardise.map_to_person_schema(cust(spark, sf), inputs.LOOKUP_DATE)
    return m.select("ingest_seq", "mapped_contact_name", "mapped_linkedin_profile", "mapped_company",
                    "mapped_location", "mapped_position", "mapped_connections_linkedin",
                    "mapped_followers_linkedin", "mapped_phone_info", "mapped_info_raw",
                    F.size("mapped_insights").alias("n_insights"), "mapped_email", "mapped_lookup_date")


@register("n2_parse_int_shorthand", f"""{CP}
SELECT ingest_seq, {R.n2('follower_count')} AS followers, {R.n2('connection_count')} AS connections_raw
FROM cp""")
def n2_parse_int_shorthand(spark, sf):
    c = cust(spark, sf)
    return c.select("ingest_seq", numbers.parse_int_shorthand("follower_count").alias("followers"),
                    numbers.parse_int_shorthand("connection_count").alias("connections_raw"))


@register("n3_capped_connections", f"""WITH r AS ({inputs.RAW_PROFILES_SQL})
SELECT ingest_seq, {R.n3('connection_count')} AS connections FROM r""")
def n3_capped_connections(spark, sf):
    r = inputs.raw_profiles(spark, sf)
    return r.select("ingest_seq", numbers.parse_connections("connection_count").alias("connections"))


@register("n4_degree_prefix", f"""{CP}
SELECT ingest_seq, {R.degree('name')} AS degree, {R.cleaned_name('name')} AS cleaned_name FROM cp""")
def n4_degree_prefix(spark, sf):
    c = cust(spark, sf)
    return c.select("ingest_seq", names.degree_prefix("name").alias("degree"),
                    names.strip_degree("name").alias("cleaned_name"))


@register("n5_name_split", f"""{CP}, c AS (SELECT ingest_seq, {R.cleaned_name('name')} AS cn FROM cp)
SELECT ingest_seq, {R.first_name('cn')} AS first_name, {R.last_name('cn')} AS last_name FROM c""")
def n5_name_split(spark, sf):
    c = cust(spark, sf).select("ingest_seq", names.strip_degree("name").alias("cn"))
    first, last = names.split_name("cn")
    return c.select("ingest_seq", first.alias("first_name"), last.alias("last_name"))


@register("n6_title_with_degree", f"""{CP}
SELECT ingest_seq, {R.title_with_degree('current_position', R.degree('name'))} AS title_current FROM cp""")
def n6_title_with_degree(spark, sf):
    c = cust(spark, sf)
    return c.select("ingest_seq", names.title_with_degree(F.col("current_position"),
                                                          names.degree_prefix("name")).alias("title_current"))


@register("n7_profile_key", f"""{CP}, r AS ({inputs.RAW_PROFILES_SQL})
SELECT 'c' || ingest_seq AS rid, {R.n7('profile_url')} AS profile_key FROM cp
UNION ALL SELECT 'e' || ingest_seq, {R.n7('profile_url')} FROM r
UNION ALL SELECT 's' || s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'https://linkedin.com/in/été-' || s_suppkey
  WHEN 1 THEN 'https://linkedin.com/in/jörg-' || s_suppkey WHEN 2 THEN 'https://linkedin.com/in/foo' || s_suppkey
  WHEN 3 THEN 'https://linkedin.com/in/a;b' || s_suppkey END FROM supplier""")
def n7_profile_key(spark, sf):
    a = cust(spark, sf).select(F.concat(F.lit("c"), F.col("ingest_seq").cast("string")).alias("rid"),
                               urls.profile_key("profile_url").alias("profile_key"))
    b = inputs.raw_profiles(spark, sf).select(
        F.concat(F.lit("e"), F.col("ingest_seq").cast("string")).alias("rid"),
        urls.profile_key("profile_url").alias("profile_key"))
    s = inputs.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    ks = k.cast("string")
    v = k % 5
    link = (F.when(v == 0, F.concat(F.lit("https://www.linkedin.com/in/%C3%89t%C3%A9-"), ks))
            .when(v == 1, F.concat(F.lit("http://de.linkedin.com/in/J\u00f6rg-"), ks, F.lit("/?x=1")))
            .when(v == 2, F.concat(F.lit("https://linkedin.com/in/\uff26oo"), ks, F.lit(";jsessionid=1")))
            .when(v == 3, F.concat(F.lit("https://linkedin.com/in/a;b"), ks, F.lit("/c;d")))
            .otherwise(F.lit("https://linkedin.com/in/")))
    c = s.select(F.concat(F.lit("s"), ks).alias("rid"), urls.profile_key(link).alias("profile_key"))
    return a.unionByName(b).unionByName(c)


@register("n8_insights_text", f"""{CP}
SELECT ingest_seq, concat_ws('; ', nullif(seg, ''), nullif(n_name, '')) AS insights_text FROM cp""")
def n8_insights_text(spark, sf):
    recs = standardise.standardise_people(cust(spark, sf))
    return recs.select("ingest_seq", "insights_text")


@register("n9_standardise_people", f"SELECT * FROM ({inputs.PERSON_RECORDS_SQL})")
def n9_standardise_people(spark, sf):
    """N1 then N2-N9 over the events-derived profiles (field precedence)."""
    return _records(spark, sf)


# ====================================================================== V
def _v1_sql():
    return f"""concat_ws('; ',
      CASE WHEN name IS NULL OR name = '' THEN 'Missing required field: name'
           WHEN NOT {R.v3('name')} THEN 'Invalid name format: ' || name END,
      CASE WHEN profile_url IS NULL OR profile_url = '' THEN 'Missing required field: profile_url'
           WHEN NOT {R.v2('profile_url')} THEN 'Invalid LinkedIn URL: ' || profile_url END,
      CASE WHEN summary IS NULL OR summary = '' THEN 'Missing required field: summary' END)"""


_V4_SQL = """concat_ws('; ',
  CASE WHEN email IS NOT NULL AND email <> ''
        AND NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$')
       THEN 'Email format looks invalid' END,
  CASE WHEN website IS NOT NULL AND website <> '' AND NOT (starts_with(website, 'http://')
        OR starts_with(website, 'https://')) THEN 'Website should start with http(s)://' END,
  CASE WHEN phone IS NOT NULL AND phone <> '' AND length(regexp_replace(phone, '[^0-9]', '', 'g')) < 7
       THEN 'Phone number too short to be valid' END,
  CASE WHEN experience_years IS NOT NULL AND experience_years <> 0
        AND (experience_years < 0 OR experience_years > 60)
       THEN 'Experience years outside plausible range (0-60)' END)"""


@register("v1_profile_errors", f"{CP} SELECT ingest_seq, {_v1_sql()} AS errors FROM cp")
def v1_profile_errors(spark, sf):
    """V1-V3: required-field errors per customer profile."""
    c = cust(spark, sf)
    return c.select("ingest_seq", F.array_join(validate.profile_errors(c), "; ").alias("errors"))


@register("v2_profile_url_valid", f"{CP} SELECT ingest_seq, {R.v2('profile_url')} AS url_ok FROM cp")
def v2_profile_url_valid(spark, sf):
    return cust(spark, sf).select("ingest_seq", urls.is_profile_url("profile_url").alias("url_ok"))


@register("v3_name_valid", f"{CP} SELECT ingest_seq, {R.v3('name')} AS name_ok FROM cp")
def v3_name_valid(spark, sf):
    return cust(spark, sf).select("ingest_seq", names.is_valid_name("name").alias("name_ok"))


@register("v4_profile_warnings", f"{CP} SELECT ingest_seq, {_V4_SQL} AS warnings FROM cp")
def v4_profile_warnings(spark, sf):
    c = cust(spark, sf)
    return c.select("ingest_seq", F.array_join(validate.profile_warnings(c), "; ").alias("warnings"))


@register("v5_validate_profiles", f"{CP} SELECT ingest_seq, {_v1_sql()} = '' AS is_valid FROM cp")
def v5_validate_profiles(spark, sf):
    valid, rejected = validate.validate_profiles(cust(spark, sf))
    return (valid.select("ingest_seq", F.lit(True).alias("is_valid"))
            .unionByName(rejected.select("ingest_seq", F.lit(False).alias("is_valid"))))


@register("v6_validation_metrics", f"""{CP}
SELECT count(*) AS total_profiles, count(*) FILTER (WHERE {_v1_sql()} = '') AS valid_profiles,
       count(*) FILTER (WHERE {_v1_sql()} <> '') AS invalid_profiles FROM cp""")
def v6_validation_metrics(spark, sf):
    c = cust(spark, sf)
    totals, _ = validate.validation_metrics(c.withColumn("errors", validate.profile_errors(c)))
    return totals


@register("v6_validation_error_counts", f"""{CP}, e AS (SELECT unnest(list_filter([
      CASE WHEN name IS NULL OR name = '' THEN 'Missing required field: name'
           WHEN NOT {R.v3('name')} THEN 'Invalid name format: ' || name END,
      CASE WHEN profile_url IS NULL OR profile_url = '' THEN 'Missing required field: profile_url'
           WHEN NOT {R.v2('profile_url')} THEN 'Invalid LinkedIn URL: ' || profile_url END,
      CASE WHEN summary IS NULL OR summary = '' THEN 'Missing required field: summary' END],
      lambda x: x IS NOT NULL)) AS error FROM cp)
SELECT error, count(*) AS n FROM e GROUP BY error""")
def v6_validation_error_counts(spark, sf):
    c = cust(spark, sf)
    _, errors = validate.validation_metrics(c.withColumn("errors", validate.profile_errors(c)))
    return errors


@register("v7_drop_duplicate_profiles", f"""{CP}
SELECT min(ingest_seq) AS ingest_seq, profile_url FROM cp
WHERE profile_url IS NOT NULL AND profile_url <> '' GROUP BY profile_url""")
def v7_drop_duplicate_profiles(spark, sf):
    return validate.drop_duplicate_profiles(cust(spark, sf)).select("ingest_seq", "profile_url")


@register("v8_clean_profiles", f"""{CP}
SELECT ingest_seq, trim(name) AS name, trim(current_position) AS current_position, trim(summary) AS summary,
  CASE WHEN profile_url IS NOT NULL AND profile_url <> '' AND NOT starts_with(profile_url, 'https://')
       THEN replace(profile_url, 'http://', 'https://') ELSE profile_url END AS profile_url
FROM cp""")
def v8_clean_profiles(spark, sf):
    return validate.clean_profiles(cust(spark, sf)).select("ingest_seq", "name", "current_position",
                                                           "summary", "profile_url")


@register("v9_route_people", f"""{CP}, r AS ({inputs.RAW_PROFILES_SQL})
SELECT 'e' || ingest_seq AS rid, 'mapped' AS route FROM r
UNION ALL SELECT 'c' || ingest_seq, CASE WHEN {_v1_sql()} = '' THEN 'valid' ELSE 'rejected' END FROM cp""")
def v9_route_people(spark, sf):
    """V9: mapped rows (events, after N1) skip validation; raw rows
    (customers) are validated. One frame, decided per row."""
    mapped = standardise.map_to_person_schema(inputs.raw_profiles(spark, sf), inputs.LOOKUP_DATE) \
        .withColumn("rid", F.concat(F.lit("e"), F.col("ingest_seq").cast("string")))
    raw = cust(spark, sf).withColumn("rid", F.concat(F.lit("c"), F.col("ingest_seq").cast("string")))
    both = standardise.with_profile_columns(mapped.unionByName(raw, allowMissingColumns=True))
    people, rejected = validate.route_people(both)
    is_mapped = F.col("mapped_linkedin_profile").isNotNull() | F.col("mapped_contact_name").isNotNull()
    return (people.select("rid", F.when(is_mapped, "mapped").otherwise("valid").alias("route"))
            .unionByName(rejected.select("rid", F.lit("rejected").alias("route"))))


# ------------------------------------------------------- company rows
def supplier_companies(spark, sf):
    """Company rows from supplier ⟕ nation, in both alias spellings, with
    blanks, duplicate domains, website-only rows and name+address twins."""
    s = inputs.table(spark, sf, "supplier")
    n = inputs.table(spark, sf, "nation")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left")
    k = F.col("s_suppkey")
    dom = F.concat(F.lit("firm"), (k % 40).cast("string"), F.lit(".de"))
    return j.select(
        k.alias("ingest_seq"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")))
         .otherwise(F.col("s_name")).alias("Company"),
        F.when(k % 5 == 0, F.concat(F.lit("Firm "), (k % 40).cast("string"))).alias("name"),
        F.when(k % 4 == 0, dom).alias("Company_Domain"),
        F.when(k % 4 == 1, F.upper(dom)).alias("domain"),
        F.when(k % 4 == 2, F.concat(F.lit("https://www."), dom, F.lit("/contact"))).alias("Company_Website"),
        F.when(k % 7 == 3, F.lit("")).alias("website"),
        F.when(k % 4 == 3, F.col("n_name")).alias("address"),
    )


SUPPLIER_COMPANIES_SQL = """
SELECT s_suppkey AS ingest_seq,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN ' ' || s_name || ' ' ELSE s_name END AS Company,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Firm ' || (s_suppkey % 40) END AS name,
  CASE WHEN s_suppkey % 4 = 0 THEN 'firm' || (s_suppkey % 40) || '.de' END AS Company_Domain,
  CASE WHEN s_suppkey % 4 = 1 THEN upper('firm' || (s_suppkey % 40) || '.de') END AS domain,
  CASE WHEN s_suppkey % 4 = 2 THEN 'https://www.firm' || (s_suppkey % 40) || '.de/contact' END AS Company_Website,
  CASE WHEN s_suppkey % 7 = 3 THEN '' END AS website,
  CASE WHEN s_suppkey % 4 = 3 THEN n_name END AS address
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
"""
SC = f"WITH sc AS ({SUPPLIER_COMPANIES_SQL})"
_CKEY = """CASE WHEN lower(coalesce(nullif(Company_Domain, ''), nullif(domain, ''), '')) <> ''
  THEN lower(coalesce(nullif(Company_Domain, ''), nullif(domain, ''), ''))
  ELSE trim(lower(coalesce(nullif(Company, ''), nullif(name, ''), ''))) || '|'
       || trim(lower(coalesce(nullif(address, ''), ''))) END"""
_VALID = ("coalesce(nullif(Company, ''), nullif(name, ''), nullif(Company_Domain, ''), nullif(domain, ''), "
          "nullif(Company_Website, ''), nullif(website, '')) IS NOT NULL")


@register("v10_valid_companies", f"{SC} SELECT ingest_seq FROM sc WHERE {_VALID}")
def v10_valid_companies(spark, sf):
    return validate.valid_companies(supplier_companies(spark, sf)).select("ingest_seq")


@register("v11_clean_companies", f"""{SC}
SELECT ingest_seq, trim(Company) AS Company, trim(Company_Website) AS Company_Website,
  CASE WHEN coalesce(nullif(Company_Domain, ''), nullif(domain, '')) IS NULL
        AND coalesce(nullif(Company_Website, ''), nullif(website, '')) IS NOT NULL
       THEN regexp_extract(lower(coalesce(nullif(Company_Website, ''), nullif(website, ''))),
                           '^https?://(?:[^/?#@]*@)?(?:[^./?#]+\\.)*([^./?#]+\\.[a-z]+)(?:[:/?#]|$)', 1)
       ELSE trim(Company_Domain) END AS Company_Domain
FROM sc""")
def v11_clean_companies(spark, sf):
    return validate.clean_companies(supplier_companies(spark, sf)).select(
        "ingest_seq", "Company", "Company_Website", "Company_Domain")


@register("v12_dedupe_companies", f"SELECT min(ingest_seq) AS ingest_seq FROM ({SUPPLIER_COMPANIES_SQL}) "
                                  f"GROUP BY {_CKEY}")
def v12_dedupe_companies(spark, sf):
    return validate.dedupe_companies(supplier_companies(spark, sf)).select("ingest_seq")


@register("v13_company_ingest_prep", f"""{SC}
SELECT min(ingest_seq) AS ingest_seq FROM sc WHERE {_VALID} GROUP BY {_CKEY}""")
def v13_company_ingest_prep(spark, sf):
    return validate.company_ingest_prep(supplier_companies(spark, sf)).select("ingest_seq")


# ====================================================================== K
def _ingest(spark, sf):
    from leadframe.plans.catalog import ingest
    return ingest(spark, sf)


def _k1_agg():
    from leadframe.plans.catalog import _K1_AGG
    return _K1_AGG


_R2_PARTS = f"""rec AS ({inputs.PERSON_RECORDS_SQL}),
lastc AS (SELECT linkedin_profile, arg_max_null(company_domain, ingest_seq) AS dom,
                 arg_max_null(company_name, ingest_seq) AS cname
          FROM rec WHERE linkedin_profile IS NOT NULL
            AND (nullif(company_domain, '') IS NOT NULL OR nullif(company_name, '') IS NOT NULL)
          GROUP BY linkedin_profile),
comp AS (SELECT company_domain AS domain,
                arg_max_null(coalesce(nullif(company_name, ''), company_domain), ingest_seq) AS name
         FROM rec WHERE linkedin_profile IS NOT NULL AND nullif(company_domain, '') IS NOT NULL
         GROUP BY company_domain)"""


@register("k3_append_company_stubs", f"""WITH rec AS ({inputs.PERSON_RECORDS_SQL})
SELECT company_name AS name, nullif(source_name, '') AS source_name, ingest_seq AS created_seq FROM rec
WHERE linkedin_profile IS NOT NULL AND nullif(company_domain, '') IS NULL AND nullif(company_name, '') IS NOT NULL""")
def k3_append_company_stubs(spark, sf):
    """K3: records naming a company without a domain each add a stub row."""
    _, companies, _ = _ingest(spark, sf)
    return companies.filter(F.col("domain").isNull()).select("name", "source_name", "created_seq")


@register("k5_link_people_companies", f"""WITH {_R2_PARTS}
SELECT l.linkedin_profile, l.dom AS company_domain,
  CASE WHEN l.dom IS NOT NULL THEN c.name ELSE l.cname END AS company_name
FROM lastc l LEFT JOIN comp c ON c.domain = l.dom""")
def k5_link_people_companies(spark, sf):
    """K5: people upserted without companies, then linked to the batch's companies."""
    rec = _records(spark, sf).filter(F.col("linkedin_profile").isNotNull())
    named = rec.filter((F.coalesce("company_domain", F.lit("")) != "") | (F.coalesce("company_name", F.lit("")) != ""))
    companies = upsert.upsert_companies(None, named.select(
        F.col("company_name").alias("name"), F.col("company_domain").alias("domain"),
        F.col("company_website").alias("website"), "source_name", "source_query",
        F.lit(None).cast("long").alias("search_query_id"), "ingest_seq"), BATCH)
    people = upsert.link_people_companies(upsert.upsert_people(None, rec, NOW), companies, rec, BATCH)
    c = companies.select(F.col("id").alias("cid"), F.col("domain").alias("company_domain"),
                         F.col("name").alias("company_name"))
    return (people.join(c, people["company_id"] == c["cid"], "left")
            .select("linkedin_profile", "company_domain", "company_name"))


def order_queries(spark, sf):
    """Query texts from orders: source = priority, text in four spellings."""
    o = inputs.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    clerk = (F.col("o_custkey") % 7).cast("string")
    st = F.col("o_orderstatus")
    v = k % 4
    text = (F.when(v == 0, F.concat(F.lit("Status "), st, F.lit(" clerk "), clerk))
            .when(v == 1, F.concat(F.lit("  status  "), F.lower(st), F.lit("   clerk "), clerk, F.lit(" ")))
            .when(v == 2, F.upper(F.concat(F.lit("Status "), st, F.lit(" clerk "), clerk)))
            .otherwise(F.concat(F.lit("Status\t"), st, F.lit(" clerk "), clerk)))
    return o.select(F.col("o_orderpriority").alias("source"), F.lit("person").alias("entity_type"),
                    text.alias("query_text"), k.alias("ingest_seq"))


ORDER_QUERIES_SQL = """
SELECT o_orderpriority AS source, 'person' AS entity_type,
  CASE o_orderkey % 4 WHEN 0 THEN 'Status ' || o_orderstatus || ' clerk ' || (o_custkey % 7)
    WHEN 1 THEN '  status  ' || lower(o_orderstatus) || '   clerk ' || (o_custkey % 7) || ' '
    WHEN 2 THEN upper('Status ' || o_orderstatus || ' clerk ' || (o_custkey % 7))
    ELSE 'Status' || chr(9) || o_orderstatus || ' clerk ' || (o_custkey % 7) END AS query_text,
  o_orderkey AS ingest_seq
FROM orders
"""
_NORMQ = "coalesce(lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'))), '')"


@register("k6_normalize_query", f"SELECT ingest_seq, {_NORMQ} AS normalized_query FROM ({ORDER_QUERIES_SQL})")
def k6_normalize_query(spark, sf):
    q = order_queries(spark, sf)
    return q.select("ingest_seq", upsert.normalize_query("query_text").alias("normalized_query"))


_K7_SQL = f"""SELECT coalesce(source, '') AS source, entity_type, {_NORMQ} AS normalized_query,
  arg_min(coalesce(query_text, ''), ingest_seq) AS query_text
FROM ({ORDER_QUERIES_SQL}) GROUP BY ALL"""


@register("k7_upsert_queries", _K7_SQL)
def k7_upsert_queries(spark, sf):
    dim = upsert.upsert_queries(None, order_queries(spark, sf), NOW)
    return dim.select("source", "entity_type", "normalized_query", "query_text")


@register("k8_attach_query_id", f"""WITH rec AS ({inputs.PERSON_RECORDS_SQL}),
d AS (SELECT DISTINCT source_name AS s, lower(trim(regexp_replace(source_query, '\\s+', ' ', 'g'))) AS q
      FROM rec WHERE ingest_seq % 2 = 0 AND linkedin_profile IS NOT NULL
        AND nullif(source_name, '') IS NOT NULL AND nullif(source_query, '') IS NOT NULL)
SELECT ingest_seq, d.s AS source, d.q AS normalized_query
FROM rec LEFT JOIN d ON d.s = rec.source_name
  AND d.q = lower(trim(regexp_replace(rec.source_query, '\\s+', ' ', 'g')))""")
def k8_attach_query_id(spark, sf):
    """K8 (per row): the dimension knows the queries of even-numbered
    records only, so odd-only queries stay unmatched."""
    rec = _records(spark, sf)
    qb = (rec.filter((F.col("ingest_seq") % 2 == 0) & F.col("linkedin_profile").isNotNull()
                     & (F.col("source_name") != "") & (F.col("source_query") != ""))
          .select(F.col("source_name").alias("source"), F.lit("person").alias("entity_type"),
                  F.col("source_query").alias("query_text"), "ingest_seq"))
    dim = upsert.upsert_queries(None, qb, NOW)
    out = upsert.attach_query_id(rec, dim).select("ingest_seq", "search_query_id")
    return (out.join(dim, out["search_query_id"] == dim["id"], "left")
            .select("ingest_seq", "source", "normalized_query"))


@register("k9_backfilled_people", f"""WITH rec AS ({inputs.PERSON_RECORDS_SQL}), ppl AS ({K1_AGG})
SELECT linkedin_profile, CASE WHEN coalesce(source_query, '') <> '' THEN coalesce(source_name, '') END AS source,
  CASE WHEN coalesce(source_query, '') <> '' THEN lower(trim(source_query)) END AS normalized_query FROM ppl""")
def k9_backfilled_people(spark, sf):
    """K9: the query every person is filled with."""
    people = upsert.upsert_people(None, _records(spark, sf), NOW)
    p, dim = upsert.backfill_queries(people, upsert.upsert_queries(None, order_queries(spark, sf), NOW), NOW)
    return (p.select("linkedin_profile", "search_query_id").join(dim, F.col("search_query_id") == dim["id"], "left")
            .select("linkedin_profile", "source", "normalized_query"))


@register("k9_backfill_queries", f"""WITH rec AS ({inputs.PERSON_RECORDS_SQL}), ppl AS ({K1_AGG}),
dim AS ({_K7_SQL}),
pairs AS (SELECT coalesce(source_name, '') AS source, 'person' AS entity_type,
            lower(trim(coalesce(source_query, ''))) AS normalized_query,
            arg_min(coalesce(source_query, ''), created_seq) AS query_text
          FROM ppl WHERE coalesce(source_query, '') <> '' GROUP BY ALL)
SELECT source, entity_type, normalized_query, query_text FROM dim
UNION ALL
SELECT p.source, p.entity_type, p.normalized_query, p.query_text FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM dim d WHERE d.source = p.source AND d.entity_type = p.entity_type
                  AND d.normalized_query = p.normalized_query)""")
def k9_backfill_queries(spark, sf):
    """K9: person queries seen on people (lower+trim only) added to the
    order-derived dimension; returns the dimension."""
    people = upsert.upsert_people(None, _records(spark, sf), NOW)
    dim = upsert.upsert_queries(None, order_queries(spark, sf), NOW)
    _, dim2 = upsert.backfill_queries(people, dim, NOW)
    return dim2.select("source", "entity_type", "normalized_query", "query_text")


def legacy_people(spark, sf):
    """A people table keyed by URLs as they were given (before N7)."""
    mapped = standardise.map_to_person_schema(inputs.raw_profiles(spark, sf), inputs.LOOKUP_DATE)
    rec = standardise.standardise_people(mapped, normalize_key=False)
    return upsert.upsert_people(None, rec, NOW)


_DEDUPE_OUT = ["first_name", "last_name", "title_current", "email", "location_text", "connections_linkedin",
               "followers_linkedin", "phone_info", "info_raw", "lookup_date"]
_STR = {"first_name", "last_name", "title_current", "email", "location_text", "phone_info", "info_raw",
        "lookup_date"}


def _k10_groups_sql():
    aggs = []
    for c in _DEDUPE_OUT:
        usable = f" FILTER (WHERE {c} <> '')" if c in _STR else ""
        aggs.append(f"arg_min_null({c}, created_seq) AS s_{c}, arg_min({c}, created_seq){usable} AS f_{c}")
    return f"""rec AS ({inputs.RAW_KEY_RECORDS_SQL}), leg AS ({K1_AGG}),
k AS (SELECT *, coalesce({R.n7('linkedin_profile')}, linkedin_profile) AS key FROM leg),
g AS (SELECT key, count(*) AS n, arg_min_null(linkedin_profile, created_seq) AS s_url,
        min(created_seq) AS created_seq, arg_min_null(is_hot, created_seq) AS is_hot,
        {", ".join(aggs)} FROM k GROUP BY key)"""


@register("k10_dedupe_people", f"""WITH {_k10_groups_sql()}
SELECT CASE WHEN n > 1 THEN key ELSE s_url END AS linkedin_profile,
  {", ".join(f"CASE WHEN n > 1 THEN coalesce(s_{c}, f_{c}) ELSE s_{c} END AS {c}" for c in _DEDUPE_OUT)},
  is_hot, created_seq FROM g""")
def k10_dedupe_people(spark, sf):
    """K10 over a legacy people table holding every URL spelling."""
    merged, _ = upsert.dedupe_people(legacy_people(spark, sf))
    return merged.select("linkedin_profile", *_DEDUPE_OUT, "is_hot", "created_seq")


@register("k11_repoint_messages", f"""WITH {_k10_groups_sql()},
m AS (SELECT k.linkedin_profile AS dup_url, g.key AS canonical_url FROM k JOIN g ON k.key = g.key
      WHERE g.n > 1 AND k.created_seq <> g.created_seq),
msg AS ({inputs.MESSAGES_SQL})
SELECT msg.id, coalesce(m.canonical_url, msg.linkedin_profile) AS linkedin_profile
FROM msg LEFT JOIN m ON m.dup_url = msg.linkedin_profile""")
def k11_repoint_messages(spark, sf):
    _, mapping = upsert.dedupe_people(legacy_people(spark, sf))
    return upsert.repoint_messages(inputs.messages(spark, sf), mapping).select("id", "linkedin_profile")


@register("k12_erase_profiles", f"""WITH rec AS ({inputs.PERSON_RECORDS_SQL}), ppl AS ({K1_AGG})
SELECT linkedin_profile FROM ppl
WHERE CAST(regexp_extract(linkedin_profile, 'user-([0-9]+)', 1) AS BIGINT) % 10 <> 0""")
def k12_erase_profiles(spark, sf):
    """Erase every user whose id ends in 0, named by any URL spelling
    (the raw profile URLs), from people and messages."""
    people, _, _ = _ingest(spark, sf)
    keys = inputs.raw_profiles(spark, sf).filter(
        F.regexp_extract("profile_url", r"(?i)user-(\d+)", 1).cast("long") % 10 == 0).select("profile_url")
    p, _m = upsert.erase_profiles(people, inputs.messages(spark, sf), keys)
    return p.select("linkedin_profile")


@register("k12_erase_messages", f"""WITH msg AS ({inputs.MESSAGES_SQL})
SELECT id FROM msg WHERE CAST(regexp_extract(lower(linkedin_profile), 'user-([0-9]+)', 1) AS BIGINT)
  NOT IN (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0)""")
def k12_erase_messages(spark, sf):
    people, _, _ = _ingest(spark, sf)
    keys = inputs.raw_profiles(spark, sf).filter(
        F.regexp_extract("profile_url", r"(?i)user-(\d+)", 1).cast("long") % 10 == 0).select("profile_url")
    _p, m = upsert.erase_profiles(people, inputs.messages(spark, sf), keys)
    return m.select("id")


@register("k12_erase_companies", f"""WITH {_R2_PARTS}, ppl AS ({K1_AGG})
SELECT 'person' AS kind, p.linkedin_profile AS key,
  CASE WHEN l.dom IS NOT NULL AND CAST(regexp_extract(l.dom, '([0-9]+)', 1) AS INTEGER) % 3 = 0 THEN NULL
       WHEN l.dom IS NOT NULL THEN c.name ELSE l.cname END AS company_name
FROM ppl p LEFT JOIN lastc l USING (linkedin_profile) LEFT JOIN comp c ON c.domain = l.dom
UNION ALL SELECT 'company', domain, name FROM comp WHERE CAST(regexp_extract(domain, '([0-9]+)', 1) AS INTEGER) % 3 <> 0""")
def k12_erase_companies(spark, sf):
    """Every third domain company erased; people who pointed there keep no company."""
    people, companies, _ = _ingest(spark, sf)
    ids = companies.filter(F.regexp_extract("domain", "([0-9]+)", 1).cast("int") % 3 == 0).select("id")
    c, p = upsert.erase_companies(companies, people, ids)
    named = c.select(F.col("id").alias("cid"), F.col("name").alias("company_name"))
    return (p.join(named, p["company_id"] == named["cid"], "left")
            .select(F.lit("person").alias("kind"), F.col("linkedin_profile").alias("key"), "company_name")
            .unionByName(c.filter(F.col("domain").isNotNull())
                         .select(F.lit("company").alias("kind"), F.col("domain").alias("key"), F.col("name").alias("company_name"))))


@register("k13_person_ingest", f"""WITH {_R2_PARTS}, ppl AS ({K1_AGG})
SELECT (SELECT count(*) FROM rec WHERE linkedin_profile IS NOT NULL) AS processed_people,
  (SELECT count(*) FROM ppl) AS people_rows,
  (SELECT count(*) FROM comp) + (SELECT count(*) FROM rec WHERE linkedin_profile IS NOT NULL
     AND nullif(company_domain, '') IS NULL AND nullif(company_name, '') IS NOT NULL) AS company_rows,
  (SELECT count(*) FROM (SELECT DISTINCT source_name, lower(trim(regexp_replace(source_query, '\\s+', ' ', 'g')))
     FROM rec WHERE linkedin_profile IS NOT NULL AND nullif(source_name, '') IS NOT NULL
       AND nullif(source_query, '') IS NOT NULL)) AS query_rows""")
def k13_person_ingest(spark, sf):
    """K13 totals of one ingest batch."""
    people, companies, queries, processed = upsert.person_ingest(_records(spark, sf), None, None, None,
                                                                 NOW, BATCH)
    def one(d, name):
        return d.agg(F.count(F.lit(1)).alias(name)).withColumn("_one", F.lit(1))
    return (processed.withColumn("_one", F.lit(1)).join(one(people, "people_rows"), "_one")
            .join(one(companies, "company_rows"), "_one").join(one(queries, "query_rows"), "_one")
            .drop("_one"))
