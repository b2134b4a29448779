"""Company-side queries: D (domains) and E (enrichment)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadframe.functions import legal
from leadframe.operators import domains, enrich, upsert, validate
from leadframe.plans import inputs
from leadframe.plans import sqlrules as R
from leadframe.plans.q_people import SUPPLIER_COMPANIES_SQL, _CKEY, _VALID, supplier_companies
from leadframe.plans.registry import BATCH, NOW, register
from leadframe.session import scratch_dir
from leadframe.sources.suffixes import DEFAULT_RULES, DEFAULT_RULES_TEXT, read_suffix_table

# ====================================================================== D


@register("d1_apex_domain", f"SELECT page_id, {R.apex('url', DEFAULT_RULES)} AS apex_domain FROM pages")
def d1_apex_domain(spark, sf):
    """D1 over every page URL."""
    pages = inputs.table(spark, sf, "pages").select("page_id", "url")
    return domains.with_apex_domain(pages, "url").select("page_id", "apex_domain")


@register("d1_apex_domain_by_table", f"SELECT page_id, {R.apex('url', DEFAULT_RULES)} AS apex_domain FROM pages")
def d1_apex_domain_by_table(spark, sf):
    """D1 over every page URL, with the rules as a table: a written list, read by Spark."""
    path = scratch_dir(spark, "suffixes")
    spark.createDataFrame([(x,) for x in DEFAULT_RULES_TEXT.split()], "value string").write.text(path)
    pages = inputs.table(spark, sf, "pages").select("page_id", "url")
    return domains.with_apex_domain_by_table(pages, "url", read_suffix_table(spark, path),
                                             country_second=DEFAULT_RULES.country_second,
                                             country_flat=DEFAULT_RULES.country_flat).select("page_id", "apex_domain")


def supplier_names(spark, sf):
    """Company names with umlauts, legal suffixes (also as substrings) and
    punctuation, from supplier."""
    s = inputs.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    ks = k.cast("string")
    v = k % 8
    name = (F.when(v == 0, F.concat(F.lit("Bäcker Söhne "), ks, F.lit(" GmbH")))
            .when(v == 1, F.concat(F.lit("Acme Agency "), ks))
            .when(v == 2, F.concat(F.lit("Straße "), ks, F.lit(" AG")))
            .when(v == 3, F.concat(F.lit("  Über Tech Inc. "), ks))
            .when(v == 4, F.concat(F.lit("Global Corp LLC "), ks))
            .when(v == 5, F.lit("X"))
            .when(v == 6, F.concat(F.lit("Nordic Ltd "), ks, F.lit(" (Group)")))
            .otherwise(F.concat(F.lit("Firm "), ks, F.lit(" SE & Co. KG"))))
    return s.select(k.alias("k"), name.alias("company"))


SUPPLIER_NAMES_SQL = """SELECT s_suppkey AS k, CASE s_suppkey % 8
  WHEN 0 THEN 'Bäcker Söhne ' || s_suppkey || ' GmbH' WHEN 1 THEN 'Acme Agency ' || s_suppkey
  WHEN 2 THEN 'Straße ' || s_suppkey || ' AG' WHEN 3 THEN '  Über Tech Inc. ' || s_suppkey
  WHEN 4 THEN 'Global Corp LLC ' || s_suppkey WHEN 5 THEN 'X'
  WHEN 6 THEN 'Nordic Ltd ' || s_suppkey || ' (Group)' ELSE 'Firm ' || s_suppkey || ' SE & Co. KG' END AS company
FROM supplier"""


@register("d2_clean_company_name", f"SELECT k, {R.clean_company_name('company')} AS clean_name "
                                   f"FROM ({SUPPLIER_NAMES_SQL})")
def d2_clean_company_name(spark, sf):
    return supplier_names(spark, sf).select("k", legal.clean_company_name("company").alias("clean_name"))


_GUESSES_SQL = f"""g AS (SELECT k, {R.clean_company_name('company')} AS c FROM ({SUPPLIER_NAMES_SQL})),
cand AS (SELECT k, unnest([c || '.com', c || '.de', c || '.io', c || '.ai', c || '.org',
    replace(c, ' ', '') || '.com', replace(c, ' ', '-') || '.com', replace(c, ' ', '') || '.de',
    replace(c, ' ', '') || '.io', replace(c, ' ', '') || '.ai']) AS domain,
  unnest(range(1, 11)) AS r FROM g WHERE c IS NOT NULL)"""


@register("d3_domain_candidates", f"""WITH {_GUESSES_SQL}
SELECT k, domain, CAST(row_number() OVER (PARTITION BY k ORDER BY min(r)) AS INTEGER) AS rank
FROM cand GROUP BY k, domain""")
def d3_domain_candidates(spark, sf):
    """D3: ordered distinct guesses per supplier name."""
    return domains.domain_candidates(supplier_names(spark, sf), "k", "company").select(
        "k", "domain", F.col("rank").cast("int").alias("rank"))


def live_domains(spark, sf):
    """Stand-in for the DNS/HTTP probe: the domains named by customers'
    websites and by even-numbered nations."""
    c = inputs.table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".com")).alias("domain"))
    n = inputs.table(spark, sf, "nation").filter(F.col("n_nationkey") % 2 == 0).select(
        F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"), F.lit(".com")).alias("domain"))
    return c.unionByName(n)


LIVE_SQL = """live AS (SELECT 'c' || c_custkey || '.com' AS domain FROM customer
  UNION SELECT 'nation' || n_nationkey || '.com' FROM nation WHERE n_nationkey % 2 = 0)"""


def nation_companies(spark, sf):
    n = inputs.table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("k"),
                    F.concat(F.initcap(F.replace(F.col("n_name"), F.lit("_"), F.lit(""))), F.lit(" GmbH"))
                    .alias("company"))


@register("d4_resolve_domains", f"""WITH {LIVE_SQL},
g AS (SELECT n_nationkey AS k, {R.clean_company_name("upper(substr(replace(n_name, '_', ''), 1, 1)) || lower(substr(replace(n_name, '_', ''), 2)) || ' GmbH'")} AS c FROM nation),
cand AS (SELECT k, unnest([c || '.com', c || '.de', c || '.io', c || '.ai', c || '.org']) AS domain,
  unnest(range(1, 6)) AS r FROM g WHERE c IS NOT NULL)
SELECT k, 'https://' || arg_min(cand.domain, r) AS website FROM cand JOIN live USING (domain) GROUP BY k""")
def d4_resolve_domains(spark, sf):
    """First live guess per nation-named company."""
    comp = nation_companies(spark, sf)
    cand = domains.domain_candidates(comp, "k", "company")
    return domains.resolve_domains(cand, live_domains(spark, sf), "k")


@register("d5_attach_company_domain", f"""WITH {LIVE_SQL}, cp AS ({inputs.CUSTOMER_PROFILES_SQL}),
a AS (SELECT ingest_seq, company, {R.apex("nullif(website, '')", DEFAULT_RULES)} AS apex FROM cp),
gs AS (SELECT ingest_seq, {R.clean_company_name('company')} AS c FROM a WHERE apex IS NULL AND nullif(company, '') IS NOT NULL),
cand AS (SELECT ingest_seq, unnest([c || '.com', c || '.de', c || '.io', c || '.ai', c || '.org']) AS domain,
  unnest(range(1, 6)) AS r FROM gs WHERE c IS NOT NULL),
hit AS (SELECT ingest_seq, arg_min(cand.domain, r) AS d FROM cand JOIN live USING (domain) GROUP BY ingest_seq)
SELECT a.ingest_seq, coalesce(a.apex, hit.d) AS company_domain,
  CASE WHEN hit.d IS NOT NULL THEN 'https://' || hit.d END AS company_website
FROM a LEFT JOIN hit USING (ingest_seq)""")
def d5_attach_company_domain(spark, sf):
    """D5 on customer profiles: website apex, else a live guess from the
    company (nation) name."""
    p = inputs.customer_profiles(spark, sf).select("ingest_seq", "company", "website")
    out = domains.attach_company_domain(p, live_domains(spark, sf))
    return out.select("ingest_seq", "company_domain", "company_website")


# ====================================================================== E
def companies_state(spark, sf, stored: bool = True):
    """Companies after a company ingest run (V13 then K4) of the supplier
    rows. ``stored``: written once and read back, as the enrichment jobs
    read the stored companies table."""
    from leadframe.session import materialize
    prep = validate.company_ingest_prep(supplier_companies(spark, sf))
    table, _ = upsert.persist_companies(None, prep.withColumn("source_name", F.lit("suppliers"))
                                        .withColumn("source_query", F.lit("all")), BATCH)
    return materialize(table, "companies") if stored else table


COMPANIES_SQL = f"""sc AS ({SUPPLIER_COMPANIES_SQL}),
v AS (SELECT * FROM sc WHERE {_VALID}),
d AS (SELECT * FROM v WHERE ingest_seq IN (SELECT min(ingest_seq) FROM v GROUP BY {_CKEY})),
c AS (SELECT ingest_seq, trim(Company) AS Company, trim(name) AS name,
        trim(Company_Website) AS Company_Website, trim(website) AS website, trim(domain) AS domain,
        CASE WHEN coalesce(nullif(Company_Domain, ''), nullif(domain, '')) IS NULL
              AND coalesce(nullif(Company_Website, ''), nullif(website, '')) IS NOT NULL
             THEN {R.apex("coalesce(nullif(trim(Company_Website), ''), nullif(trim(website), ''))", DEFAULT_RULES)}
             ELSE trim(Company_Domain) END AS Company_Domain FROM d),
k4 AS (SELECT ingest_seq, coalesce(nullif(Company, ''), nullif(name, '')) AS cname,
         coalesce(nullif(Company_Domain, ''), nullif(domain, '')) AS dom,
         coalesce(nullif(Company_Website, ''), nullif(website, '')) AS web FROM c
       WHERE coalesce(nullif(Company, ''), nullif(name, ''), nullif(Company_Domain, ''), nullif(domain, ''),
                      nullif(Company_Website, ''), nullif(website, '')) IS NOT NULL),
companies AS (SELECT dom AS domain, arg_max_null(coalesce(cname, dom, 'Unknown Company'), ingest_seq) AS name,
                arg_max(web, ingest_seq) AS website, min(ingest_seq) AS created_seq
              FROM k4 WHERE dom IS NOT NULL GROUP BY dom
              UNION ALL SELECT NULL, coalesce(cname, 'Unknown Company'), NULL, ingest_seq FROM k4 WHERE dom IS NULL)"""


@register("k4_persist_companies", f"WITH {COMPANIES_SQL} SELECT domain, name, website, created_seq FROM companies")
def k4_persist_companies(spark, sf):
    """K4: the supplier company rows through V13 and K2/K3."""
    return companies_state(spark, sf, stored=False).select("domain", "name", "website", "created_seq")


@register("e1_pending_companies", f"""WITH {COMPANIES_SQL}
SELECT name, domain, created_seq FROM companies ORDER BY name NULLS FIRST, created_seq LIMIT 50""")
def e1_pending_companies(spark, sf):
    """The next enrichment batch (50, the method default)."""
    return enrich.pending_companies(companies_state(spark, sf), 50).select("name", "domain", "created_seq")


def provided_forms(spark, sf):
    s = inputs.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    forms = ['"GmbH"', "GmbH (Germany)", "Aktiengesellschaft", "e. K.", "gmbh & co kg",
             "Gesellschaft mit beschränkter Haftung", "KG,", "Stiftung", "", None, "se", "'Limited' (UK)"]
    expr = None
    for i, f in enumerate(forms):
        val = F.lit(f).cast("string")
        expr = F.when(k % len(forms) == i, val) if expr is None else expr.when(k % len(forms) == i, val)
    return s.select(k.alias("k"), expr.alias("provided"))


PROVIDED_SQL = """SELECT s_suppkey AS k, CASE s_suppkey % 12 WHEN 0 THEN '"GmbH"' WHEN 1 THEN 'GmbH (Germany)'
  WHEN 2 THEN 'Aktiengesellschaft' WHEN 3 THEN 'e. K.' WHEN 4 THEN 'gmbh & co kg'
  WHEN 5 THEN 'Gesellschaft mit beschränkter Haftung' WHEN 6 THEN 'KG,' WHEN 7 THEN 'Stiftung' WHEN 8 THEN ''
  WHEN 9 THEN NULL WHEN 10 THEN 'se' ELSE '''Limited'' (UK)' END AS provided FROM supplier"""


@register("e2_canonical_legal_form", f"SELECT k, {R.canonical_legal_form('provided')} AS legal_form "
                                     f"FROM ({PROVIDED_SQL})")
def e2_canonical_legal_form(spark, sf):
    return provided_forms(spark, sf).select("k", legal.canonical_legal_form("provided").alias("legal_form"))


def legal_names(spark, sf):
    s = inputs.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    sufs = [" GmbH & Co. KG", " AG & Co KG", " KGaA", " GmbH", " AG", " SE", " UG (haftungsbeschränkt)",
            " OHG", " e.K.", ""]
    expr = None
    for i, x in enumerate(sufs):
        val = F.concat(F.col("s_name"), F.lit(x))
        expr = F.when(k % len(sufs) == i, val) if expr is None else expr.when(k % len(sufs) == i, val)
    return s.select(k.alias("k"), expr.alias("name"))


LEGAL_NAMES_SQL = """SELECT s_suppkey AS k, s_name || CASE s_suppkey % 10 WHEN 0 THEN ' GmbH & Co. KG'
  WHEN 1 THEN ' AG & Co KG' WHEN 2 THEN ' KGaA' WHEN 3 THEN ' GmbH' WHEN 4 THEN ' AG' WHEN 5 THEN ' SE'
  WHEN 6 THEN ' UG (haftungsbeschränkt)' WHEN 7 THEN ' OHG' WHEN 8 THEN ' e.K.' ELSE '' END AS name FROM supplier"""


@register("e3_legal_form_from_name", f"SELECT k, {R.legal_form_from_name('name')} AS legal_form "
                                     f"FROM ({LEGAL_NAMES_SQL})")
def e3_legal_form_from_name(spark, sf):
    return legal_names(spark, sf).select("k", legal.legal_form_from_name("name").alias("legal_form"))


@register("e4_derive_legal_form", f"""SELECT n.k, coalesce({R.legal_form_from_name('n.name')},
  {R.canonical_legal_form('p.provided')}) AS legal_form
FROM ({LEGAL_NAMES_SQL}) n JOIN ({PROVIDED_SQL}) p ON n.k = p.k""")
def e4_derive_legal_form(spark, sf):
    j = legal_names(spark, sf).join(provided_forms(spark, sf), "k")
    return j.select("k", legal.derive_legal_form("name", "provided").alias("legal_form"))


@register("e5_default_enrichment", f"""WITH {COMPANIES_SQL}
SELECT name AS company, CASE WHEN nullif(domain, '') IS NOT NULL THEN 'https://' || domain END AS website,
  false AS multinational, CAST(0 AS INTEGER) AS n_industries, created_seq FROM companies""")
def e5_default_enrichment(spark, sf):
    pend = enrich.pending_companies(companies_state(spark, sf), None)
    d = enrich.default_enrichment(pend).join(pend.select("id", "created_seq"), "id")
    return d.select("company", "website", "multinational", F.size("industries").alias("n_industries"),
                    "created_seq")


def results_for(pending):
    """Research answers for pending companies, derived from the rows: some
    claim a domain another company owns, some have no answer at all."""
    k = F.col("created_seq")
    dom_guess = F.concat(F.lit("firm"), (k % 40).cast("string"), F.lit(".de"))
    return pending.filter(k % 7 != 6).select(
        "id", F.col("name").alias("company"),
        F.when(k % 3 == 0, F.lit("GmbH (Germany)")).when(k % 3 == 1, F.lit("Aktiengesellschaft"))
         .alias("legal_form"),
        F.when(k % 3 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(F.concat(F.lit("Industry "), (k % 4).cast("string")))).alias("industries"),
        F.array(F.lit("Berlin")).alias("locations_germany"),
        (k % 2 == 0).alias("multinational"),
        F.concat(F.lit("https://www."), dom_guess, F.lit("/about")).alias("website"),
        F.when(k % 5 != 0, k * 10).cast("long").alias("size_employees"),
        F.array(F.lit("B2B")).alias("business_model_key_points"),
        F.array(F.lit("Parts")).alias("products_and_services"),
        F.array().cast("array<string>").alias("recent_news"))


@register("e6_missing_enrichment", f"""WITH {COMPANIES_SQL}
SELECT name, created_seq FROM companies WHERE created_seq % 7 = 6""")
def e6_missing_enrichment(spark, sf):
    """E6 (rows): pending companies without an answer; the job form raises."""
    pend = enrich.pending_companies(companies_state(spark, sf), None)
    return enrich.missing_enrichment(pend, results_for(pend)).select("name", "created_seq")


_E8_SQL = f"""{COMPANIES_SQL},
res AS (SELECT created_seq, 'firm' || (created_seq % 40) || '.de' AS web_apex FROM companies
        WHERE created_seq % 7 <> 6),
cl AS (SELECT p.created_seq, coalesce(nullif(p.domain, ''), r.web_apex) AS claimed
       FROM companies p JOIN res r USING (created_seq)),
cc AS (SELECT cl.created_seq, cl.claimed, o.created_seq AS owner FROM cl
      LEFT JOIN companies o ON o.domain = cl.claimed WHERE cl.claimed IS NOT NULL),
w AS (SELECT claimed, min(created_seq) AS winner FROM cc WHERE owner IS NULL GROUP BY claimed),
g AS (SELECT cc.created_seq, cc.claimed, coalesce(cc.owner = cc.created_seq OR (cc.owner IS NULL
        AND w.winner = cc.created_seq), false) AS accepted FROM cc LEFT JOIN w USING (claimed))"""


@register("e7_apply_enrichment", f"""WITH {_E8_SQL}
SELECT p.name, CASE WHEN r.created_seq IS NULL THEN p.domain WHEN g.accepted THEN g.claimed ELSE p.domain END AS domain,
  CASE WHEN r.created_seq IS NOT NULL THEN coalesce({R.legal_form_from_name('p.name')}, {R.canonical_legal_form(
      "CASE p.created_seq % 3 WHEN 0 THEN 'GmbH (Germany)' WHEN 1 THEN 'Aktiengesellschaft' END")}) END AS legal_form,
  CAST(CASE WHEN r.created_seq IS NULL THEN NULL WHEN p.created_seq % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS multinational,
  CASE WHEN r.created_seq IS NOT NULL AND p.created_seq % 5 <> 0 THEN p.created_seq * 10 END AS size_employees,
  CAST(CASE WHEN r.created_seq IS NULL THEN NULL WHEN p.created_seq % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_industries,
  CASE WHEN r.created_seq IS NULL THEN p.website ELSE 'https://www.firm' || (p.created_seq % 40) || '.de/about' END
    AS website,
  r.created_seq IS NOT NULL AS enriched, p.created_seq
FROM companies p LEFT JOIN res r USING (created_seq) LEFT JOIN g ON g.created_seq = p.created_seq""")
def e7_apply_enrichment(spark, sf):
    """E7 + E8: answers written onto every pending company."""
    comp = companies_state(spark, sf)
    pend = enrich.pending_companies(comp, None)
    out = enrich.apply_enrichment(comp, pend, results_for(pend), NOW)
    return out.select("name", "domain", "legal_form", "multinational", "size_employees",
                      F.size("industries").alias("n_industries"), "website",
                      F.col("last_enriched_at").isNotNull().alias("enriched"), "created_seq")


@register("e8_domain_guard", f"WITH {_E8_SQL} SELECT created_seq, claimed, accepted FROM g")
def e8_domain_guard(spark, sf):
    """Which claimed domains are written (owned elsewhere -> kept old)."""
    comp = companies_state(spark, sf)
    pend = enrich.pending_companies(comp, None)
    upd = pend.join(results_for(pend).select("id", "website"), "id")
    claims = upd.select("id", F.coalesce(F.nullif(F.col("domain"), F.lit("")),
                                         domains.apex_domain(F.col("website"), DEFAULT_RULES)).alias("claimed"))
    v = enrich.guard_domain_claims(comp, claims)
    return v.join(pend.select("id", "created_seq"), "id").select("created_seq", "claimed", "accepted")
