"""Text queries: X (extraction from search items, text facts) and M (model
answers, prompts, page excerpts)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe import fixed
from leadframe.functions import facts, names
from leadframe.functions.urls import canonical_profile_url
from leadframe.operators import extract, responses, similar
from leadframe.plans import inputs
from leadframe.plans.registry import register
from leadframe.session import materialize
from leadframe.sources.suffixes import DEFAULT_RULES
from leadframe.plans import sqlrules as R


# --------------------------------------------------------------- search items
def search_items(spark, sf):
    """One landed search item per customer: profile URLs in several
    spellings (some repeated, some not profiles), titles with and without
    names, metatags of three shapes, snippets with boilerplate and counts."""
    c = inputs.table(spark, sf, "customer")
    n = inputs.table(spark, sf, "nation")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    k = F.col("c_custkey")
    ks = k.cast("string")
    slug = F.concat(F.lit("cust-"), ks)
    link = (F.when(k % 11 == 0, F.concat(F.lit("https://example.com/in/"), slug))
            .when(k % 7 == 3, F.concat(F.lit("https://www.linkedin.com/in/cust-"), (k - 1).cast("string"), F.lit("/")))
            .when(k % 3 == 0, F.concat(F.lit("http://de.linkedin.com/in/"), slug, F.lit("/de?trk=x")))
            .otherwise(F.concat(F.lit("https://www.linkedin.com/in/"), slug, F.lit("/"))))
    cn, seg, nat = F.col("c_name"), F.col("c_mktsegment"), F.col("n_name")
    title = (F.when(k % 5 == 0, F.concat(cn, F.lit(" - "), seg, F.lit(" Manager - "), nat, F.lit(" | LinkedIn")))
             .when(k % 5 == 1, F.concat(cn, F.lit(" (@c"), ks, F.lit(") – Head of "), seg, F.lit(" | LinkedIn")))
             .when(k % 5 == 2, F.lit("LinkedIn"))
             .when(k % 5 == 3, F.concat(cn, F.lit(" | LinkedIn")))
             .otherwise(F.lit("")))
    mt = T.MapType(T.StringType(), T.StringType())
    tags = (F.when(k % 4 == 0, F.array(F.create_map(
                F.lit("og:title"), F.concat(cn, F.lit(" - Buyer at "), nat, F.lit(" | LinkedIn")),
                F.lit("og:description"), F.concat(F.lit("Experience: "), nat, F.lit(" Trading · Location: City "),
                                                  (k % 17).cast("string"), F.lit(" · 500+ connections")))))
            .when(k % 4 == 1, F.array(
                F.create_map(F.lit("profile:first_name"), F.concat(F.lit("Anna"), ks),
                             F.lit("profile:last_name"), F.lit("Kunde")),
                F.create_map(F.lit("og:description"), F.concat(F.lit("Currently working at "), nat,
                                                               F.lit(" GmbH. Based in Berlin")))))
            .when(k % 4 == 2, F.array().cast(T.ArrayType(mt))))
    follow = F.abs(F.floor(F.col("c_acctbal"))).cast("long").cast("string")
    snippet = F.concat(F.lit("Ca. "), follow, F.lit(" Follower · "), seg, F.lit(" · View "), cn,
                       F.lit("’s profile on LinkedIn, a professional community of 1 billion members. "),
                       F.when(k % 6 == 0, F.concat(F.lit("Mail c"), ks, F.lit("@firm"), (k % 9).cast("string"),
                                                   F.lit(".de. "))).otherwise(F.lit("")),
                       F.lit("Over "), (k % 30).cast("string"), F.lit(" years of experience."))
    html = F.when(k % 3 == 0, F.concat(F.lit("<b>"), (k % 900).cast("string"), F.lit(" followers</b>")))
    gr = F.struct(title.alias("title"), link.alias("link"), snippet.alias("snippet"), html.alias("htmlSnippet"),
                  F.lit("linkedin.com").alias("displayLink"),
                  F.when(k % 4 != 3, F.struct(tags.alias("metatags"))).alias("pagemap"))
    md = F.struct(k.cast("int").alias("position"), ((k / 10).cast("int") + 1).alias("page"),
                  F.concat(F.lit('site:linkedin.com/in "'), nat, F.lit('"')).alias("query_used"),
                  F.lit(1).alias("api_call_number"))
    return j.select(gr.alias("google_result"), md.alias("search_metadata"), k.alias("ingest_seq"))


def profile_answers(spark, sf):
    """Model answers for some items, in the shapes a chat model returns."""
    c = inputs.table(spark, sf, "customer")
    n = inputs.table(spark, sf, "nation")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    k = F.col("c_custkey")
    nat, seg = F.col("n_name"), F.col("c_mktsegment")
    content = (F.when(k % 4 == 0, F.concat(F.lit('{"current_position": "'), seg, F.lit(' buyer", "company": "'),
                                           nat, F.lit(' AG", "location": null}')))
               .when(k % 4 == 1, F.concat(F.lit('Sure: {"company": "'), nat,
                                          F.lit('", "follower_count": "1.2K"} done')))
               .when(k % 4 == 2, F.lit('{"company": "Y", "x": 1}'))
               .otherwise(F.lit('{"follower_count": 500}')))
    return j.select(k.alias("ingest_seq"), content.alias("content"))


ANSWERS_SQL = """SELECT c_custkey AS ingest_seq, CASE c_custkey % 4
  WHEN 0 THEN '{"current_position": "' || c_mktsegment || ' buyer", "company": "' || n_name || ' AG", "location": null}'
  WHEN 1 THEN 'Sure: {"company": "' || n_name || '", "follower_count": "1.2K"} done'
  WHEN 2 THEN '{"company": "Y", "x": 1}' ELSE '{"follower_count": 500}' END AS content
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""

_LINK_SQL = """CASE WHEN c_custkey % 11 = 0 THEN 'https://example.com/in/cust-' || c_custkey
  WHEN c_custkey % 7 = 3 THEN 'https://www.linkedin.com/in/cust-' || (c_custkey - 1) || '/'
  WHEN c_custkey % 3 = 0 THEN 'http://de.linkedin.com/in/cust-' || c_custkey || '/de?trk=x'
  ELSE 'https://www.linkedin.com/in/cust-' || c_custkey || '/' END"""
_CANON_SQL = f"""CASE WHEN c_custkey % 11 = 0 THEN NULL
  ELSE 'https://linkedin.com/in/' || regexp_extract({_LINK_SQL}, '/in/([^/?#]+)', 1) END"""
_TITLE_SQL = """CASE c_custkey % 5 WHEN 0 THEN c_name || ' - ' || c_mktsegment || ' Manager - ' || n_name || ' | LinkedIn'
  WHEN 1 THEN c_name || ' (@c' || c_custkey || ') – Head of ' || c_mktsegment || ' | LinkedIn'
  WHEN 2 THEN 'LinkedIn' WHEN 3 THEN c_name || ' | LinkedIn' ELSE '' END"""
_CUSTN = "FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"


# ====================================================================== X
@register("x1_canonical_url", f"SELECT c_custkey AS ingest_seq, {_CANON_SQL} AS profile_url {_CUSTN}")
def x1_canonical_url(spark, sf):
    it = search_items(spark, sf)
    return it.select("ingest_seq", canonical_profile_url(F.col("google_result.link")).alias("profile_url"))


@register("x2_keep_first_url", f"""SELECT min(c_custkey) AS ingest_seq, {_CANON_SQL} AS profile_url, count(*) AS n
{_CUSTN} WHERE c_custkey % 11 <> 0 GROUP BY ALL""")
def x2_keep_first_url(spark, sf):
    return extract.first_items(search_items(spark, sf)).select("profile_url", "ingest_seq", F.col("_n").alias("n"))


@register("x3_name_from_metatags", f"""SELECT c_custkey AS ingest_seq, CASE c_custkey % 4
  WHEN 0 THEN c_name WHEN 1 THEN 'Anna' || c_custkey || ' Kunde' END AS name {_CUSTN}""")
def x3_name_from_metatags(spark, sf):
    it = search_items(spark, sf)
    return it.select("ingest_seq", names.name_from_metatags(F.col("google_result.pagemap.metatags")).alias("name"))


_X4_SQL = r"""regexp_replace(regexp_replace(split_part(regexp_replace(regexp_replace({t},
  '(?i)\s*[-|]\s*LinkedIn.*$', ''), '\s*\([^)]*\)\s*', ' ', 'g'), '–', 1), '\s+', ' ', 'g'), '^ | $', '', 'g')"""


@register("x4_name_from_title", f"""SELECT c_custkey AS ingest_seq,
  CASE WHEN length(n) > 2 AND length(n) < 200 THEN n END AS name
FROM (SELECT c_custkey, {_X4_SQL.format(t=_TITLE_SQL)} AS n {_CUSTN})""")
def x4_name_from_title(spark, sf):
    it = search_items(spark, sf)
    return it.select("ingest_seq", names.name_from_title(F.col("google_result.title")).alias("name"))


def _x5_sql():
    name = f"""coalesce(CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Anna' || c_custkey || ' Kunde' END,
      CASE WHEN length(n4) > 2 AND length(n4) < 200 THEN n4 END)"""
    clean = "regexp_replace(title, '(?i)\\s*[-|]\\s*LinkedIn.*$', '')"
    removed = (f"trim(regexp_replace({clean}, '(?i)' || regexp_escape(nm) || '\\s*[–—\\-|]\\s*', '', 'g'))")
    falls = " ".join(
        f"WHEN contains({clean}, '{sep}') AND length(trim(substr({clean}, instr({clean}, '{sep}') + 1))) > 3 "
        f"THEN trim(substr({clean}, instr({clean}, '{sep}') + 1))" for sep in fixed.TITLE_SEPARATORS)
    return f"""SELECT ingest_seq, CASE WHEN title = '' OR nm IS NULL OR nm = '' THEN NULL
      WHEN contains({clean}, nm) AND length({removed}) > 3 AND length({removed}) < 200 THEN {removed}
      {falls} END AS headline
    FROM (SELECT c_custkey AS ingest_seq, {_TITLE_SQL} AS title, {name} AS nm
          FROM (SELECT *, {_X4_SQL.format(t=_TITLE_SQL)} AS n4 {_CUSTN}))"""


@register("x5_headline", _x5_sql())
def x5_headline(spark, sf):
    """X5 on item titles with the name X3/X4 found (rows-only: the name is
    used as a literal pattern per row)."""
    it = search_items(spark, sf)
    nm = F.coalesce(names.name_from_metatags(F.col("google_result.pagemap.metatags")),
                    names.name_from_title(F.col("google_result.title")))
    return it.select("ingest_seq", names.headline_from_title(F.col("google_result.title"), nm).alias("headline"))


_SNIPPET_SQL = """'Ca. ' || CAST(abs(floor(c_acctbal)) AS BIGINT) || ' Follower · ' || c_mktsegment || ' · View '
  || c_name || '’s profile on LinkedIn, a professional community of 1 billion members. '
  || CASE WHEN c_custkey % 6 = 0 THEN 'Mail c' || c_custkey || '@firm' || (c_custkey % 9) || '.de. ' ELSE '' END
  || 'Over ' || (c_custkey % 30) || ' years of experience.'"""


@register("x6_remove_boilerplate", f"""SELECT c_custkey AS ingest_seq, trim(regexp_replace(regexp_replace(
  regexp_replace({_SNIPPET_SQL}, '(?i)View [^\\n.!?]{{1,200}}?’s profile on LinkedIn[^.!?\\n]*[.!?]', ' ', 'g'),
  '[ \\t\\xA0]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS snippet {_CUSTN}""")
def x6_remove_boilerplate(spark, sf):
    it = search_items(spark, sf)
    return it.select("ingest_seq", facts.remove_boilerplate(F.col("google_result.snippet")).alias("snippet"))


_X7_SQL = (
    "SELECT page_id, CASE WHEN t = '' THEN t ELSE trim(regexp_replace(regexp_replace("
    "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, "
    "'&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), "
    "'&nbsp;', chr(160)), '&amp;', '&'), chr(9), ' '), chr(160), ' '), "
    r"'(?m)^[\s]*[\-\*•·–—›>\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}]+\s*', '', 'g'), ' {2,}', ' ', 'g')) "
    "END AS text "
    "FROM (SELECT page_id, html AS t FROM pages)")


@register("x7_normalize_text", _X7_SQL)
def x7_normalize_text(spark, sf):
    """X7 over the whole text of every page (entities, bullets, blanks)."""
    return inputs.table(spark, sf, "pages").select("page_id", facts.normalize_text("html").alias("text"))


def _first_hit_sql(text: str, patterns) -> str:
    whens = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN trim(regexp_extract({text}, '{p}', 1))"
                     for p in patterns)
    return f"CASE {whens} END"


_X6_SQL = f"""trim(regexp_replace(regexp_replace(regexp_replace({_SNIPPET_SQL},
  '(?i)View [^\\n.!?]{{1,200}}?’s profile on LinkedIn[^.!?\\n]*[.!?]', ' ', 'g'),
  '[ \\t\\xA0]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))"""


@register("x8_snippet_facts", f"""SELECT c_custkey AS ingest_seq,
  {_first_hit_sql("s", fixed.SNIPPET_LOCATION_PATTERNS)} AS location,
  {_first_hit_sql("s", fixed.SNIPPET_TITLE_PATTERNS)} AS title, trim(s) AS description
FROM (SELECT c_custkey, {_X6_SQL} AS s {_CUSTN})""")
def x8_snippet_facts(spark, sf):
    it = search_items(spark, sf)
    s = facts.snippet_facts(facts.remove_boilerplate(F.col("google_result.snippet")))
    return it.select("ingest_seq", s["location"].alias("location"), s["title"].alias("title"),
                     s["description"].alias("description"))


@register("x9_x12_metatag_facts", f"""SELECT c_custkey AS ingest_seq,
  CASE c_custkey % 4 WHEN 0 THEN 'Experience: ' || n_name || ' Trading · Location: City ' || (c_custkey % 17)
       || ' · 500+ connections' WHEN 1 THEN 'Currently working at ' || n_name || ' GmbH. Based in Berlin' END
    AS description,
  CASE WHEN c_custkey % 4 = 0 THEN 'Buyer at ' || n_name END AS current_position,
  CASE c_custkey % 4 WHEN 0 THEN n_name || ' Trading' WHEN 1 THEN n_name || ' GmbH' END AS company,
  CASE c_custkey % 4 WHEN 0 THEN 'City ' || (c_custkey % 17) WHEN 1 THEN 'Berlin' END AS location
{_CUSTN}""")
def x9_x12_metatag_facts(spark, sf):
    it = search_items(spark, sf)
    m = F.col("google_result.pagemap.metatags")
    return it.select("ingest_seq", facts.meta_description(m).alias("description"),
                     facts.meta_position(m).alias("current_position"), facts.meta_company(m).alias("company"),
                     facts.meta_location(m).alias("location"))


_PROPER_RE = r"(^|[^\pL\pN_])[A-Z][a-z]{2,}([^\pL\pN_]|$)"
_DOC_FACTS_SQL = r"""
WITH t AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents),
f AS (SELECT doc_id, t,
  nullif(regexp_extract(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 0), '') AS email,
  list_filter(regexp_extract_all(t, '(?:^|[^\pL\pN_])((?:[a-zA-Z0-9-]+\.)+[A-Za-z]{2,})(?:[^\pL\pN_]|$)', 1),
              lambda u: NOT (contains(lower(u), 'linkedin.com') OR contains(lower(u), 'twitter.com')
                OR contains(lower(u), 'x.com') OR contains(lower(u), 'facebook.com')
                OR contains(lower(u), 'instagram.com') OR contains(lower(u), 'youtube.com')
                OR contains(lower(u), 'medium.com') OR contains(lower(u), 'wikipedia.org')))[1] AS bare,
  regexp_extract(t, '(?:(?:\+|00)\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)?\d{3,4}[\s-]?\d{3,4}', 0) AS ph,
  coalesce(TRY_CAST(nullif(regexp_extract(t, '(?i)(\d{1,2})\s*\+?\s*years?\s+of\s+experience', 1), '') AS BIGINT),
           TRY_CAST(nullif(regexp_extract(t, '(?i)over\s+(\d{1,2})\s+years', 1), '') AS BIGINT),
           TRY_CAST(nullif(regexp_extract(t, '(?i)(\d{1,2})\s*\+\s*years', 1), '') AS BIGINT),
           TRY_CAST(nullif(regexp_extract(t, '(?i)(\d{1,2})\s*years', 1), '') AS BIGINT)) AS experience_years
  FROM t),
g AS (SELECT doc_id, t, email, CASE WHEN bare IS NOT NULL THEN 'https://' || bare END AS website, bare,
        CASE WHEN length(regexp_replace(ph, '[^0-9]', '', 'g')) >= 7 THEN trim(ph) END AS phone,
        experience_years FROM f),
s AS (SELECT doc_id, email, website, phone, experience_years, bare,
        unnest(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'))
          AS sent, generate_subscripts(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'),
          chr(1) || '|\n+'), 1) AS i FROM g),
k AS (SELECT doc_id, i, trim(sent, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sent FROM s
      WHERE trim(sent, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
        AND (email IS NULL OR NOT contains(trim(sent, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), email))
        AND (bare IS NULL OR NOT contains(lower(sent), bare))
        AND (phone IS NULL OR NOT contains(trim(sent, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), phone))
        AND (regexp_matches(sent, '\d') OR regexp_matches(sent, '""" + _PROPER_RE + r"""'))),
d AS (SELECT doc_id, sent, min(i) AS i FROM k GROUP BY doc_id, sent),
agg AS (SELECT doc_id, CAST(least(count(*), 5) AS INTEGER) AS salient_count, arg_min(sent, i) AS salient_first
        FROM d GROUP BY doc_id)
SELECT g.doc_id, g.email, g.website, g.phone, g.experience_years,
  coalesce(agg.salient_count, 0) AS salient_count, agg.salient_first
FROM g LEFT JOIN agg USING (doc_id)
"""


@register("x13_x17_text_facts", _DOC_FACTS_SQL)
def x13_x17_text_facts(spark, sf):
    """X13-X17 over the whole text of every document."""
    d = inputs.table(spark, sf, "documents").select("doc_id", F.col("text").alias("summary"))
    out = extract.with_summary_facts(d)
    t = facts.strip(F.col("summary"))
    sal = facts.salient_sentences(t, F.col("email"), F.col("website"), F.col("phone"))
    return out.select("doc_id", "email", "website", "phone", "experience_years",
                      F.coalesce(F.size(sal), F.lit(0)).alias("salient_count"),
                      F.get(sal, 0).alias("salient_first"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_BULLET_RE = r"(?m)^[\s]*[\-\*•·–—›>\x{2022}\x{2023}\x{25E6}\x{2043}\x{2219}]+\s*"
_X18_SQL = f"""
WITH t AS (SELECT conv_id, turn, trim(text, {_TRIM}) AS t FROM conversations),
s AS (SELECT conv_id, turn,
        unnest(string_split_regex(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+')) AS sent,
        generate_subscripts(string_split_regex(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'),
          chr(1) || '|\\n+'), 1) AS i FROM t),
k AS (SELECT conv_id, turn, i, trim(sent, {_TRIM}) AS sent FROM s
      WHERE trim(sent, {_TRIM}) <> '' AND (regexp_matches(sent, '\\d') OR regexp_matches(sent, '{_PROPER_RE}'))),
d AS (SELECT conv_id, turn, sent, min(i) AS i FROM k GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM d) WHERE r <= 5),
b AS (SELECT conv_id, turn, i, trim(regexp_replace(regexp_replace(
        {" ".join("regexp_replace(" for _ in fixed.BOILERPLATE_PATTERNS)}sent,
        {", ".join("'(?i)" + p.replace("'", "''") + "', ' ', 'g')" for p in fixed.BOILERPLATE_PATTERNS)},
        '[ \\t\\xA0]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_TRIM}) AS s FROM top),
c AS (SELECT conv_id, turn, i, trim(regexp_replace(regexp_replace(replace(replace(s, chr(9), ' '), chr(160), ' '),
        '{_BULLET_RE}', '', 'g'), ' {{2,}}', ' ', 'g'), {_TRIM}) AS c FROM b),
cd AS (SELECT conv_id, turn, c, min(i) AS i FROM c WHERE length(c) >= 2 GROUP BY ALL),
agg AS (SELECT conv_id, turn, string_agg(c, ' | ' ORDER BY i) AS so FROM
        (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r FROM cd) WHERE r <= 5 GROUP BY ALL),
has AS (SELECT DISTINCT conv_id, turn FROM top)
SELECT t.conv_id, t.turn, CASE WHEN has.conv_id IS NOT NULL THEN coalesce(agg.so, '') END AS summary_other
FROM t LEFT JOIN has USING (conv_id, turn) LEFT JOIN agg USING (conv_id, turn)"""


@register("x18_clean_sentences", _X18_SQL)
def x18_clean_sentences(spark, sf):
    """X18 on the salient sentences of conversation turns (rows-only)."""
    c = inputs.table(spark, sf, "conversations")
    t = facts.strip(F.col("text"))
    sal = facts.salient_sentences(t, F.lit(None).cast("string"), F.lit(None).cast("string"),
                                  F.lit(None).cast("string"))
    return c.select("conv_id", "turn", F.array_join(facts.clean_sentences(sal), " | ").alias("summary_other"))


@register("x19_follower_connection_counts", f"""SELECT c_custkey AS ingest_seq,
  CAST(abs(floor(c_acctbal)) AS BIGINT)::VARCHAR AS follower_count,
  CASE WHEN c_custkey % 4 = 0 THEN '500+' END AS connection_count {_CUSTN}""")
def x19_follower_connection_counts(spark, sf):
    it = search_items(spark, sf)
    g = "google_result"
    return it.select("ingest_seq",
                     facts.follower_count_in(F.col(f"{g}.snippet"), F.col(f"{g}.htmlSnippet")).alias("follower_count"),
                     facts.connection_count_in(F.col(f"{g}.pagemap.metatags")).alias("connection_count"))


def extracted(spark, sf, company_from_text=False):
    ans = responses.parse_profile_responses(profile_answers(spark, sf))
    return extract.extract_profiles(search_items(spark, sf), ans, company_from_text)


@register("x20_extract_profiles")
def x20_extract_profiles(spark, sf):
    """The whole extraction job (X1-X20) with parsed model answers."""
    p, _ = extracted(spark, sf)
    return p.select("ingest_seq", "name", "profile_url", "summary", "current_position", "company", "location",
                    "follower_count", "connection_count", "email", "website", "phone", "experience_years",
                    F.array_join("summary_other", " | ").alias("summary_other"))


_SURV_SQL = f"""WITH it AS (SELECT c_custkey AS k, {_CANON_SQL} AS url,
   (c_custkey % 4 IN (2, 3) AND c_custkey % 5 = 4) AS nameless {_CUSTN}),
s AS (SELECT url, min(k) AS k, count(*) AS n FROM it WHERE url IS NOT NULL GROUP BY url)"""


@register("x21_extraction_metrics", f"""{_SURV_SQL}
SELECT count(*) FILTER (WHERE NOT it.nameless) AS successful_extractions,
  count(*) FILTER (WHERE it.nameless) + (SELECT count(*) FROM it WHERE url IS NULL) AS failed_extractions,
  CAST(sum(s.n - 1) AS BIGINT) AS duplicate_profiles_removed
FROM s JOIN it ON it.k = s.k""")
def x21_extraction_metrics(spark, sf):
    _, m = extracted(spark, sf)
    return m


@register("x22_similar_texts", r"""WITH p AS (SELECT a.doc_id, a.text AS t1, b.text AS t2 FROM documents a
  JOIN documents b ON b.doc_id = a.doc_id + 1),
q AS (SELECT doc_id, t1, t2, CASE WHEN length(t1) <= length(t2) THEN t1 ELSE t2 END AS sh,
        CASE WHEN length(t1) >= length(t2) THEN t1 ELSE t2 END AS lo FROM p),
w AS (SELECT doc_id, t1, t2, sh,
        list_distinct(list_filter(string_split_regex(lower(sh), '\s+'), lambda x: x <> '')) AS ws,
        list_distinct(list_filter(string_split_regex(lower(lo), '\s+'), lambda x: x <> '')) AS wl FROM q)
SELECT doc_id, CASE WHEN t1 IS NULL OR t2 IS NULL OR t1 = '' OR t2 = '' THEN false
  WHEN length(sh) < 10 THEN trim(t1) = trim(t2) WHEN len(ws) = 0 THEN false
  ELSE len(list_intersect(ws, wl)) / len(ws) >= 0.8 END AS similar FROM w""")
def x22_similar_texts(spark, sf):
    """X22 on each document and the next one (one pair per row)."""
    # a text's words are taken once, and cross the network instead of it
    d = materialize(inputs.table(spark, sf, "documents").select("doc_id", facts.similar_parts(F.col("text")).alias("a")), "similar-parts")
    b = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return d.join(b, "doc_id").select("doc_id", facts.is_similar_parts(F.col("a"), F.col("b")).alias("similar"))


# the texts (class by class) and the links between them; sizes are those of the stripped texts
_X22_PAIRS = r"""t AS (SELECT doc_id, trim(text, E' \t\n\r\x0b\x0c') AS text FROM documents),
c AS (SELECT text, min(doc_id) AS k, length(text) AS chars,
        list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS words
      FROM t WHERE text <> '' GROUP BY text),
w AS (SELECT k, chars, len(words) AS n, unnest(words) AS word FROM c WHERE chars >= 10),
l AS (SELECT a.k AS a, b.k AS b FROM w a JOIN w b ON a.word = b.word AND a.k <> b.k AND a.chars <= b.chars
      GROUP BY a.k, b.k, a.n HAVING 5 * count(*) >= 4 * a.n),
u AS (SELECT DISTINCT CASE WHEN x.chars = y.chars THEN least(a, b) ELSE a END AS shorter_id,
        CASE WHEN x.chars = y.chars THEN greatest(a, b) ELSE b END AS longer_id
      FROM l JOIN c x ON x.k = a JOIN c y ON y.k = b)"""


@register("x22_similar_classes", f"""WITH {_X22_PAIRS},
n AS (SELECT k, count(*) AS n FROM (SELECT unnest([shorter_id, longer_id]) AS k FROM u) GROUP BY k)
SELECT t.doc_id, c.k AS class_id, coalesce(n.n, 0) AS n_links
FROM t LEFT JOIN c ON t.text = c.text LEFT JOIN n ON n.k = c.k""")
def x22_similar_classes(spark, sf):
    """X22 over all documents: each one's class of equal texts and how many other texts are similar."""
    return similar.similar_texts(inputs.table(spark, sf, "documents"), "doc_id", "text")[0]


@register("x22_similar_links", f"WITH {_X22_PAIRS} SELECT shorter_id, longer_id FROM u")
def x22_similar_links(spark, sf):
    """X22 over all documents: the links between classes."""
    return similar.similar_texts(inputs.table(spark, sf, "documents"), "doc_id", "text")[1]


# what a snippet says of company and place, by the customer's number: the metatag's
# value, its words in another order, some of them, another value, a short one, none
_X23_COMPANY = ["n_name || ' Trading'", "'Trading ' || n_name", "'Group ' || n_name || ' Trading'", "'Other Firm ' || c_custkey", "'ab'",
                "NULL", "''", "'Nobody'"]
_X23_PLACE = ["'City ' || (c_custkey % 17)", "'Berlin'", "'  Berlin '", "'Berlin Mitte Ost ' || c_custkey", "NULL"]
_X23_META = """CASE c_custkey % 4 WHEN 0 THEN 'Buyer at ' || n_name END AS current_position,
  CASE c_custkey % 4 WHEN 0 THEN n_name || ' Trading' WHEN 1 THEN n_name || ' GmbH' END AS company,
  CASE c_custkey % 4 WHEN 0 THEN 'City ' || (c_custkey % 17) WHEN 1 THEN 'Berlin' END AS location"""


def _x23_case(values):
    return f"CASE c_custkey % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _x23_sql():
    def similar(a, b):
        words = lambda t: f"list_distinct(list_filter(string_split_regex(lower({t}), '\\s+'), lambda x: x <> ''))"
        short, long = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) >= length({b}) THEN {a} ELSE {b} END"
        return f"""CASE WHEN {a} = '' OR {b} = '' THEN false WHEN least(length({a}), length({b})) < 10 THEN trim({a}) = trim({b})
      WHEN len({words(short)}) = 0 THEN false ELSE len(list_intersect({words(short)}, {words(long)})) / len({words(short)}) >= 0.8 END"""

    def kept(snippet, meta):
        return f"CASE WHEN length(trim({snippet})) > 2 AND NOT {similar(snippet, f"coalesce({meta}, 'None')")} THEN {snippet} END"
    return f"""SELECT ingest_seq, CASE WHEN length(current_position) > 2 THEN current_position END AS current_position, company, location,
  {kept("sc", "company")} AS snippet_company, {kept("sl", "location")} AS snippet_location
FROM (SELECT c_custkey AS ingest_seq, {_X23_META}, {_x23_case(_X23_COMPANY)} AS sc, {_x23_case(_X23_PLACE)} AS sl {_CUSTN})"""


@register("x23_unique_facts", _x23_sql())
def x23_unique_facts(spark, sf):
    """X23 with all its values: metatag facts plus snippet facts not similar to them."""
    it = search_items(spark, sf)
    m = F.col("google_result.pagemap.metatags")
    c = inputs.table(spark, sf, "customer").join(inputs.table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"), "left")
    said = c.select(F.col("c_custkey").alias("ingest_seq"), F.expr(_x23_case(_X23_COMPANY)).alias("sc"),
                    F.expr(_x23_case(_X23_PLACE)).alias("sl"))
    s = facts.snippet_facts(facts.remove_boilerplate(F.col("google_result.snippet")))
    u = facts.unique_facts(facts.meta_position(m), facts.meta_company(m), facts.meta_location(m),
                           facts.meta_description(m), s["title"], F.col("sc"), F.col("sl"), s["description"])
    return it.join(said, "ingest_seq").select("ingest_seq", *[F.try_element_at(u, F.lit(k)).alias(k) for k in (
        "current_position", "company", "location", "snippet_company", "snippet_location")])


_X24_TAIL = """CASE c_custkey % 6 WHEN 0 THEN chr(10) || 'Manager, former at Old ' || c_custkey || ', now at New ' || c_custkey || ' · x'
  WHEN 1 THEN chr(10) || 'Berufserfahrung: Haus ' || c_custkey || ' | y' WHEN 2 THEN chr(10) || 'lead, ex-@Past' || c_custkey || '; @Now ' || c_custkey
  WHEN 3 THEN chr(10) || 'previously von Alt AG; buyer | Neu ' || c_custkey WHEN 4 THEN chr(10) || 'of lower case' ELSE '' END"""


def _x24_sql():
    # RE2 has no look-behind: the words that rule a match out are an optional
    # first group, and the first match without them counts
    def first(lead):
        found = f"regexp_extract_all(t, '(former\\s|previously\\s|ex-)?{lead}([A-ZÄÖÜ][^·•|\\n,;]*)'"
        names = f"list_transform(range(1, len({found}, 1)) + 1), lambda i: CASE WHEN coalesce({found}, 1)[i], '') = '' THEN trim({found}, 2)[i]) END)"
        return f"list_filter({names}, lambda x: x IS NOT NULL)[1]"
    label = "nullif(trim(regexp_extract(t, '(?i)(?:Experience|Berufserfahrung):\\s*([^·•|\\n]+)', 1)), '')"
    def longer(x):
        return f"CASE WHEN length({x}) > 2 THEN {x} END"
    return f"""WITH d AS (SELECT c_custkey, {_SNIPPET_SQL} || CASE c_custkey % 4
    WHEN 0 THEN chr(10) || 'Experience: ' || n_name || ' Trading · Location: City ' || (c_custkey % 17) || ' · 500+ connections'
    WHEN 1 THEN chr(10) || 'Currently working at ' || n_name || ' GmbH. Based in Berlin' ELSE '' END || {_X24_TAIL} AS t {_CUSTN})
SELECT c_custkey AS ingest_seq, coalesce({longer(label)}, {longer(first("\\b(?:at|bei|of|von)\\s+"))},
  {longer(first("(?:@|\\|)\\s*"))}) AS company FROM d"""


@register("x24_company_from_text", _x24_sql())
def x24_company_from_text(spark, sf):
    """X24 on item snippets and descriptions, with and without the words that rule a company out."""
    it = search_items(spark, sf)
    tail = F.expr(_X24_TAIL.replace("c_custkey", "ingest_seq").replace("chr(10)", "'\\n'"))
    t = F.concat(F.concat_ws("\n", F.col("google_result.snippet"),
                             facts.meta_description(F.col("google_result.pagemap.metatags"))), tail)
    return it.select("ingest_seq", facts.company_from_text(t).alias("company"))


# ====================================================================== M
_ALLOWED = "[" + ", ".join(f"'{f}'" for f in fixed.PROFILE_ANSWER_FIELDS) + "]"
_M1_SQL = f"""WITH a AS ({ANSWERS_SQL}),
s AS (SELECT ingest_seq, trim(content) AS s FROM a),
b AS (SELECT ingest_seq, CASE WHEN instr(s, '{{') > 0 AND length(s) - instr(reverse(s), '}}') + 1 > instr(s, '{{')
        AND instr(reverse(s), '}}') > 0
      THEN substr(s, instr(s, '{{'), length(s) - instr(reverse(s), '}}') + 1 - instr(s, '{{') + 1) END AS j FROM s),
v AS (SELECT ingest_seq, j, coalesce(json_valid(j) AND json_type(j) = 'OBJECT'
        AND list_has_all({_ALLOWED}, json_keys(j))
        AND {" AND ".join(f"coalesce(json_type(j, '$.{f}') IN ('VARCHAR', 'NULL'), true)" for f in fixed.PROFILE_ANSWER_FIELDS)},
        false) AS ok FROM b)
SELECT ingest_seq, ok AS parse_ok,
  CASE WHEN ok THEN json_extract_string(j, '$.company') END AS company,
  CASE WHEN ok THEN json_extract_string(j, '$.current_position') END AS current_position,
  CASE WHEN ok THEN json_extract_string(j, '$.follower_count') END AS follower_count FROM v"""


@register("m1_parse_profile_responses", _M1_SQL)
def m1_parse_profile_responses(spark, sf):
    p = responses.parse_profile_responses(profile_answers(spark, sf))
    return p.select("ingest_seq", "parse_ok", "company", "current_position", "follower_count")


def company_answers(spark, sf):
    s = inputs.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    nm = F.col("s_name")
    body = F.concat(F.lit('{"Company": "'), nm, F.lit('", "Industries": ["Parts", "Trade"], "Size_Employees": '),
                    (k * 3).cast("string"), F.lit(', "Multinational": true}'))
    text = (F.when(k % 5 == 0, body)
            .when(k % 5 == 1, F.concat(F.lit("Here you go:\n```json\n"), body, F.lit("\n```\n")))
            .when(k % 5 == 2, F.concat(F.lit("Result: "), body, F.lit(" (end)")))
            .when(k % 5 == 3, F.concat(F.lit('{"company": "'), nm, F.lit('", "website": "https://s'),
                                       k.cast("string"), F.lit('.de", "size_employees": 12}')))
            .otherwise(F.concat(F.lit('{"Company": "'), nm, F.lit('", "Founded": 1990}'))))
    return s.select(k.alias("k"), text.alias("text"))


_COMPANY_ANSWERS_SQL = """SELECT s_suppkey AS k, CASE s_suppkey % 5
  WHEN 0 THEN '{"Company": "' || s_name || '", "Industries": ["Parts", "Trade"], "Size_Employees": ' || (s_suppkey * 3)
       || ', "Multinational": true}'
  WHEN 1 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || '{"Company": "' || s_name
       || '", "Industries": ["Parts", "Trade"], "Size_Employees": ' || (s_suppkey * 3) || ', "Multinational": true}'
       || chr(10) || '```' || chr(10)
  WHEN 2 THEN 'Result: {"Company": "' || s_name || '", "Industries": ["Parts", "Trade"], "Size_Employees": '
       || (s_suppkey * 3) || ', "Multinational": true} (end)'
  WHEN 3 THEN '{"company": "' || s_name || '", "website": "https://s' || s_suppkey || '.de", "size_employees": 12}'
  ELSE '{"Company": "' || s_name || '", "Founded": 1990}' END AS text FROM supplier"""
_M2_KEYS = "[" + ", ".join(f"'{n}', '{a}'" for n, a, _ in fixed.COMPANY_ANSWER_FIELDS) + "]"


@register("m2_parse_company_responses", f"""WITH a AS ({_COMPANY_ANSWERS_SQL}),
j AS (SELECT k, CASE WHEN json_valid(text) THEN text
      WHEN json_valid(regexp_extract(text, '```(?:json)?\\n([\\s\\S]*?)\\n```', 1))
        THEN regexp_extract(text, '```(?:json)?\\n([\\s\\S]*?)\\n```', 1)
      ELSE substr(text, instr(text, '{{'), length(text) - instr(reverse(text), '}}') + 1 - instr(text, '{{') + 1)
      END AS j FROM a),
v AS (SELECT k, j, coalesce(json_valid(j) AND json_type(j) = 'OBJECT' AND list_has_all({_M2_KEYS}, json_keys(j)),
        false) AS ok FROM j)
SELECT k, ok AND coalesce(json_extract_string(j, '$.Company'), json_extract_string(j, '$.company')) IS NOT NULL
    AS parse_ok,
  CASE WHEN ok THEN coalesce(json_extract_string(j, '$.Company'), json_extract_string(j, '$.company')) END AS company,
  CASE WHEN ok THEN CAST(coalesce(json_extract(j, '$.Size_Employees'), json_extract(j, '$.size_employees'))
    AS BIGINT) END AS size_employees,
  CASE WHEN ok THEN coalesce(json_extract_string(j, '$.Website'), json_extract_string(j, '$.website')) END AS website,
  CASE WHEN ok THEN CAST(coalesce(json_array_length(j, '$.Industries'), json_array_length(j, '$.industries'))
    AS INTEGER) END AS n_industries,
  CASE WHEN ok THEN CAST(coalesce(json_extract(j, '$.Multinational'), json_extract(j, '$.multinational')) AS BOOLEAN)
    END AS multinational
FROM v""")
def m2_parse_company_responses(spark, sf):
    """M2 on five answer shapes (raw, fenced, prose around braces, field
    names, an unknown key)."""
    p = responses.parse_company_responses(company_answers(spark, sf))
    return p.select("k", "parse_ok", "company", "size_employees", "website",
                    F.size("industries").alias("n_industries"), "multinational")


def raw_answer_fields(spark, sf):
    c = inputs.table(spark, sf, "customer")
    k = F.col("c_custkey")
    pos = (F.when(k % 5 == 0, F.lit("null")).when(k % 5 == 1, F.lit(" N/A ")).when(k % 5 == 2, F.lit("x"))
           .when(k % 5 == 3, F.concat(F.lit("  Buyer "), k.cast("string"), F.lit(" "))))
    return c.select(k.alias("k"), pos.alias("current_position"), F.col("c_mktsegment").alias("company"),
                    F.when(k % 2 == 0, F.lit("None")).otherwise(F.lit("Berlin")).alias("location"),
                    F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("1.2K")).alias("follower_count"),
                    F.lit("500+").alias("connection_count"))


@register("m3_clean_response_fields", """SELECT c_custkey AS k,
  CASE c_custkey % 5 WHEN 3 THEN 'Buyer ' || c_custkey END AS current_position, c_mktsegment AS company,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'Berlin' END AS location,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '1.2K' END AS follower_count, '500+' AS connection_count
FROM customer""")
def m3_clean_response_fields(spark, sf):
    return responses.clean_response_fields(raw_answer_fields(spark, sf))


PROMPT_TEMPLATE = "Name: {{NAME}}\nTitle: {{TITLE}}\nSummary: {{SUMMARY}}\nReturn JSON only."


@register("m4_build_profile_prompts", f"""SELECT c_custkey AS ingest_seq, sha256('Name: ' || c_name || chr(10)
  || 'Title: ' || {_TITLE_SQL} || chr(10) || 'Summary: Segment ' || c_mktsegment || chr(10) || chr(10)
  || 'Google Snippet: ' || {_SNIPPET_SQL} || chr(10) || 'Return JSON only.') AS prompt_hash {_CUSTN}""")
def m4_build_profile_prompts(spark, sf):
    """M4 over every search item (name = customer name, title, snippet)."""
    c = inputs.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    it = search_items(spark, sf).select("ingest_seq", F.col("google_result.title").alias("title"),
                                        F.col("google_result.snippet").alias("snippet"))
    j = it.join(c, it["ingest_seq"] == c["c_custkey"]).select(
        "ingest_seq", F.col("c_name").alias("name"), "title", "snippet",
        F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("summary"))
    return responses.build_profile_prompts(j, PROMPT_TEMPLATE).select("ingest_seq", "prompt_hash")


def homepage_items(spark, sf):
    """Search items for company homepages from pages: ten pages per company,
    in turn; some display hosts are social sites."""
    p = inputs.table(spark, sf, "pages")
    host = F.regexp_extract(F.col("url"), "^[a-z]+://([^/?#]+)", 1)
    return p.select(F.floor(F.col("page_id") / 10).alias("company"), F.col("url").alias("link"),
                    F.when(F.col("page_id") % 6 == 0, F.lit("www.linkedin.com")).otherwise(host).alias("displayLink"),
                    (F.col("page_id") % 10 + 1).alias("position"))


def _m5_sql():
    m6 = _M6_SQL.replace("4000) AS excerpt FROM pages", "4000) AS excerpt, url FROM pages")
    return f"""WITH it AS (SELECT page_id // 10 AS company, url AS link,
   CASE WHEN page_id % 6 = 0 THEN 'www.linkedin.com' ELSE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS dl,
   CAST(page_id % 10 + 1 AS BIGINT) AS position FROM pages),
ok AS (SELECT company, link, position, {R.apex('link', DEFAULT_RULES)} AS apex FROM it
       WHERE position <= 5 AND nullif(link, '') IS NOT NULL AND NOT (contains(lower(dl), 'linkedin.com')
         OR contains(lower(dl), 'twitter.com') OR contains(lower(dl), 'facebook.com')
         OR contains(lower(dl), 'instagram.com'))),
hp AS (SELECT company AS id, arg_min(link, position) AS homepage_url, arg_min(apex, position) AS h_apex
       FROM ok WHERE apex IS NOT NULL GROUP BY company),
ex AS ({m6}),
j AS (SELECT id, 'Company ' || id AS name, CASE WHEN id % 3 = 0 THEN 'known.de' END AS domain, h_apex,
        CASE WHEN id % 3 <> 0 THEN homepage_url END AS homepage_url FROM hp),
k AS (SELECT j.*, ex.excerpt FROM j LEFT JOIN ex ON ex.url = j.homepage_url),
m AS (SELECT id, 'Research the company.' || chr(10) || chr(10) || 'Target company: ' || name || '. Domain: '
        || coalesce(nullif(domain, ''), h_apex, 'unknown')
        || CASE WHEN nullif(homepage_url, '') IS NOT NULL AND nullif(excerpt, '') IS NOT NULL
           THEN chr(10) || 'Website URL: ' || homepage_url || chr(10) || 'Website excerpt (truncated):' || chr(10)
                || excerpt || chr(10) ELSE '' END AS msg FROM k)
SELECT id, sha256(msg) AS message_hash, CAST(length(msg) AS INTEGER) AS n FROM m"""


def m5_build_company_prompts(spark, sf):
    """M5: companies without a domain get their homepage (M7) and its excerpt
    (M6) into the prompt."""
    hp = responses.pick_homepage(homepage_items(spark, sf)).withColumnRenamed("company", "id")
    comp = hp.select("id").withColumn("name", F.concat(F.lit("Company "), F.col("id").cast("string"))) \
             .withColumn("domain", F.when(F.col("id") % 3 == 0, F.lit("known.de")))
    ex = responses.page_excerpts(inputs.table(spark, sf, "pages")).select("url", "excerpt")
    out = responses.build_company_prompts(comp, "Research the company.", hp, ex)
    return out.select("id", F.sha2("user_message", 256).alias("message_hash"), F.length("user_message").alias("n"))


_M6_SQL = r"""SELECT page_id, left(trim(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
      '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'),
      '(?s)<[^>]*>', ' ', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''),
    '&nbsp;', ' '), '&amp;', '&'),
  '\s+', ' ', 'g')), 4000) AS excerpt FROM pages"""


register("m5_build_company_prompts", _m5_sql())(m5_build_company_prompts)


@register("m6_page_excerpts", _M6_SQL)
def m6_page_excerpts(spark, sf):
    """M6 over every page's whole HTML."""
    return responses.page_excerpts(inputs.table(spark, sf, "pages")).select("page_id", "excerpt")


@register("m7_pick_homepage", f"""WITH it AS (SELECT page_id // 10 AS company, url AS link,
   CASE WHEN page_id % 6 = 0 THEN 'www.linkedin.com' ELSE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS dl,
   CAST(page_id % 10 + 1 AS BIGINT) AS position FROM pages),
ok AS (SELECT company, link, position, {R.apex('link', DEFAULT_RULES)} AS apex FROM it
       WHERE position <= 5 AND nullif(link, '') IS NOT NULL AND NOT (contains(lower(dl), 'linkedin.com')
         OR contains(lower(dl), 'twitter.com') OR contains(lower(dl), 'facebook.com')
         OR contains(lower(dl), 'instagram.com')))
SELECT company, arg_min(link, position) AS homepage_url, arg_min(apex, position) AS apex
FROM ok WHERE apex IS NOT NULL GROUP BY company""")
def m7_pick_homepage(spark, sf):
    return responses.pick_homepage(homepage_items(spark, sf))


def url_answers(spark, sf):
    c = inputs.table(spark, sf, "customer")
    k = F.col("c_custkey")
    ks = k.cast("string")
    t = (F.when(k % 4 == 0, F.concat(F.lit("Official site: https://www.c"), ks, F.lit(".com")))
         .when(k % 4 == 1, F.lit("I am not sure about this one."))
         .when(k % 4 == 2, F.concat(F.lit("See https://linkedin.com/company/x and https://acme"), ks,
                                    F.lit(".de/about")))
         .otherwise(F.lit("https://en.wikipedia.org/wiki/X")))
    return c.select(k.alias("k"), t.alias("content"))


@register("m8_urls_from_answers", """WITH a AS (SELECT c_custkey AS k, CASE c_custkey % 4
    WHEN 0 THEN 'Official site: https://www.c' || c_custkey || '.com' WHEN 1 THEN 'I am not sure about this one.'
    WHEN 2 THEN 'See https://linkedin.com/company/x and https://acme' || c_custkey || '.de/about'
    ELSE 'https://en.wikipedia.org/wiki/X' END AS content FROM customer)
SELECT k, CASE WHEN contains(lower(content), 'not sure') OR contains(lower(content), 'unknown')
  OR contains(lower(content), 'cannot') OR contains(lower(content), 'don''t know')
  OR contains(lower(content), 'unclear') OR contains(lower(content), 'not found')
  OR contains(lower(content), 'confident') THEN NULL
  ELSE 'https://' || list_filter(regexp_extract_all(content, 'https?://(?:www\\.)?([a-zA-Z0-9-]+\\.[a-zA-Z]{2,})', 1),
    lambda h: NOT (contains(lower(h), 'wikipedia') OR contains(lower(h), 'linkedin') OR contains(lower(h), 'facebook')
      OR contains(lower(h), 'twitter') OR contains(lower(h), 'crunchbase') OR contains(lower(h), 'xing')))[1]
  END AS website FROM a""")
def m8_urls_from_answers(spark, sf):
    return responses.urls_from_answers(url_answers(spark, sf)).select("k", "website")


@register("m9_audit_responses", """SELECT 'follower_count without keyword' AS violation, count(*) AS n
FROM customer WHERE c_custkey % 4 = 1 HAVING count(*) > 0""")
def m9_audit_responses(spark, sf):
    """M9 (rows-only): the parsed profile answers checked against the item
    text; report of violations."""
    ans = responses.parse_profile_responses(profile_answers(spark, sf))
    it = search_items(spark, sf).select("ingest_seq", F.concat_ws("\n", F.col("google_result.snippet"),
                                                                   F.col("google_result.htmlSnippet")).alias("text"))
    audited = responses.audit_profile_answers(ans.join(it, "ingest_seq"))
    return responses.violation_report(audited)


@register("m9_audit_company_answers", """WITH a AS (SELECT s_suppkey AS k, s_suppkey % 5 AS v FROM supplier)
SELECT 'more than 4 industries' AS violation, count(*) AS n FROM a WHERE v = 1 HAVING count(*) > 0
UNION ALL SELECT 'business model points not 1-6', count(*) FROM a WHERE v = 2 HAVING count(*) > 0
UNION ALL SELECT 'empty string instead of null', count(*) FROM a WHERE v = 3 HAVING count(*) > 0
UNION ALL SELECT 'legal form not a short form', count(*) FROM a WHERE v = 4 HAVING count(*) > 0""")
def m9_audit_company_answers(spark, sf):
    """M9 for company answers: one rule broken per supplier (none for every fifth)."""
    s = inputs.table(spark, sf, "supplier")
    v = F.col("s_suppkey") % 5
    words = F.split(F.lit("a b c d e f g"), " ")
    a = s.select(
        F.lit("Firm").alias("company"),
        F.when(v == 4, F.lit("GmbH (limited)")).otherwise(F.lit("GmbH")).alias("legal_form"),
        F.when(v == 1, words).otherwise(F.slice(words, 1, 4)).alias("industries"),
        F.slice(words, 1, 1).alias("locations_germany"), F.lit(False).alias("multinational"),
        F.when(v == 3, F.lit("")).alias("website"), F.lit(5).cast("long").alias("size_employees"),
        F.when(v == 2, words).otherwise(F.slice(words, 1, 6)).alias("business_model_key_points"),
        F.slice(words, 1, 1).alias("products_and_services"), F.slice(words, 1, 1).alias("recent_news"))
    return responses.violation_report(responses.audit_company_answers(a))
