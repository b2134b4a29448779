"""Model-answer and prompt-batch jobs (M1-M9).

No model is called here. Prompts are built as a table (M4, M5) to be sent by
whatever service the user runs; the answers come back as a table and are
parsed and checked with VARIANT functions (M1-M3, M8, M9).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.text import html_unescape, literal_array, nonempty, py_re, squeeze, strip
from leadframe.functions.urls import apex_domain
from leadframe.sources.suffixes import DEFAULT_RULES


def _brace_slice(s: Column) -> Column:
    """Text from the first '{' to the last '}', NULL when there is none."""
    i = F.instr(s, "{")
    r = F.instr(F.reverse(s), "}")
    k = F.when(r > 0, F.length(s) - r + 1).otherwise(F.lit(0))
    return F.when((i > 0) & (k > i), F.substring(s, i, k - i + 1))


def _vtype(v: str, path: str) -> Column:
    return F.expr(f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))")


def _vstr(v: str, path: str) -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', 'string')")


# ---------------------------------------------------------------------- M1
def parse_profile_responses(df: DataFrame, col: str = "content") -> DataFrame:
    """M1: the answer's JSON object (first '{' to last '}') checked strictly:
    only the six profile keys, each a string or null. Adds the six fields
    (NULL unless valid) and ``parse_ok``."""
    s = strip(F.col(col))
    d = df.withColumn("_slice", _brace_slice(s)).withColumn("_v", F.expr("try_parse_json(_slice)"))
    allowed = literal_array(fixed.PROFILE_ANSWER_FIELDS)
    is_obj = F.coalesce(F.expr("startswith(schema_of_variant(_v), 'OBJECT')"), F.lit(False))
    keys_ok = F.coalesce(F.forall(F.expr("json_object_keys(_slice)"), lambda k: F.array_contains(allowed, k)),
                         F.lit(False))
    types_ok = F.lit(True)
    for f in fixed.PROFILE_ANSWER_FIELDS:
        t = _vtype("_v", f"$.{f}")
        types_ok = types_ok & (t.isNull() | t.isin("STRING", "VOID"))
    d = d.withColumn("parse_ok", is_obj & keys_ok & F.coalesce(types_ok, F.lit(False)))
    d = d.withColumns({f: F.when(F.col("parse_ok"), _vstr("_v", f"$.{f}")) for f in fixed.PROFILE_ANSWER_FIELDS})
    return d.drop("_slice", "_v")


# ---------------------------------------------------------------------- M2
def parse_company_responses(df: DataFrame, col: str = "text") -> DataFrame:
    """M2: the company answer: the whole text as JSON, else a fenced json
    block, else the brace slice; keys must be the answer fields (alias or
    field name); ``company`` is required. Adds the typed fields and
    ``parse_ok``."""
    t = F.col(col)
    fenced = F.when(t.rlike(py_re(fixed.FENCED_JSON_PATTERN)),
                    F.regexp_extract(t, py_re(fixed.FENCED_JSON_PATTERN), 1))
    d = df.withColumn("_a", F.expr(f"try_parse_json(`{col}`)"))
    d = d.withColumn("_fb", fenced).withColumn("_bs", _brace_slice(t))
    d = d.withColumn("_v", F.expr("coalesce(_a, try_parse_json(_fb), try_parse_json(_bs))"))
    d = d.withColumn("_src", F.expr("CASE WHEN _a IS NOT NULL THEN `" + col + "` "
                                    "WHEN try_parse_json(_fb) IS NOT NULL THEN _fb ELSE _bs END"))
    names = [n for n, _, _ in fixed.COMPANY_ANSWER_FIELDS] + [a for _, a, _ in fixed.COMPANY_ANSWER_FIELDS]
    allowed = literal_array(names)
    is_obj = F.coalesce(F.expr("startswith(schema_of_variant(_v), 'OBJECT')"), F.lit(False))
    keys_ok = F.coalesce(F.forall(F.expr("json_object_keys(_src)"), lambda k: F.array_contains(allowed, k)),
                         F.lit(False))
    d = d.withColumn("_obj_ok", is_obj & keys_ok)
    fields = {}
    for name, alias, typ in fixed.COMPANY_ANSWER_FIELDS:
        v = F.coalesce(F.expr(f"try_variant_get(_v, '$.{alias}', '{typ}')"),
                       F.expr(f"try_variant_get(_v, '$.{name}', '{typ}')"))
        if typ == "string":
            ty = F.coalesce(_vtype("_v", f"$.{alias}"), _vtype("_v", f"$.{name}"))
            v = F.when(ty == "STRING", v)
        fields[name] = F.when(F.col("_obj_ok"), v)
    d = d.withColumns(fields)
    d = d.withColumn("parse_ok", F.col("_obj_ok") & F.col("company").isNotNull())
    return d.drop("_a", "_fb", "_bs", "_v", "_src", "_obj_ok")


# ---------------------------------------------------------------------- M3
def clean_response_fields(df: DataFrame) -> DataFrame:
    """M3: drop null/none/n/a/blank tokens and values outside 2..199 chars."""
    new = {}
    for f in fixed.ANSWER_CLEAN_FIELDS:
        v = F.col(f)
        s = strip(v)
        keep = (v.isNotNull() & (v != "") & ~F.lower(s).isin(*fixed.ANSWER_NULL_TOKENS)
                & (F.length(s) > 1) & (F.length(s) < 200))
        new[f] = F.when(keep, s)
    return df.withColumns(new)


# ---------------------------------------------------------------------- M4
def build_profile_prompts(df: DataFrame, template: str, name: str = "name", title: str = "title",
                          summary: str = "summary", snippet: str = "snippet") -> DataFrame:
    """M4: the extraction prompt per item (placeholders filled, NULL -> '';
    the summary carries the snippet line) and its SHA-256. Items with equal
    prompts share a hash, so a distinct on it saves model calls."""
    enhanced = F.concat(F.coalesce(F.col(summary), F.lit("")), F.lit(fixed.PROMPT_SNIPPET_LABEL),
                        F.coalesce(F.col(snippet), F.lit("")))
    p = F.lit(template)
    p = F.replace(p, F.lit(fixed.PROMPT_NAME_TOKEN), F.coalesce(F.col(name), F.lit("")))
    p = F.replace(p, F.lit(fixed.PROMPT_TITLE_TOKEN), F.coalesce(F.col(title), F.lit("")))
    p = F.replace(p, F.lit(fixed.PROMPT_SUMMARY_TOKEN), enhanced)
    return df.withColumn("prompt", p).withColumn(
        "prompt_hash", F.when(F.col("prompt") != "", F.sha2(F.col("prompt"), 256)))


# ---------------------------------------------------------------------- M6
def page_excerpts(pages: DataFrame, html: str = "html", max_chars: int = fixed.EXCERPT_MAX_CHARS) -> DataFrame:
    """M6: visible text of each page: comments, script/style/noscript
    elements and tags removed, entities decoded, blanks squeezed, first
    ``max_chars`` characters."""
    h = F.regexp_replace(F.col(html), "(?s)<!--.*?-->", " ")
    for tag in fixed.EXCERPT_DROP_TAGS:
        h = F.regexp_replace(h, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", " ")
    h = F.regexp_replace(h, "(?s)<[^>]*>", " ")
    h = squeeze(html_unescape(h))
    return pages.withColumn("excerpt", F.when(F.col(html).isNotNull(), F.substring(h, 1, max_chars)))


# ---------------------------------------------------------------------- M7
def pick_homepage(items: DataFrame, key: str = "company", rules=DEFAULT_RULES) -> DataFrame:
    """M7: per company, the first of its first 5 search items that has a
    link, a displayLink naming none of the social hosts, and an apex domain:
    ``key, homepage_url, apex``. An aggregate (map-side combined)."""
    dl = F.lower(F.coalesce(F.col("displayLink"), F.lit("")))
    social = F.lit(False)
    for h in fixed.HOMEPAGE_SOCIAL_HOSTS:
        social = social | dl.contains(h)
    ok = (items.filter((F.col("position") <= fixed.HOMEPAGE_ITEMS) & nonempty("link").isNotNull() & ~social)
          .withColumn("apex", apex_domain(F.col("link"), rules)).filter(F.col("apex").isNotNull()))
    return (ok.groupBy(key).agg(F.min_by(F.struct(F.col("link").alias("homepage_url"), "apex"),
                                         F.col("position")).alias("h"))
            .select(key, "h.homepage_url", "h.apex"))


# ---------------------------------------------------------------------- M5
def build_company_prompts(companies: DataFrame, template: str, homepages: DataFrame | None = None,
                          excerpts: DataFrame | None = None) -> DataFrame:
    """M5: per company ``template + target line (+ site excerpt)``.

    ``companies``: ``id, name, domain``; ``homepages`` (M7): ``id,
    homepage_url, apex`` used when the domain is unknown; ``excerpts`` (M6):
    ``url, excerpt``."""
    c = companies
    if homepages is not None:
        c = c.join(homepages.select("id", "homepage_url", F.col("apex").alias("h_apex")), "id", "left")
    else:
        c = c.withColumn("homepage_url", F.lit(None).cast("string")).withColumn("h_apex", F.lit(None).cast("string"))
    c = c.withColumn("homepage_url", F.when(nonempty("domain").isNull(), F.col("homepage_url")))
    if excerpts is not None:
        c = c.join(excerpts.select(F.col("url").alias("homepage_url"), "excerpt"), "homepage_url", "left")
    else:
        c = c.withColumn("excerpt", F.lit(None).cast("string"))
    apex = F.coalesce(nonempty("domain"), F.col("h_apex"))
    target = F.format_string(fixed.COMPANY_TARGET_FORMAT, F.coalesce(F.col("name"), F.lit("")),
                             F.coalesce(apex, F.lit("unknown")))
    context = F.when(nonempty("homepage_url").isNotNull() & nonempty("excerpt").isNotNull(),
                     F.format_string(fixed.COMPANY_EXCERPT_FORMAT, F.col("homepage_url"), F.col("excerpt"))
                     ).otherwise(F.lit(""))
    return c.withColumn("user_message", F.concat(F.lit(template + "\n\n"), target, context)) \
            .withColumn("prompt_hash", F.sha2(F.lit(template), 256))


# ---------------------------------------------------------------------- M8
def urls_from_answers(df: DataFrame, col: str = "content") -> DataFrame:
    """M8: the first URL host in a free-text answer that names none of the
    excluded sites, as ``https://host``; NULL when the answer says it is unsure."""
    t = strip(F.col(col))
    unsure = F.lit(False)
    for w in fixed.ANSWER_UNSURE_WORDS:
        unsure = unsure | F.lower(t).contains(w)
    hosts = F.filter(F.regexp_extract_all(t, F.lit(py_re(fixed.ANSWER_URL_PATTERN)), 1),
                     lambda h: ~F.exists(literal_array(fixed.ANSWER_URL_EXCLUDED),
                                         lambda x: F.lower(h).contains(x)))
    return df.withColumn("website", F.when(~unsure, F.concat(F.lit("https://"), F.get(hosts, 0))))


# ---------------------------------------------------------------------- M9
def _count_near(value: Column, text: Column, words: str) -> Column:
    quoted = F.concat(F.lit("(?iU)\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")),
                      F.lit("\\E\\s*(?:" + words + ")"))
    return F.coalesce(F.regexp_like(text, quoted), F.lit(False))


def audit_profile_answers(answers: DataFrame, text: str = "text") -> DataFrame:
    """M9 (profile answers): the prompt's acceptance rules as checks.
    A count must stand next to its keyword in the source text; the company
    website must not be a social or job site. Adds ``violations``."""
    t = F.col(text)
    v = F.array_compact(F.array(
        F.when(F.col("follower_count").isNotNull()
               & ~_count_near(F.col("follower_count"), t, "followers?|follower"),
               F.lit("follower_count without keyword")),
        F.when(F.col("connection_count").isNotNull()
               & ~_count_near(F.col("connection_count"), t, "connections?|kontakte"),
               F.lit("connection_count without keyword")),
        F.when(F.exists(literal_array(fixed.JOB_HOSTS), lambda h: F.lower(F.coalesce(F.col("company_website"),
                                                                               F.lit(""))).contains(h)),
               F.lit("company_website is a social or job site")),
    ))
    return answers.withColumn("violations", v)


def audit_company_answers(answers: DataFrame) -> DataFrame:
    """M9 (company answers): at most 4 industries, 1-6 business-model points,
    NULL instead of '' and a short legal form without notes. Adds
    ``violations``."""
    empty_str = F.lit(False)
    for n, _, typ in fixed.COMPANY_ANSWER_FIELDS:
        if typ == "string":
            empty_str = empty_str | (F.col(n) == "")
    v = F.array_compact(F.array(
        F.when(F.size("industries") > 4, F.lit("more than 4 industries")),
        F.when((F.size("business_model_key_points") < 1) | (F.size("business_model_key_points") > 6),
               F.lit("business model points not 1-6")),
        F.when(F.coalesce(empty_str, F.lit(False)), F.lit("empty string instead of null")),
        F.when(F.col("legal_form").contains("(") | (F.length("legal_form") > 20),
               F.lit("legal form not a short form")),
    ))
    return answers.withColumn("violations", v)


def violation_report(audited: DataFrame) -> DataFrame:
    """M9 report: rows per violation."""
    return audited.select(F.explode("violations").alias("violation")).groupBy("violation") \
        .agg(F.count(F.lit(1)).alias("n"))
