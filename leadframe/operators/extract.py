"""Profile extraction job over landed search items (X1-X24, X21 metrics).

``extract_profiles(items, answers)``: items carry ``google_result``,
``search_metadata`` and ``ingest_seq``; ``answers`` (optional) carry
``ingest_seq`` and the parsed model answer (M1 output). The first item per
canonical URL is kept with an aggregate (``min_by``, map-side combined), so a
URL that a third of all items share costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions import facts
from leadframe.functions.names import headline_from_title, name_from_metatags, name_from_title
from leadframe.functions.text import first_truthy, nonempty, strip
from leadframe.functions.urls import canonical_profile_url

SEQ = "ingest_seq"


def _item_columns(items: DataFrame) -> DataFrame:
    g = F.col("google_result")
    return items.select(
        SEQ, "search_metadata",
        F.coalesce(g["title"], F.lit("")).alias("title"),
        F.coalesce(g["link"], F.lit("")).alias("link"),
        F.coalesce(g["snippet"], F.lit("")).alias("snippet_raw"),
        F.coalesce(g["htmlSnippet"], F.lit("")).alias("html_snippet"),
        g["pagemap"]["metatags"].alias("metatags"))


def first_items(items: DataFrame) -> DataFrame:
    """X1 + X2: the first item of every canonical URL, before the name check,
    and ``_n``, the number of items that share the URL."""
    it = _item_columns(items).withColumn("profile_url", canonical_profile_url(F.col("link")))
    cols = [c for c in it.columns if c != "profile_url"]
    return (it.filter(F.col("profile_url").isNotNull()).groupBy("profile_url")
            .agg(F.min_by(F.struct(*cols), F.col(SEQ)).alias("r"), F.count(F.lit(1)).alias("_n"))
            .select("profile_url", "_n", "r.*"))


def extract_profiles(items: DataFrame, answers: DataFrame | None = None,
                     company_from_text: bool = False):
    """X: returns (profiles, metrics).

    ``profiles`` has the raw profile columns (``schemas.RAW_PROFILE``) plus
    ``ingest_seq``; ``metrics`` is one row: successful / failed / duplicate
    counts (X21). ``company_from_text=True`` fills a missing company with the
    rule form of the prompt's company rules (X24).
    """
    it = _item_columns(items).withColumn("profile_url", canonical_profile_url(F.col("link")))
    p = first_items(items)
    p = p.withColumn("snippet", facts.remove_boilerplate(F.col("snippet_raw")))
    p = p.withColumn("name", F.coalesce(name_from_metatags(F.col("metatags")), name_from_title(F.col("title"))))
    metrics_src = p.select(F.col("_n"), F.col("name").isNotNull().alias("_named"))

    ok = p.filter(F.col("name").isNotNull())
    ok = ok.withColumn("headline", headline_from_title(F.col("title"), F.col("name")))
    sn = facts.snippet_facts(F.col("snippet"))
    src = F.coalesce(nonempty(facts.meta_description(F.col("metatags"))), nonempty(sn["description"]),
                     F.col("snippet"))
    ok = ok.withColumn("summary", facts.clean_summary(src))

    if answers is not None:
        a = answers.select(SEQ, *[F.col(f).alias("a_" + f) for f in fixed.PROFILE_ANSWER_FIELDS])
        ok = ok.join(a, SEQ, "left")
    else:
        for f in fixed.PROFILE_ANSWER_FIELDS:
            ok = ok.withColumn("a_" + f, F.lit(None).cast("string"))

    position = first_truthy("a_current_position", "headline")
    company = F.col("a_company")
    if company_from_text:
        company = F.coalesce(nonempty(company), facts.company_from_text(F.col("summary")))
    foll = first_truthy("a_follower_count", facts.follower_count_in(F.col("snippet_raw"), F.col("html_snippet")))
    conn = first_truthy("a_connection_count", facts.connection_count_in(F.col("metatags")))

    def longer(c, n):
        return F.when(F.length(strip(c)) > n, strip(c))

    ok = ok.select(
        SEQ, "name", "profile_url", "summary",
        longer(position, 3).alias("current_position"), longer(company, 2).alias("company"),
        longer(F.col("a_location"), 2).alias("location"),
        longer(foll, 0).alias("follower_count"), longer(conn, 0).alias("connection_count"),
        longer(F.col("a_company_website"), 0).alias("company_website"),
        F.lit(None).cast("string").alias("company_domain"))
    ok = with_summary_facts(ok)

    failed_url = it.filter(F.col("profile_url").isNull()).agg(F.count(F.lit(1)).alias("n"))
    m = metrics_src.agg(F.count_if(F.col("_named")).alias("successful_extractions"),
                        F.count_if(~F.col("_named")).alias("_nameless"),
                        F.sum(F.col("_n") - 1).alias("duplicate_profiles_removed"))
    metrics = (m.withColumn("_one", F.lit(1)).join(failed_url.withColumn("_one", F.lit(1)), "_one")
               .select("successful_extractions",
                       (F.col("_nameless") + F.col("n")).alias("failed_extractions"),
                       F.coalesce(F.col("duplicate_profiles_removed"), F.lit(0)).cast("long")
                       .alias("duplicate_profiles_removed")))
    return ok, metrics


def with_summary_facts(df: DataFrame, text: str = "summary") -> DataFrame:
    """X13-X18 on a text column: email, website, phone, experience_years,
    summary_other (salient sentences, cleaned)."""
    t = strip(F.col(text))
    d = df.withColumn("_t", F.when(F.col(text).isNotNull() & (F.col(text) != ""), t))
    d = d.withColumns({"email": facts.email_in(F.col("_t")), "website": facts.website_in(F.col("_t")),
                       "phone": facts.phone_in(F.col("_t")),
                       "experience_years": facts.experience_years_in(F.col("_t")).cast("long")})
    sal = facts.salient_sentences(F.col("_t"), F.col("email"), F.col("website"), F.col("phone"))
    d = d.withColumn("summary_other", facts.clean_sentences(sal))
    return d.drop("_t")
