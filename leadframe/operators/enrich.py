"""Enrichment jobs (E1, E5-E8). The research calls themselves are not made
here: their answers arrive as a table (see ``operators.responses.M2``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe import schemas
from leadframe.functions.legal import derive_legal_form
from leadframe.functions.text import nonempty
from leadframe.functions.urls import apex_domain
from leadframe.sources.suffixes import DEFAULT_RULES

RESULT_LISTS = ["industries", "locations_germany", "business_model_key_points", "products_and_services",
                "recent_news"]


def pending_companies(companies: DataFrame, limit: int | None = 50) -> DataFrame:
    """Never enriched, or no industries, or size unknown; ordered by
    name (NULL first), oldest first on ties; ``(id, name, domain)``. The
    limit is the batch size of one enrichment run (TakeOrderedAndProject)."""
    p = companies.filter(F.col("last_enriched_at").isNull()
                         | (F.coalesce(F.size("industries"), F.lit(0)) <= 0)
                         | F.col("size_employees").isNull())
    p = p.orderBy(F.col("name").asc_nulls_first(), F.col("created_batch"), F.col("created_seq"), F.col("id"))
    p = p.limit(limit) if limit is not None else p
    return p.select("id", "name", "domain", "created_seq", "created_batch")


def default_enrichment(pending: DataFrame) -> DataFrame:
    """E5: the empty answer for each pending company: lists empty, not
    multinational, website ``https://domain`` when a domain is known."""
    empty = F.array().cast("array<string>")
    return pending.select(
        "id", F.col("name").alias("company"), F.lit(None).cast("string").alias("legal_form"),
        empty.alias("industries"), empty.alias("locations_germany"), F.lit(False).alias("multinational"),
        F.when(nonempty("domain").isNotNull(), F.concat(F.lit("https://"), F.col("domain"))).alias("website"),
        F.lit(None).cast("long").alias("size_employees"), empty.alias("business_model_key_points"),
        empty.alias("products_and_services"), empty.alias("recent_news"))


def missing_enrichment(pending: DataFrame, results: DataFrame) -> DataFrame:
    """E6 (the rows): pending companies without a usable answer."""
    ok = results.filter(F.coalesce(F.col("parse_ok"), F.lit(True))) if "parse_ok" in results.columns else results
    return pending.join(ok.select("id"), "id", "left_anti")


def assert_enrichment_complete(pending: DataFrame, results: DataFrame) -> None:
    """Abort before anything is written when an answer is missing; the
    message shows at most five ``id:name`` (the only rows brought to the
    driver)."""
    missing = missing_enrichment(pending, results)
    n = missing.count()
    if n:
        preview = ", ".join(f"{r['id']}:{r['name']}" for r in missing.orderBy("id").limit(5).collect())
        raise RuntimeError(f"Company enrichment returned no data for {n} companies (e.g., {preview}). Aborting.")


def guard_domain_claims(companies: DataFrame, claims: DataFrame) -> DataFrame:
    """Which claimed domains may be written. ``claims``: ``id, claimed``.

    A claim loses when another company already owns the domain; among new
    claims of one domain the earliest-created company wins (the reference's
    order was the completion order of its threads). The per-domain winner is
    an aggregate (map-side combined), so a domain claimed by many rows stays
    cheap. Returns ``id, claimed, accepted``.
    """
    from leadframe.session import materialize
    # the stored companies are only probed for the claimed domains and the
    # claiming ids; the claims are written once, so the planner broadcasts
    # them by their bytes when they are small and the big table is read, not
    # shuffled
    claims = materialize(claims.filter(nonempty("claimed").isNotNull()).select("id", "claimed"), "claims")
    owners = (companies.filter(F.col("domain").isNotNull())
              .join(claims.select(F.col("claimed").alias("domain")), "domain", "left_semi")
              .select(F.col("domain").alias("claimed"), F.col("id").alias("owner_id")))
    order = (companies.join(claims.select("id"), "id", "left_semi")
             .select("id", F.struct("created_batch", "created_seq", "id").alias("_ord")))
    c = claims.join(owners, "claimed", "left").join(order, "id", "left")
    free = c.filter(F.col("owner_id").isNull())
    winners = free.groupBy("claimed").agg(F.min_by("id", "_ord").alias("winner_id"))
    c = c.join(winners, "claimed", "left")
    accepted = (F.col("owner_id") == F.col("id")) | (F.col("owner_id").isNull() & (F.col("winner_id") == F.col("id")))
    return c.select("id", "claimed", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def apply_enrichment(companies: DataFrame, pending: DataFrame, results: DataFrame, now: str,
                     rules=DEFAULT_RULES, fix_ek: bool = False) -> DataFrame:
    """Write answers onto the companies that were pending.

    The ten fields are overwritten, also with NULL; multinational truthy ->
    1 else 0; legal form = E4(name, answer); domain = the pending domain, else
    the apex of the answer's website, written only if E8 accepts it;
    ``last_enriched_at = now``.
    """
    r = results.select("id", *[F.col(c).alias("r_" + c) for c in
                               ["legal_form", "website", "size_employees", "multinational"] + RESULT_LISTS])
    upd = pending.select("id", F.col("name").alias("p_name"), F.col("domain").alias("p_domain")).join(r, "id")
    upd = upd.withColumn("claimed", F.coalesce(nonempty("p_domain"), apex_domain(F.col("r_website"), rules)))
    verdict = guard_domain_claims(companies, upd.select("id", "claimed")).select(
        "id", F.col("accepted").alias("_acc"))
    upd = upd.join(verdict, "id", "left")
    u = upd.select(
        "id", F.lit(True).alias("_m"),
        derive_legal_form(F.col("p_name"), F.col("r_legal_form"), fix_ek).alias("n_legal_form"),
        F.col("r_industries").alias("n_industries"), F.col("r_locations_germany").alias("n_locations_de"),
        F.when(F.coalesce(F.col("r_multinational"), F.lit(False)), 1).otherwise(0).alias("n_multinational"),
        "claimed", F.coalesce("_acc", F.lit(False)).alias("_acc"),
        F.col("r_website").alias("n_website"), F.col("r_size_employees").alias("n_size_employees"),
        F.col("r_business_model_key_points").alias("n_business_model"),
        F.col("r_products_and_services").alias("n_products"), F.col("r_recent_news").alias("n_recent_news"))
    from leadframe.session import materialize
    j = companies.join(materialize(u, "enrichment"), "id", "left")   # u: one row per pending company
    m = F.coalesce(F.col("_m"), F.lit(False))
    out = {f.name: F.col(f.name) for f in schemas.COMPANIES.fields}
    for c in ("legal_form", "industries", "locations_de", "multinational", "website", "size_employees",
              "business_model", "products", "recent_news"):
        out[c] = F.when(m, F.col("n_" + c)).otherwise(F.col(c))
    out["domain"] = (F.when(m & F.col("claimed").isNull(), F.lit(None).cast("string"))
                     .when(m & F.col("_acc"), F.col("claimed")).otherwise(F.col("domain")))
    out["last_enriched_at"] = F.when(m, F.to_timestamp(F.lit(now))).otherwise(F.col("last_enriched_at"))
    return j.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in schemas.COMPANIES.fields])
