"""Validation and cleaning jobs (V1-V13). Every check is a column; the
valid / rejected split is two filters of one frame, rejects keep their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.names import is_valid_name
from leadframe.functions.text import first_truthy, nonempty, py_re, strip
from leadframe.functions.urls import apex_domain, is_profile_url
from leadframe.sources.suffixes import DEFAULT_RULES

SEQ = "ingest_seq"


def _len(c: str):
    return F.length(F.col(c).cast("string"))


def profile_errors(df: DataFrame) -> F.Column:
    """V1 (+V2, V3): errors of the required fields, in field order."""
    errs = []
    for f in fixed.REQUIRED_FIELDS:
        missing = nonempty(F.col(f).cast("string")).isNull()
        errs.append(F.when(missing, F.lit(f"Missing required field: {f}")))
        if f == "profile_url":
            errs.append(F.when(~missing & ~is_profile_url(F.col(f)),
                               F.concat(F.lit("Invalid LinkedIn URL: "), F.col(f))))
        if f == "name":
            errs.append(F.when(~missing & ~is_valid_name(F.col(f)),
                               F.concat(F.lit("Invalid name format: "), F.col(f))))
    return F.array_compact(F.array(*errs))


def profile_warnings(df: DataFrame) -> F.Column:
    """V4: warnings on optional fields that are present and truthy."""
    cols = set(df.columns)
    types = dict(df.dtypes)
    w = []

    def present(c):
        v = F.col(c)
        t = types[c]
        if t == "string":
            return v.isNotNull() & (v != "")
        if t.startswith("array"):
            return v.isNotNull() & (F.size(v) > 0)
        return v.isNotNull() & (v != 0)

    for c, label in (("current_position", "Current position"), ("company", "Company"),
                     ("location", "Location")):
        if c in cols:
            w.append(F.when(present(c) & (_len(c) > 200),
                            F.format_string(f"{label} field too long: %d characters", _len(c))))
    if "email" in cols:
        w.append(F.when(present("email") & ~F.col("email").rlike(py_re("^" + fixed.EMAIL_PATTERN + "\n?$")),
                        F.lit("Email format looks invalid")))
    if "website" in cols:
        w.append(F.when(present("website") & ~(F.col("website").startswith("http://")
                                               | F.col("website").startswith("https://")),
                        F.lit("Website should start with http(s)://")))
    if "phone" in cols:
        digits = F.length(F.regexp_replace(F.col("phone"), py_re(r"\D"), ""))
        w.append(F.when(present("phone") & (digits < fixed.PHONE_MIN_DIGITS),
                        F.lit("Phone number too short to be valid")))
    if "experience_years" in cols:
        y = F.col("experience_years").cast("string").try_cast("long")
        w.append(F.when(present("experience_years") & y.isNull(),
                        F.lit("Experience years should be an integer"))
                 .when(present("experience_years") & ((y < 0) | (y > 60)),
                       F.lit("Experience years outside plausible range (0-60)")))
    return F.array_compact(F.array(*w)) if w else F.array().cast("array<string>")


def validate_profiles(df: DataFrame):
    """V5: (valid, rejected). Valid iff no errors; warnings do not reject.
    Both frames carry ``errors`` and ``warnings`` columns."""
    checked = df.withColumn("errors", profile_errors(df)).withColumn("warnings", profile_warnings(df))
    return (checked.filter(F.size("errors") == 0), checked.filter(F.size("errors") > 0))


def validation_metrics(checked: DataFrame):
    """V6: (one-row totals, error counts). ``checked`` has ``errors``."""
    totals = checked.agg(F.count(F.lit(1)).alias("total_profiles"),
                         F.count_if(F.size("errors") == 0).alias("valid_profiles"),
                         F.count_if(F.size("errors") > 0).alias("invalid_profiles"))
    errors = (checked.select(F.explode("errors").alias("error"))
              .groupBy("error").agg(F.count(F.lit(1)).alias("n")))
    return totals, errors


def keep_first(df: DataFrame, key, order: str = SEQ) -> DataFrame:
    """The first row (by ``order``) per key, as an aggregate: partial
    aggregation combines a hot key map-side instead of sorting it in one task."""
    cols = df.columns
    g = (df.withColumn("_k", key).filter(F.col("_k").isNotNull())
         .groupBy("_k").agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_r")))
    return g.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def drop_duplicate_profiles(df: DataFrame) -> DataFrame:
    """V7: first row per ``profile_url``; rows without URL dropped."""
    return keep_first(df, nonempty("profile_url"))


def clean_profiles(df: DataFrame) -> DataFrame:
    """V8: trim text fields; ``http://`` -> ``https://`` on the profile URL."""
    types = dict(df.dtypes)
    new = {c: strip(c) for c in ("name", "current_position", "company", "location", "skills", "summary")
           if types.get(c) == "string"}
    if "profile_url" in types:
        u = F.col("profile_url")
        new["profile_url"] = F.when(u.isNotNull() & (u != "") & ~u.startswith("https://"),
                                    F.replace(u, F.lit("http://"), F.lit("https://"))).otherwise(u)
    return df.withColumns(new)


def route_people(df: DataFrame):
    """V9: mapped rows (they carry ``LinkedIn_Profile`` or ``Contact_Name``, read
    into ``mapped_*`` columns)
    are only cleaned; raw rows are validated, then cleaned. Decided per row.
    Returns (people, rejected)."""
    mapped = F.col("mapped_linkedin_profile").isNotNull() | F.col("mapped_contact_name").isNotNull()
    m = clean_profiles(df.filter(mapped))
    valid, rejected = validate_profiles(df.filter(~mapped))
    valid = clean_profiles(valid.drop("errors", "warnings"))
    return m.unionByName(valid), rejected


def valid_companies(df: DataFrame) -> DataFrame:
    """Any of name / domain / website."""
    return df.filter(F.coalesce(first_truthy("Company", "name"), first_truthy("Company_Domain", "domain"),
                                first_truthy("Company_Website", "website")).isNotNull())


def clean_companies(df: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Trim the six alias fields; derive ``Company_Domain`` from the
    website (apex) when neither domain spelling is set."""
    out = df.withColumns({c: strip(c) for c in ("Company", "name", "Company_Website", "website",
                                                 "Company_Domain", "domain")})
    has_dom = first_truthy("Company_Domain", "domain").isNotNull()
    apex = apex_domain(first_truthy("Company_Website", "website"), rules)
    return out.withColumn("Company_Domain", F.when(~has_dom & apex.isNotNull(), apex)
                          .otherwise(F.col("Company_Domain")))


def company_key(df: DataFrame) -> F.Column:
    """V12 key: lower(domain), else lower(name) + '|' + lower(address)."""
    dom = F.lower(F.coalesce(first_truthy("Company_Domain", "domain"), F.lit("")))
    alt = F.concat(strip(F.lower(F.coalesce(first_truthy("Company", "name"), F.lit("")))), F.lit("|"),
                   strip(F.lower(F.coalesce(nonempty("address"), F.lit("")))))
    return F.when(dom != "", dom).otherwise(alt)


def dedupe_companies(df: DataFrame) -> DataFrame:
    """First row per company key."""
    return keep_first(df, company_key(df))


def company_ingest_prep(df: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """V10 -> V12 -> V11 (dedupe before the domain is derived). Alias
    columns a source does not have are added as NULL first."""
    from leadframe import schemas
    from leadframe.sources.readers import align_schema
    df = align_schema(df, schemas.COMPANY_INPUT, keep_extra=True)
    return clean_companies(dedupe_companies(valid_companies(df)), rules)
