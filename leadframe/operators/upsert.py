"""Keyed upserts, linking, query dimension, duplicate merging, erasure.

Shape of every keyed job: one ``groupBy(key)`` of the batch whose aggregates
are all ``max_by``/``min_by``/``min``/``count`` (partial aggregation, so a hot
key is combined map-side and never lands whole in one task), then one join on
the key with the current table. "Last non-NULL wins" is
``max_by(c, CASE WHEN c IS NOT NULL THEN seq END)``: NULL orderings are skipped.
Ids are key-derived (``xxhash64``), so no global sort or counter is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe import fixed, schemas
from leadframe.functions.text import ascii_lower, nonempty, sqlite_trim, squeeze
from leadframe.functions.urls import profile_key
from leadframe.sources.readers import align_schema

SEQ = "ingest_seq"


def _last_non_null(c: str, seq: str = SEQ):
    # one SQL expression string: parsed by the JVM in a single call
    return F.expr(f"max_by(`{c}`, CASE WHEN `{c}` IS NOT NULL THEN `{seq}` END) AS `{c}`")


def person_id(key_col) -> F.Column:
    return F.xxhash64(F.lit("person"), key_col)


def company_id_for_domain(domain_col) -> F.Column:
    return F.xxhash64(F.lit("company"), domain_col)


def stub_company_id(batch_id, seq_col) -> F.Column:
    return F.xxhash64(F.lit("stub"), F.lit(str(batch_id)), seq_col)


def named_stub_id(name_col) -> F.Column:
    """Id of a stub that later batches find by its name (K3 ``reuse_by_name``)."""
    return F.xxhash64(F.lit("stub-name"), name_col)


def query_id(source, entity_type, normalized) -> F.Column:
    return F.xxhash64(F.lit("query"), source, entity_type, normalized)


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


# ---------------------------------------------------------------------- K1
def upsert_people(current: DataFrame | None, batch: DataFrame, now: str,
                  companies: DataFrame | None = None, batch_id: str | None = None, batch_no: int = 0,
                  stream_stored: bool | None = None, stub_ids: DataFrame | None = None) -> DataFrame:
    """K1: merge a batch of person records into the people table.

    Key ``linkedin_profile`` (already N7-normalised); rows without a key are
    skipped. Per column the newest non-NULL value wins, within the batch and
    over the stored row. ``lookup_date`` is always refreshed: the batch's last
    record's value, or ``now`` when that is NULL. ``is_hot``, ``status``,
    ``notes``, ``last_interaction_date`` and ``company_id`` are never touched
    (``is_hot`` starts at 0).

    With ``companies`` the K5 link is done in the same pass: the person's
    newest record naming a domain or a company is one more aggregate of the
    same ``groupBy``, resolved against ``companies`` on the batch side, so the
    stored people table is joined (shuffled) once per batch, not twice.

    The batch aggregate is written once. If its bytes let the planner
    broadcast it, the stored table streams past it without a shuffle; else it
    is one full outer join (``stream_stored`` forces either, for tests).
    ``batch_no`` is stored as the arrival batch of new people. With
    ``stub_ids`` (see ``stub_ids_by_name``) a company without a domain is
    looked up by name.
    """
    first_load = current is None
    current = current if current is not None else schemas.empty(_spark(batch), schemas.PEOPLE)
    merge = [n for n, _ in schemas.PERSON_MERGE_FIELDS]
    batch = align_schema(batch, schemas.PERSON_RECORD_Q, keep_extra=True)
    aggs = [*[_last_non_null(c) for c in merge],
            F.coalesce(F.max_by("lookup_date", SEQ), F.lit(now)).alias("lookup_date"),
            F.min(SEQ).alias("created_seq")]
    if companies is not None:
        names_co = nonempty("company_domain").isNotNull() | nonempty("company_name").isNotNull()
        aggs.append(F.max_by(F.struct(nonempty("company_domain").alias("d"), F.col(SEQ).alias("s"),
                                      nonempty("company_name").alias("n")),
                             F.when(names_co, F.col(SEQ))).alias("_co"))
    agg = (batch.groupBy("linkedin_profile").agg(*aggs)
           .filter(F.col("linkedin_profile").isNotNull()))   # keyless rows: one NULL group, dropped
    if companies is not None:
        # many people at one company share a domain; the lookup is the new
        # companies table (computed from this batch), so no eager size check
        # here: AQE broadcasts it when small and splits a hot domain otherwise
        by_domain = companies.filter(F.col("domain").isNotNull()).select(
            F.col("domain").alias("_cd"), F.col("id").alias("_cid"))
        stub = stub_company_id(batch_id, F.col("_co.s"))
        if stub_ids is not None:
            named = stub_ids.select(F.col("name").alias("_sn"), F.col("id").alias("_sid"))
            agg = agg.join(named, F.when(F.col("_co.d").isNull(), F.col("_co.n")) == F.col("_sn"), "left")
            stub = F.col("_sid")
        agg = (agg.join(by_domain, F.col("_co.d") == F.col("_cd"), "left")
               .withColumn("_new_cid", F.when(F.col("_co").isNull(), F.lit(None).cast("long"))
                           .when(F.col("_co.d").isNotNull(), F.col("_cid"))
                           .otherwise(stub))
               .drop("_co", "_cd", "_cid", "_sn", "_sid"))
    def merged(j, has_old: bool = True):
        def o(c):
            return F.col(f"o.{c}") if has_old else F.lit(None)
        key = F.coalesce(o("linkedin_profile"), F.col("n.linkedin_profile"))
        out = {
            "id": F.coalesce(o("id"), person_id(key)),
            "linkedin_profile": key,
            "lookup_date": F.coalesce(F.col("n.lookup_date"), o("lookup_date")),
            "is_hot": F.coalesce(o("is_hot"), F.lit(0)),
            "created_seq": F.coalesce(o("created_seq"), F.col("n.created_seq")),
            "created_batch": F.coalesce(o("created_batch"), F.lit(batch_no)),
        }
        for c in merge:
            out[c] = F.coalesce(F.col(f"n.{c}"), o(c))
        for c in ("status", "notes", "last_interaction_date", "company_id"):
            out[c] = o(c)
        if companies is not None:
            out["company_id"] = F.coalesce(F.col("n._new_cid"), o("company_id"))
        return j.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in schemas.PEOPLE.fields])

    if first_load:
        # no stored table: every key is new, nothing to join
        return merged(agg.alias("n"), has_old=False)
    from leadframe.session import fits_broadcast, materialize
    agg = materialize(agg, "people-batch")
    if fits_broadcast(agg) if stream_stored is None else stream_stored:
        return _past_stored(current, agg, "linkedin_profile", merged)
    o, n = current.alias("o"), agg.alias("n")
    return merged(o.join(n, F.col("o.linkedin_profile") == F.col("n.linkedin_profile"), "full_outer"))


def _past_stored(current: DataFrame, agg: DataFrame, key: str, merged) -> DataFrame:
    """Stored rows merged with a small written batch, then the keys that were new: the
    planner broadcasts the batch by its bytes, so the stored table isn't shuffled."""
    kept = merged(current.alias("o").join(agg.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "left"))
    seen = current.select(key).join(agg.select(key), key, "left_semi")
    return kept.unionByName(merged(agg.join(seen, key, "left_anti").alias("n"), has_old=False))


# ------------------------------------------------------------------ K2 / K3
def _safe_name(name, domain):
    return F.coalesce(nonempty(name), nonempty(domain), F.lit(fixed.UNKNOWN_COMPANY_NAME))


def upsert_companies(current: DataFrame | None, batch: DataFrame, batch_id: str, batch_no: int = 0,
                     stream_stored: bool | None = None, stub_ids: DataFrame | None = None) -> DataFrame:
    """K2 + K3: merge company rows keyed by domain; rows without a domain
    become new stub rows (name only, website dropped), one per row.

    ``batch``: ``name, domain, website, source_name, source_query,
    search_query_id, ingest_seq``. For a domain the name always overwrites
    (name, else domain, else "Unknown Company"); website and provenance take
    the newest non-NULL value. Join strategy as in ``upsert_people``.

    With ``stub_ids`` (``stub_ids_by_name`` of the batch) rows without a
    domain are one company per name, new or stored; its provenance takes the
    newest non-NULL value.
    """
    first_load = current is None
    current = current if current is not None else schemas.empty(_spark(batch), schemas.COMPANIES)
    b = batch.withColumn("safe_name", _safe_name(F.col("name"), F.col("domain"))) \
             .withColumn("source_name", nonempty("source_name")) \
             .withColumn("source_query", nonempty("source_query"))
    keyed = b.filter(nonempty("domain").isNotNull())
    agg = (keyed.groupBy("domain")
           .agg(F.max_by("safe_name", SEQ).alias("name"),
                *[_last_non_null(c) for c in ("website", "source_name", "source_query",
                                              "search_query_id")],
                F.min(SEQ).alias("created_seq")))
    def merged(j, has_old: bool = True):
        def o(c):
            return F.col(f"o.{c}") if has_old else F.lit(None)
        dom = F.coalesce(o("domain"), F.col("n.domain"))
        out = {f.name: o(f.name) for f in schemas.COMPANIES.fields}
        out.update({
            "id": F.coalesce(o("id"), company_id_for_domain(dom)),
            "domain": dom,
            "name": F.coalesce(F.col("n.name"), o("name")),
            "created_seq": F.coalesce(o("created_seq"), F.col("n.created_seq")),
            "created_batch": F.coalesce(o("created_batch"), F.lit(batch_no)),
        })
        for c in ("website", "source_name", "source_query", "search_query_id"):
            out[c] = F.coalesce(F.col(f"n.{c}"), o(c))
        return j.select(*[out[f.name].cast(f.dataType).alias(f.name) for f in schemas.COMPANIES.fields])

    if stub_ids is not None:
        rows = _named_stubs(b, stub_ids, batch_no)
        if first_load:
            return merged(agg.alias("n"), has_old=False).unionByName(rows)
        from leadframe.session import materialize
        rows = materialize(rows, "companies-stubs")
        table = upsert_companies(current, b.filter(nonempty("domain").isNotNull()), batch_id, batch_no, stream_stored)
        new = rows.join(current.select("id"), "id", "left_anti")
        r = rows.select("id", *[F.col(c).alias(f"_{c}") for c in _PROVENANCE])
        table = table.join(r, "id", "left")
        for c in _PROVENANCE:
            table = table.withColumn(c, F.coalesce(f"_{c}", c))
        return table.select(*schemas.COMPANIES.fieldNames()).unionByName(new)
    stubs = append_company_stubs(b, batch_id, batch_no)
    if first_load:
        return merged(agg.alias("n"), has_old=False).unionByName(stubs)
    from leadframe.session import fits_broadcast, materialize
    agg = materialize(agg, "companies-batch")
    if fits_broadcast(agg) if stream_stored is None else stream_stored:
        return _past_stored(current, agg, "domain", merged).unionByName(stubs)
    o, n = current.alias("o"), agg.alias("n")
    return merged(o.join(n, F.col("o.domain") == F.col("n.domain"), "full_outer")).unionByName(stubs)


_PROVENANCE = ("source_name", "source_query", "search_query_id")


def stub_ids_by_name(names: DataFrame, index: DataFrame | None) -> DataFrame:
    """K3 ``reuse_by_name``: distinct ``name`` -> ``id``, the stored one of
    ``index`` (``name, id``) or the one that a new stub of this name gets.
    Names are compared exactly; companies with a domain are no stubs."""
    n = names.filter(F.col("name").isNotNull()).select("name").distinct()
    if index is None:
        return n.withColumn("id", named_stub_id(F.col("name")))
    known = index.select("name", F.col("id").alias("_id"))
    return n.join(known, "name", "left").select("name", F.coalesce("_id", named_stub_id(F.col("name"))).alias("id"))


def stub_index(companies: DataFrame) -> DataFrame:
    """The earliest stub of each name in a companies table: the index of a store that has none yet."""
    return (companies.filter(F.col("domain").isNull() & F.col("name").isNotNull()).groupBy("name")
            .agg(F.min_by("id", F.struct("created_batch", "created_seq", "id")).alias("id")))


def _named_stubs(batch: DataFrame, stub_ids: DataFrame, batch_no: int) -> DataFrame:
    """One stub row per name of the batch's rows without a domain."""
    agg = (batch.filter(nonempty("domain").isNull()).groupBy(F.col("safe_name").alias("name"))
           .agg(*[_last_non_null(c) for c in _PROVENANCE], F.min(SEQ).alias("created_seq")))
    rows = agg.join(stub_ids, "name").withColumn("created_batch", F.lit(batch_no))
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in schemas.COMPANIES.fields])


def append_company_stubs(batch: DataFrame, batch_id: str, batch_no: int = 0) -> DataFrame:
    """K3: every batch row without a domain becomes a new company row."""
    stubs = batch.filter(nonempty("domain").isNull())
    cols = {f.name: F.lit(None).cast(f.dataType) for f in schemas.COMPANIES.fields}
    cols.update({
        "id": stub_company_id(batch_id, F.col(SEQ)),
        "name": _safe_name(F.col("name"), F.col("domain")),
        "source_name": nonempty("source_name"), "source_query": nonempty("source_query"),
        "search_query_id": F.col("search_query_id").cast("long"),
        "created_seq": F.col(SEQ).cast("long"), "created_batch": F.lit(batch_no),
    })
    return stubs.select(*[cols[f.name].cast(f.dataType).alias(f.name) for f in schemas.COMPANIES.fields])


def persist_companies(current: DataFrame | None, companies: DataFrame, batch_id: str, batch_no: int = 0):
    """K4: validated company rows (V13 output, alias columns) through K2/K3;
    no query id is passed. Returns (companies table, processed count column
    as a one-row frame)."""
    from pyspark.sql import types as T
    companies = align_schema(companies, T.StructType(list(schemas.COMPANY_INPUT.fields) + [
        T.StructField("source_name", T.StringType()), T.StructField("source_query", T.StringType())]),
        keep_extra=True)
    rows = companies.select(
        F.coalesce(nonempty("Company"), nonempty("name")).alias("name"),
        F.coalesce(nonempty("Company_Domain"), nonempty("domain")).alias("domain"),
        F.coalesce(nonempty("Company_Website"), nonempty("website")).alias("website"),
        nonempty("source_name").alias("source_name"), nonempty("source_query").alias("source_query"),
        F.lit(None).cast("long").alias("search_query_id"), F.col(SEQ))
    rows = rows.filter(F.coalesce(F.col("name"), F.col("domain"), F.col("website")).isNotNull())
    table = upsert_companies(current, rows, batch_id, batch_no)
    processed = rows.agg(F.count(F.lit(1)).alias("processed_companies"))
    return table, processed


# ---------------------------------------------------------------------- K5
def link_people_companies(people: DataFrame, companies: DataFrame, records: DataFrame,
                          batch_id: str) -> DataFrame:
    """K5: each person gets the company of its newest record that names a
    domain or a company; domain companies are looked up by domain, stubs by
    their record. People without such a record keep their link."""
    rec = records.filter(nonempty("company_domain").isNotNull() | nonempty("company_name").isNotNull())
    last = (rec.groupBy("linkedin_profile")
            .agg(F.max_by(F.struct(nonempty("company_domain").alias("domain"), F.col(SEQ).alias("seq")),
                          F.col(SEQ)).alias("r")))
    by_domain = companies.filter(F.col("domain").isNotNull()).select(
        F.col("domain").alias("c_domain"), F.col("id").alias("c_id"))
    link = (last.join(by_domain, F.col("r.domain") == F.col("c_domain"), "left")
            .select("linkedin_profile",
                    F.when(F.col("r.domain").isNotNull(), F.col("c_id"))
                    .otherwise(stub_company_id(batch_id, F.col("r.seq"))).alias("new_company_id")))
    return (people.join(link, "linkedin_profile", "left")
            .withColumn("company_id", F.coalesce("new_company_id", "company_id"))
            .select(*schemas.PEOPLE.fieldNames()))


# ------------------------------------------------------------------ K6 / K7
def normalize_query(c) -> F.Column:
    """K6: lower-case, trim, squeeze blanks; NULL -> ''."""
    return F.coalesce(squeeze(F.lower(F.col(c) if isinstance(c, str) else c)), F.lit(""))


def upsert_queries(dim: DataFrame | None, batch: DataFrame, now: str) -> DataFrame:
    """K7: find-or-create canonical queries.

    ``batch``: ``source, entity_type, query_text, ingest_seq``. Key
    (source or '', entity_type, K6(query_text)); a new key keeps its first
    text; every use sets ``last_executed_at`` to ``now``.
    """
    spark = _spark(batch)
    dim = dim if dim is not None else schemas.empty(spark, schemas.SEARCH_QUERIES)
    b = batch.select(F.coalesce(F.col("source"), F.lit("")).alias("source"), "entity_type",
                     F.coalesce(F.col("query_text"), F.lit("")).alias("query_text"),
                     normalize_query("query_text").alias("normalized_query"), SEQ)
    agg = (b.groupBy("source", "entity_type", "normalized_query")
           .agg(F.min_by("query_text", SEQ).alias("query_text")))
    keys = ["source", "entity_type", "normalized_query"]
    j = dim.alias("o").join(agg.alias("n"), keys, "full_outer")
    now_ts = F.to_timestamp(F.lit(now))
    used = F.col("n.query_text").isNotNull()
    return j.select(
        F.coalesce(F.col("o.id"), query_id(F.col("source"), F.col("entity_type"),
                                            F.col("normalized_query"))).alias("id"),
        "source", "entity_type",
        F.coalesce(F.col("o.query_text"), F.col("n.query_text")).alias("query_text"),
        "normalized_query",
        F.coalesce(F.col("o.created_at"), now_ts).alias("created_at"),
        F.when(used, now_ts).otherwise(F.col("o.last_executed_at")).alias("last_executed_at"),
    ).select(*schemas.SEARCH_QUERIES.fieldNames())


# ---------------------------------------------------------------------- K8
def attach_query_id(records: DataFrame, dim: DataFrame, entity_type: str = "person",
                    compat: bool = False) -> DataFrame:
    """K8: set ``search_query_id`` on records from the query dimension.

    Default: per row, by the record's own (source_name, source_query).
    ``compat=True``: the first record (by ``ingest_seq``) having both decides
    for the whole batch, as the reference does.
    """
    d = dim.filter(F.col("entity_type") == entity_type).select(
        F.col("source").alias("_s"), F.col("normalized_query").alias("_q"), F.col("id").alias("_qid"))
    has = nonempty("source_name").isNotNull() & nonempty("source_query").isNotNull()
    if not compat:
        # a dimension read from a written table is broadcast by its bytes when
        # small; else AQE splits a query that many records share
        r = records.withColumn("_s", F.when(has, F.col("source_name"))) \
                   .withColumn("_q", F.when(has, normalize_query("source_query")))
        return r.join(d, ["_s", "_q"], "left").withColumn("search_query_id", F.col("_qid")) \
                .drop("_s", "_q", "_qid")
    # a global aggregate: exactly one row, so broadcasting it is size-bounded
    first = (records.filter(has)
             .agg(F.min_by(F.struct(F.col("source_name").alias("_s"),
                                    normalize_query("source_query").alias("_q")), F.col(SEQ)).alias("f"))
             .select("f._s", "f._q").join(d, ["_s", "_q"], "left")
             .select(F.lit(1).alias("_one"), "_qid"))
    return (records.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one", "left")
            .withColumn("search_query_id", F.col("_qid")).drop("_one", "_qid"))


# ---------------------------------------------------------------------- K9
def backfill_queries(people: DataFrame, dim: DataFrame, now: str):
    """K9: create person queries for (source, query) pairs seen on people
    (lower + trim only, as the backfill does), then fill NULL
    ``search_query_id`` from them. Returns (people, dim)."""
    norm = ascii_lower(sqlite_trim(F.coalesce(F.col("source_query"), F.lit(""))))
    pairs = (people.filter(F.coalesce(F.col("source_query"), F.lit("")) != "")
             .select(F.coalesce(F.col("source_name"), F.lit("")).alias("source"),
                     F.lit("person").alias("entity_type"),
                     F.coalesce(F.col("source_query"), F.lit("")).alias("query_text"),
                     norm.alias("normalized_query"), F.struct("created_batch", "created_seq").alias(SEQ)))
    first = pairs.groupBy("source", "entity_type", "normalized_query") \
                 .agg(F.min_by("query_text", SEQ).alias("query_text"))
    keys = ["source", "entity_type", "normalized_query"]
    new = first.join(dim.select(*keys), keys, "left_anti")
    now_ts = F.to_timestamp(F.lit(now))
    new_rows = new.select(query_id(F.col("source"), F.col("entity_type"), F.col("normalized_query")).alias("id"),
                          "source", "entity_type", "query_text", "normalized_query",
                          now_ts.alias("created_at"), F.lit(None).cast("timestamp").alias("last_executed_at"))
    dim2 = dim.unionByName(new_rows)
    from leadframe.session import materialize
    dim2 = materialize(dim2, "queries")
    lookup = dim2.filter(F.col("entity_type") == "person").select(
        F.col("source").alias("_s"), F.col("normalized_query").alias("_q"), F.col("id").alias("_qid"))
    p = (people.withColumn("_s", F.coalesce(F.col("source_name"), F.lit("")))
         .withColumn("_q", norm)
         .join(lookup, ["_s", "_q"], "left")
         .withColumn("search_query_id", F.when(
             F.col("search_query_id").isNull() & (F.coalesce(F.col("source_query"), F.lit("")) != ""),
             F.col("_qid")).otherwise(F.col("search_query_id")))
         .drop("_s", "_q", "_qid"))
    return p, dim2


# --------------------------------------------------------------------- K10
DEDUPE_FIELDS = ["first_name", "last_name", "title_current", "email", "location_text",
                 "connections_linkedin", "followers_linkedin", "website_info", "phone_info",
                 "info_raw", "insights_text", "lookup_date", "is_hot", "status", "notes",
                 "last_interaction_date", "company_id"]


def dedupe_people(people: DataFrame):
    """Merge people whose profile URLs normalise (N7) to one key (the raw
    URL when N7 gives NULL). The earliest row survives; for each of the 17
    fields the survivor keeps its value unless NULL, else takes the first
    non-NULL, non-empty value of the others in order. The survivor's URL
    becomes the key; single rows stay as they are.

    Returns (people, url_mapping) where ``url_mapping`` has one row per
    removed duplicate: ``dup_url, canonical_url``.

    The key is derived in one written scan of the people that carries it, so
    whatever the table is computed from runs once. The keys held by several
    rows split those written rows in one join into the ones to merge and the
    ones that pass through without a sort. Ids must be unique (the store
    asserts it).
    """
    from leadframe.functions.urls import with_profile_key
    from leadframe.session import materialize
    order = F.struct("created_batch", "created_seq", "id")
    keyed = with_profile_key(people, "linkedin_profile", "_key")
    keyed = materialize(keyed.withColumn("_key", F.coalesce("_key", "linkedin_profile")), "dedupe-people")
    several = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_o"))
                          .filter("_n > 1").select("_key", F.col("_o.id").alias("_sid")), "dedupe-keys")
    mapping = (keyed.select("id", "linkedin_profile", "_key").join(several, "_key").filter(F.col("id") != F.col("_sid"))
               .select(F.col("linkedin_profile").alias("dup_url"), F.col("_key").alias("canonical_url")))

    types = dict(people.dtypes)

    def usable(c):
        col = F.col(c)
        if types[c] == "string":
            return col.isNotNull() & (col != "")
        return col.isNotNull()
    p = keyed.join(several, "_key", "left")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PEOPLE.fields]
    single = p.filter(F.col("_sid").isNull()).select(*columns)
    aggs = [F.min_by(F.struct(*schemas.PEOPLE.fieldNames()), order).alias("s")]
    aggs += [F.min_by(F.col(c), F.when(usable(c), order)).alias(f"_f_{c}") for c in DEDUPE_FIELDS]
    g = p.filter(F.col("_sid").isNotNull()).groupBy("_key").agg(*aggs)
    cols = []
    for f in schemas.PEOPLE.fields:
        v = F.col(f"s.{f.name}")
        if f.name in DEDUPE_FIELDS:
            v = F.coalesce(v, F.col(f"_f_{f.name}"))
        elif f.name == "linkedin_profile":
            v = F.col("_key")
        cols.append(v.cast(f.dataType).alias(f.name))
    return single.unionByName(g.select(*cols)), mapping


# --------------------------------------------------------------------- K11
def repoint_messages(messages: DataFrame, mapping: DataFrame) -> DataFrame:
    """Messages on a removed duplicate's URL move to the canonical URL.
    The mapping grows with the duplicates, so it is joined, not broadcast by
    force; AQE broadcasts it when its measured size is small."""
    m = mapping.dropDuplicates(["dup_url"])
    return (messages.join(m, messages["linkedin_profile"] == m["dup_url"], "left")
            .withColumn("linkedin_profile", F.coalesce("canonical_url", "linkedin_profile"))
            .drop("dup_url", "canonical_url"))


# --------------------------------------------------------------------- K12
def erase_profiles(people: DataFrame, messages: DataFrame, keys: DataFrame):
    """Remove the people named in ``keys`` (column ``profile_url``, any
    spelling: compared after N7) and every outreach message on them.
    Returns (people, messages)."""
    from leadframe.session import materialize
    k = materialize(keys.select(F.coalesce(profile_key("profile_url"), F.col("profile_url")).alias("_k")).distinct(),
                    "erase-keys")

    def keyed(df):
        return df.withColumn("_k", F.coalesce(profile_key("linkedin_profile"), F.col("linkedin_profile")))
    p = keyed(people).join(k, "_k", "left_anti").drop("_k")
    m = keyed(messages).join(k, "_k", "left_anti").drop("_k")
    return p, m


def erase_companies(companies: DataFrame, people: DataFrame, ids: DataFrame):
    """Company delete with the foreign-key rule: people pointing at a removed
    company get ``company_id`` NULL. ``ids``: column ``id``."""
    d = ids.select(F.col("id").alias("_del")).distinct()
    c = companies.join(d, companies["id"] == d["_del"], "left_anti")
    p = (people.join(d, people["company_id"] == d["_del"], "left")
         .withColumn("company_id", F.when(F.col("_del").isNull(), F.col("company_id")))
         .drop("_del"))
    return c, p


# --------------------------------------------------------------------- K13
def with_company_domain(records: DataFrame, rules=None) -> DataFrame:
    """Records with a key, and ``_domain``: the company domain given, else the
    apex (D1, by ``rules``) of the company website."""
    from leadframe.functions.urls import apex_domain
    from leadframe.sources.suffixes import DEFAULT_RULES
    return records.filter(F.col("linkedin_profile").isNotNull()).withColumn(
        "_domain", F.coalesce(nonempty("company_domain"),
                              apex_domain(F.col("company_website"), rules or DEFAULT_RULES)))


def person_ingest(records: DataFrame, people: DataFrame | None, companies: DataFrame | None,
                  queries: DataFrame | None, now: str, batch_id: str, batch_no: int = 0,
                  compat_query: bool = False, materialize_batch: bool = True, rules=None,
                  stub_ids: DataFrame | None = None):
    """Standardised person records -> query dimension (K7/K8) -> company
    upsert (K2/K3) -> people upsert with the company link (K1 + K5, one pass).

    ``records`` follow ``schemas.PERSON_RECORD`` (see
    ``operators.standardise.standardise_people``); with a ``_domain`` column
    they are taken as ``with_company_domain`` left them. ``batch_id`` must not
    have been used before. ``stub_ids`` turns K3's ``reuse_by_name`` on.
    Returns (people, companies, queries, processed) where ``processed`` is a one-row frame counting records with a key.
    """
    from leadframe.session import materialize

    # the batch feeds four jobs (queries, people, companies, links) and the
    # company and query tables two each: all three are written once
    keep = (lambda df, name: materialize(df, name)) if materialize_batch else (lambda df, name: df)
    keyed = records if "_domain" in records.columns else keep(with_company_domain(records, rules), "ingest-batch")
    qbatch = keyed.filter(nonempty("source_name").isNotNull() & nonempty("source_query").isNotNull()) \
                  .select(F.col("source_name").alias("source"), F.lit("person").alias("entity_type"),
                          F.col("source_query").alias("query_text"), SEQ)
    if compat_query:
        qbatch = qbatch.orderBy(SEQ).limit(1)
    queries2 = keep(upsert_queries(queries, qbatch, now), "ingest-queries")
    rec = attach_query_id(keyed, queries2, compat=compat_query)
    comp_rows = rec.select(
        F.col("company_name").alias("name"), F.col("_domain").alias("domain"),
        F.col("company_website").alias("website"), "source_name", "source_query", "search_query_id", SEQ
    ).filter(F.coalesce(nonempty("domain"), nonempty("name")).isNotNull())
    companies2 = keep(upsert_companies(companies, comp_rows, batch_id, batch_no, stub_ids=stub_ids), "ingest-companies")
    # K1 and K5 in one pass over the stored people; only the batch's domains
    # are looked up, so the stored companies are filtered before the join
    domains = rec.select(F.col("_domain").alias("domain")).distinct()
    linkable = companies2.join(domains, "domain", "left_semi") if companies is not None else companies2
    people3 = upsert_people(people, rec.drop("company_domain").withColumnRenamed("_domain", "company_domain"),
                            now, companies=linkable, batch_id=batch_id, batch_no=batch_no, stub_ids=stub_ids)
    processed = keyed.agg(F.count(F.lit(1)).alias("processed_people"))
    return people3, companies2, queries2, processed
