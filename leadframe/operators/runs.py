"""The reference's runs as composed jobs over the snapshot store.

Each function is one command of the reference re-expressed as a Spark job
(composition of the table jobs; no CLI): ingest landed profiles, ingest a
search run, ingest landed companies, enrich pending companies from landed
answers, queue outreach, fill missing query ids, merge duplicate people, erase
people. A run is one commit: all the tables it changes become visible
together, and its batch id is accepted once. It reads and rewrites only the
buckets that its batch touches, where the job allows that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadframe import schemas
from leadframe.functions.text import nonempty
from leadframe.functions.urls import profile_key
from leadframe.operators import enrich, extract, outreach, reports, responses, standardise, upsert, validate
from leadframe.session import drop_scratch, materialize
from leadframe.sources import readers
from leadframe.sources.snapshots import CommitConflict, SnapshotStore

PEOPLE, COMPANIES, QUERIES, STUB_NAMES = "people", "companies", "search_queries", "company_names"
MESSAGES, TEMPLATES = "outreach_messages", "outreach_templates"
QUERY_PEOPLE, USAGE = "query_people", "usage"


def _stub_names(store: SnapshotStore, rows: DataFrame):
    """K3 ``reuse_by_name`` over the store: (name -> id of the rows' names, new index rows, index buckets touched).

    The index of stub names is a table of its own, bucketed by name, so only
    the buckets of the batch's names are read; a store that has none yet gets
    it from its companies, once. It is written by the same commit.
    """
    names = materialize(rows.filter(F.col("name").isNotNull()).select("name").distinct(), "run-stub-names")
    index = store.read(STUB_NAMES)
    touched = None
    if index is None and store.read(COMPANIES) is not None:
        index = materialize(upsert.stub_index(store.read(COMPANIES)), "run-stub-index")
    elif index is not None:
        touched = store.touched(STUB_NAMES, names)
        index = store.read(STUB_NAMES, buckets=touched)
    ids = materialize(upsert.stub_ids_by_name(names, index), "run-stub-ids")
    rows = ids if index is None else index.select("name", "id").unionByName(ids.join(index, "name", "left_anti").select("name", "id"))
    return ids, rows if touched is None else (rows, touched)


def commit_people(store: SnapshotStore, records: DataFrame, now: str, batch_id: str, rules=None,
                  reuse_by_name: bool = False) -> DataFrame:
    """K13 on standardised records against the stored tables, one commit.
    Refuses a batch id used before, before any work. ``reuse_by_name``: a
    company without a domain is looked up by its name before a stub is added
    (K3; off, as in the reference). A table that has outgrown its buckets gets
    more of them first."""
    store.fit(PEOPLE, COMPANIES, QUERIES)
    store = store.begin()
    if store.committed(batch_id):
        raise CommitConflict(f"batch {batch_id!r} was committed before")
    keyed = materialize(upsert.with_company_domain(records, rules), "run-batch")
    batch_no = store.next_batch()
    people_b = store.touched(PEOPLE, keyed)
    nameless = F.lit(None).cast("string").alias("domain")
    stub_ids, changes = None, {}
    if reuse_by_name:
        stub_ids, changes[STUB_NAMES] = _stub_names(store, keyed.filter(nonempty("_domain").isNull())
                                                    .select(nonempty("company_name").alias("name")))
        stubs = stub_ids.select(nameless, "id")
    else:
        stubs = keyed.filter(nonempty("_domain").isNull()).select(
            nameless, upsert.stub_company_id(batch_id, F.col("ingest_seq")).alias("id"))
    company_b = store.touched(COMPANIES, keyed.filter(nonempty("_domain").isNotNull()).select(
        F.col("_domain").alias("domain"), F.lit(0).alias("id")), stubs)
    query_b = store.touched(QUERIES, keyed.select(upsert.normalize_query("source_query").alias("normalized_query")))
    people, companies, queries, processed = upsert.person_ingest(
        keyed, store.read(PEOPLE, buckets=people_b), store.read(COMPANIES, buckets=company_b),
        store.read(QUERIES, buckets=query_b), now, batch_id, batch_no, stub_ids=stub_ids)
    n = processed.first()[0]
    store.commit({QUERIES: (queries, query_b), COMPANIES: (companies, company_b), PEOPLE: (people, people_b), **changes}, batch_id)
    drop_scratch(store.spark)
    return store.spark.createDataFrame([(n,)], "processed_people long")


def ingest_people_file(spark: SparkSession, store: SnapshotStore, path: str, now: str, batch_id: str,
                       rules=None) -> DataFrame:
    """``ingest --input``: JSON people (S1) -> V9 routing -> N rules -> K13,
    committed. Returns the one-row processed count."""
    profiles, _rejected = validate.route_people(standardise.with_profile_columns(readers.read_people_json(spark, path)))
    return commit_people(store, standardise.standardise_people(profiles), now, batch_id, rules)


def ingest_search_run(store: SnapshotStore, pages: DataFrame, answers: DataFrame | None, source_name: str,
                      query: str, now: str, batch_id: str, max_results: int = 50, rules=None):
    """``run ingest-people --write-db``: landed result pages -> S2 -> X (with
    model answers) -> V5/V7/V8 -> provenance (S5) -> N1 -> V9 -> N -> K13,
    committed. Returns (processed, run summary R6)."""
    items = materialize(readers.flatten_search_pages(pages, max_results), "run-items")
    parsed = responses.parse_profile_responses(answers) if answers is not None else None
    profiles, metrics = extract.extract_profiles(items, parsed)
    checked = profiles.withColumn("errors", validate.profile_errors(profiles))
    valid = validate.clean_profiles(validate.drop_duplicate_profiles(
        checked.filter(F.size("errors") == 0).drop("errors")))
    tagged = readers.union_sources([(valid, source_name, query)])
    mapped = standardise.map_to_person_schema(tagged, now[:10])
    people, _ = validate.route_people(standardise.with_profile_columns(mapped))
    totals, _ = validate.validation_metrics(checked)
    summary = reports.run_summary(query, metrics, totals)
    summary = store.spark.createDataFrame(summary.collect(), summary.schema)    # one row, before scratch goes
    processed = commit_people(store, standardise.standardise_people(people), now, batch_id, rules)
    return processed, summary


def ingest_companies(store: SnapshotStore, rows: DataFrame, batch_id: str) -> DataFrame:
    """Company source rows (S6) -> V13 -> K4, committed."""
    store = store.begin()
    if store.committed(batch_id):
        raise CommitConflict(f"batch {batch_id!r} was committed before")
    prep = materialize(validate.company_ingest_prep(rows), "run-companies")
    alone, _ = upsert.persist_companies(None, prep, batch_id)
    touched = store.touched(COMPANIES, alone)
    table, processed = upsert.persist_companies(store.read(COMPANIES, buckets=touched), prep, batch_id,
                                                store.next_batch())
    n = processed.first()[0]
    store.commit({COMPANIES: (table, touched)}, batch_id)
    drop_scratch(store.spark)
    return store.spark.createDataFrame([(n,)], "processed_companies long")


def enrich_companies(store: SnapshotStore, answers: DataFrame, now: str, batch_id: str, limit: int = 10,
                     default_when_missing: bool = False) -> DataFrame:
    """``enrich --limit``: E1 picks the batch; ``answers`` (``id, text``) are
    parsed (M2); a missing answer aborts (E6) unless the default answer (E5)
    is allowed; E7/E8 write the result. Returns the enriched rows."""
    store = store.begin()
    companies = store.read(COMPANIES)
    pending = materialize(enrich.pending_companies(companies, limit), "run-pending")
    parsed = responses.parse_company_responses(answers).filter(F.col("parse_ok"))
    if default_when_missing:
        parsed = parsed.unionByName(
            enrich.default_enrichment(pending.join(parsed.select("id"), "id", "left_anti")),
            allowMissingColumns=True)
    enrich.assert_enrichment_complete(pending, parsed)
    out = enrich.apply_enrichment(companies, pending, parsed, now)
    done = materialize(out.join(pending.select("id"), "id", "left_semi"), "run-enriched")
    # a domain can move a company to another bucket: both are rewritten
    touched = store.touched(COMPANIES, done, companies.join(pending.select("id"), "id", "left_semi"))
    rows = store.read(COMPANIES, buckets=touched).join(pending.select("id"), "id", "left_anti").unionByName(done)
    ids = store.spark.createDataFrame(pending.select("id").collect(), "id long")     # at most ``limit`` rows
    store.commit({COMPANIES: (rows, touched)}, batch_id)
    drop_scratch(store.spark)
    return store.read(COMPANIES).join(ids, "id", "left_semi")


def add_templates(store: SnapshotStore, new: DataFrame, now: str, batch_id: str) -> None:
    """O1, committed."""
    store = store.begin()
    touched = store.touched(TEMPLATES, new)
    rows = outreach.add_templates(store.read(TEMPLATES, buckets=touched), new, now, batch_id)
    store.commit({TEMPLATES: (rows, touched)}, batch_id)


def schedule_messages(store: SnapshotStore, new: DataFrame, now: str, batch_id: str) -> None:
    """O2, committed."""
    store = store.begin()
    touched = store.touched(MESSAGES, new)
    rows = outreach.schedule_messages(store.read(MESSAGES, buckets=touched), new, now, batch_id)
    store.commit({MESSAGES: (rows, touched)}, batch_id)


def backfill_queries_run(store: SnapshotStore, now: str, batch_id: str) -> None:
    """K9 over the stored people and queries, committed (the reference does
    it whenever it opens its database)."""
    store = store.begin()
    dim = store.read(QUERIES)
    people, queries = upsert.backfill_queries(store.read(PEOPLE), dim if dim is not None else
                                              schemas.empty(store.spark, schemas.SEARCH_QUERIES), now)
    store.commit({PEOPLE: people, QUERIES: queries}, batch_id)
    drop_scratch(store.spark)


def dedupe_people_run(store: SnapshotStore, batch_id: str) -> DataFrame:
    """``dedupe-people``: K10 + K11, one commit. Returns the URL mapping."""
    store = store.begin()
    merged, mapping = upsert.dedupe_people(store.read(PEOPLE))
    mapping = materialize(mapping, "run-mapping")
    msgs = store.read(MESSAGES)
    changes = {PEOPLE: merged}
    if msgs is not None:
        changes[MESSAGES] = upsert.repoint_messages(msgs, mapping)
    store.commit(changes, batch_id)
    return mapping


def erase_people_run(store: SnapshotStore, keys: DataFrame, batch_id: str) -> None:
    """Remove the people named in ``keys`` (``profile_url``) and their
    messages, one commit; then every older version and the scratch tables of
    the session go too, so no file of the store holds them any more. What
    older versions said of other people goes with them. Not beside a running
    commit (``SnapshotStore.vacuum``)."""
    store = store.begin()
    msgs = store.read(MESSAGES)
    people, m = upsert.erase_profiles(store.read(PEOPLE), msgs if msgs is not None else
                                      store.read(PEOPLE).select("linkedin_profile").limit(0), keys)
    changes = {PEOPLE: people}
    if msgs is not None:
        changes[MESSAGES] = m
    store.commit(changes, batch_id)
    drop_scratch(store.spark)
    store.vacuum(keep=1)


def person_report(store: SnapshotStore, profile_url: str, tz: str = "UTC") -> DataFrame:
    """R1 on the store: reads the one bucket of people that holds the key."""
    key = store.spark.range(1).select(profile_key(F.lit(profile_url)).alias("linkedin_profile"))
    people = store.read(PEOPLE, buckets=store.touched(PEOPLE, key))
    return reports.report_person(reports.people_with_company(people, store.read(COMPANIES)), profile_url, tz)


def refresh_query_counts(store: SnapshotStore) -> int:
    """Bring R4's stored counts up to the newest version of the people; returns how many buckets it read.

    Whatever runs came since the last refresh, only the people buckets that
    they wrote are read, before and after, and of them one column: the counts
    after less the counts before are what changed. When that older version is
    gone (an erase, a vacuum), and the first time, the people are counted as a
    whole. The version counted is the epoch of a stream, so a refresh that
    failed half-way is done anew and none is added twice.
    """
    store = store.begin()
    now = store.base
    since = store.epoch(QUERY_PEOPLE)
    buckets = store.changed(PEOPLE, since) if store.read(QUERY_PEOPLE) is not None else None
    batch = f"stream:{QUERY_PEOPLE}:{now}"
    people = store.read(PEOPLE, buckets=buckets)
    if people is None or buckets == []:
        return 0
    new = reports.query_counts(people)
    if buckets is None:
        store.commit({QUERY_PEOPLE: new}, batch)
        return len(store.held(PEOPLE))
    old = store.read(PEOPLE, since, buckets)
    less = [] if old is None else [reports.query_counts(old).withColumn("people_count", -F.col("people_count"))]
    delta = materialize(reports.merge_query_counts(new, *less), "run-query-counts")
    touched = store.touched(QUERY_PEOPLE, delta)
    store.commit({QUERY_PEOPLE: (reports.merge_query_counts(store.read(QUERY_PEOPLE, buckets=touched), delta), touched)}, batch)
    drop_scratch(store.spark)
    return len(buckets)


def add_call_log(store: SnapshotStore, log: DataFrame, batch_id: str) -> None:
    """Add a part of the call log (S4) to R5's stored totals, one commit; a batch id counts once.

    Only this part is aggregated, and only the buckets of its runs are read.
    """
    store = store.begin()
    if store.committed(batch_id):
        raise CommitConflict(f"batch {batch_id!r} was committed before")
    new = materialize(reports.usage_totals(log), "run-usage")
    touched = store.touched(USAGE, new)
    old = store.read(USAGE, buckets=touched)
    rows = new if old is None else reports.merge_usage(old.unionByName(new))
    store.commit({USAGE: (rows, touched)}, batch_id)
    drop_scratch(store.spark)
