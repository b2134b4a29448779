"""Runs pinned to one version, erasure from every file, point lookups, K3 by name, K10 and S7 on small tables."""
import glob
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadframe import schemas
from leadframe.operators import reports, runs, upsert
from leadframe.session import scratch_dir
from leadframe.sources import readers
from leadframe.sources.snapshots import CommitConflict, SnapshotStore

NOW = "2024-02-01 00:00:00"
URL = "https://linkedin.com/in/"


def records(spark, items):
    """(key, company name, company domain) -> person records."""
    names = [f.name for f in schemas.PERSON_RECORD.fields]
    data = [{"ingest_seq": i, "linkedin_profile": URL + k, "first_name": k, "company_name": c, "company_domain": d,
             "source_name": "s", "source_query": f"q{i}"} for i, (k, c, d) in enumerate(items)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], schemas.PERSON_RECORD)


def store_of(spark, **options):
    return SnapshotStore(spark, scratch_dir(spark, "store"), **options)


def test_a_run_that_read_an_old_version_is_refused(spark):
    store = store_of(spark)
    runs.commit_people(store, records(spark, [("a", None, None)]), NOW, "one")
    run = store.begin()
    stale = run.read("people")
    runs.commit_people(store, records(spark, [("b", None, None)]), NOW, "two")
    assert run.read("people").count() == 1                      # still the version it began with
    with pytest.raises(CommitConflict):
        run.commit({"people": stale}, "three")
    assert {r["first_name"] for r in rows(store.read("people"))} == {"a", "b"}


def test_erased_people_are_in_no_file(spark):
    store = store_of(spark, buckets=4)
    runs.commit_people(store, records(spark, [(f"p{i}", None, None) for i in range(20)]), NOW, "one")
    runs.commit_people(store, records(spark, [("p3", "Acme", "acme.com")]), NOW, "two")
    msgs = spark.createDataFrame([(URL + "p3", 0), (URL + "p4", 1)], "linkedin_profile string, ingest_seq long").select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (("channel", "string"), ("template_id", "long"), ("stage_no", "int"),
                                                         ("rendered_md", "string"), ("scheduled_at", "timestamp_ntz"))])
    runs.schedule_messages(store, msgs, NOW, "three")
    keys = spark.createDataFrame([("https://www.linkedin.com/in/P3/",)], "profile_url string")
    runs.erase_people_run(store, keys, "erase")
    held = [f for f in glob.glob(store.root.removeprefix("file:") + "/data/**/*.parquet", recursive=True)]
    found = [f for f in held if "linkedin_profile" in spark.read.parquet(f).columns
             and spark.read.parquet(f).filter(F.col("linkedin_profile") == URL + "p3").count()]
    assert held and found == [] and store.versions() == [4]
    assert store.read("people").count() == 19 and store.read("outreach_messages").count() == 1


def test_person_report_reads_one_bucket(spark):
    store = store_of(spark, buckets=8)
    runs.commit_people(store, records(spark, [(f"p{i}", "Acme", "acme.com") for i in range(60)]), NOW, "one")
    got = runs.person_report(store, "https://www.linkedin.com/in/P7/")
    assert [(r["linkedin_profile"], r["company_name"]) for r in rows(got)] == [(URL + "p7", "Acme")]
    folders = {f.rsplit("/", 2)[1] for f in got.inputFiles() if "/people/" in f}
    assert len(folders) == 1
    assert f"EqualTo(linkedin_profile,{URL}p7)" in got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_recent_report_looks_up_late(spark):
    store = store_of(spark, buckets=2)
    runs.commit_people(store, records(spark, [(f"p{i}", f"c{i % 3}", None) for i in range(50)]), NOW, "one")
    people, companies = store.read("people"), store.read("companies")
    late = reports.report_recent(people, companies, limit=7, stored=True)
    assert rows(late) == rows(reports.report_recent(people, companies, limit=7))
    for by in ("connections", "followers"):
        assert rows(reports.report_recent(people, companies, by, limit=9, stored=True)) == rows(
            reports.report_recent(people, companies, by, limit=9))
    plan = late._jdf.queryExecution().executedPlan().toString()
    # the inner top comes from a scan without the wide columns, below the joins
    inner = plan.rsplit("TakeOrderedAndProject", 1)[1]
    assert plan.count("TakeOrderedAndProject") >= 2 and "Join" not in inner.split("FileScan")[0] and "first_name" not in inner.split("FileScan")[1]


@pytest.mark.parametrize("older", [False, True])
def test_a_stub_is_reused_by_name(spark, older):
    """One stub per name over runs, also one that an earlier run added without the option."""
    store = store_of(spark, buckets=4)
    runs.commit_people(store, records(spark, [("a", "Acme", None), ("b", "Beta", "beta.io"), ("c", "Acme", None)]), NOW, "one",
                       reuse_by_name=not older)
    stubs = lambda: [r for r in rows(store.read("companies")) if r["domain"] is None and r["name"] == "Acme"]
    assert len(stubs()) == (2 if older else 1)
    first = min(stubs(), key=lambda r: r["created_seq"])
    runs.commit_people(store, records(spark, [("d", "Acme", None), ("a", "Other", None), ("e", "Beta", None)]), NOW, "two",
                       reuse_by_name=True)
    runs.commit_people(store, records(spark, [("f", "Other", None), ("g", "Acme", None)]), NOW, "three", reuse_by_name=True)
    assert len(stubs()) == (2 if older else 1)
    acme = next(r for r in stubs() if r["id"] == first["id"])
    assert (acme["source_query"], acme["created_batch"], acme["created_seq"]) == ("q1", 1, first["created_seq"])
    company = {r["id"]: (r["name"], r["domain"]) for r in rows(store.read("companies"))}
    link = {r["first_name"]: r["company_id"] for r in rows(store.read("people"))}
    assert link["d"] == link["g"] == first["id"] and link["a"] == link["f"]
    assert company[link["a"]] == ("Other", None) and company[link["e"]] == ("Beta", None) and company[link["b"]] == ("Beta", "beta.io")
    assert sorted(n for n, d in company.values() if d is None) == (["Acme"] * (2 if older else 1)) + ["Beta", "Other"]


def test_without_the_option_every_run_adds_stubs(spark):
    store = store_of(spark, buckets=4)
    for batch in ("one", "two"):
        runs.commit_people(store, records(spark, [("a", "Acme", None)]), NOW, batch)
    assert store.read("companies").count() == 2 and store.read("company_names") is None


@pytest.mark.parametrize("copies", [1, 3])
def test_dedupe_with_few_and_many_duplicates(spark, copies):
    data = [(i * 10 + k, f"https://www.LinkedIn.com/in/P{i}/?x={k}" if k else URL + f"p{i}", f"e{k}" if k == 1 else None, k, 1)
            for i in range(30) for k in range(copies if i % 10 else 2)]
    people = readers.align_schema(spark.createDataFrame(
        data, "id long, linkedin_profile string, email string, created_seq long, created_batch long"), schemas.PEOPLE)
    merged, mapping = upsert.dedupe_people(people)
    got = {r["linkedin_profile"]: r for r in rows(merged)}
    assert set(got) == {URL + f"p{i}" for i in range(30)} and mapping.count() == len(data) - 30
    assert all(got[URL + f"p{i}"]["id"] == i * 10 for i in range(30))
    assert {k[len(URL):] for k, r in got.items() if r["email"] == "e1"} == {f"p{i}" for i in range(30) if copies > 1 or i % 10 == 0}


def test_json_text_columns_become_arrays(spark):
    data = [(1, '["a", "b"]', None), (2, "[1, null, {\"k\": [2]}, true]", "[]"), (3, "{}", "x"), (4, " ", "null"), (5, '"text"', '["ü"')]
    df = spark.createDataFrame(data, "id long, industries_json string, products_json string")
    done, rejects = readers.migrate_json_text(df)
    assert done.columns == ["id", "industries", "products"]
    assert {r["id"]: (r["industries"], r["products"]) for r in rows(done)} == {
        1: (["a", "b"], None), 2: (["1", '{"k":[2]}', "true"], []), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert sorted((r["id"], r["column"], r["reason"]) for r in rows(rejects)) == [
        (3, "industries_json", "not an array"), (3, "products_json", "not JSON"), (5, "industries_json", "not an array"),
        (5, "products_json", "not JSON")]
    kept = spark.createDataFrame([(1, ["new"], '["old"]'), (2, None, '["old"]')], "id long, industries array<string>, industries_json string")
    assert {r["id"]: r["industries"] for r in rows(readers.migrate_json_text(kept)[0])} == {1: ["new"], 2: ["old"]}
    again, none = readers.migrate_json_text(done)
    assert rows(again) == rows(done) and none.count() == 0


def test_buckets_follow_the_bytes(spark):
    store = store_of(spark, buckets=2)
    runs.commit_people(store, records(spark, [(f"p{i}", None, None) for i in range(400)]), NOW, "one")
    held = glob.glob(store.root.removeprefix("file:") + "/data/people/**/*.parquet", recursive=True)
    assert store.bucket_count("people") == 2 and store.fit("people", "outreach_messages") == []
    store.bucket_bytes = sum(map(os.path.getsize, held)) // 5
    runs.commit_people(store, records(spark, [("p3", "Acme", "acme.com"), ("new", None, None)]), NOW, "two")
    assert store.bucket_count("people") == 8 and len(store.held("people")) == 8
    people = store.read("people")
    assert people.count() == 401 and people.select("linkedin_profile").distinct().count() == 401
    # the batch found its old row in the new buckets, and point lookups still read one
    key = spark.createDataFrame([(URL + "p3",)], "linkedin_profile string")
    only = store.touched("people", key)
    assert len(only) == 1 and store.read("people", buckets=only).filter(F.col("linkedin_profile") == URL + "p3").count() == 1


def counted(store):
    return {(r["search_query_id"], r["people_count"]) for r in rows(store.read("query_people"))}


def test_query_counts_are_refreshed_from_changed_buckets(spark):
    store = store_of(spark, buckets=16)
    assert runs.refresh_query_counts(store) == 0                 # nothing stored yet
    full = lambda: {(r["search_query_id"], r["people_count"]) for r in rows(reports.query_counts(store.read("people")))}
    runs.commit_people(store, records(spark, [(f"p{i}", None, None) for i in range(40)]), NOW, "one")
    assert runs.refresh_query_counts(store) > 10 and counted(store) == full() and len(full()) == 40
    version = store.versions()[-1]
    assert runs.refresh_query_counts(store) == 0 and store.versions()[-1] == version
    # p7 moves from q7 to q0 and one person is new: two buckets at most
    runs.commit_people(store, records(spark, [("p7", None, None), ("x", None, None)]), NOW, "two")
    assert 1 <= runs.refresh_query_counts(store) <= 2
    assert counted(store) == full() and max(n for _, n in full()) == 2 and len(full()) == 39
    # an erase takes the older versions away: counted as a whole again
    runs.erase_people_run(store, spark.createDataFrame([(URL + "p3",)], "profile_url string"), "erase")
    runs.refresh_query_counts(store)
    assert counted(store) == full() and len(full()) == 38


def test_call_log_totals_add_up(spark):
    log = spark.createDataFrame([("r1", "a", "x", 3), ("r1", "a", None, None), ("r2", "b", "x", 5), (None, None, "x", 1),
                                 ("r1", "a", "x", 3)], "run_id string, caller string, provider string, tokens long")
    store = store_of(spark, buckets=4)
    runs.add_call_log(store, log, "one")
    runs.add_call_log(store, log.filter("run_id = 'r1'"), "two")
    runs.add_call_log(store, log.limit(0), "three")
    with pytest.raises(CommitConflict):
        runs.add_call_log(store, log, "two")
    whole = log.unionByName(log.filter("run_id = 'r1'"))
    for by in ({}, {"run_id": "r1"}, {"caller": "b"}, {"run_id": "none"}):
        got = rows(reports.usage_by_provider(store.read("usage"), stored=True, **by))
        key = lambda r: r["provider"]
        assert sorted(got, key=key) == sorted(rows(reports.usage_by_provider(whole, **by)), key=key)
