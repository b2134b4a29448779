"""The reference's runs as composed jobs (A1 ingest, A4 companies, A7 enrich,
B7 dedupe, K12 erase) over one snapshot store."""
import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadframe.operators import runs
from leadframe.session import scratch_dir
from leadframe.sources import readers
from leadframe.sources.snapshots import CommitConflict, SnapshotStore

NOW = "2024-02-01 00:00:00"


def test_runs_end_to_end(spark):
    store = SnapshotStore(spark, scratch_dir(spark, "runs"))
    d = scratch_dir(spark, "runs-in")
    os.makedirs(d)
    with open(f"{d}/p.json", "w") as fh:
        json.dump({"profiles": [
            {"Contact_Name": "Dr. Alice Example", "LinkedIn_Profile": "https://www.linkedin.com/in/Alice-X/",
             "Position": "Engineer", "Company": "Acme", "Company_Domain": "acme.com",
             "source_name": "linkedin_people_google", "source_query": "Engineer Berlin"},
            {"name": "Bob Muster", "profile_url": "https://linkedin.com/in/bob", "summary": "Sales lead."},
            {"name": "X", "profile_url": "https://linkedin.com/in/x", "summary": "bad name"}]}, fh)
    processed = rows(runs.ingest_people_file(spark, store, d, NOW, "people-1"))
    assert processed == [{"processed_people": 2}]            # the invalid raw record is rejected
    people = {r["linkedin_profile"]: r for r in rows(store.read("people"))}
    assert set(people) == {"https://linkedin.com/in/alice-x", "https://linkedin.com/in/bob"}
    assert people["https://linkedin.com/in/alice-x"]["title_current"] == "Engineer (Dr.)"

    comp = spark.createDataFrame([("Acme GmbH", "acme.com", None, None, 1), ("Beta", None, "https://www.beta.io/", None, 2)],
                                 "Company string, Company_Domain string, Company_Website string, address string, "
                                 "ingest_seq long")
    runs.ingest_companies(store, comp, "companies-1")
    by_dom = {r["domain"]: r for r in rows(store.read("companies"))}
    assert by_dom["acme.com"]["name"] == "Acme GmbH" and "beta.io" in by_dom

    ids = {r["name"]: r["id"] for r in rows(store.read("companies"))}
    answers = spark.createDataFrame([(ids["Acme GmbH"], '{"Company": "Acme GmbH", "Industries": ["Tools"], '
                                                        '"Size_Employees": 50}')], "id long, text string")
    done = rows(runs.enrich_companies(store, answers, NOW, "enrich-1", limit=10, default_when_missing=True))
    assert {r["name"]: r["size_employees"] for r in done} == {"Acme GmbH": 50, "Beta": None}
    assert all(r["last_enriched_at"] is not None for r in done)

    runs.erase_people_run(store, spark.createDataFrame([("https://www.linkedin.com/in/BOB",)], "profile_url string"), "erase-1")
    assert [r["linkedin_profile"] for r in rows(store.read("people"))] == ["https://linkedin.com/in/alice-x"]
    mapping = runs.dedupe_people_run(store, "dedupe-1")
    assert mapping.count() == 0
    assert store.read("people").filter(F.col("company_id").isNotNull()).count() == 1
    with pytest.raises(CommitConflict):                      # a batch id is accepted once
        runs.ingest_people_file(spark, store, d, NOW, "people-1")
    runs.backfill_queries_run(store, NOW, "backfill-1")
    assert [r["query_text"] for r in rows(store.read("search_queries"))] == ["Engineer Berlin"]


def people_file(spark, name, profiles):
    d = scratch_dir(spark, name)
    os.makedirs(d)
    with open(f"{d}/p.json", "w") as fh:
        json.dump(profiles, fh)
    return d


def test_stub_companies_of_two_runs_stay_apart(spark):
    store = SnapshotStore(spark, scratch_dir(spark, "stubs"))
    for i, (who, firm) in enumerate([("ann", "Alpha"), ("bob", "Beta")]):
        d = people_file(spark, "stub", [{"Contact_Name": who.title() + " X", "Company": firm,
                                         "LinkedIn_Profile": f"https://linkedin.com/in/{who}"}])
        runs.ingest_people_file(spark, store, d, NOW, f"run-{i}")
    from leadframe.operators import reports
    view = rows(reports.people_with_company(store.read("people"), store.read("companies")))
    assert sorted((r["linkedin_profile"][-3:], r["company_name"]) for r in view) == [("ann", "Alpha"), ("bob", "Beta")]
    assert [r["linkedin_profile"][-3:] for r in rows(reports.report_recent(store.read("people"), store.read("companies")))] \
        == ["bob", "ann"]


def test_failed_commit_and_replay_change_nothing(spark, monkeypatch):
    store = SnapshotStore(spark, scratch_dir(spark, "replay"))
    d = people_file(spark, "replay-in", [{"Contact_Name": "Ann X", "Company": "Alpha", "LinkedIn_Profile": "https://linkedin.com/in/ann"}])
    for step in ("_write", "_publish"):
        orig, calls = getattr(SnapshotStore, step), []

        def dies(self, *a, _orig=orig, _calls=calls):
            _calls.append(1)
            if step == "_publish" or len(_calls) == 2:       # in _write: after the first table
                raise OSError("lost")
            return _orig(self, *a)
        monkeypatch.setattr(SnapshotStore, step, dies)
        with pytest.raises(OSError):
            runs.ingest_people_file(spark, store, d, NOW, "only")
        monkeypatch.setattr(SnapshotStore, step, orig)
        assert store.versions() == [] and store.read("people") is None
    # a manifest whose writer died while creating it doesn't block
    store._fs.create(store._path("_manifests/000000000001"), False).close()
    runs.ingest_people_file(spark, store, d, NOW, "only")
    assert store.read("people").count() == 1 and store.read("companies").count() == 1
    with pytest.raises(CommitConflict):
        runs.ingest_people_file(spark, store, d, NOW, "only")
    assert store.read("companies").count() == 1


def test_small_batch_rewrites_only_its_buckets(spark):
    store = SnapshotStore(spark, scratch_dir(spark, "buckets"), buckets=16)
    many = [{"Contact_Name": f"P{i} X", "Company": f"C{i}", "Company_Domain": f"c{i}.com",
             "LinkedIn_Profile": f"https://linkedin.com/in/p{i}"} for i in range(200)]
    runs.ingest_people_file(spark, store, people_file(spark, "many", many), NOW, "many")
    before = store._newest()["tables"]
    runs.ingest_people_file(spark, store, people_file(spark, "one", [dict(many[7], Position="New")]), NOW, "one")
    after = store._newest()["tables"]
    for t in ("people", "companies"):
        changed = [b for b in after[t]["buckets"] if after[t]["buckets"][b] != before[t]["buckets"].get(b)]
        assert len(changed) == 1 and len(before[t]["buckets"]) == 16
    assert store.read("people").count() == 200 and store.read("companies").count() == 200
    assert store.read("people").filter("title_current = 'New'").count() == 1


def test_stored_tables_gain_columns(spark):
    """S7 on read: a table written before a column was added reads with it, NULL."""
    from leadframe import schemas
    store = SnapshotStore(spark, scratch_dir(spark, "grow"))
    old = spark.createDataFrame([(1, "https://linkedin.com/in/a")], "id long, linkedin_profile string")
    store.write(old, "people")
    assert store.read("people").schema == schemas.PEOPLE
    assert rows(store.read("people"))[0]["created_batch"] is None


def test_two_rows_with_one_id_are_refused(spark):
    store = SnapshotStore(spark, scratch_dir(spark, "clash"))
    with pytest.raises(ValueError, match="share one id"):
        store.write(spark.createDataFrame([(1, "a"), (1, "b")], "id long, linkedin_profile string"), "people")
    assert store.versions() == []


def test_pages_to_tables_as_one_run(spark):
    """Landed pages (short ones) through S2, X, V, N and K13 to R6, twice."""
    store = SnapshotStore(spark, scratch_dir(spark, "search"))

    def item(who, n):
        return {"title": f"{who} - Engineer - Acme | LinkedIn", "link": f"https://www.linkedin.com/in/p{n}/",
                "snippet": f"{who} is an engineer. 500+ connections."}
    names = ["Ann Lee", "Bob Ray", "Cy Doe", "Di Moe", "Ed Poe"]
    pages = [("q", 1, 1000, [item(n, i) for i, n in enumerate(names[:2])], 1),
             ("q", 11, 1000, [item(n, i + 2) for i, n in enumerate(names[2:])] + [item(names[0], 0)], 2)]
    df = spark.createDataFrame(pages, readers.SEARCH_PAGE)
    processed, summary = runs.ingest_search_run(store, df, None, "search", "q", NOW, "s1", max_results=20)
    assert rows(processed) == [{"processed_people": 5}]
    s = rows(summary)[0]
    assert (s["total_profiles"], s["valid_profiles"], s["duplicate_profiles_removed"]) == (5, 5, 1)
    people = {r["linkedin_profile"]: r for r in rows(store.read("people"))}
    assert len(people) == 5 and people["https://linkedin.com/in/p3"]["first_name"] == "Di"
    assert people["https://linkedin.com/in/p0"]["created_seq"] < people["https://linkedin.com/in/p4"]["created_seq"]
    more = spark.createDataFrame([("q2", 1, 5, [item("Flo Yu", 9), item("Ann Lee", 0)], 3)], readers.SEARCH_PAGE)
    runs.ingest_search_run(store, more, None, "search", "q2", NOW, "s2")
    assert store.read("people").count() == 6
    assert {r["query_text"] for r in rows(store.read("search_queries"))} == {"q", "q2"}
