"""V, E, O, M, R and S jobs on the FIXTURES.md cases."""
import json
import os

import pytest
from conftest import one_col, rows
from pyspark.sql import functions as F

from leadframe import schemas
from leadframe.functions import legal
from leadframe.operators import enrich, outreach, reports, responses, validate
from leadframe.session import scratch_dir
from leadframe.sources import readers
from leadframe.sources.readers import align_schema
from leadframe.sources.snapshots import SnapshotStore

NOW = "2024-02-01 00:00:00"


# ------------------------------------------------------------------ V
def _companies(spark, data):
    df = spark.createDataFrame(data, "Company string, Company_Domain string, Company_Website string, "
                                     "address string, ingest_seq long")
    return align_schema(df, schemas.COMPANY_INPUT, keep_extra=True)


def test_a3_company_validation(spark):
    valid = _companies(spark, [(None, None, None, None, 1), ("Acme", None, None, None, 2),
                               (None, None, "https://acme.com", None, 3), (None, "acme.com", None, None, 4)])
    assert sorted(r["ingest_seq"] for r in rows(validate.valid_companies(valid))) == [2, 3, 4]
    dup = _companies(spark, [("Acme", "acme.com", None, None, 1), ("ACME GmbH", "acme.com", None, None, 2),
                             ("Acme Berlin", None, None, "Berlin", 3), ("Acme Berlin", None, None, "Berlin", 4)])
    assert sorted(r["ingest_seq"] for r in rows(validate.dedupe_companies(dup))) == [1, 3]
    derive = _companies(spark, [("Beta", None, "https://www.beta.io/contact", None, 1)])
    assert rows(validate.clean_companies(derive))[0]["Company_Domain"] == "beta.io"


def test_v5_valid_plus_rejected_is_input(spark):
    df = spark.createDataFrame([("Alice Example", "https://linkedin.com/in/alice", "s", 1),
                                ("X", "https://linkedin.com/in/x", "s", 2),
                                ("Bob", "https://example.com/in/bob", "s", 3),
                                ("Carl", "https://linkedin.com/in/carl", "", 4)],
                               "name string, profile_url string, summary string, ingest_seq long")
    valid, rejected = validate.validate_profiles(df)
    v, r = rows(valid), rows(rejected)
    assert len(v) + len(r) == 4
    assert [x["ingest_seq"] for x in v] == [1]
    errs = {x["ingest_seq"]: x["errors"] for x in r}
    assert errs[2] == ["Invalid name format: X"]
    assert errs[3] == ["Invalid LinkedIn URL: https://example.com/in/bob"]
    assert errs[4] == ["Missing required field: summary"]


def test_v4_warnings(spark):
    df = spark.createDataFrame([("bad@", "www.x.com", "12-34", 70), ("a@b.de", "https://x.com", "+49 711 1234567", 0)],
                               "email string, website string, phone string, experience_years long")
    w = [r["w"] for r in df.select(validate.profile_warnings(df).alias("w")).collect()]
    assert w[0] == ["Email format looks invalid", "Website should start with http(s)://",
                    "Phone number too short to be valid", "Experience years outside plausible range (0-60)"]
    assert w[1] == []


# ------------------------------------------------------------------ E
def test_b5_legal_forms(spark):
    df = spark.createDataFrame([("Muster GmbH & Co. KG", None), ("Muster", "GmbH (Germany)"),
                                ("Muster", "Aktiengesellschaft"), ("Muster", "e. K."), ("Muster e.K.", None),
                                ("Muster", "Stiftung")], "name string, provided string")
    got = [r[0] for r in df.select(legal.derive_legal_form("name", "provided")).collect()]
    assert got == ["GmbH & Co. KG", "GmbH", "AG", "e.K.", None, "Stiftung"]
    fixed = [r[0] for r in df.select(legal.derive_legal_form("name", "provided", fix_ek=True)).collect()]
    assert fixed[4] == "e.K."


def test_d2_suffix_substring_quirk(spark):
    assert one_col(spark, ["Acme Agency", "Bäcker GmbH", "X"], legal.clean_company_name) == ["acmeency", "baecker", None]
    assert one_col(spark, ["Acme Agency"], lambda c: legal.clean_company_name(c, compat=False)) == ["acme agency"]


def _company_table(spark, data):
    df = spark.createDataFrame(data, "id long, name string, domain string, created_seq long")
    return align_schema(df, schemas.COMPANIES)


def test_a5_domain_conflict(spark):
    comp = _company_table(spark, [(1, "Acme", "acme.com", 1), (2, "Beta", "beta.io", 2)])
    pend = spark.createDataFrame([(2, "Beta", None, 2)], "id long, name string, domain string, created_seq long")
    res = spark.createDataFrame([(2, "Beta", "GmbH", "https://acme.com")],
                                "id long, company string, legal_form string, website string")
    for c in enrich.RESULT_LISTS:
        res = res.withColumn(c, F.array().cast("array<string>"))
    res = res.withColumn("multinational", F.lit(None).cast("boolean")).withColumn("size_employees", F.lit(None).cast("long"))
    out = {r["id"]: r for r in rows(enrich.apply_enrichment(comp, pend, res, NOW))}
    assert out[2]["domain"] == "beta.io" and out[2]["legal_form"] == "GmbH"
    assert out[2]["last_enriched_at"] is not None and out[1]["last_enriched_at"] is None
    assert out[2]["multinational"] == 0


def test_a7_pending_default_and_missing(spark):
    comp = _company_table(spark, [(1, "Acme GmbH", "acme.com", 1), (2, "Broken Co", "broken.example", 2)])
    pend = enrich.pending_companies(comp, 10)
    assert [r["name"] for r in rows(pend)] == ["Acme GmbH", "Broken Co"]
    res = enrich.default_enrichment(pend.filter(F.col("id") == 1))
    assert rows(res)[0]["website"] == "https://acme.com"
    with pytest.raises(RuntimeError, match="1 companies"):
        enrich.assert_enrichment_complete(pend, res)
    done = enrich.apply_enrichment(comp, pend.filter(F.col("id") == 1), res, NOW)
    assert {r["id"]: r["last_enriched_at"] is not None for r in rows(done)} == {1: True, 2: False}


# ------------------------------------------------------------------ O
def test_b8_due_messages(spark):
    m = spark.createDataFrame([(1, "scheduled", "2024-01-02"), (2, "scheduled", "2024-01-01"),
                               (3, "sent", "2024-01-01"), (4, "scheduled", None), (5, "scheduled", "2024-01-03")],
                              "id long, status string, scheduled_at string") \
        .withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp_ntz"))
    m = align_schema(m, schemas.OUTREACH_MESSAGES)
    assert [r["id"] for r in outreach.due_messages(m, "2024-01-02 00:00:00").collect()] == [2, 1]


def test_o3_status_events_last_write_wins(spark):
    m = align_schema(spark.createDataFrame([(1, "scheduled")], "id long, status string"), schemas.OUTREACH_MESSAGES)
    ev = spark.createDataFrame([(1, "sent", "2024-01-01 10:00:00", 1), (1, "replied", "2024-01-02 10:00:00", 2)],
                               "message_id long, kind string, ts string, ingest_seq long") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    r = rows(outreach.apply_status_events(m, ev))[0]
    assert r["status"] == "replied" and r["sent_at"] is not None and r["replied_at"] is not None


# ------------------------------------------------------------------ M
def test_b9_answers(spark):
    df = spark.createDataFrame([('{"company":"Acme"}',), ('Sure: {"company":"Acme"} done',),
                                ('{"company":"Acme","x":1}',), ('{"follower_count":500}',), ("no json",)],
                               "content string")
    out = [(r["parse_ok"], r["company"]) for r in responses.parse_profile_responses(df).collect()]
    assert out == [(True, "Acme"), (True, "Acme"), (False, None), (False, None), (False, None)]
    c = spark.createDataFrame([('```json\n{"Company":"Acme"}\n```',), ('{"company":"Acme","Size_Employees":5}',),
                               ('{"Company":"Acme","Other":1}',)], "text string")
    got = [(r["parse_ok"], r["company"], r["size_employees"]) for r in responses.parse_company_responses(c).collect()]
    assert got == [(True, "Acme", None), (True, "Acme", 5), (False, None, None)]


def test_m3_m8_m6(spark):
    df = spark.createDataFrame([(" n/a ", "x", "  Acme ", "1K", None)],
                               "current_position string, company string, location string, follower_count string, "
                               "connection_count string")
    r = rows(responses.clean_response_fields(df))[0]
    assert (r["current_position"], r["company"], r["location"], r["follower_count"]) == (None, None, "Acme", "1K")
    a = spark.createDataFrame([("See https://linkedin.com/x and https://www.acme.de/about",), ("I am not sure",)],
                              "content string")
    assert [r["website"] for r in responses.urls_from_answers(a).collect()] == ["https://acme.de", None]
    p = spark.createDataFrame([("<html><head><style>p{}</style><script>var a='</p>';</script></head>"
                                "<body><!-- c --><p>Fish &amp; Chips</p><noscript>x</noscript>\n<p>ok</p></body>",)],
                              "html string")
    assert rows(responses.page_excerpts(p, max_chars=12))[0]["excerpt"] == "Fish & Chips"


# ------------------------------------------------------------------ S / R
def test_s1_both_json_shapes(spark):
    d = scratch_dir(spark, "s1test")
    os.makedirs(d, exist_ok=True)
    with open(f"{d}/a.json", "w") as fh:
        json.dump({"profiles": [{"name": "A", "profile_url": "u1", "follower_count": 1000}]}, fh)
    with open(f"{d}/b.json", "w") as fh:
        json.dump([{"Contact_Name": "B", "LinkedIn_Profile": "u2"}], fh)
    with open(f"{d}/c.json", "w") as fh:
        json.dump({"profiles": []}, fh)
    r = sorted(rows(readers.read_people_json(spark, d)), key=lambda x: x["ingest_seq"])
    assert [(x["name"], x["mapped_contact_name"], x["follower_count"]) for x in r] == [("A", None, "1000"),
                                                                                      (None, "B", None)]


def test_a8_call_log_and_usage(spark):
    d = scratch_dir(spark, "logtest")
    os.makedirs(d, exist_ok=True)
    line = {"caller": "unit.test", "provider": "openai", "model": "gpt-x", "operation": "chat.completions.create",
            "prompt_name": "demo", "prompt_hash": "abc", "duration_ms": 42, "status": "ok",
            "usage": {"total_tokens": 10}, "run_id": "test-run-123", "extras": {"company_name": "Acme"}}
    with open(f"{d}/log.jsonl", "w") as fh:
        fh.write(json.dumps(line) + "\nnot json\n[1,2]\n")
        fh.write(json.dumps({"provider": "", "usage": {"total_tokens": "x"}, "run_id": "test-run-123"}) + "\n")
    log = readers.read_call_log(spark, d)
    assert log.count() == 2
    u = {r["provider"]: (r["calls"], r["tokens"]) for r in reports.usage_by_provider(log, "test-run-123").collect()}
    assert u == {"openai": (1, 10), "unknown": (1, 0)}


def test_s2_flatten_stops_at_gap_and_total(spark):
    item = lambda i: (f"t{i}", f"https://x/{i}", None, None, None, None)
    pages = spark.createDataFrame([("q", 1, 25, [item(i) for i in range(10)], 1),
                                   ("q", 11, 25, [item(i) for i in range(10, 20)], 1),
                                   ("q", 21, 25, [item(i) for i in range(20, 25)], 1),
                                   ("g", 1, 100, [item(i) for i in range(3)], 1),
                                   ("g", 21, 100, [item(i) for i in range(5)], 1)], readers.SEARCH_PAGE)
    out = rows(readers.flatten_search_pages(pages, max_results=22))
    q = sorted(r["search_metadata"]["position"] for r in out if r["search_metadata"]["query_used"] == "q")
    assert q == list(range(1, 23))
    g = [r for r in out if r["search_metadata"]["query_used"] == "g"]
    assert len(g) == 3          # page 11 is missing: stop before page 21


def test_s7_align_idempotent(spark):
    df = spark.createDataFrame([("a",)], "name string")
    a1 = readers.align_schema(df, schemas.RAW_PROFILE)
    a2 = readers.align_schema(a1, schemas.RAW_PROFILE)
    assert a1.schema == a2.schema == schemas.RAW_PROFILE and rows(a1) == rows(a2)


def test_s8_snapshot_versions(spark):
    store = SnapshotStore(spark, scratch_dir(spark, "snaptest"))
    assert store.read("t") is None
    store.write(spark.range(3), "t")
    store.write(store.read("t").filter("id > 0"), "t")
    assert store.versions() == [1, 2] and store.read("t").count() == 2 and store.read("t", 1).count() == 3
    store.vacuum(keep=1)
    assert store.versions() == [2] and store.read("t").count() == 2


def test_s2_short_pages_reach_the_item_limit(spark):
    """Pages of 8, 9 and 10 items, 20 wanted: 20 returned, also from pages past the first two."""
    item = {"title": "t", "link": "l"}
    pages = spark.createDataFrame([("q", 1, 1000, [item] * 8, 1), ("q", 11, 1000, [item] * 9, 2),
                                   ("q", 21, 1000, [item] * 10, 3), ("r", 11, 1000, [item], 4)], readers.SEARCH_PAGE)
    out = rows(readers.flatten_search_pages(pages, max_results=20))
    assert sorted(r["item_index"] for r in out) == list(range(20))
    assert len({r["ingest_seq"] for r in out}) == 20
    assert max(r["search_metadata"]["position"] for r in out) == 23


def test_s2_stops(spark):
    """A gap, an empty page, and start + size past the total end a query."""
    item = {"title": "t", "link": "l"}
    pages = spark.createDataFrame(
        [("gap", 1, 99, [item] * 2, 1), ("gap", 21, 99, [item], 2), ("empty", 1, 99, [item], 3), ("empty", 11, 99, [], 4),
         ("empty", 21, 99, [item], 5), ("total", 1, 10, [item], 6), ("total", 11, 10, [item], 7),
         ("again", 1, 99, [item], 8), ("again", 1, 99, [item] * 3, 9)], readers.SEARCH_PAGE)
    out = readers.flatten_search_pages(pages, 50).groupBy("search_metadata.query_used").count().collect()
    assert {r[0]: r[1] for r in out} == {"gap": 2, "empty": 1, "total": 1, "again": 3}


def test_o_appends_keep_stored_rows(spark):
    new = lambda u: spark.createDataFrame([(u, 1)], "linkedin_profile string, ingest_seq long").withColumns(
        {c: F.lit(None).cast("string") for c in ("channel", "template_id", "stage_no", "rendered_md", "scheduled_at")})
    one = outreach.schedule_messages(None, new("u1"), NOW, "a")
    two = rows(outreach.schedule_messages(one, new("u2"), NOW, "b"))
    assert sorted(r["linkedin_profile"] for r in two) == ["u1", "u2"] and len({r["id"] for r in two}) == 2


def test_r2_sort_and_filters(spark):
    people = align_schema(spark.createDataFrame(
        [(1, "a", 10, 100, 1), (2, "b", None, 300, 2), (3, "c", 500, None, 3)],
        "id long, linkedin_profile string, connections_linkedin long, followers_linkedin long, created_seq long"),
        schemas.PEOPLE)
    comp = align_schema(spark.createDataFrame([], "id long"), schemas.COMPANIES)
    by = lambda **kw: [r["linkedin_profile"] for r in reports.report_recent(people, comp, **kw).collect()]  # noqa
    assert by() == ["c", "b", "a"]
    assert by(sort_by="followers") == ["b", "a", "c"]
    assert by(sort_by="connections") == ["c", "a", "b"]
    assert by(min_followers=150) == ["b"]
    assert by(limit=1) == ["c"]
