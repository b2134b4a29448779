from conftest import rows
from pyspark.sql import functions as F

from leadframe import schemas
from leadframe.operators import standardise, upsert

NOW = "2024-02-01 00:00:00"


def _raw(spark, recs):
    from pyspark.sql import types as T
    schema = T.StructType(list(schemas.RAW_PROFILE.fields) + [
        T.StructField("source_name", T.StringType()), T.StructField("source_query", T.StringType()),
        T.StructField("ingest_seq", T.LongType())])
    return spark.createDataFrame(recs, schema)


def _a1(spark):
    # A1: one raw person record from a run of query "Engineer Berlin"
    return [("Alice Example", "https://www.linkedin.com/in/Alice-Example-12345/", None, "Software Engineer",
             "Acme GmbH", "Berlin, Germany", "1K", "500+", None, "acme.com", None, None, None, None, None,
             "linkedin_people_google", "Engineer Berlin", 1)]


def test_a1_ingest_people_and_company(spark):
    mapped = standardise.map_to_person_schema(_raw(spark, _a1(spark)), "2024-02-01")
    recs = standardise.standardise_people(mapped)
    people, companies, queries, processed = upsert.person_ingest(recs, None, None, None, NOW, "t",
                                                                 materialize_batch=False)
    p = rows(people)
    assert len(p) == 1
    p = p[0]
    assert p["linkedin_profile"].startswith("https://linkedin.com/in/")
    assert (p["first_name"], p["last_name"], p["title_current"]) == ("Alice", "Example", "Software Engineer")
    assert p["followers_linkedin"] == 1000 and p["connections_linkedin"] == 500
    c = rows(companies)
    assert [(x["name"], x["domain"]) for x in c] == [("Acme GmbH", "acme.com")]
    assert p["company_id"] == c[0]["id"]
    q = rows(queries)
    assert len(q) == 1 and q[0]["normalized_query"] == "engineer berlin"
    assert p["search_query_id"] == q[0]["id"] == c[0]["search_query_id"]
    assert rows(processed) == [{"processed_people": 1}]


def test_a2_mapped_record_degree_moves_to_title(spark):
    df = spark.createDataFrame(
        [("Dr. Alice Example", "https://linkedin.com/in/alice", "Engineer", "linkedin_people_google",
          "Engineer Berlin", "Acme", "acme.com", 1)],
        "mapped_contact_name string, mapped_linkedin_profile string, mapped_position string, "
        "source_name string, source_query string, mapped_company string, mapped_company_domain string, "
        "ingest_seq long")
    recs = standardise.standardise_people(df)
    people, companies, _, processed = upsert.person_ingest(recs, None, None, None, NOW, "t", materialize_batch=False)
    p = rows(people)[0]
    assert (p["first_name"], p["last_name"]) == ("Alice", "Example")
    assert "(Dr" in p["title_current"]
    assert [r["domain"] for r in rows(companies)] == ["acme.com"]


def test_k1_last_non_null_wins_and_idempotent(spark):
    b = spark.createDataFrame([
        (1, "https://linkedin.com/in/a", "Ann", None, "a@x.com", None),
        (2, "https://linkedin.com/in/a", None, "Lee", None, "2024-01-05"),
        (3, "https://linkedin.com/in/a", "Anna", None, None, None),
        (4, None, "Nobody", None, None, None)],
        "ingest_seq long, linkedin_profile string, first_name string, last_name string, email string, "
        "lookup_date string")
    once = upsert.upsert_people(None, b, NOW)
    r = rows(once)
    assert len(r) == 1
    r = r[0]
    assert (r["first_name"], r["last_name"], r["email"]) == ("Anna", "Lee", "a@x.com")
    assert r["lookup_date"] == NOW          # the last record's date is NULL -> now
    assert r["is_hot"] == 0 and r["created_seq"] == 1
    twice = upsert.upsert_people(once, b, NOW)
    strip = lambda rs: sorted(tuple(sorted(x.items())) for x in rs)
    assert strip(rows(twice)) == strip(rows(once))


def test_a4_company_upsert_twice_one_row(spark):
    b = spark.createDataFrame([("Acme", "acme.com", "https://acme.com", 1), ("ACME GmbH", "acme.com", None, 2)],
                              "name string, domain string, website string, ingest_seq long") \
        .withColumn("source_name", F.lit(None).cast("string")).withColumn("source_query", F.lit(None).cast("string")) \
        .withColumn("search_query_id", F.lit(None).cast("long"))
    c1 = upsert.upsert_companies(None, b, "b1")
    c2 = upsert.upsert_companies(c1, b, "b2")
    r = rows(c2)
    assert len(r) == 1
    assert (r[0]["name"], r[0]["website"]) == ("ACME GmbH", "https://acme.com")


def test_k3_stubs_are_not_idempotent(spark):
    b = spark.createDataFrame([("Nameonly", None, None, 1)], "name string, domain string, website string, "
                              "ingest_seq long").withColumn("source_name", F.lit(None).cast("string")) \
        .withColumn("source_query", F.lit(None).cast("string")).withColumn("search_query_id", F.lit(None).cast("long"))
    c1 = upsert.upsert_companies(None, b, "b1")
    c2 = upsert.upsert_companies(c1, b, "b2")
    assert [r["name"] for r in rows(c2)] == ["Nameonly", "Nameonly"]


def test_a6_query_dimension(spark):
    b = spark.createDataFrame([("linkedin_people_google", "person", " Engineer   Berlin ", 1),
                               ("linkedin_people_google", "person", "engineer berlin", 2),
                               ("another_source", "person", "engineer berlin", 3)],
                              "source string, entity_type string, query_text string, ingest_seq long")
    d = rows(upsert.upsert_queries(None, b, NOW))
    assert len(d) == 2
    by = {r["source"]: r for r in d}
    assert by["linkedin_people_google"]["query_text"] == " Engineer   Berlin "
    assert by["linkedin_people_google"]["id"] != by["another_source"]["id"]


def test_k9_backfill_lower_trim_only(spark):
    people = spark.createDataFrame([(1, "u1", "src", " Some  Query ", None)],
                                   "created_seq long, linkedin_profile string, source_name string, "
                                   "source_query string, search_query_id long")
    from leadframe.sources.readers import align_schema
    dim = spark.createDataFrame([], schemas.SEARCH_QUERIES)
    p, d = upsert.backfill_queries(align_schema(people, schemas.PEOPLE), dim, NOW)
    d = rows(d)
    assert [r["normalized_query"] for r in d] == ["some  query"]   # no squeeze
    assert rows(p)[0]["search_query_id"] == d[0]["id"]


def test_b7_dedupe_and_repoint(spark):
    people = spark.createDataFrame(
        [(1, "https://linkedin.com/in/Alice", None, "", 0, 1), (2, "https://linkedin.com/in/alice", "a@acme.com",
                                                               "Berlin", 1, 2),
         (3, "https://linkedin.com/in/Bob", None, None, 0, 3)],
        "id long, linkedin_profile string, email string, location_text string, is_hot int, created_seq long")
    from leadframe.sources.readers import align_schema
    people = align_schema(people, schemas.PEOPLE)
    merged, mapping = upsert.dedupe_people(people)
    m = {r["id"]: r for r in rows(merged)}
    assert set(m) == {1, 3}
    assert m[1]["linkedin_profile"] == "https://linkedin.com/in/alice"
    assert (m[1]["email"], m[1]["location_text"], m[1]["is_hot"]) == ("a@acme.com", "", 0)
    assert m[3]["linkedin_profile"] == "https://linkedin.com/in/Bob"     # single rows stay as they are
    msgs = spark.createDataFrame([(10, "https://linkedin.com/in/alice"), (11, "https://linkedin.com/in/Alice")],
                                 "id long, linkedin_profile string")
    r = {x["id"]: x["linkedin_profile"] for x in rows(upsert.repoint_messages(msgs, mapping))}
    assert r == {10: "https://linkedin.com/in/alice", 11: "https://linkedin.com/in/Alice"}
    # idempotent: merging the result again changes nothing
    again, _ = upsert.dedupe_people(merged)
    assert sorted(map(str, rows(again))) == sorted(map(str, rows(merged)))


def test_k12_erase(spark):
    people = spark.createDataFrame([(1, "https://linkedin.com/in/ann"), (2, "https://linkedin.com/in/bob")],
                                   "id long, linkedin_profile string")
    msgs = spark.createDataFrame([(10, "https://www.linkedin.com/in/Ann/"), (11, "https://linkedin.com/in/bob")],
                                 "id long, linkedin_profile string")
    keys = spark.createDataFrame([("http://de.linkedin.com/in/ANN?x=1",)], "profile_url string")
    p, m = upsert.erase_profiles(people, msgs, keys)
    assert [r["id"] for r in rows(p)] == [2]
    assert [r["id"] for r in rows(m)] == [11]


def test_k5_last_record_with_company_wins(spark):
    people = spark.createDataFrame([("u1", None)], "linkedin_profile string, company_id long")
    from leadframe.sources.readers import align_schema
    people = align_schema(people, schemas.PEOPLE)
    comp = spark.createDataFrame([(7, "acme.com"), (8, "beta.io")], "id long, domain string")
    rec = spark.createDataFrame([("u1", 1, "acme.com", "Acme"), ("u1", 2, "beta.io", "Beta"),
                                 ("u1", 3, None, None)],
                                "linkedin_profile string, ingest_seq long, company_domain string, company_name string")
    out = rows(upsert.link_people_companies(people, comp, rec, "t"))
    assert out[0]["company_id"] == 8


def test_k1_broadcast_path_equals_shuffle_path(spark):
    first = spark.createDataFrame([(1, "u1", "Ann", None), (2, "u2", "Bob", "b@x")],
                                  "ingest_seq long, linkedin_profile string, first_name string, email string")
    second = spark.createDataFrame([(3, "u2", None, "b2@x"), (4, "u3", "Cy", None), (5, "u1", "Anne", None)],
                                   "ingest_seq long, linkedin_profile string, first_name string, email string")
    state = upsert.upsert_people(None, first, NOW)
    a = upsert.upsert_people(state, second, NOW)                       # batch broadcast
    b = upsert.upsert_people(state, second, NOW, stream_stored=False)  # full outer join
    key = lambda rs: sorted(tuple(sorted(r.items())) for r in rs)
    assert key(rows(a)) == key(rows(b))
    by = {r["linkedin_profile"]: r for r in rows(a)}
    assert (by["u1"]["first_name"], by["u2"]["email"], by["u3"]["created_seq"]) == ("Anne", "b2@x", 4)


def test_k2_both_join_paths_agree(spark):
    def batch(vals):
        df = spark.createDataFrame(vals, "name string, domain string, website string, ingest_seq long")
        return df.withColumns({c: F.lit(None).cast(t) for c, t in
                               (("source_name", "string"), ("source_query", "string"), ("search_query_id", "long"))})
    first = upsert.upsert_companies(None, batch([("A", "a.com", "https://a.com", 1), ("B", "b.com", None, 2)]), "1", 1)
    new = batch([("A2", "a.com", None, 1), ("C", "c.com", None, 2), ("Stub", None, None, 3)])
    got = [sorted(map(str, rows(upsert.upsert_companies(first, new, "2", 2, stream_stored=x)))) for x in (True, False)]
    assert got[0] == got[1] and len(got[0]) == 4


def test_arrival_order_holds_across_batches(spark):
    """A later batch's low sequence numbers come after an earlier batch's high ones."""
    from leadframe.operators import enrich, reports
    rec = lambda vals: spark.createDataFrame(vals, "ingest_seq long, linkedin_profile string, first_name string")
    one = upsert.upsert_people(None, rec([(900, "https://linkedin.com/in/Old", "O")]), NOW, batch_no=1)
    two = upsert.upsert_people(one, rec([(1, "https://linkedin.com/in/old", "N")]), NOW, batch_no=2)
    comp = spark.createDataFrame([], schemas.COMPANIES)
    assert [r["linkedin_profile"] for r in reports.report_recent(two, comp).collect()] == \
        ["https://linkedin.com/in/old", "https://linkedin.com/in/Old"]
    merged = rows(upsert.dedupe_people(two)[0])
    assert [(r["first_name"], r["created_batch"]) for r in merged] == [("O", 1)]
    from leadframe.sources.readers import align_schema
    c = align_schema(spark.createDataFrame([(1, "Same", 5, 2), (2, "Same", 9, 1)],
                                           "id long, name string, created_seq long, created_batch long"), schemas.COMPANIES)
    assert [r["id"] for r in enrich.pending_companies(c).collect()] == [2, 1]
