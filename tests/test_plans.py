"""Plan checks: where the shuffles are, that filters and columns reach the
Parquet scan, that keyed jobs aggregate map-side, and that Python runs only
"""
from conftest import SF_SMALL

from leadframe.operators import reports
from leadframe.plans import catalog, q_companies, q_text


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_k1_aggregates_map_side(spark):
    from leadframe.operators import upsert
    recs = catalog.person_records(spark, SF_SMALL)
    p = _plan(upsert.upsert_people(None, recs, catalog.NOW))
    # a partial aggregate before the exchange on the key, a final one after it
    assert p.count("SortAggregate") + p.count("HashAggregate") >= 2
    assert "BatchEvalPython" not in p          # no row-at-a-time Python


def test_k1_small_batch_does_not_shuffle_the_stored_table(spark):
    from leadframe.operators import upsert
    state = spark.read.parquet(f"{SF_SMALL}/customer.parquet").selectExpr(
        "c_custkey AS id", "concat('https://linkedin.com/in/c-', c_custkey) AS linkedin_profile",
        "c_custkey AS created_seq")
    from leadframe import schemas
    from leadframe.sources.readers import align_schema
    state = align_schema(state, schemas.PEOPLE)
    batch = spark.createDataFrame([(1, "https://linkedin.com/in/c-1", "Ann")],
                                  "ingest_seq long, linkedin_profile string, first_name string")
    df = upsert.upsert_people(state, batch, catalog.NOW)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in p
    assert "Exchange hashpartitioning(linkedin_profile" not in p


def test_d1_apex_needs_no_shuffle_or_python(spark):
    p = _plan(q_companies.d1_apex_domain(spark, SF_SMALL))
    assert "SortMergeJoin" not in p and "BroadcastHashJoin" not in p
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_text_facts_stay_in_the_jvm(spark):
    p = _plan(q_text.x13_x17_text_facts(spark, SF_SMALL))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_report_filters_reach_the_scan(spark):
    people = spark.read.parquet(f"{SF_SMALL}/customer.parquet").selectExpr(
        "c_custkey AS id", "c_name AS linkedin_profile", "c_custkey AS created_seq", "1L AS created_batch",
        "CAST(c_acctbal AS BIGINT) AS followers_linkedin", "c_nationkey AS connections_linkedin",
        "CAST(NULL AS STRING) AS first_name", "CAST(NULL AS STRING) AS last_name",
        "CAST(NULL AS STRING) AS title_current", "CAST(c_nationkey AS BIGINT) AS company_id")
    comp = spark.read.parquet(f"{SF_SMALL}/nation.parquet").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS id", "n_name AS name", "n_name AS domain")
    df = reports.report_recent(people, comp, sort_by="followers", min_followers=100, limit=5)
    p = _plan(df)
    assert "TakeOrderedAndProject" in p
    df.explain("formatted")
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(c_acctbal)" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int,c_acctbal:double>" in text


def test_k10_reads_people_twice_and_keys_once(spark):
    """One narrow pass derives the keys; the merge itself needs no Python, and singletons no aggregate."""
    from pyspark.sql import functions as F
    from leadframe import schemas
    from leadframe.operators import upsert
    from leadframe.sources.readers import align_schema
    people = spark.range(50).select("id", F.concat(F.lit("https://linkedin.com/in/p"), F.col("id")).alias("linkedin_profile"))
    merged, mapping = upsert.dedupe_people(align_schema(people, schemas.PEOPLE))
    for df in (merged, mapping):
        assert "Python" not in _plan(df)
    assert "Range" not in _plan(mapping)            # read back, not derived again
    assert merged.count() == 50 and mapping.count() == 0


def test_k13_does_not_shuffle_the_stored_companies(spark):
    """A small batch meets the stored tables by broadcast of the batch alone."""
    recs = catalog.person_records(spark, SF_SMALL).limit(20)
    from leadframe.operators import upsert
    from leadframe.session import materialize
    people, companies, queries, _ = upsert.person_ingest(recs, None, None, None, catalog.NOW, "a")
    stored = [materialize(t, "stored") for t in (people, companies, queries)]
    people2, *_ = upsert.person_ingest(recs, *stored, catalog.NOW, "b")
    assert "SortMergeJoin" not in _plan(people2)


def test_s1_has_no_one_task_window(spark):
    import json
    import os
    from leadframe.session import scratch_dir
    from leadframe.sources import readers
    d = scratch_dir(spark, "s1")
    os.makedirs(d)
    for i in (2, 0, 1):
        with open(f"{d}/{i}.json", "w") as fh:
            json.dump([{"name": f"n{i}{k}"} for k in range(3)], fh)
    df = readers.read_people_json(spark, d)
    assert "Window" not in _plan(df) or "SinglePartition" not in _plan(df)
    assert [r["name"] for r in df.orderBy("ingest_seq").collect()] == [f"n{i}{k}" for i in range(3) for k in range(3)]


def test_scratch_needs_a_shared_folder_off_local(spark, monkeypatch):
    import pytest
    from leadframe import session

    class Conf:
        def get(self, key, default=None):
            return default

    class OnCluster:
        conf = Conf()
    monkeypatch.setattr(session, "_is_local", lambda s: False)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_dir(OnCluster(), "x")


def test_small_dimensions_are_not_spread(spark):
    from leadframe.plans import inputs
    assert inputs.table(spark, SF_SMALL, "nation").rdd.getNumPartitions() == 1
