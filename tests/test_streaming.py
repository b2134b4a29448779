"""Streams run the batch jobs per micro-batch; a replayed batch is skipped."""
import json
import os

from leadframe.session import scratch_dir
from leadframe.sources.snapshots import SnapshotStore
from leadframe.streaming import ingest


def test_people_stream_two_files(spark):
    land, root, ck = (scratch_dir(spark, n) for n in ("land", "store", "ck"))
    os.makedirs(land)
    recs = [{"name": "Ann Lee", "profile_url": "https://www.linkedin.com/in/Ann/", "company": "Acme",
             "company_domain": "acme.com", "source_name": "s", "source_query": "q", "ingest_seq": 1},
            {"name": "Ann Lee", "profile_url": "http://de.linkedin.com/in/ann", "follower_count": "2K",
             "ingest_seq": 2}]
    for i, r in enumerate(recs):
        with open(f"{land}/{i}.json", "w") as fh:
            fh.write(json.dumps(r) + "\n")
    q = ingest.start_people_ingest(spark, land, root, ck, trigger={"availableNow": True})
    q.awaitTermination(300)
    store = SnapshotStore(spark, root)
    people = store.read("people").collect()
    assert len(people) == 1 and people[0]["followers_linkedin"] == 2000
    assert store.read("companies").collect()[0]["domain"] == "acme.com"
    # replaying a committed batch changes nothing
    n = len(store.versions())
    assert not ingest.ingest_batch(store, spark.read.schema(ingest.PROFILE_STREAM_SCHEMA).json(land), "stream:people:0")
    assert len(store.versions()) == n


def test_usage_stream(spark):
    d = scratch_dir(spark, "logs")
    os.makedirs(d)
    with open(f"{d}/a.jsonl", "w") as fh:
        fh.write(json.dumps({"provider": "openai", "usage": {"total_tokens": 10}, "run_id": "r"}) + "\n")
        fh.write("broken\n")
    q = (ingest.usage_stream(spark, d, "r").writeStream.outputMode("complete").format("memory")
         .queryName("usage_t").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert [tuple(r) for r in spark.sql("SELECT provider, calls, tokens FROM usage_t").collect()] == [("openai", 1, 10)]
