"""S1 on large files: split over tasks, the rows of the whole-file reader."""
import json
import random

import pytest
from pyspark.sql import functions as F

from leadframe.sources import readers
from leadframe.sources.json_split import read_array_elements


def profile(rnd, i):
    return {"name": rnd.choice(["A } \" \\ {", "B][", "\\\\\" }}", "Ü漢"]) + str(i), "profile_url": f"u{i}",
            "summary": rnd.choice([None, "", "x" * 300, '{"profiles":[{']),
            "company": {"a": {"b": [1, {"c": "}"}]}} if i % 3 == 0 else "co", "extra": [{"z": 1}] if i % 5 == 0 else []}


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_split_files_read_like_whole_ones(spark, tmp_path, small_splits):
    rnd = random.Random(1)
    many = [profile(rnd, i) for i in range(60)]
    files = [json.dumps(many), json.dumps(many, indent=2, ensure_ascii=False),
             json.dumps({"meta": {"profiles": [{"name": "no"}]}, "n": [1, [2, {"q": 3}]], "profiles": many,
                         "tail": {"x": [{"name": "no"}]}}, ensure_ascii=False, indent=1),
             json.dumps([1, "x", {"name": "only"}, [{"name": "nested"}], {"name": "two"}, None]),
             "[]", '{"profiles": []}', '{"other": [{"name":"no"}]}', json.dumps(many)[:-20],
             '  \n [ {"name": "sp"} ,\n {"name": "sp2"}\n]\n\n', '"just text"', "", '{"profiles": null}',
             '{"profiles": "x", "z": {"profiles": [{"name": "no"}]}}', '{"a": "profiles", "profiles": [{"name": "m1"}, {}]}',
             '{"profiles":{"profiles":[{"name":"no"}]}}']
    for i, text in enumerate(files):
        (tmp_path / f"{i:02d}.json").write_text(text, encoding="utf-8")
    whole = readers.read_people_json(spark, str(tmp_path), whole_bytes=1 << 30)
    split = readers.read_people_json(spark, str(tmp_path), whole_bytes=-1)
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    assert split.count() == 60 * 3 + 2 + 2 + 2


def test_one_large_file_is_read_by_many_tasks_in_order(spark, tmp_path):
    n = 60_000
    with open(tmp_path / "people.json", "w") as f:
        f.write('{"profiles": [')
        f.writelines(("," if i else "") + json.dumps({"name": f"N{i}", "profile_url": "x" * 200}) for i in range(n))
        f.write("]}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        raw = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert raw.rdd.getNumPartitions() >= 10
        got = read_array_elements(spark, str(tmp_path), 0).select("pos", F.expr("try_variant_get(p, '$.name', 'string')").alias("name"))
        wrong = got.filter(F.col("name") != F.concat(F.lit("N"), F.col("pos").cast("string")))
        assert got.select("pos").distinct().count() == n and wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
