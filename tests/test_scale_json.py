"""An element of a large file is parsed once, a small file's shape is seen without its schema."""
import json
import re

from conftest import rows
from pyspark.sql import functions as F

from leadframe.sources import json_split, readers


def test_large_json_elements_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([1, {"name": "a}b{\"]["}, "x", {"n": {"m": [1, {}]}}, [], None, {}, {"name": "\\"}]) + "\n")
    (tmp_path / "b.json").write_text(' {"k": [{"name": "no"}], "profiles": [ {"name": "p"} , 2, {"name": "q"}], "z": {}}')
    (tmp_path / "c.json").write_text('[{"name": "ok"}, {"name": bad}, {"name": "last"}]')
    got = json_split.read_array_elements(spark, str(tmp_path), 1)
    names = got.select(F.regexp_extract("file", "[^/]+$", 0).alias("f"), "pos", F.to_json("p").alias("t"))
    found = {}
    for r in sorted(rows(names), key=lambda r: (r["f"], r["pos"])):
        found.setdefault(r["f"], []).append(json.loads(r["t"]))
    assert found == {"a.json": [{"name": "a}b{\"]["}, {"n": {"m": [1, {}]}}, {}, {"name": "\\"}],
                     "b.json": [{"name": "p"}, {"name": "q"}], "c.json": [{"name": "ok"}, {"name": "last"}]}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Filter .*parse_json", plan)


def test_small_json_files_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n[{"name": "a"}, 1, {"name": "b"}]')
    (tmp_path / "b.json").write_text('{"profiles": [{"name": "c"}], "x": []}')
    (tmp_path / "c.json").write_text('{"x": [{"name": "no"}]}')
    (tmp_path / "d.json").write_text('[')
    people = readers.read_people_json(spark, str(tmp_path))
    assert [r["name"] for r in rows(people.orderBy("ingest_seq"))] == ["a", "b", "c"]
    assert "schema_of_variant(v" not in people._jdf.queryExecution().logical().toString()
