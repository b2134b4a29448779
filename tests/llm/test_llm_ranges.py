"""Op 4: id ranges without Python."""
from conftest import rows

from leadframe.llm import spotsigs


def test_spot_ranges_need_no_python_beside_the_texts(spark):
    borders = [-3.0, 0.0, 2.0, 2.5, 7.0]
    ids = [None, -4, -3, -2, 0, 1, 2, 3, 7, 8]
    df = spark.createDataFrame([(i,) for i in ids], "id long").select("id", spotsigs._place(borders).alias("p"))
    assert [r["p"] for r in rows(df)] == [0 if i is None else sum(b < i for b in borders) for i in ids]
    assert "Python" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert rows(spark.range(1).select(spotsigs._place([]).alias("p"))) == [{"p": 0}]
