"""X22 on neighbours: a text's words are taken once."""
from conftest import rows

from leadframe.plans import q_text


def test_similar_texts_of_next_rows_equal_plain_python(spark, tmp_path):
    texts = [None, "", "abc", "  abc           ", "abc", "abd", "abcdefghij klm", "ABCDEFGHIJ  klm x y", "          ", "           ",
             "one two three four five", "five four THREE two one six", "a b c d e f g h", "\u2003a b c d e f\u2003", "abcdefghi ", "abcdefghi"]
    spark.createDataFrame(list(enumerate(texts)) + [(3, "abc"), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def similar(a, b):
        if not a or not b:
            return False
        short, long = (a if len(a) <= len(b) else b), (a if len(a) >= len(b) else b)
        if len(short) < 10:
            return a.strip() == b.strip()
        ws, wl = set(short.lower().split()), set(long.lower().split())
        return bool(ws) and len(ws & wl) / len(ws) >= 0.8
    table = list(enumerate(texts)) + [(3, "abc")]
    wanted = sorted((i, similar(a, b)) for i, a in table for j, b in table if j == i + 1)
    got = q_text.x22_similar_texts(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["similar"]) for r in rows(got)) == wanted
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("array_intersect") == 1     # words are taken before the join, once a text
