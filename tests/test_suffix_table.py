"""D1 with the rules as a table: equal to the column rule, plan independent of the list."""
import re

from conftest import rows
from pyspark.sql import functions as F

from leadframe.operators import domains
from leadframe.session import scratch_dir
from leadframe.sources.suffixes import (DEFAULT_RULES, DEFAULT_RULES_TEXT, load_suffix_rules, parse_suffix_rules,
                                        read_suffix_table, suffix_table)

LIST = """// comment
com
uk
co.uk
  DE   // trailing words
*.ck
!www.ck
*.kobe.jp
!city.kobe.jp
jp
a.b.c.d.e

*.x.y
"""
URLS = ["https://www.example.com/a", "http://a.b.example.co.uk", "shop.example.de:80", "www.ck", "a.www.ck", "b.c.ck", "ck", "c.ck",
        "city.kobe.jp", "x.city.kobe.jp", "a.b.kobe.jp", "q.a.b.kobe.jp", "kobe.jp", "one.a.b.c.d.e", "a.b.c.d.e", "b.c.d.e",
        "p.q.x.y", "q.x.y", "x.y", "", "   ", None, "localhost", "127.0.0.1", "a..com", ".com", "com", "nothing.here",
        "user@host.example.com", "EXAMPLE.COM.", "x" * 300 + ".com", "a." * 3000 + "example.com"]


def table(spark, text):
    return suffix_table(spark.createDataFrame([(x,) for x in text.split("\n")] + [(None,)], "value string"))


def both(spark, urls, rules, rule_rows, **country):
    df = spark.createDataFrame(list(enumerate(urls)), "host int, url string")        # ``host``: a clashing name
    a = domains.with_apex_domain(df, "url", "apex", rules)
    b = domains.with_apex_domain_by_table(df, "url", rule_rows, "apex", **country)
    assert b.columns == ["host", "url", "apex"]
    return [{r["host"]: r["apex"] for r in rows(x)} for x in (a, b)]


def test_equals_the_column_rule(spark):
    urls = URLS * 2                                                                  # repeated rows
    a, b = both(spark, urls, parse_suffix_rules(LIST), table(spark, LIST))
    assert a == b and len(b) == len(urls)
    assert b[0] == "example.com" and b[3] == "www.ck" and b[5] == "b.c.ck" and b[8] == "city.kobe.jp" and b[11] == "a.b.kobe.jp"
    a, b = both(spark, urls, DEFAULT_RULES, table(spark, DEFAULT_RULES_TEXT),
                country_second=DEFAULT_RULES.country_second, country_flat=DEFAULT_RULES.country_flat)
    assert a == b


def test_empty_tables(spark):
    none = table(spark, "")
    a, b = both(spark, URLS, parse_suffix_rules(""), none)
    assert a == b and set(b.values()) == {None}
    assert rows(domains.with_apex_domain_by_table(spark.createDataFrame([], "url string"), "url", table(spark, LIST))) == []


def test_long_list_is_read_by_spark_and_not_in_the_plan(spark):
    def plan(n):
        path = scratch_dir(spark, "list")
        spark.range(n).select(F.concat(F.lit("s"), "id", F.when(F.col("id") % 3 == 0, ".com").otherwise(".net"))).write.text(path)
        rules = read_suffix_table(spark, path)
        df = spark.createDataFrame([("www.a.s3.com",), ("a.s4.net",), ("s5.net",)], "url string")
        out = domains.with_apex_domain_by_table(df, "url", rules)
        return path, out, out._jdf.queryExecution().optimizedPlan().toString()
    path, out, text = plan(9_000)
    assert {r["url"]: r["apex_domain"] for r in rows(out)} == {"www.a.s3.com": "a.s3.com", "a.s4.net": "a.s4.net", "s5.net": None}
    assert abs(len(text) - len(plan(9)[2])) < 200
    names = spark.read.text(path)
    rules = load_suffix_rules(names.inputFiles()[0].removeprefix("file://"))
    part = read_suffix_table(spark, names.inputFiles()[0])
    assert {r["name"] for r in rows(part)} == set(rules.exact) and not re.search("s8999", text)
