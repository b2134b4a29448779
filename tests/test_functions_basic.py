"""Column rules checked against the worked values in FIXTURES.md."""
from conftest import one_col

from leadframe.functions import names, numbers, urls
from leadframe.functions.text import squeeze, strip
from leadframe.sources.suffixes import DEFAULT_RULES


def test_x1_canonical_url(spark):
    got = one_col(spark, ["https://www.linkedin.com/in/Alice-X/",
                          "http://de.linkedin.com/in/m%C3%BCller/de?x=1",
                          "linkedin.com/in/foo", "https://example.com/in/foo",
                          "https://linkedin.com/in/a+b", None, ""], urls.canonical_profile_url)
    assert got == ["https://linkedin.com/in/Alice-X", "https://linkedin.com/in/m%C3%BCller",
                   "://linkedin.com/in/foo", None, "https://linkedin.com/in/a+b", None, None]


def test_n7_profile_key(spark):
    got = one_col(spark, ["https://www.linkedin.com/in/Alice-X/",
                          "http://de.linkedin.com/in/m%C3%BCller/de?x=1",
                          "linkedin.com/in/foo", "https://example.com/in/foo",
                          "https://linkedin.com/in/a+b", "https://linkedin.com/in/Ａｂ​",
                          "https://linkedin.com/in/", None], urls.profile_key)
    assert got == ["https://linkedin.com/in/alice-x", "https://linkedin.com/in/müller",
                   None, None, "https://linkedin.com/in/a+b", "https://linkedin.com/in/ab",
                   None, None]


def test_v2_profile_url_predicate(spark):
    got = one_col(spark, ["https://linkedin.com/in/x", "ftp://linkedin.com/in/x",
                          "https://example.com/in/x", "linkedin.com/in/x", None],
                  urls.is_profile_url)
    assert got == [True, False, False, False, False]


def test_d1_apex(spark):
    got = one_col(spark, ["https://www.beta.io/contact", "acme.com", "a.b.example.co.uk",
                          "http://1.2.3.4/x", "localhost", "https://user@shop.acme.de:8080/p",
                          "foo.bar.ck", "www.ck", "x.unknowntld", None, " "],
                  lambda c: urls.apex_domain(c, DEFAULT_RULES))
    assert got == ["beta.io", "acme.com", "example.co.uk", None, None, "acme.de",
                   "foo.bar.ck", "www.ck", None, None, None]


def test_n2_n3_numbers(spark):
    vals = ["1.2K", "500+", "3M", "1,234", "4.540", "2.5", "n/a", "", None, " 1k ", "2B"]
    assert one_col(spark, vals, numbers.parse_int_shorthand) == [
        1200, 500, 3000000, 1234, 5, 2, None, None, None, 1000, 2000000000]
    assert one_col(spark, vals, numbers.parse_connections) == [
        500, 500, 500, 500, 5, 2, None, None, None, 500, 500]


def test_n4_n5_names(spark):
    vals = ["Prof. Dr. Max Beispiel", "Dr.-Ing. Eva Muster Test", "Alice", "Dr. Alice Example",
            "Prof. Dr. med. Hans Wurst", "", None]
    assert one_col(spark, vals, names.degree_prefix) == [
        "Prof. Dr.", "Dr.-Ing.", None, "Dr.", "Prof. Dr.", None, None]
    cleaned = one_col(spark, vals, names.strip_degree)
    assert cleaned == ["Max Beispiel", "Eva Muster Test", "Alice", "Alice Example",
                       "med. Hans Wurst", "", ""]
    firsts = one_col(spark, cleaned, lambda c: names.split_name(c)[0])
    lasts = one_col(spark, cleaned, lambda c: names.split_name(c)[1])
    assert firsts == ["Max", "Eva", "Alice", "Alice", "med.", None, None]
    assert lasts == ["Beispiel", "Muster Test", None, "Example", "Hans Wurst", None, None]


def test_x3_x4_x5_titles(spark):
    assert one_col(spark, ["Alice Example (@al) – CTO | LinkedIn", "Bob Muster - LinkedIn",
                           "Al", "  Carla   Dee  "], names.name_from_title) == [
        "Alice Example", "Bob Muster", None, "Carla Dee"]
    assert one_col(spark, ["Alice Example - CTO - Acme | LinkedIn", "x | LinkedIn"],
                   names.name_from_og_title) == ["Alice Example", None]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("Alice Example - CTO at Acme | LinkedIn", "Alice Example"),
                                ("Alice (x) – Head of Sales – Acme", "Alice"),
                                ("No separators here", "Nobody")], "t string, n string")
    got = [r[0] for r in df.select(names.headline_from_title("t", "n")).collect()]
    # name present but not followed by a separator: the title stays whole
    assert got == ["CTO at Acme", "Alice (x) – Head of Sales – Acme", None]


def test_text_strip_squeeze(spark):
    assert one_col(spark, ["　 a  b\t\n", None], strip) == ["a  b", None]
    assert one_col(spark, ["　 a  b\t\nc ", ""], squeeze) == ["a b c", ""]
