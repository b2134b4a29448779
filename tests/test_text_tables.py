"""Text rules on hand-worked values: (input, expected), the rule beside each."""
import pytest
from conftest import one_col
from pyspark.sql import functions as F

from leadframe.functions import facts, names

BOILERPLATE = [                                            # X6
    ("Hi. View Ann Lee’s profile on LinkedIn, the world's largest network. Bye.", "Hi. Bye."),
    ("View Bob's profile on LinkedIn!", ""),
    ("Text VIEW x profile on LinkedIn, a professional community of 1 billion members. End", "Text End"),
    ("Sehen Sie sich das Profil von Max auf LinkedIn an. Rest", "Rest"),
    ("View on the lake. Nice", "View on the lake. Nice"),  # not the profile sentence
    ("a \t  b\n\n\n\nc", "a b\n\nc"),                       # blanks squeezed, 3+ newlines to 2
    ("", ""), (None, None),
]
NORMALIZE = [                                              # X7
    ("Caf&eacute; &amp; Bar &lt;3", "Café & Bar <3"),
    ("• first\n  - second\n\t› third", "first\nsecond\nthird"),
    ("a\tb  c", "a b c"),
    ("&amp;lt;", "&lt;"),                                  # decoded once
    ("one - two", "one - two"),                            # a dash inside a line stays
    ("", ""), (None, None),
]
EMAIL = [("Mail a.b+c@x-y.co.uk now", "a.b+c@x-y.co.uk"), ("no at sign", None), ("x@y", None),
         ("first@a.io second@b.io", "first@a.io"), (None, None)]          # X13
WEBSITE = [                                                # X14
    ("see https://linkedin.com/in/x and http://acme.de/team?x=1", "http://acme.de/team?x=1"),
    ("only https://www.facebook.com/a", None),
    ("visit acme.io today", "https://acme.io"),
    ("twitter.com then acme.org", "https://acme.org"),
    ("de.wikipedia.org only", None),
    ("nothing here", None),
]
PHONE = [("call +49 711 123-4567", "+49 711 123-4567"), ("pin 123456", None), ("tel 0711 1234567", "0711 1234567"),
         ("no digits", None)]                              # X15: at least 7 digits
YEARS = [("over 12 years in sales", 12), ("5+ years of experience", 5), ("10 years", 10), ("3 + years", 3),
         ("many years", None), ("20 years here, 7 years of experience", 7)]   # X16: patterns in order
HEADLINE = [                                               # X5
    ("Ann Lee - Head of Sales | LinkedIn", "Ann Lee", "Head of Sales"),
    ("Ann Lee – CTO", "Ann Lee", None),                    # 3 characters are too few, by name and after "–"
    ("ANN LEE - ann lee - Buyer", "Ann Lee", "ann lee - Buyer"),   # name not in the title as written: first "-"
    ("Ann Lee | LinkedIn", "Ann Lee", "Ann Lee"),          # no separator left behind the name: nothing is removed
    ("A.B (x) - Chief", "A.B (x)", "Chief"),               # the name is no pattern
    ("", "Ann", None), ("Ann - Boss", "", None),
]
SALIENT = [                                                # X17 then its limits
    ("Built 3 plants. all lower here. Moved to Berlin.", ["Built 3 plants.", "Moved to Berlin."]),
    ("Mail a@b.io now. Born 1970.", ["Born 1970."]),       # the sentence with the e-mail goes
    ("One A1. Two A2. Three A3. Four A4. Five A5. Six A6.", ["One A1.", "Two A2.", "Three A3.", "Four A4.", "Five A5."]),
    ("Same 1. Same 1. Other 2.", ["Same 1.", "Other 2."]),
    ("nothing special here", None),
]


@pytest.mark.parametrize("rule, table", [
    (facts.remove_boilerplate, BOILERPLATE), (facts.normalize_text, NORMALIZE), (facts.email_in, EMAIL),
    (facts.website_in, WEBSITE), (facts.phone_in, PHONE), (facts.experience_years_in, YEARS)],
    ids=["X6", "X7", "X13", "X14", "X15", "X16"])
def test_rule_table(spark, rule, table):
    assert one_col(spark, [x for x, _ in table], rule) == [want for _, want in table]


def test_x5_headline(spark):
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(HEADLINE)], "i int, t string, n string")
    got = df.select("i", names.headline_from_title(F.col("t"), F.col("n")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == [want for *_, want in HEADLINE]


def test_x17_salient_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SALIENT)], "i int, t string")
    found = [rule(F.col("t")) for rule in (facts.email_in, facts.website_in, facts.phone_in)]
    got = df.select("i", facts.salient_sentences(F.col("t"), *found).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [want for _, want in SALIENT]
