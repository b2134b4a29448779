"""X22 over a table against brute force on all pairs; D4's filter of live domains."""
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadframe.operators import domains, similar


def brute(table, percent=80):
    """{stripped text: smallest id}, {(shorter text, longer text)}; equally long: the pair in text order."""
    ids = {}
    for i, t in table:
        t = (t or "").strip()
        if t:
            ids.setdefault(t, set()).add(i)
    first = {t: min((i for i in x if i is not None), default=None) for t, x in ids.items()}
    links = set()
    words = {t: set(t.lower().split()) for t in first if len(t) >= 10}
    for a in words:
        for b in words:
            if a != b and len(a) <= len(b) and 100 * len(words[a] & words[b]) >= percent * len(words[a]):
                links.add(tuple(sorted((a, b))) if len(a) == len(b) else (a, b))
    return first, links


def awkward():
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choices(vocabulary, k=draw.randint(1, 40))) for _ in range(60)]
    texts += [t + " more " + draw.choice(vocabulary) for t in texts[:15]]
    texts += ["one two three four five", "ONE two three four  six five", "five four three two one",   # equally long
              "abc", " abc ", "abcdefghi", "abc abc abc", "\t \n", "", None, "a b", "the the the the the", "word " * 3000,
              " ".join(vocabulary) * 2, "naïve café über straße", "NAÏVE CAFÉ über straße ok", texts[0], " " + texts[0]]
    table = [(i + 1, t) for i, t in enumerate(texts)]
    table += [(3, texts[5] + " other"), (3, "x y z one two three"), (3, "x y z one two three"), (None, texts[6]), (None, "only null id here")]
    return table + [(900, texts[1])] * 60       # a third of all rows are one row


@pytest.mark.parametrize("small", [False, True])
def test_similar_texts_equal_brute_force(spark, monkeypatch, small):
    if small:       # many pieces of a list, blocks and chunks
        for name, n in (("LIST_ROWS", 2), ("BLOCK_WORDS", 64), ("BLOCK_TEXTS", 2), ("CHUNK", 4)):
            monkeypatch.setattr(similar, name, n)
    table = awkward()
    df = spark.createDataFrame(table, "doc_id long, text string").select(
        "doc_id", "text", *[F.lit(7).alias(c) for c in ("id", "row", "digest", "words", "class_id", "n_links")])
    members, links = similar.similar_texts(df, "doc_id", "text")
    first, want = brute(table)
    assert any(len(a) == len(b) for a, b in want) and len(want) > 20
    got = sorted(((r["shorter_id"], r["longer_id"]) for r in rows(links)), key=str)
    ids = [tuple(sorted((first[a], first[b]), key=lambda x: (x is None, x))) if len(a) == len(b) else (first[a], first[b])
           for a, b in want]
    assert got == sorted(ids, key=str)
    degree = {}
    for pair in want:
        for t in pair:
            degree[t] = degree.get(t, 0) + 1
    wanted = [(i, first.get((t or "").strip()), degree.get((t or "").strip(), 0)) for i, t in table]
    assert sorted(map(tuple, members.collect()), key=str) == sorted(wanted, key=str)


def test_similar_texts_empty_and_blank(spark):
    for table in ([], [(1, None), (None, ""), (1, "  \t")]):
        members, links = similar.similar_texts(spark.createDataFrame(table, "k long, t string"), "k", "t")
        assert links.count() == 0
        assert sorted((r["k"] or 0, r["class_id"], r["n_links"]) for r in rows(members)) == sorted((i or 0, None, 0) for i, _ in table)
    with pytest.raises(ValueError):
        similar.similar_texts(spark.createDataFrame([], "k long, t string"), "k", "t", 0)


def test_live_filter_loses_no_live_guess(spark):
    guesses = spark.range(20000).select((F.col("id") % 4000).alias("k"), F.col("id").alias("rank"),
                                        F.concat(F.lit("d"), F.col("id"), F.lit(".com")).alias("domain"))
    guesses = guesses.unionByName(spark.createDataFrame([(1, 5, None)], "k long, rank long, domain string"))
    live = spark.range(0, 20000, 50).select(F.concat(F.lit("D"), F.col("id"), F.lit(".com")).alias("domain"))
    live = live.unionByName(spark.createDataFrame([(None,), ("d0.com",), ("d0.com",)], "domain string"))
    lower = live.select(F.lower("domain").alias("domain"))
    passed = domains.probably_live(guesses, lower)
    assert passed.columns == guesses.columns
    assert passed.join(lower.distinct(), "domain").count() == 400
    assert passed.count() < 400 + 0.15 * 20000      # what is shuffled: the live guesses and few others
    assert domains.probably_live(guesses, lower.limit(0)).count() == 0
    plain = rows(domains.resolve_domains(guesses, live, "k").orderBy("k"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        filtered = domains.resolve_domains(guesses, live, "k")
        assert "bit_or" in filtered._jdf.queryExecution().optimizedPlan().toString()
        assert rows(filtered.orderBy("k")) == plain and len(plain) > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
