"""A third of the rows under one id, a third one repeated row, null ids, and columns named like the operators' own."""
import random

import corpus_pipeline
import pytest
from llm_fixtures import rows_of
from pyspark.sql import functions as F
from test_llm_dedup import brute_components, squeeze

from leadframe.llm import exact_dedup, jaccard, langid, mixing, quality, secrets, sharding

SF = "/root/testdata/sf0.001"
OWN = ["__text", "__text_", "__quality", "__kept", "__times", "__row", "__copy", "__none", "__id", "__m", "__salt", "id", "more", "text.x",
       "h", "label", "Score", "component_id", "keep_id", "rid", "key", "pos", "vslot"]


def hot_rows():
    rnd = random.Random(9)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    one = text(60)
    near = one.split()
    rows = [(7, text(rnd.randint(8, 40))) for _ in range(150)] + [(3, one)] * 150
    rows += [(None, text(rnd.randint(5, 30))) for _ in range(50)] + [(None, None), (None, ""), (None, " \t")]
    for i in range(100):
        v = list(near)
        v[i % 60] = "edit"
        rows.append((1000 + i, " ".join(v) if i % 4 == 0 else text(20)))
    rnd.shuffle(rows)
    return [(i, t, "en", rnd.choice(["a", "b", None]), len(t or "")) for i, t in rows]


def hot(spark, own=True):
    df = spark.createDataFrame(hot_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    if own:
        df = df.select("*", *[F.lit(f"{c}!").alias(c) for c in OWN])
    return df.repartition(4)


BASE = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_carry_any_column(spark):
    docs = hot(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert labels.count()
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and set(rows_of(kept, *BASE)) <= set(hot_rows())
    exact = corpus_pipeline.exact_dedup_stage(spark, docs, SF)
    assert exact.columns == docs.columns
    assert sorted(squeeze(t) for _, t, *_ in rows_of(exact, *BASE)) == sorted({squeeze(t) for _, t, *_ in hot_rows()})
    near = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert near.columns == docs.columns
    order = sorted(hot_rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = [order[i][:2] for i, _, c in brute_components([(i, *r[1:]) for i, r in enumerate(order)]) if i == c]
    assert sorted(rows_of(near, "doc_id", "text"), key=str) == sorted(want, key=str)
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count()
    for stage in (exact, near, mixed, kept):
        assert all(r[c] == f"{c}!" for r in stage.limit(50).collect() for c in OWN)
    assert corpus_pipeline.encode_stage(spark, docs, SF).count() == len(hot_rows())


def test_shards_stay_even(spark):
    """The law on the operator's own output, with one row a third of all."""
    rows = rows_of(sharding.shard_documents(hot(spark), 6), "doc_id", "size", "text_crc32", "shard", "slot", "vslot")
    assert sorted((i or 0, n) for i, n, *_ in rows) == sorted((r[0] or 0, len((r[1] or "").encode()) + 8) for r in hot_rows())
    load = [sum(r[1] for r in rows if r[3] == k) for k in range(6)]
    assert max(load) - min(load) <= 0.1 * sum(load) / 6
    for k in range(6):
        assert sorted(r[4] for r in rows if r[3] == k) == list(range(sum(r[3] == k for r in rows)))
    in_slot = [sum(r[5] == v for r in rows) for v in {r[5] for r in rows}]
    assert max(in_slot) <= 20


def test_mix_keys_differ_under_one_id(spark):
    docs = hot(spark, own=False)
    a, b = (sorted(rows_of(mixing.mix_sources(docs.repartition(n), carry=("text", "source")), "doc_id", "text", "times"), key=str) for n in (3, 5))
    assert a == b                                           # whatever the order of the input
    hot_id = [t for i, _, t in a if i == 7]
    assert min(hot_id) < max(hot_id)                        # not taken or left as a block
    same = [t for i, _, t in a if i == 3]
    assert min(same) < max(same)


def test_secrets_need_few_owners_and_repositories(spark):
    tok = [f"Zx9tok{k}abcdEF0123456789" for k in range(4)]
    rows = [(1, tok[0], "en", "s1"), (2, tok[0], "en", "s1"), (3, tok[1], "en", "s1"), (4, tok[1], "de", "s1"), (5, tok[1], "fr", "s1"),
            (6, tok[2], "en", "s1"), (7, tok[2], "en", "s2"), (8, tok[3], "en", "s1"), (9, tok[3], None, "s1"), (9, tok[3], None, "s1"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted((r.doc_id or 0, len(r.added), r.n_live, r.n_shared, r.max_owners, r.max_repos) for r in secrets.scan_secrets(docs).collect())
    assert got == [(0, 0, 0, 0, 0, 0), (1, 1, 1, 0, 1, 1), (2, 1, 1, 0, 1, 1), (3, 0, 0, 1, 1, 3), (4, 0, 0, 1, 1, 3), (5, 0, 0, 1, 1, 3),
                   (6, 0, 0, 1, 2, 2), (7, 0, 0, 1, 2, 2), (8, 1, 1, 0, 1, 2), (9, 1, 1, 0, 1, 2), (9, 1, 1, 0, 1, 2)]


def test_quality_learns_the_same_from_repeated_ids(spark):
    docs = hot(spark, own=False)
    labels = spark.createDataFrame([(7, 1), (3, 0), (1001, 1), (1002, 0), (None, 1), (3, 0)], "doc_id long, quality int")
    first, again = (quality.learn_quality(docs.repartition(n), labels) for n in (2, 7))
    assert first.tolist() == again.tolist() and first.any()


@pytest.mark.parametrize("name", ["quality", "langid"])
def test_long_texts_and_empty_tables(spark, name):
    rows = [(1, "word " * 200_000, "en"), (2, "", "en"), (3, None, None), (4, "Ein kurzer Text über Häuser", "de"), (4, "Ein kurzer Text über Häuser", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if name == "quality":
        w = quality.learn_quality(docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))
        run = lambda d: quality.score_quality(d, w)
    else:
        m = langid.learn_languages(docs.filter("lang IS NOT NULL"))
        run = lambda d: langid.predict_languages(d, m)
    got = rows_of(run(docs), "doc_id", "score")
    assert len(got) == 5 and len({s for i, s in got if i == 4}) == 1 and run(docs.limit(0)).count() == 0


def test_language_ties_go_to_the_first_name(spark):
    """Two languages of the same texts: equal scores, the first by name."""
    docs = spark.createDataFrame([(i, f"alpha beta {i // 2}", "xx" if i % 2 else "aa") for i in range(40)], "doc_id long, text string, lang string")
    got = langid.predict_languages(docs, langid.learn_languages(docs))
    m = langid.learn_languages(docs)
    flat = langid.Model(m.languages, m.idf, m.weights * 0, m.temperature, m.prior * 0)
    assert {r.lang_pred for r in langid.predict_languages(docs, flat).collect()} == {"aa"} and got.count() == 40


def test_near_and_exact_dedup_of_hot_rows(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(hot_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted((i, c) for i, _, c in brute_components(rows))
    assert sorted(rows_of(jaccard.jaccard_components(docs), "doc_id", "component_id")) == want
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == len({squeeze(r[1]) for r in rows})
