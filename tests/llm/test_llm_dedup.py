"""Exact dedup and the n-gram Jaccard join against brute force."""
import hashlib
import random
import re

from llm_fixtures import documents, empty, frame, prose, rows_of

from leadframe.llm import exact_dedup, jaccard
from leadframe.llm.textscan import batch_words, shingle_sets


def squeeze(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest())
                  for k, g in groups.items() for _, i in g)


def test_exact_dedup_matches_brute_force(spark):
    rows = documents()
    got = exact_dedup.exact_dedup(frame(spark, rows), digest_all=True)
    assert sorted(rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256")) == brute_exact(rows)
    assert all(kept == (i == k) for i, k, kept in rows_of(got, "doc_id", "keep_id", "kept"))


def test_exact_dedup_refines_to_the_same_groups(spark):
    rows = documents()
    got = exact_dedup.exact_dedup(frame(spark, rows), prefix_chars=4)
    assert sorted(rows_of(got, "doc_id", "keep_id", "group_size")) == [r[:3] for r in brute_exact(rows)]
    hashes = dict(rows_of(got, "doc_id", "text_sha256"))
    want = {i: h for i, _, _, h in brute_exact(rows)}
    assert all(h is None or h == want[i] for i, h in hashes.items())
    assert sum(h is None for h in hashes.values()) > 10         # most texts were settled before the full hash


def test_repeated_rows_keep_exactly_one(spark):
    rows = [(1, "same text", None, None)] * 5 + [(2, "same  text", None, None), (None, None, None, None), (None, "", None, None)]
    got = rows_of(exact_dedup.exact_dedup(frame(spark, rows)), "doc_id", "keep_id", "group_size", "kept")
    assert sorted(got, key=str) == sorted([(1, 2, 6, False)] * 5 + [(2, 2, 6, True), (None, None, 2, True),
                                                                   (None, None, 2, False)], key=str)
    kept = exact_dedup.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(rows_of(kept, "doc_id"), key=str) == [(2,), (None,)]


def test_exact_dedup_empty_table(spark):
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    assert exact_dedup.keep_first(empty(spark)).count() == 0


def shingles(t, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, percent=80):
    sets = {i: shingles(t) for i, t, *_ in rows}
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def check(spark, rows, **args):
    got = sorted(rows_of(jaccard.jaccard_components(frame(spark, rows), **args), "doc_id", "n_shingles", "component_id"))
    assert got == brute_components(rows, args.get("percent", 80))


def test_jaccard_matches_brute_force(spark):
    check(spark, documents())


def near_copies(seed, groups, size, most):
    """Groups of edited copies, chains of edits, and a passage that all share."""
    rnd = random.Random(seed)
    common = prose(rnd, 20)
    texts = []
    for _ in range(groups):
        words = prose(rnd, rnd.randint(5, 90)).split()
        for _ in range(size):
            v = list(words)
            for _ in range(rnd.randint(0, most)):
                at = rnd.randrange(len(v))
                rnd.choice((lambda: v.__setitem__(at, "e%d" % rnd.randint(0, 99)), lambda: v.insert(at, "new"),
                            lambda: v.pop(at) if len(v) > 1 else None))()
            if rnd.random() < 0.3:
                words = v
            texts.append(" ".join(v) + (" " + common if rnd.random() < 0.5 else ""))
    return [(i, t, None, None) for i, t in enumerate(texts)]


def test_jaccard_random_near_copies(spark):
    check(spark, near_copies(1, 12, 12, 3))
    check(spark, near_copies(2, 4, 40, 2))


def test_jaccard_salted_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 8)
    check(spark, near_copies(3, 3, 50, 2))


def test_jaccard_ids_that_many_rows_share(spark):
    """A third of the rows under one id with texts of their own, a third one repeated row: ids meet where any of their rows link."""
    rows = near_copies(4, 10, 6, 2)
    base = [(i + 10, t) for i, t, *_ in rows]
    hot = [(500, t + " tail") for _, t in base[::2]] + [(500, prose(random.Random(9), 40 + n)) for n in range(30)]
    again = [(base[7][0], base[7][1])] * 60
    table = base + hot + again + [(None, base[0][1])] * 5 + [(600, None), (600, ""), (2, hot[-1][1])]
    docs = frame(spark, [(i, t, None, None) for i, t in table])
    got = rows_of(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id")
    keyed = [(i, t) for i, t in enumerate(t for t in table if t[0] is not None)]
    by_row = {row: comp for row, _, comp in brute_components([(n, t[1]) for n, t in keyed])}
    comp = {t[0]: t[0] for _, t in keyed}
    for _ in range(len(comp)):      # the least id of a component of rows, until nothing changes
        least, before = {}, dict(comp)
        for n, t in keyed:
            least[by_row[n]] = min(least.get(by_row[n], comp[t[0]]), comp[t[0]])
        for n, t in keyed:
            comp[t[0]] = min(comp[t[0]], least[by_row[n]])
        if comp == before:
            break
    assert comp[500] == 2 and len(set(comp.values())) > 3
    assert sorted(got, key=str) == sorted([(i, len(shingles(t)), comp.get(i)) for i, t in table], key=str)


def test_jaccard_repeats_nulls_and_empty_table(spark):
    rows = [(5, "a b c d e f", None, None), (5, "a b c d e f", None, None), (3, "A B c d e f", None, None),
            (9, None, None, None), (10, "", None, None), (None, "a b c d e f", None, None)]
    got = sorted(rows_of(jaccard.jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id"), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (9, 0, 9), (10, 0, 10), (None, 2, None)], key=str)
    assert jaccard.jaccard_components(empty(spark)).count() == 0
    kept = jaccard.keep_one(frame(spark, rows))
    assert sorted(rows_of(kept, "doc_id"), key=str) == sorted([(3,), (9,), (10,), (None,)], key=str)


def test_shingle_sets_agree_with_words(spark):
    import pyarrow as pa
    texts = [t for _, t, *_ in documents()]
    sets = [s for w in batch_words(pa.array(texts, pa.string()), 4096) for s in shingle_sets(w)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    seen = {}
    for s, t in zip(sets, texts):
        assert seen.setdefault(s.tobytes(), shingles(t)) == shingles(t)


def test_long_list_probe_gives_up_exactly():
    import numpy as np
    rnd = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(rnd.integers(0, 400, rnd.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        both = len(np.intersect1d(x, y))
        for need in (0, 1, both - 1, both, both + 1):
            assert jaccard.overlap_reaches(x, y, need) == (both >= need)


def test_no_text_in_the_dedup_shuffles(spark):
    plan = exact_dedup.exact_dedup(frame(spark, documents()), digest_all=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
