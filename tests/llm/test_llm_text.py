"""BPE, SpotSigs, language ID and the quality classifier."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_fixtures import documents, empty, frame, rows_of

from leadframe.llm import bpe, langid, quality, spotsigs
from leadframe.llm.ftrl import fit_temperature, softmax

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS)


@pytest.fixture(scope="module")
def tik(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def encode(texts, vocabulary):
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    ids = bpe.encode_block(np.frombuffer(b"".join(raw), np.uint8), off, vocabulary)
    return [np.frombuffer(x, "<u4") for x in ids]


# ------------------------------------------------------------------ BPE
def test_pieces_and_merges_match_tiktoken(vocabulary, tik):
    rnd = random.Random(1)
    alphabet = list("abst mdrevlREV'' \n\t\r!?.,0129éßñ漢字 　😀’ЖΩ½²٣\x85\x1c\x1d_-ǅʰ ́")
    for _ in range(60):
        texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(50)]
        for t, ids in zip(texts, encode(texts, vocabulary)):
            assert ids.tolist() == tik.encode_ordinary(t), t
            assert vocabulary.decode(ids, vocabulary.offsets(ids)) == t.encode()


def test_documents_and_long_pieces(vocabulary, tik):
    texts = [t or "" for _, t, *_ in documents()] + ["ab" * 3000, "é" * 700, "x" * 65, " " * 5000 + "y", "'" * 100 + "s"]
    for t, ids in zip(texts, encode(texts, vocabulary)):
        assert ids.tolist() == tik.encode_ordinary(t)


def test_cache_is_bounded(tik):
    small = bpe.Vocabulary(RANKS, cache_pieces=10)
    for _ in range(3):
        texts = ["some words that fill the little cache %d" % i for i in range(30)]
        assert [x.tolist() for x in encode(texts, small)] == [tik.encode_ordinary(t) for t in texts]
    texts = ["one", "two"]
    encode(texts, small)
    assert len(small.pieces) <= 10


def test_scan_equals_the_serial_machine():
    rnd = np.random.default_rng(2)
    of_symbol, _, every, _ = bpe._machine()
    for n in (0, 1, 63, 64, 65, 5000):
        symbols = rnd.integers(0, 16, n)
        state, want = bpe.NONE, []
        for a in symbols:
            want.append(state)
            state = bpe._step(bpe.NONE if a >= 8 else state, a % 8)[0]
        assert bpe.states_before(of_symbol[symbols]).tolist() == want


def test_encode_and_decode_frames(spark, tik):
    rows = documents() + [(1, "twice", None, None), (1, "twice", None, None), (None, "no id", None, None)]
    ids = bpe.encode(frame(spark, rows), RANKS, carry=("doc_id", "id"))
    back = rows_of(bpe.decode(ids, RANKS), "doc_id", "n_tokens", "decoded")
    want = [(i, len(tik.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows]
    assert sorted(((i, n, bytes(d)) for i, n, d in back), key=str) == sorted(want, key=str)
    assert bpe.encode(empty(spark), RANKS).count() == 0
    plain = bpe.encode(frame(spark, rows[:3]), RANKS, with_offsets=False)
    assert plain.columns == ["doc_id", "n_tokens", "ids"]
    fused = bpe.encode(frame(spark, rows), RANKS, with_offsets=False, decoded_col="d")
    assert sorted(((i, n, bytes(d)) for i, n, d in rows_of(fused, "doc_id", "n_tokens", "d")), key=str) == sorted(want, key=str)


def test_text_that_is_not_utf8(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff62' AS STRING) AS text UNION ALL SELECT 2L, 'ok'")
    out = bpe.decode(bpe.encode(df, RANKS), RANKS)
    assert sorted((i, bytes(d)) for i, d in rows_of(out, "doc_id", "decoded")) == [(1, "a�b".encode()), (2, b"ok")]


# ------------------------------------------------------------------ SpotSigs
def brute_spots(text):
    """Signatures as tuples of words, from the definition."""
    import re
    words = re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text or "")
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, w in [(-1, "^")] * bool(words) + list(enumerate(words)):
        if i >= 0 and w not in anchors:
            continue
        chain = [x for x in words[i + 1:] if x not in anchors][:spotsigs.CHAIN]
        if chain:
            out.add((w, *chain))
    return out


def test_signatures_follow_the_definition(spark):
    rows = documents()
    prints = dict(rows_of(spotsigs.fingerprints(frame(spark, rows)), "doc_id", "fingerprint"))
    sets = {i: brute_spots(t) for i, t, *_ in rows}
    for i, s in sets.items():
        assert len(spotsigs.unpack(prints[i])) == len(s)
    ids = sorted(sets)
    for a in ids[::3]:
        for b in ids[::5]:
            union = sets[a] | sets[b]
            want = len(sets[a] & sets[b]) / len(union) if union else 1.0
            got = spotsigs.likeness(spotsigs.unpack(prints[a]), spotsigs.unpack(prints[b]))
            assert got == pytest.approx(want)
    assert spotsigs.fingerprints(empty(spark)).count() == 0


def brute_next(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t, *_ in rows]
    out = []
    for k, (i, *_) in enumerate(rows):
        t, f = texts[k], texts[(k + 1) % len(rows)]
        e = spotsigs.edited_text(t, f)
        a, b, c = spotsigs.text_spots([t, e, f])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), spotsigs.pack(a), spotsigs.pack(b),
                    spotsigs.likeness(a, b), spotsigs.likeness(a, c)))
    return sorted(out, key=str)


def test_next_documents_over_all_ranges(spark):
    rows = documents() + [(7, "tie b", None, None), (7, "tie a", None, None), (None, "no id", None, None)]
    got = spotsigs.compare_with_next(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_next(rows)
    for few in (rows[:1], rows[:2]):
        assert sorted((tuple(r) for r in spotsigs.compare_with_next(frame(spark, few)).collect()), key=str) == brute_next(few)
    assert spotsigs.compare_with_next(empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [50, 80])
def test_near_components_equal_all_pairs(spark, percent):
    rows = documents()
    sets = {i: s for (i, *_), s in zip(rows, spotsigs.text_spots([t or "" for _, t, *_ in rows]))}
    comp = {i: i for i in sets}

    def find(i):
        return i if comp[i] == i else find(comp[i])
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    got = spotsigs.near_components(frame(spark, rows), percent=percent)
    assert sorted(rows_of(got, "doc_id", "n_spots", "component_id")) == [(i, len(sets[i]), find(i)) for i in ids]


def test_corpus_anchors_are_the_words_of_most_documents(spark):
    rnd = random.Random(3)
    often = ["ja", "się", "için"]
    rows = [(i, " ".join(x for _ in range(9) for x in (rnd.choice(often), "w%d" % rnd.randint(0, 9999), "v%d" % rnd.randint(0, 9999))),
             None, None) for i in range(60)] + [(60, None, None, None), (61, "", None, None)]
    flags = spotsigs.corpus_anchors(frame(spark, rows))
    assert set(np.flatnonzero(flags)) >= set(spotsigs._cell(spotsigs.word_hashes(often)))
    assert not flags[spotsigs._cell(spotsigs.word_hashes(spotsigs.ANCHORS))].any()
    assert not spotsigs.corpus_anchors(empty(spark)).any()


def test_query_covers_whole_texts_in_any_language(spark, tmp_path):
    """Lists, short texts and texts without any of ANCHORS: every word is in the fingerprint of the query."""
    from leadframe.llm.queries import op4_spotsigs
    lists = [" ".join("%s%d" % (w, i * 7 + k) for k, w in enumerate(["sivu", "kartta", "talo"] * 20)) for i in range(30)]
    texts = lists + ["alpha beta", "alpha beta gamma delta omega sigma", "ja ja ja", "", None]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op4_spotsigs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(0.3 < got[i].near_edited < 0.8 for i in range(29))
    assert spotsigs.likeness(*(spotsigs.unpack(got[i].fingerprint) for i in (30, 31))) < 0.5
    assert len(spotsigs.unpack(got[32].fingerprint)) > 0
    assert got[33].fingerprint == got[34].fingerprint == ""


def test_any_changed_content_word_changes_the_fingerprint():
    flags = np.zeros(spotsigs.CELLS, bool)
    flags[spotsigs._cell(spotsigs.word_hashes(["the", "of"]))] = True
    rnd = random.Random(6)
    for n in (1, 2, 3, 4, 9, 40):
        words = [rnd.choice(["the", "of"]) if rnd.random() < 0.3 else "w%d" % i for i in range(n)] + ["w99"]
        changed = [" ".join(words[:i] + ["other"] + words[i + 1:]) for i in range(n + 1)]
        own, *others = spotsigs.text_spots([" ".join(words)] + changed, anchors=flags)
        assert all(spotsigs.likeness(own, o) < 1 for o in others)
    both = spotsigs.text_spots(["the of the", "the of the", "w1 w2"], anchors=flags)
    assert len(both[0]) and (both[0] == both[1]).all()
    apart = [spotsigs.text_spots([t], anchors=flags)[0] for t in ("a b c the d", "x", "", "of of")]
    assert all((a == b).all() for a, b in zip(apart, spotsigs.text_spots(["a b c the d", "x", "", "of of"], anchors=flags)))


# ------------------------------------------------------------------ classifiers
def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_held_out_accuracy(spark):
    from leadframe.llm.queries import op7_language
    got = {i: (h, p, s) for i, h, p, s in rows_of(op7_language(spark, SF), "doc_id", "held_out", "lang_pred", "score")}
    rows = rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "lang")
    assert len(got) == len(rows)
    held = [(lang, got[i][1]) for i, lang in rows if crc(i) % 3 == 1]
    assert all(got[i][0] == (crc(i) % 3 == 1) for i, _ in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for _, _, s in got.values())


def test_language_awkward_rows(spark):
    rows = [(i, "der die das und nicht " * 3, "de", None) for i in range(20)] + \
           [(i, "the of and with this " * 3, "en", None) for i in range(20, 40)]
    model = langid.learn_languages(frame(spark, rows + [(41, None, "xx", None), (42, "text", None, None)]))
    assert model.languages == ["de", "en"]
    odd = [(1, None, None, None), (2, "", None, None), (3, "123 !? $$", None, None), (4, "and the", None, None), (4, "and the", None, None)]
    got = rows_of(langid.predict_languages(frame(spark, odd), model), "doc_id", "lang_pred")
    assert sorted(got) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    none = langid.learn_languages(empty(spark))
    assert rows_of(langid.predict_languages(frame(spark, odd[3:4]), none), "lang_pred", "score") == [("und", 0.0)]
    assert langid.predict_languages(empty(spark), model).count() == 0


def test_every_language_is_learnt_whatever_its_share(spark):
    """Rare languages (one of 12 rows, one of 2, one with null or repeated ids only) beside hot ones."""
    rnd = random.Random(8)
    words = {"en": "the of and with this that from have been which", "de": "der die das und nicht sich auch werden eine ist",
             "fi": "että hän ovat myös kuin mutta olla jotka sekä kanssa", "tr": "bir için olarak daha sonra kadar gibi çok değil",
             "pl": "się jest nie który przez oraz była także został"}

    def text(lang):
        return " ".join(rnd.choice(words[lang].split()) for _ in range(30))
    rows = [(i, text("en"), "en", None) for i in range(6000)] + [(i, text("de"), "de", None) for i in range(6000, 8000)]
    rows += [(i, text("fi"), "fi", None) for i in range(8000, 8012)] + [(i, text("tr"), "tr", None) for i in (8012, 8013)]
    rows += [(None, text("pl"), "pl", None) for _ in range(3)] + [(1, text("pl"), "pl", None) for _ in range(3)]
    rows += [(2, "same words again", "en", None)] * 500
    model = langid.learn_languages(frame(spark, rows))
    assert model.languages == sorted(words)
    asked = [(i, text(lang), lang, None) for i, lang in enumerate(sorted(words) * 20)]
    got = rows_of(langid.predict_languages(frame(spark, asked), model, carry=("lang",)), "lang", "lang_pred")
    assert all(a == b for a, b in got)


def test_language_sample_is_bounded_by_language(spark):
    rows = [(i, "text %d" % i, "en" if i % 10 else "de", None) for i in range(1000)] + [(7, "copy", "de", None)] * 400
    known = frame(spark, rows).selectExpr("lang", "text", "xxhash64(doc_id, text) AS row")
    found, share = langid._sample(known, 30)
    assert share == {"en": 900, "de": 500}
    have = {k: sum(r.lang == k for r in found) for k in share}
    assert all(15 <= n <= 30 for n in have.values()) and len({(r.lang, r.row) for r in found}) == len(found)


def test_frequencies_cover_every_row():
    texts = ["Ab c", "ab", None, "zz 1", "é" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])
    out = next(iter(langid._frequencies([batch]))).to_pydict()
    seen = dict(zip(out["feature"], out["n"]))
    assert seen.pop(langid.FEATURES) == 5
    counts = list(langid.row_counts(pa.array(texts)))
    assert {f: n for f, n in enumerate(np.sum([c > 0 for c in counts], axis=0)) if n} == seen


def test_temperature_calibrates():
    rnd = np.random.default_rng(4)
    scores = rnd.normal(size=(4000, 3)) * 2
    labels = np.array([rnd.choice(3, p=p) for p in softmax(scores)])
    assert fit_temperature(scores * 5, labels) == pytest.approx(5, rel=0.2)
    assert fit_temperature(scores[:0], labels[:0]) == 1.0


def test_quality_held_out_accuracy(spark):
    from leadframe.llm.queries import op8_quality
    got = {i: r for i, *r in rows_of(op8_quality(spark, SF), "doc_id", "held_out", "score", "predicted")}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = rows_of(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "quality")
    held = [(q, got[i][2]) for i, q in labels if crc(i) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert all(h == (crc(i) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, (h, s, p) in got.items())


def test_quality_awkward_rows(spark):
    rows = [(i, "plain words in a row %d" % i, None, None) for i in range(60)] + \
           [(i, "$$$ ### %%% &&&" * 3, None, None) for i in range(60, 120)]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)] + [(3, None, 0), (None, 1, 0), (5, 0, 0), (500, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    weights = quality.learn_quality(frame(spark, rows), labels)
    odd = [(1, None, None, None), (2, "", None, None), (3, "other words here", None, None), (4, "### $$$", None, None), (4, "### $$$", None, None)]
    got = dict(rows_of(quality.score_quality(frame(spark, odd), weights), "doc_id", "score"))
    assert got[3] > 0.5 > got[4] and got[1] == got[2]
    assert (quality.learn_quality(frame(spark, rows), labels.limit(0)) == 0).all()
    assert quality.score_quality(empty(spark), weights).count() == 0


def test_quality_sample_is_bounded(spark):
    rows = [(i, "w%d" % i, None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    seen = []
    orig = quality.train
    try:
        quality.train = lambda r: seen.append(len(r)) or orig(r)
        quality.learn_quality(frame(spark, rows), labels, per_class=20)
    finally:
        quality.train = orig
    assert 20 <= seen[0] <= 40
