"""op4, op7 and op8 as registered, against plain Python written from their formulas, on the awkward fixture.

The random tables of the hashes and numpy's shuffles are taken as given; every
word, n-gram, count, weight, signature and score is computed anew, one by one.
"""
import base64
import hashlib
import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import documents, frame, rows_of
from pyspark.sql import functions as F

from leadframe.llm import langid, quality, spotsigs
from leadframe.llm.queries import op4_spotsigs, op7_language, op8_quality
from leadframe.llm.textscan import _tables

M64 = (1 << 64) - 1
GOLD = 0x9E3779B97F4A7C15


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


VALUE = [int(v) for v in _tables()[0]]


def word_hash(word):
    total, p = 0, 1
    for b in word:
        total, p = (total + VALUE[b] * p) & M64, p * (GOLD | 1) & M64
    return mix((total + len(word)) & M64)


def split(raw, is_gap):
    words, word = [], bytearray()
    for b in raw:
        if is_gap(b):
            if word:
                words.append(bytes(word))
            word = bytearray()
        else:
            word.append(b)
    return words + ([bytes(word)] if word else [])


def space(b):
    return b in b" \t\n\x0b\x0c\r"


def mark(b):
    return b < 128 and not chr(b).isalnum()


class BruteFtrl:
    """The update of follow-the-regularised-leader, one coordinate at a time."""

    def __init__(self, classes, alpha, beta, l1, l2):
        self.z, self.n, self.k = {}, {}, classes
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weight(self, f, c):
        z, n = self.z.get((f, c), 0.0), self.n.get((f, c), 0.0)
        if abs(z) <= self.l1:
            return 0.0
        return (math.copysign(self.l1, z) - z) / ((self.beta + math.sqrt(n)) / self.alpha + self.l2)

    def learn(self, x, label, weight=1.0):
        w = {(f, c): self.weight(f, c) for f in x for c in range(self.k)}
        p = probabilities([sum(v * w[f, c] for f, v in x.items()) for c in range(self.k)])
        for f, v in x.items():
            for c in range(self.k):
                g = weight * v * (p[c] - (c == label))
                n = self.n.get((f, c), 0.0)
                step = (math.sqrt(n + g * g) - math.sqrt(n)) / self.alpha
                self.z[f, c] = self.z.get((f, c), 0.0) + g - step * w[f, c]
                self.n[f, c] = n + g * g


def probabilities(s):
    e = [math.exp(v - max(s)) for v in s]
    return [v / sum(e) for v in e]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("brute")
    rows = documents()
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000], la, s) for i, t, la, s in rows]
    frame(spark, rows).write.parquet(str(root / "documents.parquet"))
    labels = [(i, None if i % 11 == 0 else int(len(t or "") % 3 == 0), None if i % 4 else "x") for i, t, _, _ in rows]
    labels += [(5, 1, None), (6, 0, "x"), (6, 1, "x"), (None, 1, None), (10_000, 1, None), (9, 2, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, score string").write.parquet(str(root / "labels.parquet"))
    return str(root), rows, labels


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# ------------------------------------------------------------------ op4
def brute_anchor_cells(texts):
    docs, occurrences = Counter(), Counter()
    for t in texts:
        cells = [word_hash(w) >> 47 for w in split((t or "").encode(), mark)]
        occurrences.update(cells)
        docs.update(set(cells))
    out, used = set(), 0
    for cell in sorted(docs, key=lambda c: (-docs[c], c)):
        used += occurrences[cell]
        if used > spotsigs.COMMON_SHARE * sum(occurrences.values()) or len(out) == spotsigs.MOST_COMMON:
            break
        out.add(cell)
    return out


def brute_signatures(text, cells):
    words = [word_hash(w) for w in split(text.encode(), mark)]
    common = [w >> 47 in cells for w in words]
    if all(common):
        common = [False] * len(words)
    content = [w for w, c in zip(words, common) if not c]
    starts = [(1, 0, 0)] if words else []                       # (anchor, next content word, content words so far)
    seen = 0
    for w, c in zip(words, common):
        if c:
            starts.append((w, seen, 0))
        seen += not c
    order = [mix(w) for w in content]
    windows = [range(i, i + 3) for i in range(len(content) - 2)] or ([range(len(content))] if content else [])
    for i in sorted({min(w, key=lambda j: (order[j], j)) for w in windows}):
        starts.append((content[i], i + 1, 1))
    out = set()
    for anchor, at, got in starts:
        sig = mix(anchor)
        for j in (at, at + 1):
            sig = mix((sig * GOLD + (content[j] if j < len(content) else 0)) & M64)
            got += j < len(content)
        if got:
            out.add(sig >> 32)
    return out


def packed(signatures):
    return base64.b64encode(b"".join(s.to_bytes(4, "little") for s in sorted(signatures))).decode()


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_op4_equals_brute_force(spark, tables):
    sf, rows, _ = tables
    texts = [t or "" for _, t, _, _ in sorted(rows, key=lambda r: r[0])]
    cells = brute_anchor_cells(texts)
    got = {r["doc_id"]: r.asDict() for r in op4_spotsigs(spark, sf).collect()}
    assert len(got) == len(texts) and cells
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        n = len(text) // 4
        edited = text[:len(text) - n] + following[:n]
        own, changed = brute_signatures(text, cells), brute_signatures(edited, cells)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (packed(own), packed(changed))
        assert r["near_edited"] == pytest.approx(jaccard(own, changed))
        assert r["near_next"] == pytest.approx(jaccard(own, brute_signatures(following, cells)))


# ------------------------------------------------------------------ op7
def brute_ngrams(text):
    letter = [unicodedata.category(c)[0] == "L" for c in text.lower()]
    points = [ord(c) if a else 32 for c, a in zip(text.lower(), letter)]
    out = Counter()
    for i in range(len(points)):
        h = 0
        for j in range(i, min(i + 3, len(points))):
            h = ((h ^ points[j]) * 0x01000193 + 0x9E3779B9) & 0xFFFFFFFF
            if any(letter[i:j + 1]):
                out[((h ^ (h >> 15)) * 0x85EBCA6B & 0xFFFFFFFF) >> 18] += 1
    return out


def brute_language_model(rows, hashes):
    """rows: (id, text, lang); -> a function text -> (lang, score)."""
    known = [(la, hashes[i, t], brute_ngrams(t)) for i, t, la in rows if la is not None and t is not None]
    frequency = Counter(f for *_, grams in known for f in grams)

    def vector(grams):
        x = {f: grams[f] * (math.log((1 + len(known)) / (1 + frequency[f])) + 1 if frequency[f] else math.log(1 + len(known)))
             for f in sorted(grams)}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / max(1e-12, length) for f, v in x.items()}
    languages = sorted({la for la, *_ in known})
    sample = sorted({(la, h): grams for la, h, grams in known}.items(), key=lambda r: r[0])
    have, learn, held = Counter(), [], []
    for (la, _), grams in sample:
        have[la] += 1
        (held if have[la] % 5 == 0 else learn).append((vector(grams), languages.index(la)))
    model = BruteFtrl(len(languages), langid.ALPHA, langid.BETA, langid.L1, langid.L2)
    for epoch in range(langid.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            model.learn(*learn[i])

    def scores(x):
        return [sum(v * model.weight(f, c) for f, v in x.items()) for c in range(len(languages))]
    raw = [(scores(x), y) for x, y in held]

    def loss(t):
        return -sum(math.log(max(probabilities([v / math.exp(t) for v in s])[y], 1e-12)) for s, y in raw)
    lo, hi = -3.0, 3.0
    for _ in range(100):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    true = Counter(la for la, *_ in known)
    prior = [math.log(true[la] / len(known)) - math.log(have[la] / len(sample)) for la in languages]

    def predict(text):
        grams = brute_ngrams(text or "")
        if not grams:
            return "und", 0.0
        p = probabilities([v / math.exp((lo + hi) / 2) + q for v, q in zip(scores(vector(grams)), prior)])
        return languages[p.index(max(p))], max(p)
    return predict


def test_op7_equals_brute_force(spark, tables):
    sf, rows, _ = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hashes = {(i, t): h for i, t, h in rows_of(docs.withColumn("h", F.xxhash64("doc_id", "text")), "doc_id", "text", "h")}
    predict = brute_language_model([(i, t, la) for i, t, la, _ in rows if crc(i, 3) != 1], hashes)
    got = {r["doc_id"]: r for r in op7_language(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        lang, score = predict(t)
        assert got[i]["held_out"] == (crc(i, 3) == 1)
        assert got[i]["score"] == pytest.approx(score, abs=1e-4)
        assert got[i]["lang_pred"] == lang or abs(score - 0.5) < 1e-4


def test_language_sample_is_bounded_in_all(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                 F.concat(F.lit("l"), F.col("id") % 8).alias("lang"))
    known = df.select("lang", "text", F.xxhash64("doc_id", "text").alias("row"))
    for sample, each in ((10_000, 50), (8 * 30, 30), (8, langid.LEAST)):
        found, share = langid._sample(known, 1000, sample)
        assert Counter(r.lang for r in found) == {f"l{i}": each for i in range(8)} and set(share.values()) == {50}


# ------------------------------------------------------------------ op8
SHAPE_VALUE = [int(v) for v in quality._SHAPE_VALUE]


def byte_class(b):
    return ord("a") if b >= 128 or chr(b).islower() else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b


def shape(word):
    runs = [byte_class(b) for b in word]
    runs = [c for i, c in enumerate(runs) if i == 0 or runs[i - 1] != c]
    return mix(sum(mix(SHAPE_VALUE[c] + i & M64) for i, c in enumerate(runs)) & M64)


def brute_quality_features(text):
    words = split((text or "").encode(), space)
    out, before, seen = Counter(), (1, 1), set()
    for w in words:
        now = word_hash(w), shape(w)
        pair, shapes = (mix((b * GOLD + x) & M64) for b, x in zip(before, now))
        for x, seed in ((now[0], 0x51), (pair, 0xB2), (now[1], 0x53), (shapes, 0xB4)):
            out[mix((x + seed) & M64) >> 46] += 1
        out[0] += pair in seen                                  # a word pair seen before
        out[1] += now[0] == before[0]                           # a word that follows itself
        seen.add(pair)
        before = now
    return +out


def test_op8_equals_brute_force(spark, tables):
    sf, rows, labels = tables
    marks = {}
    for i, y, _ in labels:
        if i is not None and y in (0, 1) and i < len(rows) and crc(i, 5) != 0:
            marks[i] = max(y, marks.get(i, 0))
    texts = {i: t for i, t, _, _ in rows}
    ids = sorted(marks, key=str)
    have = Counter(marks.values())
    constant = quality.FEATURES

    def vector(text):
        f = brute_quality_features(text)
        return {k: quality.SCALE * f[k] / max(1, sum(f.values())) for k in sorted(f)} | {constant: 1.0}
    learn = [(vector(texts[i]), marks[i]) for i in ids]
    model = BruteFtrl(2, quality.ALPHA, quality.BETA, quality.L1, quality.L2)
    for epoch in range(quality.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(learn)):
            model.learn(*learn[k])                              # all labelled rows are in the sample: weight 1
    got = {r["doc_id"]: r for r in op8_quality(spark, sf).collect()}
    assert len(got) == len(rows) and min(have.values()) > 5
    for i, t in texts.items():
        s = sum(v * (model.weight(f, 1) - model.weight(f, 0)) for f, v in vector(t).items())
        assert got[i]["held_out"] == (crc(i, 5) == 0)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-6)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.3)
