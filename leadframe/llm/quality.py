"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL.

A word gives its own hash, its hash with the word before, its shape (letters,
capitals, digits and marks, runs collapsed) and its shape with the one before;
a word pair that the document has already had gives one more, and so does a
word that follows itself. Values are relative frequencies, so the score is a sparse dot product that doesn't grow
with the text. All features hash into ``FEATURES`` slots.

Training takes a bounded sample of the labelled rows: at most ``PER_CLASS`` of
each class by hash order, re-weighted to the classes' true shares, so scores
stay probabilities. Scoring streams whole texts; the weights, of fixed size,
are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import text_and
from leadframe.llm.ftrl import Ftrl
from leadframe.llm.textscan import batch_words, mix

FEATURES = 1 << 18
PER_CLASS = 3000
EPOCHS = 3
SCALE = 20.0            # of the relative frequencies
KEEP_AT = 0.3           # least score of a document that stays
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
_SEEDS = (0x51, 0xB2, 0x53, 0xB4)


def _shape_table() -> np.ndarray:
    """Class of a byte: small letter (and all beyond ASCII), capital, digit, or the mark itself."""
    t = np.arange(256)
    t[128:] = ord("a")
    t[97:123] = ord("a")
    t[65:91] = ord("A")
    t[48:58] = ord("0")
    rng = np.random.default_rng(77)
    return t, rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_SHAPE, _SHAPE_VALUE = _shape_table()


def _shapes(words) -> np.ndarray:
    """Hash of each word's shape."""
    shape = _SHAPE[words.data]
    n = len(shape)
    new = np.ones(n, bool)
    new[1:] = shape[1:] != shape[:-1]
    new[words.start] = True
    count = np.cumsum(new)
    start = np.zeros(n, np.int64)
    start[words.start] = count[words.start]
    rank = count - np.maximum.accumulate(start)             # number of runs since the word's start
    value = np.where(new, mix(_SHAPE_VALUE[shape] + rank.astype(np.uint64)), np.uint64(0))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    return mix(total[words.end] - total[words.start])


def row_features(words):
    """Feature numbers of each row of a block, with repeats."""
    h, off = words.hash, words.word_off
    if len(h) == 0:
        for _ in range(len(off) - 1):
            yield np.zeros(0, np.int64)
        return
    s = _shapes(words)
    start = np.zeros(len(h), bool)
    start[off[:-1][off[:-1] < len(h)]] = True

    def pair(x):
        before = np.empty_like(x)
        before[0], before[1:] = 0, x[:-1]
        before[start] = np.uint64(1)
        return mix(before * np.uint64(0x9E3779B97F4A7C15) + x)
    two = pair(h)
    double = np.zeros(len(h), bool)
    double[1:] = (h[1:] == h[:-1]) & ~start[1:]
    cols = [(mix(x + np.uint64(seed)) >> np.uint64(64 - 18)).astype(np.int64)
            for x, seed in zip((h, two, s, pair(s)), _SEEDS)]
    every = np.stack(cols)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        again = (b - a) - len(np.unique(two[a:b]))          # word pairs that the row has already had
        yield np.concatenate([every[:, a:b].ravel(), np.zeros(again, np.int64),
                              np.ones(int(double[a:b].sum()), np.int64)])


def train(rows: list[tuple[bytes, bytes, int, float]], epochs: int = EPOCHS) -> np.ndarray:
    """rows: (distinct feature numbers, counts, label, weight), the first two
    packed as 32-bit integers -> weights; the constant, feature FEATURES, is last."""
    model = Ftrl(FEATURES + 1, 2, ALPHA, BETA, L1, L2)
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, n, label, weight = rows[i]
            at, n = np.frombuffer(at, np.int32).astype(np.int64), np.frombuffer(n, np.int32)
            model.learn(np.append(at, FEATURES), np.append(SCALE * n / max(1, int(n.sum())), 1.0), label, weight)
    w = model.weights()
    return w[:, 1] - w[:, 0]


def score_rows(words, weights: np.ndarray):
    for f in row_features(words):
        s = weights[FEATURES] + (SCALE * weights[f].sum() / len(f) if len(f) else 0.0)
        yield 1.0 / (1.0 + np.exp(-np.clip(s, -50, 50)))


_SAMPLE = "id string, label int, at binary, n binary"


def sample_features(batches):
    """(id, label, text) -> (id, label, distinct features, counts)."""
    for batch in batches:
        at, n = [], []
        for words in batch_words(batch.column(2)):
            for f in row_features(words):
                u, c = np.unique(f, return_counts=True)
                at.append(u.astype(np.int32).tobytes())
                n.append(c.astype(np.int32).tobytes())
        if at:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()),
                                              pa.array(n, pa.binary())], ["id", "label", "at", "n"])


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", learn_from=None, per_class: int = PER_CLASS):
    """Weights of the classifier, from at most ``per_class`` labelled rows of each class.

    ``learn_from``: a Column over the labels' id that says which rows may be
    learnt from. Rows without a label (null, or other than 0 and 1) are left
    out; of several labels of one document the largest counts, of several texts
    under one id the one of least hash, and repeated rows count once, so reruns
    learn the same. Without any labelled row, or any document, the weights are 0
    (every score 0.5). Other columns aren't read.
    """
    mark = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    mark = mark.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    if learn_from is not None:
        mark = mark.filter(learn_from(F.col("id")))
    mark = mark.groupBy("id").agg(F.max("label").alias("label"))
    known = mark.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    known = known.withColumn("order", F.xxhash64("id"))
    share = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # by hash, about per_class of each class; the limit makes it a bound
    span = float(1 << 62)
    part = F.lit(0.0)
    for k, n in share.items():
        part = F.when(F.col("label") == k, F.lit(min(1.0, 1.2 * per_class / n))).otherwise(part)
    drawn = known.filter(F.shiftrightunsigned("order", 2).cast("double") / span <= part)
    picks = [drawn.filter(F.col("label") == k).orderBy("order", "id").limit(per_class) for k in sorted(share)]
    if not picks:
        return np.zeros(FEATURES + 1)
    pick = picks[0]
    for p in picks[1:]:
        pick = pick.unionByName(p)
    pick = F.broadcast(pick.select("id", "label"))          # at most 2 * per_class rows
    # of several texts under one id the one of least hash; combined map-side, so a hot id sends one text a task
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(pick, "id")
             .groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")))
    found = (texts.select(F.col("id").cast("string").alias("id"), "label", F.col("t.text").alias("text"))
             .mapInArrow(sample_features, _SAMPLE).orderBy("id").collect())
    have = {k: sum(r.label == k for r in found) for k in share}
    whole = sum(share.values())
    rows = [(r.at, r.n, r.label, share[r.label] / whole * len(found) / have[r.label]) for r in found]
    return train(rows)


def score_quality(df: DataFrame, weights: np.ndarray, text_col: str = "text", carry: tuple = ("doc_id",),
                  score_col: str = "score") -> DataFrame:
    """Return the ``carry`` columns and ``score_col``, one row per input row; no shuffle.

    Null or empty text has no features and scores the constant alone. Repeated
    rows are scored each, equal texts alike; texts of any length are read whole;
    an empty table gives no rows; a carried column may have any name but
    ``score_col``.
    """
    held = df.sparkSession.sparkContext.broadcast(weights)
    x = text_and(df, text_col, carry)
    schema = x.drop("t").schema.add("score", "double")

    def run(batches):
        w = held.value
        for batch in batches:
            score = [s for words in batch_words(batch.column(0)) for s in score_rows(words, w)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], schema.names)
    return x.mapInArrow(run, schema).toDF(*carry, score_col)
