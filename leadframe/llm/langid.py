"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text, in which every
character that is not a letter counts as a space, hash into ``FEATURES`` slots;
n-grams without a letter don't count. A document is its TF-IDF vector of length
one. Weights are learnt by follow-the-regularised-leader with elastic-net
penalties, and a temperature is fitted on rows held back from the learning, so
the score is a calibrated probability.

Document frequencies, the languages and their shares cover all rows that may be
learnt from; the fit takes at most ``PER_LANGUAGE`` distinct rows of each
language, by hash order, so no language is lost however rare it is. Of many
languages (a dirty column) each gives fewer, ``SAMPLE`` in all, but ``LEAST``. The sample's
shares differ from the true ones; the logarithm of their ratio is added to the
scores. (Weights on the examples, as in ``quality``, would say the same, but at a
share of one in ten thousand so little is learnt from them that the language is
never predicted.) Scoring streams whole texts; what is broadcast (weights,
frequencies) grows with the number of languages only, 128 KB each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadframe.llm.bpe import LETTER, STMD, class_table
from leadframe.llm.common import Scratch, text_and
from leadframe.llm.ftrl import Ftrl, fit_temperature, softmax
from leadframe.llm.textscan import blocks, text_bytes

FEATURES = 1 << 14
PER_LANGUAGE = 1000
SAMPLE = 32_000         # rows of all languages, if that leaves LEAST of each
LEAST = 10
CALIBRATION = 5         # every fifth row of a language's sample fits the temperature
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray         # FEATURES
    weights: np.ndarray     # FEATURES x languages
    temperature: float
    prior: np.ndarray       # log(true share / share of the sample) of each language

    def probabilities(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return softmax(x @ self.weights[at] / self.temperature + self.prior)


def row_counts(column):
    """For each row the counts of its n-grams (an array of FEATURES)."""
    data, off = text_bytes(column)
    letters = class_table()
    for i, j in blocks(off):
        raw, cut = data[off[i]:off[j]], off[i:j + 1] - off[i]
        rows = [raw[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(cut[:-1], cut[1:])]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        cut = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        kind = letters[points]
        is_letter = (kind == LETTER) | (kind >= STMD)
        x = np.where(is_letter, points, 32).astype(np.uint32)
        n = len(x)
        feature = np.full((3, n), FEATURES, np.int64)       # FEATURES: does not count
        h, any_letter = np.zeros(n, np.uint32), np.zeros(n, bool)
        for k in range(3):
            m = max(0, n - k)
            h[:m] = (h[:m] ^ x[k:]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
            any_letter[:m] |= is_letter[k:]
            spread = (h[:m] ^ (h[:m] >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            feature[k, :m] = np.where(any_letter[:m], spread >> np.uint32(32 - 14), FEATURES)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            counts = np.bincount(feature[0, a:b], minlength=FEATURES + 1)
            for k in (1, 2):                                # n-grams stay inside the row
                counts += np.bincount(feature[k, a:max(a, b - k)], minlength=FEATURES + 1)
            yield counts[:FEATURES]


def _vector(counts: np.ndarray, idf: np.ndarray):
    at = np.flatnonzero(counts)
    x = counts[at] * idf[at]
    return at, x / max(1e-12, float(np.sqrt(x @ x)))


def _frequencies(batches):
    """Document frequency of each feature over a task's rows."""
    seen, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for counts in row_counts(batch.column(0)):
            seen += counts > 0
            rows += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, FEATURES), pa.int32()),
                                      pa.array(np.append(seen[at], rows), pa.int64())], ["feature", "n"])


def _sparse(batches):
    for batch in batches:
        at, n = [], []
        for counts in row_counts(batch.column(2)):
            f = np.flatnonzero(counts)
            at.append(f.astype(np.int32).tobytes())
            n.append(counts[f].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()),
                                          pa.array(n, pa.binary())], ["lang", "row", "at", "n"])


def _sample(known: DataFrame, per_language: int, sample: int = SAMPLE):
    """(lang, text) -> rows (lang, row, at, n) by language, and each language's number of rows.

    At most ``per_language`` distinct rows of each language, and of all at most
    ``sample`` or LEAST of each; equal rows count once in the sample and each in
    the number.
    """
    rows = Scratch(known.sparkSession, "langid").put(
        known.groupBy("lang", "row").agg(F.count("*").alias("n")), "rows")         # hashes, no text
    seen = rows.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect()     # one row a language
    if not seen:
        return [], {}
    per_language = min(per_language, max(LEAST, sample // len(seen)))
    # by hash, about per_language of each language; the row number makes it a bound
    parts = F.broadcast(known.sparkSession.createDataFrame(
        [(r.lang, min(1.0, max(1.2 * per_language, per_language + 40) / r.d)) for r in seen], "lang string, part double"))
    drawn = rows.join(parts, "lang").filter(F.shiftrightunsigned("row", 2).cast("double") / float(1 << 62) <= F.col("part"))
    pick = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("row"))).filter(F.col("k") <= per_language)
    pick = F.broadcast(pick.select("lang", "row"))          # at most per_language rows of each language
    found = (known.join(pick, ["lang", "row"]).select("lang", "row", "text")
             .mapInArrow(_sparse, "lang string, row long, at binary, n binary").dropDuplicates(["lang", "row"])
             .orderBy("lang", "row").collect())
    return found, {r.lang: r.n for r in seen}


def learn_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Fit on the rows of ``df`` that have a language; none: a model that only says ``und``.

    Every language of these rows is learnt, from at most ``per_language`` rows;
    beyond ``sample / per_language`` languages from ``sample / languages``, LEAST
    at least. Repeated rows count once in the sample.
    """
    known = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                      F.xxhash64(id_col, text_col).alias("row"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # at most FEATURES + 1 rows reach the driver
    seen = known.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    seen = {r.feature: r.n for r in seen.collect()}
    total = seen.pop(FEATURES, 0)
    idf = np.full(FEATURES, np.log(1.0 + total))
    for f, n in seen.items():
        idf[f] = np.log((1.0 + total) / (1.0 + n)) + 1.0
    rows, share = _sample(known, per_language, sample)
    return fit(rows, share, idf)


def fit(rows, share: dict, idf: np.ndarray) -> Model:
    """rows: (lang, row, at, n) by language; share: number of rows of each language in the whole table."""
    languages = sorted(share)
    if not languages:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0, np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}
    have = np.zeros(len(languages))
    learn, held = [], []
    for r in rows:
        y = number[r.lang]
        have[y] += 1        # a language with fewer than CALIBRATION rows is learnt from all of them
        (held if have[y] % CALIBRATION == 0 else learn).append((r.at, r.n, y))

    def example(r):
        counts = np.zeros(FEATURES)
        counts[np.frombuffer(r[0], np.int32)] = np.frombuffer(r[1], np.int32)
        return _vector(counts, idf)
    model = Ftrl(FEATURES, len(languages), ALPHA, BETA, L1, L2)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(learn)):
            model.learn(*example(learn[i]), learn[i][2])
    w = model.weights()
    scores = np.zeros((len(held), len(languages)))
    for i, r in enumerate(held):
        at, x = example(r)
        scores[i] = x @ w[at]
    true = np.array([share[x] for x in languages], float)
    prior = np.log(true / true.sum()) - np.log(have / have.sum())
    return Model(languages, idf, w, fit_temperature(scores, np.array([r[2] for r in held], int)), prior)


def predict_languages(df: DataFrame, model: Model, text_col: str = "text", carry: tuple = ("doc_id",)) -> DataFrame:
    """Return the ``carry`` columns, lang_pred and score (calibrated probability), one row per input row.

    ``und`` with score 0 where the text is null or has no letter. Of languages
    that tie the first by name wins; repeated rows are predicted each, equal
    texts alike; an empty table gives no rows; a carried column may have any
    name but ``lang_pred`` and ``score``. No shuffle.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    x = text_and(df, text_col, carry)
    schema = x.drop("t").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        m = held.value
        for batch in batches:
            lang, score = [], []
            for counts in row_counts(batch.column(0)):
                at, v = _vector(counts, m.idf)
                if len(at) == 0 or not m.languages:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                else:
                    p = m.probabilities(at, v)
                    k = int(p.argmax())
                    lang.append(m.languages[k])
                    score.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()),
                                              pa.array(score, pa.float64())], schema.names)
    return x.mapInArrow(run, schema).toDF(*carry, "lang_pred", "score")
