"""SpotSigs document fingerprints.

A spot signature is a common word (the anchor) with the chain of the next
content words; common words inside the chain are skipped. The start of the text
counts as an anchor too, so a text without common words still has a signature.
The fingerprint is the set of a text's signatures. Common words and chains run
through prose but hardly through mark-up, so fingerprints of pages that share
their prose agree.

Two kinds of anchors. ``ANCHORS`` is a fixed list in four languages. With
``corpus_anchors`` (the registered query) nothing depends on a language: the
common words are those of most documents, over the whole corpus, and one rule
adds hash-selected words to every text: of each run of CHAIN + 1 content words
the one with the least hash is an anchor too, and stays a content word. So
every content word of every text is in a signature, whatever the language; a
text of common words only counts them all as content.

Likeness is the Jaccard similarity of two fingerprints. ``min(m, n) / max(m, n)``
of the set sizes bounds it, which prunes a comparison against a threshold
before any signature is read, and lets ``near_components`` partition documents
by set size: with borders a factor 1/threshold apart, a document can only match
its own partition and the next smaller one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.jaccard import set_components
from leadframe.llm.textscan import batch_words, mix, scan_words, word_hashes

# Common words, in four languages.
ANCHORS = """
the of and to in is it that for was on are as with by this an be or at from
le la les de des du un une et en que qui dans pour par sur est au il elle pas
der die das und ist nicht von zu mit den dem ein eine im auf als auch sich
el los las que y en del se por con no una su para es al lo como
""".split()

CHAIN = 2       # content words after an anchor
CELLS = 1 << 17             # cells of the document frequencies: the size of what reaches the driver
MOST_COMMON = 256           # cells of common words at most
COMMON_SHARE = 0.4          # and of all word occurrences at most this share is in them


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(47)).astype(np.int64)            # 17 bits


def _frequencies(batches):
    """Documents and occurrences of each cell over a task's rows."""
    docs, all_words = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
    for batch in batches:
        for words in batch_words(batch.column(0), letters_only=True):
            cell, off = _cell(words.hash), words.word_off
            all_words += np.bincount(cell, minlength=CELLS)
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            docs += np.bincount(np.unique(row * CELLS + cell) % CELLS, minlength=CELLS)
    at = np.flatnonzero(docs)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(docs[at], pa.int64()),
                                      pa.array(all_words[at], pa.int64())], ["cell", "docs", "n"])


def corpus_anchors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The common words of all texts, as a table of CELLS flags over the words' hashes.

    The cells with the most documents, as long as they are at most MOST_COMMON
    and hold at most COMMON_SHARE of all word occurrences.
    """
    seen = df.select(F.col(text_col)).mapInArrow(_frequencies, "cell int, docs long, n long")
    # at most CELLS rows reach the driver
    seen = seen.groupBy("cell").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).toArrow()
    cell, docs, n = (c.to_numpy() for c in seen.columns)
    order = np.lexsort((cell, -docs))
    order = order[np.cumsum(n[order]) <= COMMON_SHARE * n.sum()][:MOST_COMMON]
    flags = np.zeros(CELLS, bool)
    flags[cell[order]] = True
    return flags


def _selected(v: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """Positions with the least value of ``width`` neighbours in a row; a shorter row is one run."""
    n, i = len(v), np.arange(len(v))
    start, end = (np.repeat(x, np.diff(off)) for x in (off[:-1], off[1:]))
    best, at = v.copy(), i.copy()
    for j in range(1, width):
        other = np.minimum(i + j, n - 1)
        less = (i + j < end) & (v[other] < best)
        best, at = np.where(less, v[other], best), np.where(less, other, at)
    return np.unique(at[(i + width <= end) | (i == start)])


def _spots(words, anchors: np.ndarray, chain: int):
    """Sorted distinct 32-bit signatures of each row.

    ``anchors``: hashes of common words, or the flags of ``corpus_anchors``.
    """
    h, off = words.hash, words.word_off
    m = len(h)
    whole = anchors.dtype == bool
    common = anchors[_cell(h)] if whole else np.isin(h, anchors)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    if whole:
        common &= np.bincount(doc[~common], minlength=len(off) - 1)[doc] > 0
    content = np.flatnonzero(~common)
    follow = np.searchsorted(content, np.arange(m + 1))     # number of content words before a word
    ends = follow[off[1:]]                                  # content words before each row's end
    at = np.flatnonzero(common)
    starts = np.flatnonzero(np.diff(off) > 0)               # rows with words: the text's start is an anchor
    anchor = np.concatenate([h[at], np.full(len(starts), 1, np.uint64)])
    row = np.concatenate([doc[at], starts])
    first = np.concatenate([follow[at], follow[off[starts]]])
    got = np.zeros(len(row), np.int64)
    if whole:
        picked = _selected(mix(h[content]), follow[off], chain + 1)
        anchor = np.concatenate([anchor, h[content[picked]]])
        row = np.concatenate([row, doc[content[picked]]])
        first = np.concatenate([first, picked + 1])
        got = np.concatenate([got, np.ones(len(picked), np.int64)])        # a signature even as the last word
    sig = mix(anchor)
    padded = np.append(content, [0] * chain)
    for i in range(chain):
        there = first + i < ends[row]
        word = np.where(there, np.append(h, np.uint64(0))[padded[first + i]], np.uint64(0))
        sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + word)
        got += there
    keep = got > 0
    row, sig = row[keep], (sig[keep] >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((sig, row))
    row, sig = row[order], sig[order]
    cut = np.searchsorted(row, np.arange(len(off)))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield np.unique(sig[a:b])


def pack(spots: np.ndarray) -> str:
    """Fingerprint as text: base64 of the sorted little-endian signatures."""
    return base64.b64encode(spots.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(x: np.ndarray, y: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 below the threshold. Two empty sets are equal."""
    small, large = sorted((x, y), key=len)
    if len(large) == 0:
        return 1.0
    if len(small) < threshold * len(large) or len(small) == 0:      # pruned by size
        return 0.0
    i = np.searchsorted(large, small)
    i[i == len(large)] = 0
    both = int((large[i] == small).sum())
    out = both / (len(x) + len(y) - both)
    return out if out >= threshold else 0.0


def text_spots(texts: list[str], chain: int = CHAIN, anchors: np.ndarray | None = None) -> list[np.ndarray]:
    """Signatures of a few texts."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    words = scan_words(np.frombuffer(b"".join(raw), np.uint8), off, letters_only=True)
    return list(_spots(words, _anchors() if anchors is None else anchors, chain))


def _anchors() -> np.ndarray:
    return np.unique(word_hashes(ANCHORS))


def _shared(df: DataFrame, anchors: np.ndarray | None):
    """The anchors (none given: the fixed list), broadcast: at most CELLS flags."""
    return df.sparkSession.sparkContext.broadcast(_anchors() if anchors is None else anchors)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN,
                 anchors: np.ndarray | None = None) -> DataFrame:
    """Return per row: ``id_col``, n_spots, fingerprint. No shuffle.

    Null or empty text, or text without words, has the empty fingerprint;
    equal texts have equal ones; repeated rows stay; other columns aren't read.
    """
    x = df.select(F.col(id_col), F.col(text_col))
    schema = x.select(id_col).schema.add("n_spots", "integer").add("fingerprint", "string")
    held = _shared(df, anchors)

    def run(batches):
        anchors = held.value
        for batch in batches:
            sets = [s for words in batch_words(batch.column(1), letters_only=True) for s in _spots(words, anchors, chain)]
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()),
                                                  pa.array([pack(s) for s in sets])], schema.names)
    return x.mapInArrow(run, schema)


def _spot_sets(chain, held, column):
    for words in batch_words(column, letters_only=True):
        yield words.first, (np.sort(mix(s.astype(np.uint64))) for s in _spots(words, held.value, chain))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                    chain: int = CHAIN, anchors: np.ndarray | None = None) -> DataFrame:
    """Near duplicates by fingerprint: ``id_col``, n_spots, component_id (the smallest id reachable).

    Documents link when the likeness of their fingerprints is at least
    ``percent``. Signature lists are partitioned by set size (a class and the
    next smaller one, a factor 100 / percent apart); in them, pairs pass the
    exact pruning of the set join in ``jaccard`` before their sets meet, and a
    group of copies never gives all its pairs. Documents without words link
    with nothing; ids and rows as in ``jaccard_components``.
    """
    out = set_components(df, partial(_spot_sets, chain, _shared(df, anchors)), percent, id_col, text_col, size_classes=True)
    return out.withColumnRenamed("n", "n_spots")


_EDITED = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN,
                      anchors: np.ndarray | None = None) -> DataFrame:
    """Fingerprint each text and its edited text, and compare: columns as op4's contract.

    The next document is the one with the next id (rows of one id in text
    order; after the last, the first). Documents are dealt by ranges of ids, so
    texts cross the network once, and a task streams its range in order. The
    first document of a range also goes to the end of the range before; these
    are as many rows as there are ranges. Ranges come from quantiles of the
    ids, as Spark's own range partitioning does. Null text counts as empty, a
    null id comes first, an empty table gives no rows, one row follows itself.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted(set(docs.select(F.col("id").cast("double").alias("x")).approxQuantile(
        "x", [i / n for i in range(1, n)], 1 / (4 * n))))
    # (range, first id of the range); at most n rows reach the driver
    place = _place(borders)
    firsts = sorted(((r.p, r.lo, r.nulls) for r in docs.select("id", place.alias("p")).groupBy("p").agg(
        F.min("id").alias("lo"), F.max(F.col("id").isNull()).alias("nulls")).collect()))
    if not firsts:
        return spark.createDataFrame([], _EDITED.replace("id long", f"{id_col} long", 1))
    heads = [(p, None if nulls else lo) for p, lo, nulls in firsts]
    before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}      # the last range is before the first
    own = docs.select(place.alias("p"), F.lit(0).alias("k"), "id", "text")
    ask = spark.createDataFrame([(p, lo, before[p]) for p, lo in heads], "hp int, hid long, hb int")
    extra = (docs.select("id", "text").join(F.broadcast(ask), F.col("id").eqNullSafe(F.col("hid")))      # at most n rows
             .groupBy("hb", "id").agg(F.min("text").alias("text"))
             .select(F.col("hb").alias("p"), F.lit(1).alias("k"), "id", "text"))
    rows = (own.unionByName(extra).repartition(max(1, n // 4), "p").sortWithinPartitions("p", "k", "id", "text")
            .select("p", "k", "id", "text"))

    shared = _shared(df, anchors)

    def run(batches):
        anchors = shared.value
        held = None         # the last document, whose next one is still to come
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                p, k, ids, texts = (c.to_pylist() for c in part.columns)
                if held is not None:
                    p, k, ids, texts = [held[0]] + p, [held[1]] + k, [held[2]] + ids, [held[3]] + texts
                pairs = [(i, i + 1) for i in range(len(p) - 1) if k[i] == 0 and p[i] == p[i + 1]]
                held = (p[-1], k[-1], ids[-1], texts[-1])
                if pairs:
                    yield _compare([ids[i] for i, _ in pairs], [texts[i] for i, _ in pairs],
                                   [texts[j] for _, j in pairs], anchors, chain)
    out = rows.mapInArrow(run, _EDITED)
    return out.withColumnRenamed("id", id_col)


def _place(borders: list[float]):
    """Range number of ``id``, the borders below it; null is in the first range. A search by halves as one
    expression, so the texts beside the id don't wait in a Python task's queue."""
    x = F.coalesce(F.col("id").cast("double"), F.lit(float("-inf")))

    def within(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > borders[mid], within(mid + 1, hi)).otherwise(within(lo, mid))
    return within(0, len(borders))


def _compare(ids, texts, following, anchors, chain):
    edited = [edited_text(t, f) for t, f in zip(texts, following)]
    raw = [t.encode("utf-8", "replace") for t in edited]
    spots = _batch_spots(texts + following[-1:], anchors, chain)        # rows follow each other, but for range ends
    after = [spots[i + 1] if texts[i + 1] is following[i] else None for i in range(len(texts) - 1)] + [spots[-1]]
    for i, s in enumerate(after):
        if s is None:
            after[i] = _batch_spots([following[i]], anchors, chain)[0]
    changed = _batch_spots(edited, anchors, chain)
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
        pa.array([pack(s) for s in spots[:-1]]), pa.array([pack(s) for s in changed]),
        pa.array([likeness(a, b) for a, b in zip(spots, changed)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(spots, after)], pa.float64())], _EDITED_NAMES)


_EDITED_NAMES = [c.split()[0] for c in _EDITED.split(", ")]


def _batch_spots(texts, anchors, chain):
    return [s for words in batch_words(pa.array(texts, pa.large_string()), letters_only=True)
            for s in _spots(words, anchors, chain)]
