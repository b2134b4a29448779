"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

``write_blocks`` lays the candidates out along a Hilbert curve over the dimensions
that vary most and writes them as Parquet: one folder per range of the curve, one
row per block of at most ``BLOCK_ROWS`` vectors, with each dimension's least and
greatest value and the labels in it beside the packed vectors.

``mine`` takes the anchors in batches of a fixed number of components, in the
order of the curve. Of a block's zone map, interval arithmetic gives bounds of an
anchor's inner products with all its vectors; a block is read if they meet one of
the anchor's windows. A first look at the batch's own stretch of the curve raises
the windows' lower ends to the k-th best score there, so that the look at all
blocks reads and returns less. The bounds only skip blocks that can't hold a
result: results equal brute force over all rows. Vectors without structure (all
directions alike) give wide zones, and then every block is read.

Memory: a task holds one batch of anchors (``BATCH_CELLS`` components) and one
block; the driver holds one batch and its positives. Queries against all rows are
quadratic by nature; no row stands for a pair of an anchor and a vector, only the
best k of a window per task leave it.

Rows that take no part: a null id, label or vector, or any null or non-finite
component. Shorter vectors count as padded with zeros. Components are floored
multiples of 1/256 and held within +-2**26 (|x| up to 262,144), so scores fit a
long up to 2,048 dimensions. Repeated rows and ids are rows of their own: each is
an anchor, a positive of the other, a candidate. Ties in score go by id. An empty
table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch

SCALE = 256
CLIP = 1 << 26
CURVE_DIMS, CURVE_BITS = 12, 5      # 60 bits: the curve's place fits a long
BLOCK_ROWS = 1024
PART_BYTES = 16 << 20               # packed vectors of one folder, about
BATCH_CELLS = 1 << 21               # components of the anchors held at once (16 MB as doubles)
CHUNK = 256                         # anchors scored against a block at once
LEAST = -(1 << 62)

_BLOCK = ("part int, block int, low array<int>, high array<int>, labels_in array<long>, "
          "ids binary, labels binary, anchors binary, vectors binary")
_HIT = "slot long, anchor_id long, positive_id long, positive_score long, score long, id long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (integers below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):        # undo the turns of each level
        q, p = 1 << b, (1 << b) - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            t = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, t)
            x[i] ^= t
    for i in range(1, dims):                # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= t
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of ints as rows of ``dims`` components, padded with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), dims), np.int32)
    out[np.arange(dims) < n[:, None]] = flat
    return out


def quantised(df: DataFrame, id_col: str, vector_col: str, label_col: str, anchor: Column) -> DataFrame:
    """Rows that take part: id, label, anchor, v (floored multiples of 1/256)."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(vector_col, lambda x: F.floor(
        F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(CLIP))), F.lit(-float(CLIP)))).cast("int"))
    return (df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                    F.coalesce(anchor, F.lit(False)).alias("anchor"), v.alias("v")))


def _moments(batches):
    """Per task and dimension: rows, sum and sum of squares."""
    n, s, ss = 0, np.zeros(0), np.zeros(0)
    for b in batches:
        col = b.column(0)
        d = int(np.diff(col.offsets.to_numpy()).max(initial=0))
        if d > len(s):
            s, ss = np.pad(s, (0, d - len(s))), np.pad(ss, (0, d - len(ss)))
        x = _matrix(col, len(s)).astype(float)
        n, s, ss = n + len(x), s + x.sum(0), ss + (x * x).sum(0)
    dim = [-1, *range(len(s))]          # dim -1: the rows
    yield pa.RecordBatch.from_pydict({"dim": pa.array(dim, pa.int32()), "s": pa.array([float(n), *s]),
                                      "ss": pa.array([0.0, *ss])})


def _pack(dims):
    """Sorted rows of one range of the curve -> its blocks, with zone maps."""
    def run(batches):
        from pyspark import TaskContext
        part, block, rest = TaskContext.get().partitionId(), 0, []

        def packed(t):
            nonlocal block
            v = _matrix(t.column("v").combine_chunks(), dims)
            label = t.column("label").to_numpy()
            low, high = v.min(0), v.max(0)
            if len(v) and low.min(initial=0) >= -(1 << 15) and high.max(initial=0) < 1 << 15:
                v = v.astype(np.int16)
            row = {"part": part, "block": block, "low": low, "high": high, "labels_in": np.unique(label),
                   "ids": t.column("id").to_numpy().tobytes(), "labels": label.tobytes(),
                   "anchors": np.packbits(t.column("anchor").to_numpy(zero_copy_only=False).astype(bool)).tobytes(),
                   "vectors": v.tobytes()}
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("low", pa.list_(pa.int32())),
                            ("high", pa.list_(pa.int32())), ("labels_in", pa.list_(pa.int64())), ("ids", pa.binary()),
                            ("labels", pa.binary()), ("anchors", pa.binary()), ("vectors", pa.binary())])
        for b in batches:
            rest.append(b)
            if sum(len(x) for x in rest) >= BLOCK_ROWS:
                t = pa.Table.from_batches(rest)
                n = len(t) - len(t) % BLOCK_ROWS
                for at in range(0, n, BLOCK_ROWS):
                    yield packed(t.slice(at, BLOCK_ROWS))
                rest = t.slice(n).to_batches()
        if sum(len(x) for x in rest):
            yield packed(pa.Table.from_batches(rest))
    return run


@dataclass
class Blocks:
    table: DataFrame | None     # None: no rows
    dims: int


def write_blocks(rows: DataFrame, scratch: Scratch) -> Blocks:
    """``quantised`` rows in blocks along the curve (see ``_BLOCK``), in folders by ``part``."""
    spark = rows.sparkSession
    sums = {r.dim: (r.s, r.ss) for r in rows.select("v").mapInArrow(_moments, "dim int, s double, ss double")
            .groupBy("dim").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()}      # a row per dimension
    n = int(sums.pop(-1, (0, 0))[0])
    if n == 0:
        return Blocks(None, 0)
    dims = len(sums)
    mean = np.array([sums[i][0] / n for i in range(dims)])
    spread = np.sqrt(np.maximum(np.array([sums[i][1] / n for i in range(dims)]) - mean * mean, 0)) if dims else mean
    used = np.argsort(-spread, kind="stable")[:CURVE_DIMS]
    mid, width = mean[used], np.maximum(spread[used], 1e-9)

    def place(batches):
        for b in batches:
            x = _matrix(b.column("v"), dims)[:, used]
            cells = np.clip(((x - mid) / width + 2) / 4 * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
            h = hilbert(cells.astype(np.int64), CURVE_BITS) if dims else np.zeros(len(b), np.int64)
            yield b.append_column("h", pa.array(h))
    slots = spark.sparkContext.defaultParallelism
    parts = max(1, min(-(-n // BLOCK_ROWS), max(slots, n * max(dims, 1) * 4 // PART_BYTES)))
    # the random key deals a vector that many rows share over several ranges
    ranged = (rows.mapInArrow(place, "id long, label long, anchor boolean, v array<int>, h long").withColumn("salt", F.rand(11))
              .repartitionByRange(parts, "h", "salt").sortWithinPartitions("h", "id").drop("salt", "h"))
    path = f"{scratch.root}/blocks"
    ranged.mapInArrow(_pack(dims), _BLOCK).write.partitionBy("part").parquet(path)
    # the partition column comes last when read back
    first, rest = _BLOCK.split(", ", 1)
    return Blocks(spark.read.schema(f"{rest}, {first}").parquet(path), dims)


@dataclass
class Batch:
    """Anchors held at once: vectors, ids, labels, home (part, block, row in it); windows and positives once known."""
    v: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    home: np.ndarray
    low: np.ndarray | None = None           # (anchors, windows)
    high: np.ndarray | None = None
    pos_id: np.ndarray | None = None
    pos_score: np.ndarray | None = None


def _vectors(row, dims):
    n = len(row["ids"]) // 8
    wide = len(row["vectors"]) == n * dims * 4
    return np.frombuffer(row["vectors"], np.int32 if wide else np.int16).reshape(n, dims)


def _anchor_rows(dims):
    """Blocks -> one row per block with its anchors."""
    def run(batches):
        for b in batches:
            out = {"part": [], "n": [], "ids": [], "labels": [], "vectors": [], "home": []}
            for row in b.to_pylist():
                n = len(row["ids"]) // 8
                at = np.flatnonzero(np.unpackbits(np.frombuffer(row["anchors"], np.uint8), count=n))
                if len(at) == 0:
                    continue
                out["part"].append(row["part"])
                out["n"].append(len(at))
                out["ids"].append(np.frombuffer(row["ids"], np.int64)[at].tobytes())
                out["labels"].append(np.frombuffer(row["labels"], np.int64)[at].tobytes())
                out["vectors"].append(_vectors(row, dims)[at].astype(np.int32).tobytes())
                out["home"].append(np.stack([np.full(len(at), row["part"]), np.full(len(at), row["block"]), at], 1)
                                   .astype(np.int64).tobytes())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, {"part": pa.int32(), "n": pa.int32()}.get(k, pa.binary()))
                                              for k, v in out.items()})
    return run


def _needed(batch: Batch, low, high, labels_in, same: bool) -> np.ndarray:
    """(anchors, blocks): the block's bounds meet a window of the anchor, and it has a label of the kind asked for."""
    up, down = np.maximum(batch.v, 0), np.minimum(batch.v, 0)
    most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    need = np.zeros(most.shape, bool)
    for w in range(batch.low.shape[1]):
        need |= (most >= batch.low[:, w, None]) & (least <= batch.high[:, w, None])
    need &= (batch.low <= batch.high).any(1)[:, None]
    for j, labels in enumerate(labels_in):
        need[:, j] &= np.isin(batch.labels, labels) if same else (len(labels) > 1) | ~np.isin(batch.labels, labels)
    return need


def _first_k(slot, score, ids, k):
    """The first k of each slot, higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, slot))
    slot, score, ids = slot[order], score[order], ids[order]
    new = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
    rank = np.arange(len(slot)) - np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))
    return slot[rank < k], score[rank < k], ids[rank < k]


class _Best:
    """The best k of each window seen by one task; a full window's lower end rises to its k-th best score."""

    def __init__(self, batch: Batch, k: int):
        self.k, self.low, self.windows = k, batch.low.copy(), batch.low.shape[1]
        self.found = [np.zeros(0, np.int64)] * 3
        self.new: list = []
        self.n_new = 0

    def add(self, *hits):
        self.new.append(hits)
        self.n_new += len(hits[0])
        if self.n_new > 100_000:
            self.settle()

    def settle(self):
        cols = [np.concatenate(c) for c in zip(self.found, *self.new)]
        self.found, self.new, self.n_new = list(_first_k(*cols, self.k)), [], 0
        slot, score, _ = self.found
        full = np.flatnonzero(np.bincount(slot, minlength=self.low.size)[slot] == self.k)
        worst = np.full(self.low.size, LEAST)
        if len(full):
            at = full[np.r_[slot[full][1:] != slot[full][:-1], True]]      # the last of each full slot
            worst[slot[at]] = score[at]
        self.low = np.maximum(self.low, worst.reshape(self.low.shape))


def _search_block(batch: Batch, chosen, row, dims, same, best: _Best):
    v, ids, labels = _vectors(row, dims), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    exact = int(np.abs(batch.v).max(initial=0)) * int(np.abs(v.astype(np.int64)).max(initial=0)) * max(dims, 1) < 1 << 53
    kind = np.float64 if exact else np.int64        # doubles hold these sums exactly
    vt = v.astype(kind).T
    for at in range(0, len(chosen), CHUNK):
        c = chosen[at:at + CHUNK]
        score = (batch.v[c].astype(kind) @ vt).astype(np.int64)
        ok = (labels[None, :] == batch.labels[c][:, None]) == same
        own = np.flatnonzero((batch.home[c, 0] == row["part"]) & (batch.home[c, 1] == row["block"]))
        ok[own, batch.home[c[own], 2]] = False
        for w in range(best.windows):
            hit = ok & (score >= best.low[c, w, None]) & (score <= batch.high[c, w, None])
            if hit.sum() > 4 * best.k * len(c) and len(ids) > best.k:       # only a row's k best scores and their ties
                kth = np.partition(np.where(hit, score, LEAST), len(ids) - best.k, axis=1)[:, len(ids) - best.k]
                hit &= score >= kth[:, None]
            r, j = np.nonzero(hit)
            if len(r):
                best.add(*_first_k(c[r] * best.windows + w, score[r, j], ids[j], best.k))


def _zones(shared, dims, same):
    """Zone maps -> the blocks that some window must read."""
    def run(batches):
        batch = shared.value
        for b in batches:
            rows = b.to_pylist()
            low = np.array([r["low"] for r in rows], np.int64).reshape(len(rows), dims)
            high = np.array([r["high"] for r in rows], np.int64).reshape(len(rows), dims)
            need = _needed(batch, low, high, [r["labels_in"] for r in rows], same).any(0)
            yield pa.RecordBatch.from_pydict({"part": pa.array([r["part"] for r, x in zip(rows, need) if x], pa.int32())})
    return run


def _search(shared, dims, k, same):
    """Blocks -> the best k of every window in them."""
    def run(batches):
        batch = shared.value
        best = _Best(batch, k)
        for b in batches:
            for row in b.to_pylist():
                low, high = np.array([row["low"]], np.int64), np.array([row["high"]], np.int64)
                seen = Batch(batch.v, batch.ids, batch.labels, batch.home, best.low, batch.high)
                chosen = np.flatnonzero(_needed(seen, low.reshape(1, dims), high.reshape(1, dims), [row["labels_in"]], same)[:, 0])
                _search_block(batch, chosen, row, dims, same, best)
                best.settle()
        slot, score, ids = best.found
        a, w = slot // best.windows, slot % best.windows
        none = np.zeros(len(slot), np.int64)
        yield pa.RecordBatch.from_pydict({
            "slot": slot, "anchor_id": batch.ids[a], "positive_id": none if batch.pos_id is None else batch.pos_id[a, w],
            "positive_score": none if batch.pos_id is None else batch.pos_score[a, w], "score": score, "id": ids})
    return run


def _best_of(blocks: Blocks, batch: Batch, k: int, same: bool, parts=None) -> DataFrame:
    """The best k rows of every window; over ``parts`` only, or over all parts that a zone map asks for."""
    spark = blocks.table.sparkSession
    shared = spark.sparkContext.broadcast(batch)
    if parts is None:
        zones = blocks.table.select("low", "high", "labels_in", "part").mapInArrow(_zones(shared, blocks.dims, same), "part int")
        parts = [r.part for r in zones.distinct().collect()]        # numbers of folders
    hits = blocks.table.filter(F.col("part").isin(parts)).mapInArrow(_search(shared, blocks.dims, k, same), _HIT)
    rank = F.row_number().over(W.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def _raise(batch: Batch, hits: DataFrame, k: int):
    """Lower ends to the k-th best score found."""
    low = batch.low.ravel().copy()
    for r in hits.filter(F.col("rank") == k).select("slot", "score").collect():     # a row per window at most
        low[r.slot] = max(low[r.slot], r.score)
    batch.low = low.reshape(batch.low.shape)


def _batches(anchors: DataFrame, dims: int):
    """Stretches of parts (first, last) with at most BATCH_CELLS components, or one part."""
    first = last = None
    held = 0
    for r in anchors.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():     # a row per folder
        if first is not None and (held + r.n) * max(dims, 1) > BATCH_CELLS:
            yield first, last
            first, held = None, 0
        first, last, held = r.part if first is None else first, r.part, held + r.n
    if first is not None:
        yield first, last


def mine(df: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50,
         high_percent: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row where ``anchor`` holds and each of its ``n_positives`` best rows
    of the same label: the first ``n_negatives`` rows of other labels whose score
    is between ``low_percent`` and ``high_percent`` of the positive's.
    """
    spark = df.sparkSession
    s = Scratch(spark, "negatives")
    blocks = write_blocks(quantised(df, id_col, vector_col, label_col, anchor), s)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if blocks.table is None:
        return spark.createDataFrame([], schema)
    dims = blocks.dims
    anchors = s.put(blocks.table.mapInArrow(
        _anchor_rows(dims), "part int, n int, ids binary, labels binary, vectors binary, home binary"), "anchors")
    found = f"{s.root}/found"
    n = 0
    for first, last in _batches(anchors, dims):
        rows = anchors.filter(F.col("part").between(first, last)).collect()         # one batch of anchors
        ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in rows])
        batch = Batch(np.concatenate([np.frombuffer(r.vectors, np.int32) for r in rows]).reshape(len(ids), dims).astype(np.int64),
                      ids, np.concatenate([np.frombuffer(r.labels, np.int64) for r in rows]),
                      np.concatenate([np.frombuffer(r.home, np.int64) for r in rows]).reshape(len(ids), 3))
        here = sorted({r.part for r in rows})
        batch.low, batch.high = np.full((len(ids), 1), LEAST), np.full((len(ids), 1), -LEAST)
        _raise(batch, _best_of(blocks, batch, n_positives, True, here), n_positives)
        batch.pos_id = np.zeros((len(ids), n_positives), np.int64)
        batch.pos_score = np.full((len(ids), n_positives), -1)
        positives = _best_of(blocks, batch, n_positives, True).select("slot", "rank", "score", "id").collect()
        for r in positives:                                                         # n_positives an anchor at most
            batch.pos_id[r.slot, r.rank - 1], batch.pos_score[r.slot, r.rank - 1] = r.id, r.score
        # low_percent * positive <= 100 * negative <= high_percent * positive; none for negative scores
        score = batch.pos_score
        batch.low = np.where(score >= 0, -(-low_percent * score // 100), 1)
        batch.high = np.where(score >= 0, high_percent * score // 100, 0)
        _raise(batch, _best_of(blocks, batch, n_negatives, False, here), n_negatives)
        (_best_of(blocks, batch, n_negatives, False)
         .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                 F.col("score").alias("negative_score")).write.parquet(f"{found}/batch={n}"))
        n += 1
    if n == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch int").parquet(found).drop("batch")
