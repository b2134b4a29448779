"""N-gram Jaccard join as a T-occurrence search (DivideSkip), without all pairs.

A document is the set of its distinct word shingles (64-bit hashes). Two
documents link when the Jaccard similarity of their sets reaches ``percent``.

For a document x with |x| shingles, a partner shares at least
T = ceil(t |x|) of them. DivideSkip splits the |x| inverted lists into short
and long ones: the T - 1 longest lists can't give a partner by themselves, so
only the |x| - T + 1 shortest are merged, and the long ones are probed by
binary search for the documents that the merge brought up.

1. Scan: one row per document (set size, set hash, parity signature) and
   occurrence counts in ``CELLS`` hash cells. The counts, a table of fixed
   size, give the global order of shingles, rare first; any order is correct,
   this one keeps common lines and passages out of the short lists.
2. Short lists: a second scan posts each document's |x| - T + 1 first shingles.
   Spark's sort by shingle is the merge; runs of one document end there.
   Lists longer than their share of a task are salted.
3. A list of g documents doesn't give g^2 pairs: its first document (the one
   with the fewest rarer shingles, the likely origin of a group of copies) is
   the hub and is paired with the others.
4. Candidates pass the size bound, the position bound and the parity bound (all
   exact), then their sets meet: the long lists are probed by binary search,
   and the required overlap decides.
5. Links join documents into components. A list whose documents are all in one
   component is done: more links can't change anything. In the others, each
   document outside the hub's component is paired with the list's documents of
   other components that pass the bounds, and these pairs are verified too. So
   every link between two components is found, and components are exact. The
   merge's own threshold prunes here: of the shared shingles at most
   max(T_x, T_y) - 1 lie outside the short lists, so the short lists must hold
   the rest; from the first shared list on, both documents must still be in as
   many lists of two and more.
"""

from __future__ import annotations

import math
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch, fresh, named
from leadframe.llm.components import components
from leadframe.llm.textscan import batch_words, mix, shingle_sets

SHINGLE = 5
PERCENT = 80
CELLS = 1 << 17             # cells of the occurrence counts: the size of what is broadcast
SIGNATURE_BITS = 1024
LIST_ROWS = 1024            # least number of occurrences for which a list is salted
BROADCAST_IDS = 200_000     # ids of 8 bytes: at most 1.6 MB


def _cell(tokens):
    return (tokens >> np.uint64(47)).astype(np.int64)       # 17 bits


def required(percent: int, m):
    """Least overlap of sets with sizes that sum to m: ceil(percent m / (100 + percent))."""
    return -(-percent * m // (100 + percent))


def _parity(tokens: np.ndarray) -> bytes:
    """Bit b is the parity of the number of tokens that fall on b.

    Sets that differ in d tokens differ in at most d bits.
    """
    bits = np.bincount((tokens & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64), minlength=SIGNATURE_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def shingles_of(k, column):
    """(first row, sets of shingles) of each block of a text column."""
    for words in batch_words(column):
        yield words.first, shingle_sets(words, k)


_SCAN = "id long, n int, s1 long, s2 long, sig binary, cell int, seen long"


def _scan(sets_of):
    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            ids = batch.column(0)
            n, s1, s2, sig = [], [], [], []
            for _, sets in sets_of(batch.column(1)):
                sets = list(sets)
                counts += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
                for x in sets:
                    n.append(len(x))
                    s1.append(int(np.add.reduce(x).view(np.int64)))
                    s2.append(int(np.add.reduce(mix(x ^ np.uint64(0xA5A5A5A5))).view(np.int64)))
                    sig.append(_parity(x))
            if n:
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                     pa.array(sig, pa.binary()), none.cast(pa.int32()), none.cast(pa.int64())], _names(_SCAN))
        full = np.flatnonzero(counts)
        none = pa.nulls(len(full))
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()),
             none.cast(pa.binary()), pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())], _names(_SCAN))
    return run


@cache
def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_POST = "token long, salt int, pos int, n int, id long"


def size_class(percent, n):
    """Class of a set size; sets that link are in one class or in neighbouring ones."""
    return math.floor(math.log(n) / math.log(100 / percent) + 1e-9)


def _post(sets_of, percent, size_classes, counts, list_rows):
    """Post each document's short lists; copies of a set within a task post once.

    With size classes a list holds one class and the next smaller one only.
    """
    def run(batches):
        seen_by_cell = counts.value
        posted = set()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, sets in sets_of(batch.column(1)):
                cols, who = [[], [], [], []], []
                for i, x in enumerate(sets, row):
                    n = len(x)
                    if n == 0 or ids[i] is None:
                        continue
                    same = (n, int(np.add.reduce(x)), int(np.add.reduce(mix(x ^ np.uint64(0xA5A5A5A5)))))
                    if same in posted:
                        continue
                    posted.add(same)
                    short = n - -(-percent * n // 100) + 1
                    seen = seen_by_cell[_cell(x)]
                    first = np.lexsort((x, seen))[:short]
                    # 0: the whole list is here; else one of the parts of a long list
                    salt = np.where(seen[first] >= list_rows,
                                    (np.int64(ids[i]) * 2654435761 >> 7) % (1 + seen[first] // list_rows) + 1, 0)
                    own = size_class(percent, n)
                    for c in (own, own + 1) if size_classes else (None,):
                        cols[0].append(x[first] if c is None else mix(x[first] + np.uint64(c)))
                        cols[1].append(salt)
                        cols[2].append(np.arange(short))
                        cols[3].append(np.full(short, n))
                        who.append((ids[i], short))
                if who:
                    token, salt, pos, n = (np.concatenate(c) for c in cols)
                    doc = np.repeat(np.array([w[0] for w in who], np.int64), [w[1] for w in who])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(pos.astype(np.int32)),
                         pa.array(n.astype(np.int32)), pa.array(doc)], _names(_POST))
    return run


_LIST = "token long, pos int, n int, id long, hub long, hub_n int, close boolean"


def _lists(percent):
    """Rows sorted by (token, salt, pos, n, id): keep runs of two and more, with the run's first row as hub."""
    def run(batches):
        held = None     # the last run's key and hub, whether its first row was already sent, and that row
        for batch in batches:
            if batch.num_rows == 0:
                continue
            token, salt, pos, n, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if held is not None:        # the run may go on: put its hub in front again
                t, s, hp, hn, hd, sent = held
                token, salt, pos, n, doc = (np.concatenate(([v], c)) for v, c in
                                            ((t, token), (s, salt), (hp, pos), (hn, n), (hd, doc)))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(token)))
            hub = np.repeat(first, length)
            keep = np.repeat((length > 1) | (salt[first] > 0), length)
            if held is not None and sent:
                keep[0] = False
            if keep.any():
                h = hub[keep]
                p, m, hp, hm = pos[keep].astype(np.int64), n[keep].astype(np.int64), pos[h].astype(np.int64), n[h].astype(np.int64)
                close = ((100 * np.minimum(m, hm) >= percent * np.maximum(m, hm)) & (doc[keep] != doc[h])
                         & (np.minimum(m - p, hm - hp) >= required(percent, m + hm)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)),
                     pa.array(doc[keep]), pa.array(doc[h]), pa.array(hm.astype(np.int32)), pa.array(close)], _names(_LIST))
            f = first[-1]
            held = (token[f], salt[f], pos[f], n[f], doc[f],
                    bool(keep[f]) or (f == 0 and held is not None and sent))
    return run


_SETS = "id long, tokens binary"


def _sets(sets_of):
    def run(batches):
        for batch in batches:
            sets = [x.tobytes() for _, block in sets_of(batch.column(1)) for x in block]
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], _names(_SETS))
    return run


def overlap_reaches(x: np.ndarray, y: np.ndarray, need: int, step: int = 64) -> bool:
    """Whether sorted sets share ``need`` tokens: binary probes of x's tokens in y, given up once out of reach."""
    if len(x) > len(y):
        x, y = y, x
    got, at = 0, 0
    while at < len(x):
        if got + len(x) - at < need:
            return False
        part = x[at:at + step]
        i = np.searchsorted(y, part)
        i[i == len(y)] = 0
        got += int((y[i] == part).sum())
        at += step
        step *= 4
    return got >= need


_LINK = "a long, b long"


def _verify(percent):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(overlap_reaches(x, y, required(percent, len(x) + len(y))))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], _names(_LINK))
    return run


def _near(percent, n, m, p=None, q=None):
    """Size bound, and with positions the position bound, as a Column."""
    size = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    if p is None:
        return size
    return size & ((100 + percent) * F.least(n - p, m - q) >= percent * (n + m))


_MEMBER = ("pos", "n", "id", "comp", "left")


class _Join:
    def __init__(self, docs: DataFrame, sets_of, percent: int, size_classes: bool = False):
        self.docs, self.sets_of, self.percent, self.size_classes = docs, sets_of, percent, size_classes
        self.spark = docs.sparkSession
        self.s = Scratch(self.spark, "jaccard")

    def scan(self):
        both = self.s.put(self.docs.mapInArrow(_scan(self.sets_of), _SCAN), "scan")
        self.rows = both.filter("cell IS NULL").select("id", "n", "s1", "s2", "sig")
        # at most CELLS rows reach the driver
        seen = both.filter("cell IS NOT NULL").groupBy("cell").agg(F.sum("seen").alias("seen")).toArrow()
        counts = np.zeros(CELLS, np.int64)
        counts[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
        return counts

    def lists(self, counts):
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        list_rows = max(LIST_ROWS, int(counts.sum()) * (100 - self.percent) // 100 // (4 * parts))
        posts = self.docs.mapInArrow(_post(self.sets_of, self.percent, self.size_classes,
                                           self.spark.sparkContext.broadcast(counts), list_rows), _POST)
        posts = posts.repartition("token", "salt").sortWithinPartitions("token", "salt", "pos", "n", "id")
        return self.s.put(posts.mapInArrow(_lists(self.percent), _LIST), "lists")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """pairs (a, b) -> those that link."""
        percent = self.percent
        one = self.rows.filter("id IS NOT NULL")
        x = one.select(F.col("id").alias("a"), F.col("n").alias("n"), F.col("sig").alias("sx"))
        y = one.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("sig").alias("sy"))

        def word(c, i):
            return F.conv(F.hex(F.substring(F.col(c), 8 * i + 1, 8)), 16, -10).cast("long")
        apart = sum((F.bit_count(word("sx", i).bitwiseXOR(word("sy", i))) for i in range(SIGNATURE_BITS // 64)), F.lit(0))
        most = F.col("n") + F.col("m") - 2 * F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / (100 + percent))
        pairs = pairs.join(x, "a").join(y, "b").filter(_near(percent, F.col("n"), F.col("m")) & (apart <= most))
        pairs = self.s.put(pairs.select("a", "b").distinct(), name + "-pairs")
        ids = self.s.put(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(),
                         name + "-ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        sets = self.docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_sets(self.sets_of), _SETS)
        sets = self.s.put(sets, name + "-sets")
        met = (pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
               .join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").select("a", "b", "x", "y"))
        links = self.s.put(met.mapInArrow(_verify(percent), _LINK), name + "-links")
        self.s.drop(sets)
        return links

    def run(self):
        counts = self.scan()
        lists = self.lists(counts)
        first = lists.filter("close").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        first = self.s.put(first, "first")
        links = self.verified(first, "first")
        # documents with one set are one node: link each to the smallest id of its set
        known = self.rows.filter("id IS NOT NULL AND n > 0").select("id", "n", "s1", "s2")
        sets = (known.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).filter("c > 1")
                .select("n", "s1", "s2", "rep"))
        copies = known.join(self.s.put(sets, "copies"), ["n", "s1", "s2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
        comp = self.s.put(components(links.unionByName(copies), self.s), "comp")

        # lists with documents of several components: the rest of their pairs
        # left: the document's lists from this one on, in shingle order
        own = W.partitionBy("id")
        at = (lists.select("token", "pos", "n", "id", "hub", "close")
              .withColumn("left", F.count("*").over(own) - F.row_number().over(own.orderBy("pos")) + 1)
              .join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        at = self.s.put(at, "members")
        main = (at.filter("id = hub").groupBy("token").agg(F.min(F.struct("pos", "n", "id", "comp")).alias("hub"))
                .select("token", F.col("hub.comp").alias("main")))
        out = at.join(main, "token").filter("comp <> main")
        tried = F.when(F.col("close"), F.col("hub")).alias("u_tried")       # the pair with the hub was verified
        out = self.s.put(out.select("token", "main", tried, *[F.col(c).alias("u_" + c) for c in _MEMBER]), "outside")
        p = self.percent
        both, larger = F.col("u_n") + F.col("n"), F.greatest("u_n", "n")
        merged = F.ceil(p * both / (100 + p)) - F.ceil(p * larger / 100) + 1
        on = ((F.col("u_comp") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("u_id") < F.col("id")))
              & _near(p, F.col("u_n"), F.col("n"), F.col("u_pos"), F.col("pos"))
              & (F.least("u_left", "left") >= merged) & ~F.col("u_tried").eqNullSafe(F.col("id")))
        more = (out.alias("u").join(at.select("token", *_MEMBER).alias("v"), (F.col("u.token") == F.col("v.token")) & on)
                .select(F.least("u_id", "id").alias("a"), F.greatest("u_id", "id").alias("b")).distinct()
                .join(first, ["a", "b"], "left_anti"))
        more = self.s.put(more, "more")
        if more.isEmpty():
            return comp
        # what these links join, component by component
        links = self.verified(more, "more")
        for c in ("a", "b"):
            links = (links.join(comp.select(F.col("id").alias(c), F.col("comp").alias("c")), c, "left")
                     .withColumn(c, F.coalesce("c", c)).drop("c"))
        links = self.s.put(links.filter("a <> b"), "joined")
        if links.isEmpty():
            return comp
        over = self.s.put(components(links, self.s).select(F.col("id").alias("comp"), F.col("comp").alias("top")), "over")
        # components that were joined, and documents that were in none
        alone = over.join(comp.select("comp"), "comp", "left_anti").select(F.col("comp").alias("id"), F.col("top").alias("comp"))
        return comp.join(over, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp")).unionByName(alone)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       k: int = SHINGLE, percent: int = PERCENT, unique: bool = False) -> DataFrame:
    """Return one row per input row: ``id_col``, n_shingles, component_id.

    Documents link when 100 |x & y| >= percent |x | y| on their sets of k-word
    shingles (fewer words: the whole sequence as one shingle); component_id is
    the smallest id reachable by links. A document without words, or with null
    text, has no shingles and links with nothing. Ids are whole numbers; rows
    that share an id are one node, rows with a null id keep a null component.
    An empty table gives no rows; other columns aren't read. ``unique``: as in
    ``set_components``.
    """
    out = set_components(df, partial(shingles_of, k), percent, id_col, text_col, unique=unique)
    return out.withColumnRenamed("n", "n_shingles")


def set_components(df: DataFrame, sets_of, percent: int, id_col: str, text_col: str,
                   size_classes: bool = False, unique: bool = False) -> DataFrame:
    """The join on any sets of a text: ``sets_of(column)`` gives blocks of sorted
    distinct 64-bit hashes. Returns ``id_col``, n, component_id.

    Ids are looked through for repeats first. Where some repeat, the join runs on
    row numbers, written once with the rows, so that an id which many rows share
    is no key of it; ids then meet where their rows do. ``unique``: the caller
    knows that no id repeats, so nothing is looked through.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    once = unique or docs.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty()
    if once:
        job = _Join(docs, sets_of, percent, size_classes)
        comp, sizes = job.run(), job.rows.select("id", "n")
    else:
        comp, sizes = _components_by_row(docs, sets_of, percent, size_classes)
    out = sizes.join(comp, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n"),
                      F.coalesce("comp", "id").alias("component_id"))


def _components_by_row(docs: DataFrame, sets_of, percent: int, size_classes: bool):
    """(id, comp) and (id, n) of documents whose ids may repeat. Rows with a null id keep a null number."""
    s = Scratch(docs.sparkSession, "jaccard-by-row")
    number = F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())
    docs = s.put(docs.withColumn("row", number), "rows")
    job = _Join(docs.select(F.col("row").alias("id"), "text"), sets_of, percent, size_classes)
    comp = job.run().withColumnRenamed("id", "row")
    sizes = job.rows.select(F.col("id").alias("row"), "n").join(docs.select("row", "id"), "row").select("id", "n")
    sizes = sizes.unionByName(job.rows.filter("id IS NULL").select("id", "n"))
    # one row for each id in a component of rows, so a hot id is combined before it is shuffled
    met = s.put(docs.filter("row IS NOT NULL").select("row", "id").join(comp, "row", "left")
                .select("id", F.coalesce("comp", "row").alias("comp")).distinct(), "met")
    least = met.groupBy("comp").agg(F.min("id").alias("b"))
    by_row = met.join(least, "comp").select(F.col("id").alias("a"), "b")
    return components(by_row, s), sizes


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df``, all columns, less those whose component has a smaller id.

    This goes by id: rows that share the smallest id of a component all stay,
    rows with a null id too, and all rows of a dropped id go. For ids that may
    repeat or be null see ``keep_one_row``. What is dropped is found by a join on the id, in which adaptive
    execution splits an id that many rows share.
    """
    found = jaccard_components(df, id_col, text_col, k, percent)
    gone = found.filter(F.col(id_col).cast("long") != F.col("component_id")).select(F.col(id_col).alias("__id"))
    gone = Scratch(df.sparkSession, "jaccard-gone").put(gone.distinct(), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return df.join(gone, F.col(id_col) == F.col("__id"), "left_anti")


def keep_one_row(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component stays, all columns: the first by id (null last), then text.

    Every row is a document of its own: the join runs on row numbers in that
    order, which are written once with the rows, so ids may repeat or be null.
    Equal rows stay in the order of the input. Rows without shingles all stay.
    The sort is by ranges of (id, text, place), so no id or text is a task's.
    """
    row = fresh("__row", df.columns)
    order = [named(id_col).asc_nulls_last(), named(text_col), F.col(row)]
    rows = df.withColumn(row, F.monotonically_increasing_id()).orderBy(*order)
    s = Scratch(df.sparkSession, "jaccard-rows")
    rows = s.put(rows.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = jaccard_components(rows.select(row, named(text_col).alias("t")), row, "t", k, percent, unique=True)
    gone = s.put(found.filter(F.col(row) != F.col("component_id")).select(row), "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, row, "left_anti").select(*[named(c) for c in df.columns])
