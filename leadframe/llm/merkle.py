"""Merkle dataset manifest: one tree of leaf hashes for each group of rows, one over the groups' roots.

``build`` hashes every row to a leaf, gives the leaves of a group gapless places
and stores the built levels as parent-linked node rows. A node row holds its
hash, its siblings on the way up and the key of the node it leads to, ``span``
levels above (span 1: one row for each node of each level; the default 8 keeps
one stored level of eight, 1/256 more rows than leaves). The last link of a
group's tree leads into the tree over the groups.

``climb`` is one Spark recursive query: from every leaf it follows the links,
appends the siblings and folds the claimed leaf hash with them, until it stands
at the root. The links above the leaves are 1/256 of the leaves, so a step moves
no leaf unless those are too many to broadcast.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex
text. While a level has more than one node, each two consecutive ones become
their H; a last one without a partner becomes its own H.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch

SPAN = 8
TOP = "/"           # the tree over the groups; a group's tree is '' (null) or '=' and the group
SLICE = 12          # node rows of 2**SLICE places share a shuffle key
ROWS_OUT = 4096

_NODE = ("tree string, level int, pos long, hash binary, sibs array<binary>, top binary, "
         "up_tree string, up_level int, up_pos long")


def leaf_hash(*columns: Column) -> Column:
    """H of the columns: each '-' if null, else its UTF-8 byte count, ':' and its text."""
    def item(c):
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat(*[item(c) for c in columns]), 256)


def places(df: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Add ``pos`` (gapless from 0 within ``group``, by ``order``) and ``n``, the rows of the group.

    Rows are sorted by ranges of (group, order) and a random last key, so neither
    a hot group nor a repeated row stays in one task; a place is the row's
    number in its range plus the group's rows in earlier ranges.
    """
    keys = [group, *order]
    rows = scratch.put(df.withColumn("__salt", F.rand(7)).repartitionByRange(*keys, "__salt")
                       .sortWithinPartitions(*keys).drop("__salt")
                       .withColumn("__m", F.monotonically_increasing_id()), name)
    part = F.shiftright("__m", 33).alias("__part")
    w = W.partitionBy(group)
    ranges = (rows.groupBy(group, part).agg(F.count("*").alias("c"), F.min("__m").alias("first"))
              .select(group, "__part", (F.coalesce(F.sum("c").over(w.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)),
                                                   F.lit(0)) - F.col("first")).alias("shift"),
                      F.sum("c").over(w).alias("n")))
    return (rows.withColumn("__part", F.shiftright("__m", 33)).join(ranges, [group, "__part"])
            .withColumn("pos", F.col("__m") + F.col("shift")).drop("__m", "__part", "shift"))


def fold_run(hashes: list[bytes], height: int) -> tuple[list[list[bytes]], bytes]:
    """Siblings of each node over ``height`` levels (empty where it has none), and the node they lead to."""
    levels = [hashes]
    for _ in range(height):
        h = [x.hex() for x in levels[-1]]
        levels.append([sha256("".join(h[i:i + 2]).encode()).digest() for i in range(0, len(h), 2)])
    sibs = [[level[j ^ 1] if j ^ 1 < len(level) else b"" for level, j in zip(levels[:-1], (i >> k for k in range(height)))]
            for i in range(len(hashes))]
    return sibs, levels[-1][0]


def _link(level: int, span: int, kept: list[str], schema: pa.Schema):
    """Arrow batches of sorted places -> node rows, a run of 2**span places at a time."""
    def run(batches):
        out = {n: [] for n in schema.names}
        buffer, key = [], None

        def flush():
            n = buffer[0]["n"]
            last = n <= 1 << span
            height = (n - 1).bit_length() if last else span
            sibs, top = fold_run([r["hash"] for r in buffer], height)
            tree = buffer[0]["tree"]
            root = last and tree == TOP
            up = (None, None, None) if root else (TOP, 0, buffer[0]["rank"]) if last else (tree, level + 1, key[1])
            for r, s in zip(buffer, sibs):
                for name, v in zip(out, (tree, level, r["pos"], r["hash"], s, top, *up, *(r[c] for c in kept))):
                    out[name].append(v)

        def batch():
            done = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            for v in out.values():
                v.clear()
            return done

        for b in batches:
            for r in b.to_pylist():
                k = (r["tree"], r["pos"] >> span)
                if k != key:
                    if buffer:
                        flush()
                        buffer.clear()
                        if len(out["tree"]) >= ROWS_OUT:
                            yield batch()
                    key = k
                buffer.append(r)
        if buffer:
            flush()
        yield batch()
    return run


def _links(rows: DataFrame, level: int, span: int, kept: list[str]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = _NODE + "".join(f", {c} {kinds[c]}" for c in (*kept, "n", "rank"))
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    # a slice holds whole runs
    return (rows.repartition("tree", F.shiftright("pos", max(SLICE, span))).sortWithinPartitions("tree", "pos")
            .mapInArrow(_link(level, span, [*kept, "n", "rank"], arrow), schema))


@dataclass
class Manifest:
    leaves: DataFrame       # node rows of the leaves, with key, claim and n
    nodes: DataFrame        # node rows above
    subroots: DataFrame     # tree, subroot
    root: str | None        # None: no rows
    span: int


def build(df: DataFrame, leaf: Column, group: str, order: str, claim: Column | None = None, span: int = SPAN,
          scratch: Scratch | None = None) -> Manifest:
    """The manifest of ``df``: ``leaf`` hashes a row, ``claim`` (default: the same) is the hash to be verified later.

    Leaves ascend by ``order`` (null first, then by leaf hash, so rows that share
    an id have a defined place; repeated rows are leaves of their own), groups
    bytewise (null first). Equal leaves may trade places with each other, which
    changes no hash. An empty table has no node and no root. Columns other than
    those named aren't read.
    """
    s = scratch or Scratch(df.sparkSession, "merkle")
    rows = df.select(F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("tree"), F.col(order).alias("key"),
                     F.unhex(leaf).alias("hash"), F.unhex(leaf if claim is None else claim).alias("claim"))
    rows = s.put(places(rows, "tree", ["key", "hash"], s, "ranges"), "places")
    trees = rows.filter("pos = 0").select("tree", F.lit(TOP).alias("top"))
    trees = s.put(places(trees, "top", ["tree"], s, "tree-ranges")
                  .select("tree", F.col("pos").alias("rank"), F.col("n").alias("n_trees")), "trees")
    rows = rows.join(trees.select("tree", "rank"), "tree")
    leaves, uppers, tops = _tree(rows, span, s, ["key", "claim"], "leaf")
    over = tops.join(trees, "tree").select(F.lit(TOP).alias("tree"), F.col("rank").alias("pos"), F.col("top").alias("hash"),
                                           F.col("n_trees").alias("n"), F.lit(None).cast("long").alias("rank"))
    first, more, root = _tree(over, span, s, [], "top")
    nodes = first.select(*uppers.columns).unionByName(uppers).unionByName(more)
    top = root.select(F.lower(F.hex("top")).alias("root")).first()
    return Manifest(leaves, s.put(nodes, "nodes"), tops.select("tree", F.lower(F.hex("top")).alias("subroot")),
                    top and top["root"], span)


def _tree(rows, span, s, kept, name):
    """Node rows of the first level, of the levels above, and each tree's top hash."""
    first = s.put(_links(rows, 0, span, kept), f"{name}-0")
    names = [f.strip().split()[0] for f in _NODE.split(", ")]
    tops, uppers = first.filter(f"n <= {1 << span} AND pos = 0").select("tree", "top"), first.filter("false").select(*names)
    below, level = first, 0
    while not below.filter(f"n > {1 << span}").isEmpty():
        level += 1
        up = below.filter(f"n > {1 << span} AND pos % {1 << span} = 0").select(
            "tree", F.shiftright("pos", span).alias("pos"), F.col("top").alias("hash"),
            F.shiftright(F.col("n") + ((1 << span) - 1), span).alias("n"), "rank")
        below = s.put(_links(up, level, span, []), f"{name}-{level}")
        uppers = uppers.unionByName(below.select(*names))
        tops = tops.unionByName(below.filter(f"n <= {1 << span} AND pos = 0").select("tree", "top"))
    return first, uppers, tops


_FOLD = """aggregate({n}.sibs, struct({h} AS h, {n}.pos AS p),
    (a, s) -> struct(sha2(CASE WHEN a.p % 2 = 1 THEN concat(lower(hex(s)), a.h) ELSE concat(a.h, lower(hex(s))) END, 256) AS h,
                     shiftright(a.p, 1) AS p), a -> a.h)"""
_PROOF = "aggregate({n}.sibs, {start}, (a, s) -> concat(a, s))"

_CLIMB = """
WITH RECURSIVE climb(key, leaf, tree, proof, folded, up_tree, up_level, up_pos) AS (
  SELECT l.key, l.hash, l.tree, {proof0}, {fold0}, l.up_tree, l.up_level, l.up_pos FROM {leaves} l
  UNION ALL
  SELECT c.key, c.leaf, c.tree, {proof1}, {fold1}, u.up_tree, u.up_level, u.up_pos
  FROM climb c JOIN {nodes} u ON u.tree = c.up_tree AND u.level = c.up_level AND u.pos = c.up_pos)
SELECT key, leaf, tree, proof, folded FROM climb WHERE up_tree IS NULL
"""


def climb(m: Manifest, scratch: Scratch | None = None) -> DataFrame:
    """A row for each leaf: key, leaf, subroot, root, proof (its siblings' digests, 32 bytes each), folded, verified.

    ``folded`` is the root that the claimed hash leads to, ``verified`` whether it is the manifest's.
    """
    spark = m.leaves.sparkSession
    s = scratch or Scratch(spark, "climb")
    sql = _CLIMB.format(leaves="{leaves}", nodes="{nodes}",
                        proof0=_PROOF.format(n="l", start="CAST('' AS BINARY)"), fold0=_FOLD.format(n="l", h="lower(hex(l.claim))"),
                        proof1=_PROOF.format(n="u", start="c.proof"), fold1=_FOLD.format(n="u", h="c.folded"))
    # the recursion's own guard is a million rows; here its rows are the leaves times the links to the root
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        top = s.put(spark.sql(sql, leaves=m.leaves, nodes=m.nodes), "climbed")
    finally:
        spark.conf.set(limit, before)
    root = F.lit(m.root).cast("string")
    return (top.join(m.subroots, "tree")
            .select("key", F.lower(F.hex("leaf")).alias("leaf"), "subroot", root.alias("root"), "proof", "folded",
                    (F.col("folded") == root).alias("verified")))
