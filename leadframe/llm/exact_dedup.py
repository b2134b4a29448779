"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at what the level before left in a shared group:

1. one scan writes a narrow row per document: normalised length, prefix hash;
2. lengths held by one document settle it; of the rest, (length, prefix hash)
   pairs held by one document settle it;
3. a second scan reads full content and hashes it, only for documents whose
   (length, prefix hash) cell survived. The scan-side filter is a table of at
   most ``FILTER_CELLS`` cell numbers, broadcast under that fixed bound; it may
   let a settled document through (it then forms a group of one) but never
   keeps a survivor back. Text is never shuffled, unless ``carry`` names it:
   then the surviving rows meet their group's result with all they carry.

Groups are aggregated with map-side combining, so a group of copies that holds
a third of all rows sends one row per task; rows meet their group's result in a
join on the full hash, where adaptive execution splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch, fresh, squeezed
from leadframe.llm.common import named as column

PREFIX_CHARS = 64
FILTER_CELLS = 1 << 16


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS, digest_all: bool = False,
                carry: tuple = (), prefix: str = "") -> DataFrame:
    """Return one row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, and the ``carry`` columns.

    Texts are equal when identical after white space is deleted; null counts as
    empty. The row with the most code points in the original text, then the
    smallest id, stays; of rows that tie in both (repeated rows) exactly one is
    kept. An empty table gives no rows. Columns not named are not read.
    ``text_sha256`` is null for documents that an earlier level settled, unless
    ``digest_all`` asks for the digest of every row (then level 3 reads every
    text, but groups are still refined level by level). ``prefix`` goes before
    the names of all but the carried columns, so that they can't clash; with
    one, ``id_col`` comes only if it is carried.
    """
    spark = df.sparkSession
    s = Scratch(spark, "exact-dedup")
    more = F.struct(F.lit(0).alias(fresh("__none", carry)), *[column(c) for c in carry]).alias("more")
    base = (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), more)
            .select("id", F.coalesce(F.length("t"), F.lit(0)).alias("cp"), squeezed(F.col("t")).alias("norm"), "more")
            .select("id", "cp", "norm", F.length("norm").alias("len"),
                    F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("ph"), "more"))
    cell = F.pmod(F.xxhash64("len", "ph"), F.lit(FILTER_CELLS)).alias("cell")

    def hashed(rows):
        return rows.select("id", "cp", "len", "ph", F.sha2("norm", 256).alias("full"),
                           F.monotonically_increasing_id().alias("rid"), "more")

    # levels 1 and 2 on narrow rows; copies combine map-side, before any shuffle by length
    full = s.put(hashed(base), "full") if digest_all else None
    sig = full if digest_all else base
    seen = s.put(sig.groupBy("len", "ph").count(), "seen")
    lens = seen.groupBy("len").agg(F.sum("count").alias("n")).filter("n > 1").select("len")
    keys = s.put(seen.join(lens, "len", "left_semi").filter("count > 1").select("len", "ph"), "keys")
    # level 3: full content of the surviving cells only
    settled = None
    if not digest_all:
        cells = F.broadcast(s.put(keys.select(cell).distinct(), "cells"))   # at most FILTER_CELLS rows
        full = s.put(hashed(base.select("*", cell).join(cells, "cell", "left_semi")), "full")
        settled = base.select("*", cell).join(cells, "cell", "left_anti")
    alive = full.select("id", "cp", "len", "ph", "full", "rid").join(keys, ["len", "ph"], "left_semi")
    groups = s.put(alive.groupBy("full").agg(F.count("*").alias("n"),
                                             F.min(F.struct((-F.col("cp")).alias("m"), "id", "rid")).alias("k"))
                   .filter("n > 1").select("full", "n", F.col("k.id").alias("kid"), F.col("k.rid").alias("krid")),
                   "groups")

    def named(rows, keep_id, size, kept, digest):
        cols = {"keep_id": keep_id, "group_size": size, "kept": kept, "text_sha256": digest}
        return rows.select(*([] if prefix else [F.col("id").alias(id_col)]),
                           *[c.alias(prefix + name) for name, c in cols.items()],
                           *[F.col("more").getField(c).alias(c) for c in carry])
    one = F.lit(1).cast("long")
    out = named(full.join(groups, "full", "left"),
                F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("kid")), F.coalesce("n", one),
                F.col("n").isNull() | (F.col("rid") == F.col("krid")), F.col("full"))
    if settled is not None:
        out = out.unionByName(named(settled, F.col("id"), one, F.lit(True), F.lit(None).cast("string")))
    return out


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns.

    Settled rows go straight through; only rows whose cell survived are written
    and joined with their group's result.
    """
    p = fresh("__", df.columns)
    found = exact_dedup(df, id_col, text_col, carry=tuple(df.columns), prefix=p)
    return found.filter(F.col(f"{p}kept")).select(*[column(c) for c in df.columns])
