"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every source gets a word target: its weight's share of all words, held to
``max_epochs`` times the source's own words, the excess reshared by weight.
A source's documents are taken in complete epochs first; the rest of the
target is filled without replacement in the order of exponential keys
``-ln(u) / w``, ``u`` a hash of the id, the text and the number among equal rows,
and ``w`` the document's quality weight.

The prefix sum over a source runs in two levels, so that a source with a third
of all rows never meets in one task: keys fall into fine buckets, a window adds
the buckets' words up (one row per bucket), and only the one bucket per source
in which the budget ends is summed document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadframe.llm.common import WORD_PATTERN, Scratch, fresh, named
from leadframe.llm.merkle import places

SEED = "mix-1"
JUNK = "#$%&*|!"
BUCKET_ROWS = 20_000    # documents per key bucket, about


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.1 with the share of mark-up characters."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    junk = (n - F.length(F.translate(t, JUNK, ""))).cast("double")
    return F.when(n > 0, F.greatest(F.lit(0.1), 1.0 - 4.0 * junk / n)).otherwise(0.1)


def uniform(id_: Column, digest: Column, copy: Column, seed: str) -> Column:
    """A number in (0, 1) from the id (null: -), the text's MD5 and the number among equal rows: 13 hex digits of an MD5."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("-")), digest, copy.cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """sizes: one row per source (sn, src, source_size) -> the same with target.

    Sources in code point order, null last, take the weights in turn. The
    capped share has a closed form: in ascending order of cap / weight, a
    source is held to its cap when an equal share of what is left by weight
    would reach it; the others share the remainder. These windows see one row
    per source.
    """
    by_name = W.orderBy("sn", "src")
    k = (F.row_number().over(by_name) - 1) % len(weights)
    x = (sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(v)) for v in weights]), k + 1))
         .withColumn("cap", (max_epochs * F.col("source_size")).cast("double")))
    every = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("w"), "sn", "src").rowsBetween(W.unboundedPreceding, -1)
    x = (x.withColumn("total", F.sum("source_size").over(every).cast("double"))
         .withColumn("all_w", F.sum("w").over(every))
         .withColumn("cap_before", F.coalesce(F.sum("cap").over(order), F.lit(0.0)))
         .withColumn("w_before", F.coalesce(F.sum("w").over(order), F.lit(0.0))))
    held = F.col("cap") / F.col("w") <= (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))
    x = (x.withColumn("held", held)
         .withColumn("held_cap", F.sum(F.when(F.col("held"), F.col("cap")).otherwise(0.0)).over(every))
         .withColumn("held_w", F.sum(F.when(F.col("held"), F.col("w")).otherwise(0.0)).over(every)))
    free = F.col("w") * ((F.col("total") - F.col("held_cap"))
                         / F.when(F.col("all_w") > F.col("held_w"), F.col("all_w") - F.col("held_w")))
    return x.select("sn", "src", "source_size", F.when(F.col("held"), F.col("cap")).otherwise(free).alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights=(5, 2, 1), max_epochs: int = 3, seed: str = SEED,
                quality: Column | None = None, carry: tuple = (), prefix: str = "") -> DataFrame:
    """Return per row: ``id_col``, size, source_size, target, taken, times, and the ``carry`` columns.

    ``prefix`` goes before the names of all but the carried columns, so that
    they can't clash; with one, ``id_col`` comes only if it is carried.

    ``times`` is how often the mix takes the document (complete epochs, plus
    one if the sample takes it), ``taken`` its words over all of them. The
    sample stops at the document nearest the budget. Null text has size 0 and
    is never taken; a null source is a source of its own; rows that share an id
    or have none, and repeated rows, are documents of their own with keys of
    their own; ties in the key go by id and size; a table without words, or without rows, gives targets
    of 0 or no rows. Reruns give the same result. ``quality`` is a Column over
    ``df``; without it the share of mark-up characters decides.
    """
    spark = df.sparkSession
    s = Scratch(spark, "mixing")
    text = F.col(text_col)
    weight = quality if quality is not None else quality_weight(text)
    docs = s.put(df.select(F.col(id_col).alias("id"), F.col(source_col).isNull().alias("sn"),
                           F.coalesce(F.col(source_col), F.lit("")).alias("src"),
                           word_count(text).alias("size"), F.greatest(weight.cast("double"), F.lit(1e-6)).alias("w"),
                           F.md5(F.coalesce(text, F.lit(""))).alias("digest"),
                           F.struct(F.lit(0).alias(fresh("__none", carry)), *[named(c) for c in carry]).alias("more"),
                           F.monotonically_increasing_id().alias("rid")), "sized")
    # rows with one id and text are numbered, without a group in one task; the others are number 0
    equal = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), "digest").alias("equal")
    narrow = docs.select(equal, "sn", "src", "rid")
    repeated = s.put(narrow.groupBy("equal").count().filter("count > 1").select("equal"), "repeated")
    copy = F.lit(0).cast("long")
    if not repeated.isEmpty():
        copies = places(narrow.join(repeated, "equal", "left_semi"), "equal", ["sn", "src"], s, "copies")
        docs = docs.join(copies.select("rid", "pos"), "rid", "left")
        copy = F.coalesce("pos", copy)
    key = -F.ln(uniform(F.col("id"), F.col("digest"), copy, seed)) / F.col("w")
    docs = s.put(docs.select("id", "sn", "src", "size", key.alias("key"), "more", "rid"), "keyed")
    n = docs.count()
    buckets = max(256, n // BUCKET_ROWS)
    docs = docs.withColumn("bucket", F.floor(F.col("key") / (1.0 + F.col("key")) * buckets))
    by_bucket = s.put(docs.groupBy("sn", "src", "bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = source_targets(by_bucket.groupBy("sn", "src").agg(F.sum("words").alias("source_size")),
                             weights, max_epochs)
    size = F.col("source_size")
    targets = (targets.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"))
               .withColumn("rest", F.col("target") - F.col("epochs") * size))
    before = W.partitionBy("sn", "src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    edge = (by_bucket.withColumn("bucket_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
            .join(targets, ["sn", "src"])
            .groupBy("sn", "src", "source_size", "target", "epochs", "rest")
            .agg(F.max(F.when(F.col("bucket_before") < F.col("rest"),
                              F.struct("bucket", "bucket_before"))).alias("e"))
            .select("sn", "src", "source_size", "target", "epochs", "rest",
                    F.col("e.bucket").alias("edge"), F.col("e.bucket_before").alias("edge_before")))
    edge = s.put(edge, "sources")
    rows = docs.join(edge, ["sn", "src"])
    in_edge = W.partitionBy("sn", "src").orderBy("key", "id", "size", "rid").rowsBetween(W.unboundedPreceding, -1)
    at_edge = (rows.filter("bucket = edge")
               .withColumn("words_before", F.col("edge_before") + F.coalesce(F.sum("size").over(in_edge), F.lit(0)))
               .withColumn("extra", F.col("words_before") + F.col("size") / 2 <= F.col("rest")).drop("words_before"))
    others = (rows.filter("edge IS NULL OR bucket <> edge")
              .withColumn("extra", F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False))))
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("extra").cast("long")).otherwise(F.lit(0).cast("long"))
    out = others.unionByName(at_edge).withColumn("times", times).withColumn("taken", F.col("times") * F.col("size"))
    names = ["size", "source_size", "target", "taken", "times"]
    return out.select(*([] if prefix else [F.col("id").alias(id_col)]), *[F.col(c).alias(prefix + c) for c in names],
                      *[F.col("more").getField(c).alias(c) for c in carry])
