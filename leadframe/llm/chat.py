"""Chat formatting: collapse cumulative snapshots, then render (DataFrame functions only).

A chat service logs a conversation again after every turn, so many logged
conversations are prefixes of longer ones. Each turn gets the rolling hash of
the conversation up to it; a conversation whose whole hash is a proper-prefix
hash of another one is dropped by an anti-join, identical ones collapse to the
smallest id, and only the rest are rendered.

The rolling hash is the running XOR of turn hashes salted with their position
(two independent 64-bit hashes), so it needs one window per conversation over
narrow rows. Prefix hashes are made distinct, with map-side combining, before
the anti-join: a first turn shared by a third of all conversations is one row.
Texts cross the network once, for the conversations that stay. A conversation
is one output row, so its own turns do meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch


def chat_turn(role: Column, text: Column) -> Column:
    """One rendered turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", render=chat_turn) -> DataFrame:
    """Return one row per maximal conversation: ``id_col``, n_turns, n_copies, rendered.

    Turns are ordered by turn number, null last; turns with one number by role,
    then by text hash. Null text counts as empty, a null role as ``unknown``,
    rows with a null id are one conversation. ``n_copies`` counts the logged
    conversations identical to this one, itself included. An empty table gives
    no rows; other columns aren't read.
    """
    spark = df.sparkSession
    s = Scratch(spark, "chat")
    role, text = F.coalesce(F.col(role_col), F.lit("unknown")), F.coalesce(F.col(text_col), F.lit(""))
    turns = df.select(F.col(id_col).alias("id"), F.col(turn_col).isNull().alias("tn"), F.col(turn_col).alias("turn"),
                      role.alias("role"), text.alias("text"))
    turns = turns.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(7), "text", "role").alias("h2"))
    order = ["tn", "turn", "role", "h1", "h2"]
    w = W.partitionBy("id").orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    prefixes = (turns.select("id", *order).withColumn("pos", F.row_number().over(w).cast("long"))
                .withColumn("a", F.bit_xor(F.xxhash64("h1", "pos")).over(so_far))
                .withColumn("b", F.bit_xor(F.xxhash64("h2", "pos")).over(so_far))
                .withColumn("n", F.count("*").over(W.partitionBy("id")))
                .select("id", "pos", "n", "a", "b"))
    prefixes = s.put(prefixes, "prefixes")
    proper = prefixes.filter("pos < n").select(F.col("pos").alias("n"), "a", "b").distinct()
    whole = prefixes.filter("pos = n").select("id", "n", "a", "b")
    kept = s.put(whole.groupBy("n", "a", "b").agg(F.min("id").alias("id"), F.count("*").alias("n_copies"))
                 .join(proper, ["n", "a", "b"], "left_anti")
                 .select(F.col("id").alias("kid"), F.col("n").alias("n_turns"), "n_copies"), "kept")
    pieces = (turns.join(kept, F.col("id").eqNullSafe(F.col("kid")))
              .select("kid", "n_turns", "n_copies",
                      F.struct(*order, render(F.col("role"), F.col("text")).alias("piece")).alias("p")))
    return (pieces.groupBy("kid", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("p")).alias("ps"))
            .select(F.col("kid").alias(id_col), "n_turns", "n_copies",
                    F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("rendered")))
