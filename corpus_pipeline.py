"""Corpus pipeline: five stages over documents, each one of the dealt operators.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``docs``. No stage counts on unique ids or non-null columns: every row
is a document of its own, null text counts as empty, repeated rows as copies, an
empty table stays empty, and other columns go along whatever their names are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from leadframe.llm import bpe, exact_dedup, jaccard, mixing, quality
from leadframe.llm.common import Scratch, fresh, named

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_stage(spark, docs, sf_dir):
    """Rejected documents go: those with a score under ``quality.KEEP_AT``.

    The labels belong to the corpus, so the classifier learns from all of them.
    Empty texts score the constant; equal texts score alike, so copies stay or
    go together.
    """
    weights = quality.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("__quality", docs.columns)
    scored = quality.score_quality(docs, weights, carry=tuple(docs.columns), score_col=score)
    return scored.filter(F.col(score) >= quality.KEEP_AT).drop(score)


def exact_dedup_stage(spark, docs, sf_dir):
    """One row of each group of equal texts stays, empty texts among them: the longest, then the smallest id."""
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark, docs, sf_dir):
    """One row of each component of the n-gram Jaccard join stays: the smallest id (null last), then text.
    Rows without words all stay."""
    return jaccard.keep_one_row(docs)


def mixing_stage(spark, docs, sf_dir):
    """Documents as often as the mix takes them; copies are equal rows. Documents without words go."""
    p = fresh("__", docs.columns)
    mixed = mixing.mix_sources(docs, carry=tuple(docs.columns), prefix=p)
    times = F.sequence(F.lit(1).cast("long"), F.col(f"{p}times"))
    return (mixed.filter(F.col(f"{p}times") > 0).withColumn(f"{p}copy", F.explode(times))
            .select(*[named(c) for c in docs.columns]))


def encode_stage(spark, docs, sf_dir):
    """Token ids of every row (none for an empty text), and the digest of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    both = bpe.encode(docs, ranks, carry=("doc_id", "source"), with_offsets=False, decoded_col="decoded")
    return both.select("doc_id", "source", "n_tokens", F.col("ids").alias("tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte bpe", encode_stage),
]

# The classifier and the vocabulary are beyond SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = s.put(out, name.replace(" ", "-")) if i < len(STAGES) - 1 else out
    return docs
