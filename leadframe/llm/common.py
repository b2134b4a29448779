"""Shared helpers: the shared scratch folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of every contract: space and \t \n \v \f \r.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only a plain local session without the setting (tests) gets a folder of its
    own; on any other master a missing setting is an error, since executors
    can't read each other's disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


class Scratch:
    """Intermediate tables written once under the shared folder and read back.

    That cuts lineage: a lost executor costs a re-read, not a recompute.
    ``drop`` removes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken) -> str:
    """``name``, lengthened until it is the start of no column's name in ``taken``."""
    lower = [c.lower() for c in taken]
    while any(c.startswith(name.lower()) for c in lower):
        name += "_"
    return name


def named(c: str) -> "F.Column":
    """The column of exactly this name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def text_and(df: DataFrame, text_col: str, carry) -> DataFrame:
    """The text as ``t`` and the carried columns as ``c0``, ``c1``...: names that no
    carried column can clash with; ``toDF`` gives them back after the Arrow pass."""
    return df.select(named(text_col).alias("t"), *[named(c).alias(f"c{i}") for i, c in enumerate(carry)])


def squeezed(text) -> "F.Column":
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")
