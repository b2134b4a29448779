"""One large JSON array read by many tasks.

Spark's text source cuts a file at any separator: here at ``}``, so a fragment
is a stretch of text up to the next closing brace and every split of the file is
read by a task of its own. Whether a fragment starts inside a string, and how
deep, depends on everything before it, but both are prefix sums:

* quotes (without escaped ones) modulo 2 tell inside from outside; an escape
  never reaches over a border, since JSON has no ``\\}``;
* the depth is the sum of the brackets outside strings, known per fragment for
  either start.

So each is summed within a split and then over the splits of a file (one row per
split). A fragment that starts and ends at the array's depth is a whole element;
only elements of several fragments (nested objects, braces in strings) are put
together by a ``groupBy``. The text is written once with its narrow columns, the
sums run on those alone, and no task ever holds more than one element.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe.session import materialize

AT = ["file", "block", "seq"]       # a fragment's place


def _fragments(spark: SparkSession, path: str, over_bytes: int) -> DataFrame:
    """file, block (start of the split), seq (order in it), value and per start state the depth's change and low."""
    raw = (spark.read.option("lineSep", "}").text(path).filter(F.col("_metadata.file_size") > over_bytes)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("seq"), "value"))
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))

    def outside(text):
        """The brackets outside strings, and the closing one unless it is in a string."""
        return F.regexp_replace(F.concat(text, F.lit("}")), r'"[^"]*+(?:"|$)|[^\[\]{}"]++', "")

    def change(d, low):
        return F.struct(F.lit(d).alias("d"), F.lit(low).alias("low"))

    def depth(brackets):
        """Most fragments are an object without brackets in it, or the end of one."""
        steps = F.aggregate(F.split(brackets, ""), change(0, 0),
                            lambda a, c: F.struct((a["d"] + _step(c)).alias("d"), F.least(a["low"], a["d"] + _step(c)).alias("low")))
        return F.when(brackets.isin("", "{}"), change(0, 0)).when(brackets == "}", change(-1, -1)).otherwise(steps)
    # a step each, so that a text is gone through once
    seen = raw.withColumn("plain", plain)
    quotes = F.length("plain") - F.length(F.replace(F.col("plain"), F.lit('"'), F.lit("")))
    seen = seen.select(*AT, "file_size", "value", quotes.cast("long").alias("quotes"), outside(F.col("plain")).alias("out"),
                       outside(F.concat(F.lit('"'), F.col("plain"))).alias("within"))
    return seen.withColumns({"out": depth(F.col("out")), "within": depth(F.col("within"))})


def _step(c):
    return F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)


def _summed(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier fragments of the file."""
    w = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (rows.groupBy("file", "block").agg(F.sum(value).alias("n"))
              .select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    return (rows.withColumn("own", F.coalesce(F.sum(value).over(w), F.lit(0))).join(splits, ["file", "block"])
            .withColumn(out, F.col("own") + F.col("shift")).drop("own", "shift"))


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("opens", "closes", "drops")]))
def _edges(value: pd.Series, within: pd.Series, depth: pd.Series, array_depth: pd.Series) -> pd.DataFrame:
    """Where a fragment at the array's edge opens the array, closes it again, or first leaves the array's depth."""
    return pd.DataFrame([_edge(*r) for r in zip(value, within, depth, array_depth)], columns=["opens", "closes", "drops"],
                        dtype="Int32")


def _edge(text, inside, depth, array_depth):
    opens = closes = drops = None
    key, start, i = None, 0, 0
    while i < len(text):
        c = text[i]
        if inside:
            if c == "\\":
                i += 1
            elif c == '"':
                inside = False
                if depth == array_depth - 1:
                    key = text[start:i]
        elif c == '"':
            inside, start = True, i + 1
        elif c in "{[":
            wanted = array_depth == 1 or key == "profiles"
            if c == "[" and depth == array_depth - 1 and wanted and opens is None:
                opens = i + 1
            depth += 1
        elif c == "]":
            depth -= 1
            if depth == array_depth - 1:
                if opens is not None and closes is None:
                    closes = i
                elif opens is None and drops is None:
                    drops = i
        elif c == "," and depth == array_depth - 1:
            key = None
        i += 1
    return opens, closes, drops


def read_array_elements(spark: SparkSession, path: str, over_bytes: int) -> DataFrame:
    """file, pos, p (VARIANT): the objects of the array in each file larger than ``over_bytes``.

    A file holds a bare array, or an object whose ``profiles`` is one; ``pos``
    counts the array's objects from 0 (other elements are skipped). A file whose
    brackets or quotes don't match gives no rows, an element that is no JSON none.
    """
    parts = materialize(_fragments(spark, path, over_bytes), "json-fragments")
    narrow = parts.select(*AT, "file_size", "quotes", "out", "within", F.octet_length("value").alias("bytes"),
                          F.when((F.col("block") == 0) & F.col("value").rlike(r"^\s*+\["), 1)
                          .when((F.col("block") == 0) & F.col("value").rlike(r"^\s*+\{"), 2).alias("starts"))
    state = _summed(narrow, "quotes", "q").withColumn("inside", F.col("q") % 2 == 1)
    state = state.withColumn("change", F.when(F.col("inside"), F.col("within")).otherwise(F.col("out")))
    state = state.withColumn("d", F.col("change.d"))
    first = Window.partitionBy("file", "block").orderBy("seq")
    state = materialize(_summed(state, "d", "depth").withColumn("n", F.row_number().over(first)).select(
        *AT, "inside", F.col("depth").cast("int").alias("depth"), "d", (F.col("depth") + F.col("change.low")).cast("int").alias("low"),
        F.when((F.col("block") == 0) & (F.col("n") == 1), F.col("starts")).alias("starts"), "quotes", "bytes", "file_size"),
        "json-depths")
    # a file without a separator at its end has one fragment more than separators, and its brace was never there
    missing = F.count(F.lit(1)) - (F.max("file_size") - F.sum("bytes"))
    files = (state.groupBy("file").agg(F.max("starts").alias("array_depth"), F.sum("quotes").alias("q"),
                                       F.sum("d").alias("d"), missing.alias("missing"))
             .filter((F.col("q") % 2 == 0) & (F.col("d") + F.col("missing") == 0) & F.col("array_depth").isNotNull())
             .select("file", "array_depth"))
    state = state.join(files, "file")
    edge = (state.filter(F.least("depth", "low") < F.col("array_depth")).join(parts.select(*AT, "value"), AT)
            .select(*AT, "array_depth", _edges("value", "inside", "depth", "array_depth").alias("e")).select(*AT, "e.*"))
    edge = materialize(edge, "json-edges")
    place = F.struct("block", "seq")
    opened = edge.filter("opens IS NOT NULL").groupBy("file").agg(F.min(F.struct("block", "seq", "opens", "closes")).alias("open"))
    closed = (edge.join(opened, "file").filter((place > F.struct("open.block", "open.seq")) & F.col("drops").isNotNull())
              .groupBy("file").agg(F.min(F.struct("block", "seq", "drops")).alias("close")))
    span = materialize(opened.join(closed, "file", "left").filter("open.closes IS NOT NULL OR close IS NOT NULL"), "json-spans")
    inside = state.join(span, "file").filter(
        (place >= F.struct("open.block", "open.seq"))
        & F.when(F.col("open.closes").isNotNull(), place == F.struct("open.block", "open.seq"))
        .otherwise(place <= F.struct("close.block", "close.seq")))
    at_open, at_close = place == F.struct("open.block", "open.seq"), place == F.struct("close.block", "close.seq")
    ends = ((F.col("depth") + F.col("d") == F.col("array_depth")) & ~at_close.eqNullSafe(True)
            & F.col("open.closes").isNull() & ((F.col("inside").cast("int") + F.col("quotes")) % 2 == 0))
    inside = inside.select(*AT, ends.cast("int").alias("ends"), ((F.col("depth") == F.col("array_depth")) & ~F.col("inside") & ends).alias("whole"),
                           F.when(at_open, F.col("open.opens")).otherwise(0).alias("from"),
                           F.when(at_open & F.col("open.closes").isNotNull(), F.col("open.closes"))
                           .when(at_close, F.col("close.drops")).alias("to"))
    element = materialize(_summed(inside, "ends", "pos"), "json-elements")
    text = F.when(F.col("to").isNull(), F.concat(F.expr("substr(value, `from` + 1)"), F.lit("}"))).otherwise(
        F.expr("substr(value, `from` + 1, `to` - `from`)"))
    rows = parts.select(*AT, "value").join(element, AT).select(*AT, "pos", "whole", text.alias("text"))
    several = (rows.filter(~F.col("whole")).groupBy("file", "pos")
               .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))),     # one element's text
                                             lambda x: x["text"]), "").alias("text")))
    json = rows.filter("whole").select("file", "pos", "text").unionByName(several)
    # what stands before an element is a comma, or elements that are no objects and a comma; after it nothing,
    # so a text that starts as an object is that object
    bare = F.regexp_replace("text", r"^\s*+,", "")
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))), "$", "array<variant>")
    objects = F.slice(F.filter(items, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), 1, 1)
    alone = F.array_compact(F.array(F.try_parse_json(bare)))
    # a generator parses once; a filter on its result would parse before and after
    return json.select("file", "pos", F.explode(F.when(F.col("text").rlike(r"^\s*+,?+\s*+\{"), alone).otherwise(objects)).alias("p"))
