"""Readers and landing-table jobs: S1-S7.

JSON whose shape varies per file (a bare array or an object holding the
array) is parsed to VARIANT so both shapes are read by one job, in
executors, without collecting anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadframe import fixed, schemas


# ---------------------------------------------------------------------- S7
def align_schema(df: DataFrame, target: T.StructType, defaults: dict | None = None,
                 keep_extra: bool = False) -> DataFrame:
    """Give ``df`` every column of ``target`` (missing ones as NULL or
    their default), cast to the target type; idempotent. With
    ``keep_extra`` the other columns follow unchanged."""
    defaults = defaults or {}
    have = set(df.columns)
    exprs = []
    for f in target.fields:
        t = f.dataType.simpleString()
        if f.name in have:
            exprs.append(f"CAST(`{f.name}` AS {t}) AS `{f.name}`")
        elif defaults.get(f.name) is not None:
            v = str(defaults[f.name]).replace("'", "''")
            exprs.append(f"CAST('{v}' AS {t}) AS `{f.name}`")
        else:
            exprs.append(f"CAST(NULL AS {t}) AS `{f.name}`")
    if keep_extra:
        names = set(target.fieldNames())
        exprs += [f"`{c}`" for c in df.columns if c not in names]
    return df.selectExpr(*exprs)


# Columns of older company tables that hold JSON text -> the array column of today.
JSON_TEXT_COLUMNS = {"industries_json": "industries", "locations_de_json": "locations_de",
                     "business_model_json": "business_model", "products_json": "products", "recent_news_json": "recent_news"}


def migrate_json_text(df: DataFrame, key: str = "id", columns: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Columns that hold JSON text become ``array<string>`` columns.

    Returns (rows, rejects). Of an array each text is an element as it is, any
    other value its JSON text, nulls are left out. NULL, blank text and JSON
    ``null`` give NULL. Text that is no JSON or no array gives NULL too, and a
    reject row: ``key``, ``column``, ``value``, ``reason``. Where the array
    column is there already, its value wins over the text; columns of the
    table that are missing are skipped. Native: one pass per output.
    """
    columns = {old: new for old, new in (columns or JSON_TEXT_COLUMNS).items() if old in df.columns}
    if not columns:
        schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(n, T.StringType())
                                                                             for n in ("column", "value", "reason")]])
        return df, schemas.empty(df.sparkSession, schema)

    def variant(old):
        return f"try_parse_json(`{old}`)"

    def array_of(old):
        return F.expr(f"""transform(filter(try_variant_get({variant(old)}, '$', 'array<variant>'),
                x -> x IS NOT NULL AND schema_of_variant(x) <> 'VOID'),
            x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN variant_get(x, '$', 'string') ELSE to_json(x) END)""")

    def reason(old):
        v = variant(old)
        return F.expr(f"""CASE WHEN trim(`{old}`) = '' OR `{old}` IS NULL THEN NULL WHEN {v} IS NULL THEN 'not JSON'
            WHEN schema_of_variant({v}) = 'VOID' OR startswith(schema_of_variant({v}), 'ARRAY') THEN NULL
            ELSE 'not an array' END""")
    rows = df
    for old, new in columns.items():
        value = F.coalesce(F.col(new), array_of(old)) if new in df.columns else array_of(old)
        rows = rows.withColumn(new, value)
    checked = F.array(*[F.struct(F.lit(old).alias("column"), F.col(old).alias("value"), reason(old).alias("reason"))
                        for old in columns])
    rejects = (df.select(key, F.explode(F.filter(checked, lambda x: x["reason"].isNotNull())).alias("r"))
               .select(key, "r.column", "r.value", "r.reason"))
    return rows.drop(*columns), rejects


# ---------------------------------------------------------------------- S1
def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct ``key`` values with their rank from 0, without a one-task
    window: Spark's range partitions are sorted and numbered on their own, and
    the sizes of the partitions before are added (one number per partition)."""
    from leadframe.session import materialize
    w = Window.partitionBy("_p").orderBy(key)
    d = df.select(key).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, key).select(key, F.spark_partition_id().alias("_p"))
    d = materialize(d, "file-ranges").withColumn("_i", F.row_number().over(w) - 1)
    before, offsets = 0, []
    for r in sorted(d.groupBy("_p").count().collect()):
        offsets.append((r[0], before))
        before += r[1]
    base = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_p int, _before long")
    return d.join(F.broadcast(base), "_p").select(key, (F.col("_before") + F.col("_i")).alias(out))   # a row per partition


WHOLE_BYTES = 4 << 20     # files beyond this are split over tasks


def read_people_json(spark: SparkSession, path: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """People JSON files: an object whose ``profiles`` holds the array, or
    a bare array; an empty or missing array reads as no rows, an element that
    is no object as none. Raw and mapped keys are both read; ``ingest_seq``
    keeps file order (file, position). A file of at most ``whole_bytes`` is
    one cell, a larger one is read split by split (``json_split``); the rows
    are the same either way."""
    from leadframe.sources.json_split import read_array_elements
    # names and sizes only (no content is read); numbered range by range, then joined by AQE's choice
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"),
                                                              F.col("_metadata.file_size").alias("_size"))
    files = numbered(names, "_file", "_fr")
    raw = (spark.read.text(path, wholetext=True).filter(F.col("_metadata.file_size") <= whole_bytes)
           .select("value", F.col("_metadata.file_path").alias("_file")).join(files, "_file"))
    # the shape from the first character: the whole file's schema would be put together for it
    v = raw.select("_fr", F.expr("try_parse_json(value)").alias("v"), F.col("value").rlike(r"^[\s\x{FEFF}]*+\[").alias("bare"))
    arr = F.expr("""filter(CASE WHEN bare THEN try_variant_get(v, '$', 'array<variant>')
                         ELSE try_variant_get(v, '$.profiles', 'array<variant>') END,
                       x -> startswith(schema_of_variant(x), 'OBJECT'))""")
    items = v.select("_fr", F.posexplode(arr).alias("_pos", "p"))
    if not names.filter(F.col("_size") > whole_bytes).isEmpty():
        large = read_array_elements(spark, path, whole_bytes).withColumnRenamed("file", "_file")
        items = items.unionByName(large.join(files, "_file").select("_fr", F.col("pos").alias("_pos"), "p"))
    fields = ([(f.name, f.name, f.dataType.simpleString()) for f in schemas.RAW_PROFILE.fields]
              + [(k, schemas.mapped(k), t.simpleString()) for k, t in schemas.MAPPED_KEYS]
              + [("source_name", "source_name", "string"), ("source_query", "source_query", "string")])
    cols = [F.expr(f"try_variant_get(p, '$.{k}', '{t}')").alias(n) for k, n, t in fields]
    return items.select(*cols, ((F.col("_fr").cast("long") * (1 << 32)) + F.col("_pos")).alias("ingest_seq"))


# ---------------------------------------------------------------------- S2
SEARCH_ITEM = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("link", T.StringType()),
    T.StructField("snippet", T.StringType()), T.StructField("htmlSnippet", T.StringType()),
    T.StructField("displayLink", T.StringType()),
    T.StructField("pagemap", T.StructType([T.StructField(
        "metatags", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])),
])
SEARCH_PAGE = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("total_results", T.LongType()),
    T.StructField("items", T.ArrayType(SEARCH_ITEM)), T.StructField("landed_seq", T.LongType()),
])


def flatten_search_pages(pages: DataFrame, max_results: int, page_size: int = 10) -> DataFrame:
    """Landed result pages -> one row per item.

    Pages are read in order from start=1 in steps of ``page_size``; reading
    stops at the first missing or empty page, after a page whose
    ``start + page_size`` passes ``total_results``, and at ``max_results``
    items per query. ``position = start + i``, ``page = (start-1)//size+1``.

    ``ingest_seq`` orders the items of all queries: by the first landing of
    the query, then the item's place in it (``landed_seq`` numbers landings
    and is unique; ``max_results`` is below 2^20).

    The per-query window sees one narrow row per landed page; the items are
    joined to the pages that count afterwards.
    """
    p = (pages.filter((F.col("start") >= 1) & (((F.col("start") - 1) % page_size) == 0))
         .withColumn("page_no", ((F.col("start") - 1) / page_size).cast("int")))
    # a page landed twice: the last landing wins (aggregate, map-side combined)
    p = (p.withColumn("n_items", F.coalesce(F.size("items"), F.lit(0)))
         .groupBy("query", "page_no")
         .agg(F.max_by(F.struct("start", "total_results", "n_items", "landed_seq"), F.col("landed_seq")).alias("pg"),
              F.min("landed_seq").alias("_landed"))
         .select("query", "page_no", "pg.*", "_landed"))
    w = Window.partitionBy("query").orderBy("page_no")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = (F.col("start") + page_size) > F.coalesce(F.col("total_results"), F.lit(0))
    ok = ((F.col("page_no") == F.row_number().over(w) - 1) & (F.col("n_items") > 0)
          & ~F.coalesce(F.lag(ended).over(w), F.lit(False)))
    p = (p.withColumn("_ok", F.min(ok.cast("int")).over(run))
         .withColumn("_before", F.coalesce(F.sum("n_items").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                           F.lit(0)))
         .withColumn("_query_seq", F.min("_landed").over(Window.partitionBy("query")))
         .filter((F.col("_ok") == 1) & (F.col("_before") < max_results))
         .select("query", "landed_seq", "page_no", "_before", "_query_seq"))
    it = (pages.select("query", "start", "landed_seq", "items").join(p, ["query", "landed_seq"])
          .filter((F.col("start") - 1) == F.col("page_no") * page_size)
          .select("query", "start", "page_no", "_before", "_query_seq", F.posexplode("items").alias("i", "google_result")))
    it = it.withColumn("item_index", (F.col("_before") + F.col("i")).cast("long")).filter(F.col("item_index") < max_results)
    return it.select(
        "google_result",
        F.struct((F.col("start") + F.col("i")).alias("position"), (F.col("page_no") + 1).alias("page"),
                 F.col("query").alias("query_used"),
                 (F.col("page_no") + 1).alias("api_call_number")).alias("search_metadata"),
        "item_index", (F.col("_query_seq") * (1 << 20) + F.col("item_index")).alias("ingest_seq"),
    )


# ---------------------------------------------------------------------- S3
def build_search_queries(terms: DataFrame, terms_col: str = "terms",
                         site: str = fixed.SEARCH_SITE) -> DataFrame:
    """S3: ``site:<host>/in "t1" "t2"`` per term list."""
    q = F.concat(F.lit(f"site:{site} "),
                 F.array_join(F.transform(F.col(terms_col), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " "))
    return terms.withColumn("query", q)


# ---------------------------------------------------------------------- S4
def _py_int_of(v: str) -> str:
    """SQL for Python ``int(x)`` of a variant value, 0 where int() fails."""
    t = f"schema_of_variant({v})"
    s = f"try_variant_get({v}, '$', 'string')"
    return f"""CASE
      WHEN {v} IS NULL THEN 0
      WHEN {t} IN ('TINYINT','SMALLINT','INT','BIGINT') THEN try_variant_get({v}, '$', 'bigint')
      WHEN {t} = 'BOOLEAN' THEN IF(try_variant_get({v}, '$', 'boolean'), 1, 0)
      WHEN {t} = 'DOUBLE' OR startswith({t}, 'DECIMAL') OR {t} = 'FLOAT'
        THEN coalesce(try_cast(try_variant_get({v}, '$', 'double') AS BIGINT), 0)
      WHEN {t} = 'STRING' AND {s} RLIKE '^[\\\\s]*[+-]?[0-9]+(_[0-9]+)*[\\\\s]*$'
        THEN coalesce(try_cast(regexp_replace(trim({s}), '_', '') AS BIGINT), 0)
      ELSE 0 END"""


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """The model-call log (JSON lines). Malformed lines and non-objects
    are dropped. ``tokens`` is what the usage report adds for the line:
    Python ``int(usage.total_tokens or 0)``, 0 where that fails."""
    return parse_call_log(spark.read.text(path))


def parse_call_log(lines: DataFrame) -> DataFrame:
    """S4 on a frame of text lines (column ``value``), batch or streaming."""
    v = lines.select(F.expr("try_parse_json(value)").alias("v")) \
        .filter(F.expr("startswith(schema_of_variant(v), 'OBJECT')"))
    s = lambda k: F.expr(f"try_variant_get(v, '$.{k}', 'string')").alias(k)
    falsy_provider = F.expr("""CASE WHEN v:provider IS NULL THEN NULL
        WHEN schema_of_variant(v:provider) = 'VOID' THEN NULL
        WHEN schema_of_variant(v:provider) = 'STRING' THEN nullif(try_variant_get(v, '$.provider', 'string'), '')
        WHEN schema_of_variant(v:provider) = 'BOOLEAN' THEN IF(try_variant_get(v, '$.provider', 'boolean'), 'True', NULL)
        WHEN schema_of_variant(v:provider) IN ('TINYINT','SMALLINT','INT','BIGINT','DOUBLE','FLOAT')
             OR startswith(schema_of_variant(v:provider), 'DECIMAL')
          THEN IF(try_variant_get(v, '$.provider', 'double') = 0, NULL, try_variant_get(v, '$.provider', 'string'))
        ELSE nullif(nullif(to_json(v:provider), '[]'), '{}') END""")
    usage = F.expr("""CASE WHEN v:usage IS NOT NULL AND startswith(schema_of_variant(v:usage), 'OBJECT')
                           THEN v:usage:total_tokens END""")
    return v.select(
        s("ts"), s("caller"), falsy_provider.alias("provider"), s("model"), s("operation"),
        s("prompt_name"), s("prompt_hash"), F.expr("try_variant_get(v, '$.duration_ms', 'bigint')").alias("duration_ms"),
        s("status"), s("error"), s("run_id"),
        F.expr("try_variant_get(v, '$.usage.prompt_tokens', 'bigint')").alias("prompt_tokens"),
        F.expr("try_variant_get(v, '$.usage.completion_tokens', 'bigint')").alias("completion_tokens"),
        usage.alias("_tt"),
        F.expr("to_json(v:extras)").alias("extras_json"),
    ).withColumn("tokens", F.expr(_py_int_of("_tt"))).drop("_tt")


# ---------------------------------------------------------------------- S5
def union_sources(sources) -> DataFrame:
    """Tag each frame with ``source_name`` and ``source_query`` and
    concatenate (bag union, missing columns NULL)."""
    out = None
    for df, name, query in sources:
        t = df.withColumn("source_name", F.lit(name)).withColumn("source_query", F.lit(query))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------- S6
def read_landed_companies(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed company rows (``Company, Company_Website, Company_Domain,
    address, phone, place_id``) from JSON lines or Parquet."""
    r = spark.read.schema(schemas.COMPANY_INPUT)
    df = r.json(path) if fmt == "json" else r.parquet(path)
    return df
