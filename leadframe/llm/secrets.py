"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Base kinds are fixed patterns; a generic pattern adds candidates. All candidate
values are hashed and aggregated over the corpus by distinct owner and
repository: a value that several owners hold, or that one owner holds in many
of its repositories, is a widely copied example; a value of one owner in few
repositories looks live. Base spans always stay (both counts are reported beside
them); a generic candidate becomes a span only if it looks live and overlaps no
base span.

Spans come from two built-ins that walk the same matches: the parts between
them (split) and the matches themselves (regexp_extract_all); running lengths
give code point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import Scratch

KINDS = ("assign", "access", "hex", "owned")
_WORDS = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
          "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
# pattern, group that holds the value, least length of that group
PATTERNS = {
    "assign": ("(" + _WORDS + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("(AKIA[A-Z0-9]+)", 1, 20),
    "hex": ("([0-9a-f]{24,})", 1, 24),      # a run is maximal either way, so this equals [0-9a-f]+ of 24 or more
    "owned": ("([A-Za-z0-9_-]{20,})", 1, 20),
}
MIN_DIGITS = MIN_LETTERS = 4    # of a generic candidate
MAX_OWNERS, MAX_REPOS = 1, 2    # owners and repositories of a value that still looks live

SPAN = "array<struct<start:int,kind:int,end:int,vh:bigint>>"


def spans_of(text: Column, kind: str) -> Column:
    """All matches of a kind: array of (start, kind number, end, value hash)."""
    pattern, group, least = PATTERNS[kind]
    parts = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("part"), hits.alias("hit"), values.alias("value"))
    number = KINDS.index(kind)

    def step(acc, x):
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"),
                        F.xxhash64(x["value"]).alias("vh"))
        keep = F.length(x["value"]) >= least
        if kind == "owned":
            letters = F.regexp_replace(x["value"], "[^A-Za-z]", "")
            digits = F.regexp_replace(x["value"], "[^0-9]", "")
            keep = keep & (F.length(letters) >= MIN_LETTERS) & (F.length(digits) >= MIN_DIGITS)
        got = F.when(keep, F.concat(acc["got"], F.array(span))).otherwise(acc["got"])
        return F.struct(end.alias("at"), got.alias("got"))

    empty = F.array().cast(SPAN)
    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("got")), step, lambda acc: acc["got"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def span_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 owner_cols: tuple = ("source",), repo_cols: tuple = ("source", "lang")) -> DataFrame:
    """Return per row: ``id_col``, base and added (arrays of spans), n_live, n_shared, max_owners, max_repos.

    ``base`` holds the fixed kinds, ``added`` the generic spans that look live;
    ``n_live`` and ``n_shared`` count all candidates by whether at most
    MAX_OWNERS owners and MAX_REPOS repositories hold their value; the maxima
    are over the row's candidates (0 without any). An owner is the value of
    ``owner_cols``, a repository that of ``repo_cols``; null counts as a value.
    Null text is empty, texts of any length are read whole; repeated rows are
    scanned separately but count one owner; an empty table gives no rows; other
    columns aren't read.
    """
    s = Scratch(df.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def name(cols):
        return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))])

    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), name(owner_cols).alias("owner"),
                     name(repo_cols).alias("repo"))
    rows = rows.select("id", "owner", "repo", F.concat(*[spans_of(F.col("text"), k) for k in KINDS[:3]]).alias("base"),
                       spans_of(F.col("text"), "owned").alias("owned"), F.monotonically_increasing_id().alias("rid"))
    apart = F.filter("owned", lambda o: ~F.exists(
        F.col("base"), lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    found = s.put(rows.select("id", "owner", "repo", "rid", "base", apart.alias("owned")), "found")
    cand = (found.select("rid", "owner", "repo", F.explode(F.concat("base", "owned")).alias("c"))
            .select("rid", "owner", "repo", F.col("c.vh").alias("vh"), "c"))
    held = cand.select("vh", "owner", "repo").distinct()
    owners = (held.groupBy("vh", "owner").agg(F.count("*").alias("repos"))
              .groupBy("vh").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos")))
    owners = s.put(owners, "owners")
    live = (F.col("owners") <= MAX_OWNERS) & (F.col("repos") <= MAX_REPOS)
    per_row = (cand.join(owners, "vh").groupBy("rid")
               .agg(F.collect_list(F.when(live & (F.col("c.kind") == 3), F.col("c"))).alias("added"),
                    F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_shared"),
                    F.max("owners").alias("max_owners"), F.max("repos").alias("max_repos")))
    zero = F.lit(0).cast("long")
    return found.join(per_row, "rid", "left").select(
        F.col("id").alias(id_col), "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"),
        *[F.coalesce(c, zero).alias(c) for c in ("n_live", "n_shared", "max_owners", "max_repos")])
