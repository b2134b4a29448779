"""Text column rules shared by all jobs.

Python's ``str.strip``/``split``, ``re`` flags and HTML unescaping differ from
Spark's defaults; these helpers give the Python behaviour with native column
expressions, and with two small Arrow UDFs where the JVM has no equivalent
(HTML entity decoding, NFKC). The UDFs only receive values that need them:
every other row passes NULL, so the Python side sees almost nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters Python's str.isspace() accepts.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A"
            r"\u2028\u2029\u202F\u205F\u3000]")


def rule(fn):
    """Memoise a column rule per JVM for plain arguments (names, numbers,
    rule sets). Building a rule tree costs thousands of py4j calls on the
    driver; a Column is an unresolved expression, so one built tree serves
    every frame of the session. Column arguments are not cached."""
    import functools
    cache = {}
    owner = [None]      # the application whose JVM holds the cached trees

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        try:
            from pyspark import SparkContext
            sc = SparkContext._active_spark_context
            app = sc.applicationId if sc is not None else None
            key = (args, tuple(sorted(kwargs.items())))
            hash(key)
        except TypeError:
            return fn(*args, **kwargs)
        if any(isinstance(a, Column) for a in args) or any(isinstance(v, Column) for v in kwargs.values()):
            return fn(*args, **kwargs)
        if owner[0] != app:
            cache.clear()
            owner[0] = app
        if key not in cache:
            cache[key] = fn(*args, **kwargs)
        return cache[key]
    return wrapper


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Reusing a Column object in several places copies its whole expression
    tree; binding it through ``transform(array(value), v -> body(v))``
    keeps one copy, so long rule chains stay small to plan and run."""
    return F.get(F.transform(F.array(value), body), 0)


def py_re(pattern: str, ignorecase: bool = False, multiline: bool = False) -> str:
    """Java flags that make ``pattern`` behave like Python's ``re`` on str:
    Unicode \\w \\d \\s \\b (U), only \\n ends a line (d), Unicode case folding."""
    flags = "Ud" + ("i" if ignorecase else "") + ("m" if multiline else "")
    return f"(?{flags}){pattern}"


def strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def squeeze(c) -> Column:
    """Python ``' '.join(s.split())``."""
    return F.regexp_replace(strip(c), WS_CLASS + "+", " ")


def nonempty(c) -> Column:
    """'' -> NULL (Python falsy string)."""
    return F.nullif(col_(c), F.lit(""))


def first_truthy(*cols) -> Column:
    """Python ``a or b or c`` over strings: '' and NULL both count as missing."""
    return F.coalesce(*[nonempty(c) for c in cols])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def ascii_lower(c) -> Column:
    """Lower-case ASCII letters only (SQLite ``lower``)."""
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col_(c), up, up.lower())


def sqlite_trim(c) -> Column:
    """SQLite ``trim``: blanks (U+0020) only."""
    return F.btrim(col_(c), F.lit(" "))


# --------------------------------------------------------------- Arrow UDFs
@F.pandas_udf(T.StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    import html
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else None)


@F.pandas_udf(T.StringType())
def _slug_udf(s: pd.Series) -> pd.Series:
    import unicodedata
    from urllib.parse import unquote
    return s.map(lambda v: unicodedata.normalize("NFKC", unquote(v))
                 if isinstance(v, str) else None)


# The two UDFs are pure, but marked non-deterministic on purpose: that
# keeps the optimizer from copying them into pushed-down filters or several
# collapsed projections, so each row reaches Python at most once and after
# any re-partitioning of the input.
_unescape_udf = _unescape_udf.asNondeterministic()
_slug_udf = _slug_udf.asNondeterministic()


def html_unescape(c) -> Column:
    """Python ``html.unescape``; only values holding '&' reach Python."""
    c = col_(c)
    return F.coalesce(_unescape_udf(F.when(c.contains("&"), c)), c)


def unquote_nfkc(c) -> Column:
    """Python ``unicodedata.normalize('NFKC', unquote(v))``; only values with
    '%' or non-ASCII characters reach Python."""
    c = col_(c)
    return F.coalesce(_slug_udf(F.when(c.rlike("[%\\x{80}-\\x{10FFFF}]"), c)), c)
