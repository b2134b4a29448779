"""Name and title column rules: X3, X4, X5 (names and headline from search
items), N4, N5, N6 (degree prefix, name split, title with degree), V3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.text import rule, col_, let, py_re, squeeze, strip

_LINKEDIN_PIPE_TAIL = py_re(r"\s*\|\s*LinkedIn.*$", ignorecase=True)
_LINKEDIN_SEP_TAIL = py_re(r"\s*[-|]\s*LinkedIn.*$", ignorecase=True)
_PARENS = py_re(r"\s*\([^)]*\)\s*")
_DEGREE = py_re("^(?:" + "|".join(fixed.DEGREE_PREFIX_PATTERNS) + ")", ignorecase=True)


def _len_between(c: Column, lo: int, hi: int) -> Column:
    """lo < len(c) < hi"""
    return (F.length(c) > lo) & (F.length(c) < hi)


@rule
def name_from_og_title(og_title) -> Column:
    """The og:title part of X3: cut ``| LinkedIn…``, keep the part before
    the first `` - ``; length 3..199."""
    t = F.regexp_replace(strip(col_(og_title)), _LINKEDIN_PIPE_TAIL, "")
    t = F.when(t.contains(" - "), strip(F.substring_index(t, " - ", 1))).otherwise(t)
    return F.when(_len_between(t, 2, 200), t)


@rule
def name_from_metatags(metatags) -> Column:
    """Per tag in order, ``profile:first_name`` + ``profile:last_name``;
    else the og:title name; the first tag giving one wins."""
    def per_tag(tag):
        first = strip(F.coalesce(tag["profile:first_name"], F.lit("")))
        last = strip(F.coalesce(tag["profile:last_name"], F.lit("")))
        og = strip(F.coalesce(tag["og:title"], F.lit("")))
        return (F.when((first != "") & (last != ""), F.concat(first, F.lit(" "), last))
                .when(og != "", name_from_og_title(og)))
    cands = F.filter(F.transform(F.coalesce(col_(metatags), F.array()), per_tag),
                     lambda x: x.isNotNull())
    return F.get(cands, 0)


@rule
def name_from_title(title) -> Column:
    """Cut ``[-|] LinkedIn…``, drop ``(…)``, keep the part before an en or
    em dash, squeeze blanks; length 3..199."""
    t = F.regexp_replace(col_(title), _LINKEDIN_SEP_TAIL, "")
    t = F.regexp_replace(t, _PARENS, " ")
    t = F.when(t.rlike("[–—]"), strip(F.regexp_extract(t, "^([^–—]*)", 1))).otherwise(t)
    t = squeeze(t)
    return F.when(_len_between(t, 2, 200), t)


def _quote(lit_col: Column) -> Column:
    """Quote a string for use as a literal inside a Java pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(lit_col, F.lit(r"\E"), F.lit(r"\E\\E\Q")),
                    F.lit(r"\E"))


def headline_from_title(title, name) -> Column:
    """Remove every ``name`` + separator from the title (case-insensitive);
    accept 4..199 chars; else the text after the first separator found, the
    separators tried in the order – — - |, first one longer than 3 chars."""
    title, name = col_(title), col_(name)
    clean = F.regexp_replace(title, _LINKEDIN_SEP_TAIL, "")
    pattern = F.concat(F.lit("(?iUd)"), _quote(name), F.lit(r"\s*[–—\-|]\s*"))
    removed = strip(F.regexp_replace(clean, pattern, F.lit("")))
    by_name = F.when(F.instr(clean, name) > 0, F.when(_len_between(removed, 3, 200), removed))
    fallbacks = []
    for sep in fixed.TITLE_SEPARATORS:
        after = strip(F.substring(clean, F.instr(clean, sep) + 1, 1 << 30))
        fallbacks.append(F.when((F.instr(clean, sep) > 0) & (F.length(after) > 3), after))
    out = F.coalesce(by_name, *fallbacks)
    return F.when(title.isNotNull() & (title != "") & name.isNotNull() & (name != ""), out)


@rule
def degree_prefix(full_name) -> Column:
    """The first matching degree prefix as written (trimmed), or NULL."""
    text = strip(F.coalesce(col_(full_name), F.lit("")))
    return F.nullif(strip(F.regexp_extract(text, "(" + _DEGREE + ")", 1)), F.lit(""))


@rule
def strip_degree(full_name) -> Column:
    """The name with one degree prefix removed, trimmed."""
    text = strip(F.coalesce(col_(full_name), F.lit("")))
    return strip(F.regexp_replace(text, _DEGREE, ""))


@rule
def split_name(cleaned) -> tuple[Column, Column]:
    """(first, last): tokens on single blanks; one token -> last NULL."""
    def tokens(c):
        return F.filter(F.split(c, " "), lambda t: t != "")

    def first_of(c):
        return let(tokens(c), lambda toks: F.when(F.size(toks) >= 2, F.get(toks, 0)).otherwise(
            F.when(c != "", F.nullif(F.split(c, " ").getItem(0), F.lit("")))))

    def last_of(c):
        return let(tokens(c), lambda toks: F.when(
            F.size(toks) >= 2, F.array_join(F.slice(toks, 2, F.size(toks) - 1), " ")))
    return let(col_(cleaned), first_of), let(col_(cleaned), last_of)


@rule
def title_with_degree(title, degree) -> Column:
    """``title (degree)``, or ``(degree)`` when the title is empty."""
    def body(t, d):
        wrapped = F.concat(F.lit("("), d, F.lit(")"))
        return (F.when(d.isNull() | (d == ""), t)
                .when(t.isNotNull() & (t != ""), F.concat(t, F.lit(" "), wrapped))
                .otherwise(wrapped))
    return let(col_(degree), lambda d: let(col_(title), lambda t: body(t, d)))


@rule
def is_valid_name(name) -> Column:
    """V3: trimmed length 2..200 and not starting with http, www or @."""
    n = strip(col_(name))
    return F.coalesce((F.length(n) >= 2) & (F.length(n) <= 200)
                      & ~n.startswith("http") & ~n.startswith("www") & ~n.startswith("@"),
                      F.lit(False))
