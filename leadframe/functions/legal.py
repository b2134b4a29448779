"""Company-name and legal-form column rules: D2, E2, E3, E4."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.text import rule, WS_CLASS, col_, py_re, strip


@rule
def clean_company_name(name, compat: bool = True) -> Column:
    """Lower-case, ä->ae ö->oe ü->ue ß->ss, drop legal suffixes, keep
    ``[a-z0-9\\s-]``, trim; NULL unless 2..50 chars.

    ``compat=True`` drops the suffixes as substrings, as the reference does
    ("acme agency" -> "acmeency"); ``compat=False`` drops whole words only.
    """
    n = strip(F.lower(col_(name)))
    for a, b in fixed.UMLAUT_REPLACEMENTS:
        n = F.replace(n, F.lit(a), F.lit(b))
    if compat:
        for suf in fixed.NAME_LEGAL_SUFFIXES:
            n = F.replace(F.replace(n, F.lit(" " + suf), F.lit("")), F.lit(" & " + suf), F.lit(""))
    else:
        alt = "|".join(s.replace("&", "\\&").replace(" ", "\\s") for s in fixed.NAME_LEGAL_SUFFIXES)
        n = F.regexp_replace(n, py_re(r"\s(?:&\s)?(?:" + alt + r")(?![\w])"), "")
    n = strip(F.regexp_replace(n, py_re(r"[^a-z0-9\s-]"), ""))
    return F.when((F.length(n) >= 2) & (F.length(n) <= 50), n)


def _lookup(pairs, key: Column) -> Column:
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, key)


@rule
def canonical_legal_form(raw) -> Column:
    """Quotes and ``(…)`` removed; known phrases (substring, in order)
    give their short form; then exact short forms (commas to blanks,
    ``& co kg`` -> ``& co. kg``); then the letters-and-dots token; else the
    cleaned text."""
    r = col_(raw)
    text = F.regexp_replace(strip(r), "^[\"']+|[\"']+$", "")
    text = strip(F.regexp_replace(text, py_re(r"\s*\([^)]*\)\s*"), " "))
    low = F.lower(text)
    phrase = F.coalesce(*[F.when(low.contains(p), F.lit(s)) for p, s in fixed.LEGAL_FORM_PHRASES])
    normalized = strip(F.regexp_replace(F.replace(low, F.lit(","), F.lit(" ")), WS_CLASS + "+", " "))
    normalized = F.replace(normalized, F.lit("& co kg"), F.lit("& co. kg"))
    token = F.regexp_replace(low, "[^a-z.]", "")
    out = F.coalesce(phrase, _lookup(fixed.LEGAL_FORM_SHORTS, normalized),
                     _lookup(fixed.LEGAL_FORM_SHORTS, token), F.nullif(text, F.lit("")))
    return F.when(r.isNotNull() & (r != ""), out)


@rule
def legal_form_from_name(name, fix_ek: bool = False) -> Column:
    """The legal form written in a company name: compound forms first,
    then simple ones. The reference's ``e.K.`` pattern cannot match; with
    ``fix_ek=True`` a working pattern is used instead."""
    low = F.lower(strip(col_(name)))
    rules = list(fixed.LEGAL_FORM_NAME_COMPOUND) + list(fixed.LEGAL_FORM_NAME_SIMPLE)
    if fix_ek:
        rules[-1] = (fixed.LEGAL_FORM_EK_FIXED, rules[-1][1])
    out = F.coalesce(*[F.when(low.rlike(py_re(p)), F.lit(c)) for p, c in rules])
    return F.when(low.isNotNull() & (low != ""), out)


@rule
def derive_legal_form(name, provided, fix_ek: bool = False) -> Column:
    """The form found in the name, else the canonical provided one."""
    return F.coalesce(legal_form_from_name(name, fix_ek), canonical_legal_form(provided))
