"""Free-text and metatag fact rules (X6-X19, X22-X24), as column expressions.

All patterns come from ``leadframe.fixed``; ``py_re`` gives them Python's
``re`` semantics on the JVM (Unicode classes, only '\\n' ends a line).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.names import _LINKEDIN_PIPE_TAIL
from leadframe.functions.text import (rule, WS_CLASS, col_, html_unescape, literal_array, py_re,
                                      strip)

# ------------------------------------------------------------------ X6 / X7
_BOILER = [py_re(p, ignorecase=True) for p in fixed.BOILERPLATE_PATTERNS]
_BULLETS = py_re(r"^[\s]*[" + fixed.BULLET_CHARS + r"]+\s*", multiline=True)


def _boiler_core(t: Column) -> Column:
    for p in _BOILER:
        t = F.regexp_replace(t, p, " ")
    t = F.regexp_replace(t, r"[ \t\xA0]{2,}", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


@rule
def remove_boilerplate(text) -> Column:
    """Drop the profile-site boilerplate sentences, squeeze blanks and
    runs of 3+ newlines, trim. Empty and NULL pass through."""
    t = col_(text)
    return F.when(t.isNull() | (t == ""), t).otherwise(_boiler_core(t))


def _normalize_core(t: Column, unescape: bool = True) -> Column:
    if unescape:
        t = html_unescape(t)
    t = F.translate(t, "\t\xa0", "  ")
    t = F.regexp_replace(t, _BULLETS, "")
    t = F.regexp_replace(t, " {2,}", " ")
    return strip(t)


@rule
def normalize_text(text) -> Column:
    """Unescape HTML entities, tab/nbsp to blank, strip bullet prefixes
    per line, squeeze blanks, trim. Empty and NULL pass through."""
    t = col_(text)
    return F.when(t.isNull() | (t == ""), t).otherwise(_normalize_core(t))


@rule
def clean_summary(text) -> Column:
    """X7(X6(text)) as used for the profile summary."""
    return normalize_text(remove_boilerplate(text))


# ---------------------------------------------------------------------- X8
@rule
def snippet_facts(snippet) -> Column:
    """struct(location, title, description) from a snippet."""
    s = col_(snippet)
    loc = F.coalesce(*[F.when(s.rlike(py_re(p)), strip(F.regexp_extract(s, py_re(p), 1)))
                       for p in fixed.SNIPPET_LOCATION_PATTERNS])
    title = F.coalesce(*[F.when(s.rlike(py_re(p)), strip(F.regexp_extract(s, py_re(p), 1)))
                         for p in fixed.SNIPPET_TITLE_PATTERNS])
    has = s.isNotNull() & (s != "")
    return F.struct(F.when(has, loc).alias("location"), F.when(has, title).alias("title"),
                    F.when(has, strip(s)).alias("description"))


# ----------------------------------------------------------------- X9..X12
def _tag(tag, key) -> Column:
    return strip(F.coalesce(tag[key], F.lit("")))


@rule
def meta_description(metatags) -> Column:
    """The last non-empty og:description."""
    descs = F.filter(F.transform(F.coalesce(col_(metatags), F.array()),
                                 lambda t: _tag(t, "og:description")), lambda d: d != "")
    return F.try_element_at(descs, F.lit(-1))


def _position_from_title(og: Column) -> Column:
    clean = F.regexp_replace(og, _LINKEDIN_PIPE_TAIL, "")
    seps = fixed.TITLE_SEPARATORS
    # only the first separator (in list order) present in the title is used
    after = None
    for sep in reversed(seps):
        part = strip(F.substring(clean, F.instr(clean, sep) + 1, 1 << 30))
        after = F.when(F.instr(clean, sep) > 0, part) if after is None else \
            F.when(F.instr(clean, sep) > 0, part).otherwise(after)
    chunk = strip(F.regexp_extract(after, "^([^|·•]*)", 1))
    return F.when((og != "") & (F.length(chunk) > 3), chunk)


@rule
def meta_position(metatags) -> Column:
    """Text after the first separator of og:title, up to the next
    ``|·•``; longer than 3 chars; first tag giving one."""
    c = F.filter(F.transform(F.coalesce(col_(metatags), F.array()),
                             lambda t: _position_from_title(_tag(t, "og:title"))),
                 lambda x: x.isNotNull())
    return F.get(c, 0)


_COMPANY_PATTERNS = [py_re(p, ignorecase=True, multiline=True) for p in fixed.META_COMPANY_PATTERNS]
_ONLY_NUMBERS = py_re(r"^[0-9+\s]+$")
_TAIL_AFTER_SEP = py_re(r"\s*[·•,].*$")


def _companies_in(desc: Column) -> Column:
    found = []
    for p in _COMPANY_PATTERNS:
        ms = F.transform(F.regexp_extract_all(desc, F.lit(p), 1), lambda m: strip(m))
        ms = F.filter(ms, lambda m: (F.length(m) > 2) & (F.length(m) < 100)
                      & ~F.lower(m).startswith("the ") & ~F.lower(m).startswith("a ")
                      & ~F.lower(m).startswith("an ") & ~m.rlike(_ONLY_NUMBERS))
        ms = F.filter(F.transform(ms, lambda m: strip(F.regexp_replace(m, _TAIL_AFTER_SEP, ""))),
                      lambda m: F.length(m) > 2)
        found.append(ms)
    return F.get(F.concat(*found), 0)


@rule
def meta_company(metatags) -> Column:
    """X11: company from og:description (4 patterns, all matches in order,
    quality filters); first tag giving one."""
    c = F.filter(F.transform(F.coalesce(col_(metatags), F.array()), lambda t: F.when(
        _tag(t, "og:description") != "", _companies_in(_tag(t, "og:description")))),
        lambda x: x.isNotNull())
    return F.get(c, 0)


_LOCATION_PATTERNS = [py_re(p, ignorecase=True) for p in fixed.META_LOCATION_PATTERNS]


def _location_in(desc: Column) -> Column:
    outs = []
    for p in _LOCATION_PATTERNS:
        loc = strip(F.regexp_extract(desc, p, 1))
        outs.append(F.when(desc.rlike(p) & (F.length(loc) > 2) & (F.length(loc) < 100), loc))
    return F.coalesce(*outs)


@rule
def meta_location(metatags) -> Column:
    """Location from og:description, first pattern with a 3..99 char
    hit; first tag giving one."""
    c = F.filter(F.transform(F.coalesce(col_(metatags), F.array()), lambda t: F.when(
        _tag(t, "og:description") != "", _location_in(_tag(t, "og:description")))),
        lambda x: x.isNotNull())
    return F.get(c, 0)


# ---------------------------------------------------------------- X13..X17
_EMAIL = py_re(fixed.EMAIL_PATTERN)
_URL = py_re(fixed.URL_PATTERN)
_BARE = py_re(fixed.BARE_DOMAIN_PATTERN)
_PHONE = py_re(fixed.PHONE_PATTERN)
_EXPERIENCE = [py_re(p, ignorecase=True) for p in fixed.EXPERIENCE_PATTERNS]
_SPLIT = py_re(fixed.SENTENCE_SPLIT)
_PROPER = py_re(fixed.PROPER_WORD)


@rule
def email_in(text) -> Column:
    """First e-mail address."""
    t = col_(text)
    return F.when(t.rlike(_EMAIL), F.regexp_extract(t, _EMAIL, 0))


def _excluded(u: Column, hosts) -> Column:
    return F.exists(literal_array(hosts), lambda h: F.lower(u).contains(h))


@rule
def website_in(text) -> Column:
    """First http(s) URL naming none of the excluded hosts; else the
    first bare domain (also not excluded) prefixed with https://."""
    t = col_(text)
    urls = F.filter(F.regexp_extract_all(t, F.lit(_URL), 0),
                    lambda u: ~_excluded(u, fixed.WEBSITE_EXCLUDED))
    bare = F.filter(F.regexp_extract_all(t, F.lit(_BARE), 0),
                    lambda u: ~_excluded(u, fixed.BARE_WEBSITE_EXCLUDED))
    return F.coalesce(F.get(urls, 0), F.concat(F.lit("https://"), F.get(bare, 0)))


@rule
def phone_in(text) -> Column:
    """The first phone-like match, kept only if it has 7+ digits."""
    t = col_(text)
    m = F.regexp_extract(t, _PHONE, 0)
    digits = F.length(F.regexp_replace(m, py_re(r"\D"), ""))
    return F.when(t.rlike(_PHONE) & (digits >= fixed.PHONE_MIN_DIGITS), strip(m))


@rule
def experience_years_in(text) -> Column:
    """Years from the first of 4 patterns that matches."""
    t = col_(text)
    return F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 1).try_cast("int"))
                        for p in _EXPERIENCE])


def salient_sentences(text, email: Column, website: Column, phone: Column) -> Column:
    """Sentences (split at .!? + blank, or newlines) that do not repeat
    the e-mail, website or phone found, and hold a digit or a capitalised
    word; distinct in order, first 5. NULL when none."""
    t = col_(text)
    site = F.replace(F.replace(website, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    sents = F.transform(F.split(t, _SPLIT), lambda s: strip(s))

    def keep(s):
        k = s != ""
        k = k & F.coalesce(~(email.isNotNull() & (email != "") & (F.instr(s, email) > 0)), F.lit(True))
        k = k & F.coalesce(~(site.isNotNull() & (site != "") & (F.instr(F.lower(s), site) > 0)),
                           F.lit(True))
        k = k & F.coalesce(~(phone.isNotNull() & (phone != "") & (F.instr(s, phone) > 0)), F.lit(True))
        return k & (s.rlike(py_re(r"\d")) | s.rlike(_PROPER))

    out = F.slice(F.array_distinct(F.filter(sents, keep)), 1, fixed.MAX_SALIENT)
    return F.when(F.size(out) > 0, out)


_JOIN_SEP = "\u0000"


def clean_sentences(sentences) -> Column:
    """X6 then X7 per sentence, drop those under 2 chars, distinct,
    first 5. The HTML unescape of X7 runs once on the joined array (the
    separator cannot come out of an entity), not per element."""
    arr = col_(sentences)
    items = F.transform(arr, lambda s: F.when(s == "", s).otherwise(_boiler_core(s)))
    items = F.split(html_unescape(F.array_join(items, _JOIN_SEP)), _JOIN_SEP)
    items = F.transform(items, lambda s: _normalize_core(s, unescape=False))
    out = F.slice(F.array_distinct(F.filter(items, lambda s: F.length(s) >= 2)), 1, fixed.MAX_SALIENT)
    return F.when(arr.isNotNull(), out)


# -------------------------------------------------------------------- X19
_FOLLOWERS = [py_re(p, ignorecase=True) for p in fixed.FOLLOWER_PATTERNS]
_CONNECTIONS = [py_re(p, ignorecase=True) for p in fixed.CONNECTION_PATTERNS]


@rule
def follower_count_in(snippet, html_snippet) -> Column:
    """X19 followers: per pattern, snippet then htmlSnippet; first hit."""
    texts = [F.coalesce(col_(snippet), F.lit("")), F.coalesce(col_(html_snippet), F.lit(""))]
    return F.coalesce(*[F.when(t.rlike(p), F.regexp_extract(t, p, 1))
                        for p in _FOLLOWERS for t in texts])


@rule
def connection_count_in(metatags) -> Column:
    """X19 connections: per tag's og:description, first pattern hit; the
    last tag with a hit wins."""
    def per_tag(tag):
        d = _tag(tag, "og:description")
        return F.coalesce(*[F.when(d.rlike(p), F.regexp_extract(d, p, 1)) for p in _CONNECTIONS])
    hits = F.filter(F.transform(F.coalesce(col_(metatags), F.array()), per_tag),
                    lambda x: x.isNotNull())
    return F.try_element_at(hits, F.lit(-1))


# --------------------------------------------------------------- X22 / X23
def _word_set(t: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(t), WS_CLASS + "+"), lambda w: w != ""))


def is_similar_text(t1, t2, threshold: float = 0.8) -> Column:
    """Word-set containment of the shorter text in the longer >= threshold;
    texts under 10 chars must be equal after trimming. On equal lengths the
    first text plays both parts (so two texts of one length count as similar)."""
    return is_similar_parts(similar_parts(col_(t1)), similar_parts(col_(t2)), threshold)


def similar_parts(t: Column) -> Column:
    """What X22 asks of one text: its length, its word set from 10 characters on, the trimmed text if that has fewer."""
    n = F.length(t)
    return F.struct(n.alias("chars"), F.when(n >= 10, _word_set(t)).alias("words"),
                    F.when(F.length(strip(t)) < 10, strip(t)).alias("short"))


def is_similar_parts(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """X22 on the ``similar_parts`` of both texts."""
    n, m = a["chars"], b["chars"]
    ws, wl = F.when(n <= m, a["words"]).otherwise(b["words"]), F.when(n >= m, a["words"]).otherwise(b["words"])
    ratio = F.size(F.array_intersect(ws, wl)) / F.size(ws)
    return (F.when(n.isNull() | m.isNull() | (n == 0) | (m == 0), F.lit(False))
            .when(F.least(n, m) < 10, F.coalesce(a["short"] == b["short"], F.lit(False)))
            .when(F.size(ws) == 0, F.lit(False))
            .otherwise(ratio >= threshold))


def unique_facts(meta_position_c, meta_company_c, meta_location_c, meta_desc_c,
                 snip_title, snip_company, snip_location, snip_desc) -> Column:
    """Metatag facts plus ``snippet_*`` facts that are not similar to
    them; values of 2 chars or less and description keys dropped. A missing
    metatag value is compared as the text 'None'."""
    def other(v, meta_v):
        return F.when(F.coalesce(v, F.lit("")) != "",
                      F.when(~is_similar_text(v, F.coalesce(meta_v, F.lit("None"))), v))
    m = F.create_map(
        F.lit("current_position"), meta_position_c, F.lit("company"), meta_company_c,
        F.lit("location"), meta_location_c,
        F.lit("snippet_title"), snip_title,
        F.lit("snippet_company"), other(snip_company, meta_company_c),
        F.lit("snippet_location"), other(snip_location, meta_location_c))
    return F.map_filter(m, lambda k, v: v.isNotNull() & (F.length(strip(v)) > 2))


# -------------------------------------------------------------------- X24
_X24_LABEL = py_re(r"(?:Experience|Berufserfahrung):\s*([^·•|\n]+)", ignorecase=True)
_X24_TITLE = py_re(r"(?<!former\s)(?<!previously\s)(?<!ex-)\b(?:at|bei|of|von)\s+"
                   r"([A-ZÄÖÜ][^·•|\n,;]*)")
_X24_SYMBOL = py_re(r"(?<!former\s)(?<!previously\s)(?<!ex-)(?:@|\|)\s*([A-ZÄÖÜ][^·•|\n,;]*)")


@rule
def company_from_text(text) -> Column:
    """The extraction prompt's company rules run as rules: after
    "Experience:"/"Berufserfahrung:"; else after at/bei/of/von, then after
    @ or |; skipped when "former", "previously" or "ex-" stands right before."""
    t = col_(text)
    outs = []
    for p in (_X24_LABEL, _X24_TITLE, _X24_SYMBOL):
        v = strip(F.regexp_extract(t, p, 1))
        outs.append(F.when(t.rlike(p) & (F.length(v) > 2), v))
    return F.coalesce(*outs)
