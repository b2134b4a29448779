"""URL column rules: canonical profile URL (X1), profile key (N7), profile URL
predicate (V2), host and apex (registrable) domain (D1).

Python's ``urlsplit`` is lenient where ``parse_url`` is strict (spaces, no
scheme), so the split is a regex with the same precedence: scheme up to the
first ':' if it is a valid scheme, '//' starts the authority, path runs to the
first '?' or '#'. ``;params`` of the last path segment are cut, as ``urlparse``
does for the web schemes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.text import rule, col_, let, strip, unquote_nfkc

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _prep(url: Column) -> Column:
    # urlsplit drops leading C0 controls / blanks and every tab, CR and LF.
    u = F.regexp_replace(url, r"^[\x00-\x20]+", "")
    return F.translate(u, "\t\r\n", "")


def url_parts(url) -> tuple[Column, Column, Column]:
    """(scheme lowered, netloc, path without ;params) like Python ``urlparse``; '' when absent."""
    return _parts_of(_prep(col_(url)))


def _parts_of(u: Column) -> tuple[Column, Column, Column]:
    """url_parts of an already prepared (and bound) URL."""
    return (F.lower(F.regexp_extract(u, _SPLIT, 1)), F.regexp_extract(u, _SPLIT, 2),
            F.regexp_replace(F.regexp_extract(u, _SPLIT, 3), ";[^/]*$", ""))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


@rule
def canonical_profile_url(link) -> Column:
    """Canonical search-item URL, NULL if not a profile URL.

    Query and fragment dropped; must contain the profile host pattern; the
    ``de.``/``www.`` host variants and ``http://`` are rewritten; only
    ``/in/{slug}`` is kept, slug case kept.
    """
    link = col_(link)

    def on_clean(clean):
        is_profile = F.lit(False)
        for p in fixed.PROFILE_URL_PATTERNS:
            is_profile = is_profile | F.lower(clean).contains(p)
        c2 = F.replace(F.replace(clean, F.lit("de.linkedin.com"), F.lit("linkedin.com")),
                       F.lit("www.linkedin.com"), F.lit("linkedin.com"))

        def on_c3(c3):
            parts = _segments(url_parts(c3)[2])
            slug_form = F.when((F.size(parts) >= 2) & (F.get(parts, 0) == "in"),
                               F.concat(F.lit(fixed.PROFILE_CANONICAL_PREFIX), F.get(parts, 1)))
            return F.when(is_profile, F.coalesce(slug_form, c3))
        return let(F.when(c2.startswith("https://"), c2).otherwise(
            F.replace(c2, F.lit("http://"), F.lit("https://"))), on_c3)

    def on_url(u):
        scheme, netloc, path = _parts_of(u)
        return let(F.concat(scheme, F.lit("://"), netloc, path), on_clean)
    return F.when(link.isNotNull() & (link != ""), let(_prep(link), on_url))


@rule
def profile_slug(url) -> Column:
    """The JVM part of N7: the raw slug when the URL is a profile URL, else
    NULL. Plain expressions only (no lambda binding): its result feeds an
    Arrow UDF, which cannot take arguments that hold lambdas."""
    url = col_(url)
    _, netloc, path = url_parts(url)
    host = F.replace(F.replace(F.lower(netloc), F.lit("www."), F.lit("")),
                     F.lit("de.linkedin.com"), F.lit("linkedin.com"))
    path = F.regexp_replace(path, "/+$", "")
    ok = (url.isNotNull() & (url != "") & (host != "")
          & host.contains(fixed.PROFILE_SITE) & path.startswith("/in/"))
    return F.when(ok, F.get(_segments(path), 1))


@rule
def key_from_slug(slug) -> Column:
    """The rest of N7 on a slug column: decode, NFKC, trim, lower, drop
    zero-width characters, prefix."""
    slug = col_(slug)
    s = F.translate(F.lower(strip(unquote_nfkc(slug))), "\u200b\u200c\u200d", "")
    return F.when(slug.isNotNull(), F.concat(F.lit(fixed.PROFILE_CANONICAL_PREFIX), s))


def profile_key(url) -> Column:
    """``https://linkedin.com/in/{slug}`` with the slug percent-decoded,
    NFKC-normalised, stripped, lower-cased and zero-width characters removed;
    NULL when the URL is not a profile URL. A profile URL without a slug has
    none either."""
    return key_from_slug(profile_slug(url))


def with_profile_key(df, url_col: str, out_col: str):
    """N7 as two projections: the slug (JVM only) first, then the decoding
    step that may call Python. Cheaper to plan and run than the one-column
    rule, and the Arrow UDF sees a plain column."""
    return (df.withColumns({"_pk_slug": profile_slug(F.col(url_col))})
            .withColumns({out_col: key_from_slug(F.col("_pk_slug"))}).drop("_pk_slug"))


@rule
def is_profile_url(url) -> Column:
    """V2: scheme http(s), host contains the site, path contains ``/in/``."""
    url = col_(url)
    scheme, netloc, path = url_parts(url)
    return F.coalesce(url.isNotNull() & scheme.isin("http", "https")
                      & F.lower(netloc).contains(fixed.PROFILE_SITE)
                      & path.contains("/in/"), F.lit(False))


@rule
def host_of(url_or_domain) -> Column:
    """Host as the apex rule sees it: trimmed, lower-cased, scheme added when
    missing, userinfo and port removed."""
    def from_text(t):
        u = F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(
            F.concat(F.lit("http://"), t))
        rest = F.regexp_replace(u, r"^([a-z0-9+.\-]+:)?//", "")
        net = F.regexp_extract(rest, r"^([^/?#]*)", 1)
        net = F.regexp_replace(net, r"^.*@", "")
        net = F.translate(net, "\u3002\uff0e\uff61", "...")
        return F.substring_index(net, ":", 1)
    return let(F.lower(strip(col_(url_or_domain))), from_text)


@rule
def apex_domain(url_or_domain, rules) -> Column:
    """Registrable domain (one label left of the longest public suffix),
    NULL when there is none (IP address, single label, unknown suffix).

    ``rules`` is a :class:`leadframe.sources.suffixes.SuffixRules`; its
    sets are bounded parameter lists, evaluated as hashed ``IN`` sets inside
    the expression, so this rule needs no join and no shuffle. Intermediate
    values are bound once (``let``) to keep the expression small.
    """
    src = col_(url_or_domain)

    def on_labels(labels):
        n = F.size(labels)

        def suffix_at(i):
            return F.array_join(F.slice(labels, i + 1, n - i), ".")

        def is_suffix(i):
            def on_s(s):
                cond = s.isin(*rules.exact) if rules.exact else F.lit(False)
                if rules.country_second:
                    second = F.split(s, r"\.")
                    country = F.get(second, F.size(second) - 1)
                    listed = F.get(second, 0).isin(*rules.country_second)
                    if rules.country_flat:
                        listed = listed & ~country.isin(*rules.country_flat)
                    cond = cond | s.rlike("^[a-z]{2}$") | (s.rlike(r"^[a-z]+\.[a-z]{2}$") & listed)
                if rules.wildcard:
                    wc = (i + 1 < n) & suffix_at(i + 1).isin(*rules.wildcard)
                    if rules.exception:
                        wc = wc & ~s.isin(*rules.exception)
                    cond = cond | wc
                if rules.exception:
                    below = F.when(i >= 1, suffix_at(F.greatest(i - 1, F.lit(0))).isin(*rules.exception))
                    cond = cond | F.coalesce(below, F.lit(False))
                return F.coalesce(cond, F.lit(False))
            return let(suffix_at(i), on_s)

        def on_pos(pos):
            label = F.get(labels, (pos - 2).cast("int"))
            suffix = F.array_join(F.slice(labels, pos.cast("int"), (n - pos + 1).cast("int")), ".")
            return F.when((pos >= 2) & (label != ""), F.concat(label, F.lit("."), suffix))

        flags = F.transform(F.sequence(F.lit(0), n - 1), is_suffix)
        return let(F.array_position(flags, True), on_pos)

    out = let(F.split(host_of(src), r"\.", -1), on_labels)
    return F.when(src.isNotNull() & (strip(src) != ""), out)
