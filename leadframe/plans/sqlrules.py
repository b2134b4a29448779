"""SQL (DuckDB) statements of some column rules, used by the oracle queries.

They are an independent statement of the rule for the test inputs (ASCII
text), written against DuckDB's functions; the Spark side uses the column
rules in ``leadframe.functions``.
"""

from leadframe import fixed

DEGREE_RE = "(?i)^(?:" + "|".join(fixed.DEGREE_PREFIX_PATTERNS) + ")"


def n2(x: str) -> str:
    s = f"upper(trim({x}))"
    s2 = f"regexp_replace({s}, '\\+$', '')"
    return f"""(CASE WHEN {x} IS NULL OR {s} = '' THEN NULL
      WHEN regexp_matches({s2}, '^[0-9]+(\\.[0-9]+)?[KMB]?$') THEN CAST(round_even(
        CAST(regexp_extract({s2}, '^([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE)
        * CASE regexp_extract({s2}, '([KMB]?)$', 1) WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000
               WHEN 'B' THEN 1000000000 ELSE 1 END, 0) AS BIGINT)
      ELSE TRY_CAST(nullif(regexp_replace({s2}, '[^0-9]', '', 'g'), '') AS BIGINT) END)"""


def n3(x: str) -> str:
    return f"(CASE WHEN {n2(x)} IS NULL THEN NULL ELSE least({n2(x)}, 500) END)"


def url_host(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def url_path(x: str) -> str:
    path = f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return f"regexp_replace({path}, ';[^/]*$', '')"


def url_scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def n7(x: str) -> str:
    host = f"replace(replace(lower({url_host(x)}), 'www.', ''), 'de.linkedin.com', 'linkedin.com')"
    path = f"rtrim({url_path(x)}, '/')"
    slug = f"list_filter(string_split({path}, '/'), lambda s: s <> '')[2]"
    return f"""(CASE WHEN {x} IS NULL OR {x} = '' OR {host} = '' THEN NULL
      WHEN NOT contains({host}, 'linkedin.com') OR NOT starts_with({path}, '/in/') THEN NULL
      ELSE 'https://linkedin.com/in/' || lower(trim({slug})) END)"""


def v2(x: str) -> str:
    return (f"(coalesce({x} IS NOT NULL AND {url_scheme(x)} IN ('http', 'https') "
            f"AND contains(lower({url_host(x)}), 'linkedin.com') AND contains({url_path(x)}, '/in/'), false))")


def v3(x: str) -> str:
    t = f"trim({x})"
    return (f"(coalesce(length({t}) BETWEEN 2 AND 200 AND NOT starts_with({t}, 'http') "
            f"AND NOT starts_with({t}, 'www') AND NOT starts_with({t}, '@'), false))")


def degree(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return f"nullif(trim(regexp_extract({t}, '({DEGREE_RE})', 1)), '')"


def cleaned_name(x: str) -> str:
    t = f"trim(coalesce({x}, ''))"
    return f"trim(regexp_replace({t}, '{DEGREE_RE}', ''))"


def first_name(c: str) -> str:
    toks = f"list_filter(string_split({c}, ' '), lambda t: t <> '')"
    return (f"(CASE WHEN len({toks}) >= 2 THEN {toks}[1] "
            f"WHEN {c} <> '' THEN nullif(string_split({c}, ' ')[1], '') END)")


def last_name(c: str) -> str:
    toks = f"list_filter(string_split({c}, ' '), lambda t: t <> '')"
    return f"(CASE WHEN len({toks}) >= 2 THEN array_to_string({toks}[2:], ' ') END)"


def title_with_degree(title: str, deg: str) -> str:
    return (f"(CASE WHEN {deg} IS NULL OR {deg} = '' THEN {title} "
            f"WHEN {title} IS NOT NULL AND {title} <> '' THEN {title} || ' (' || {deg} || ')' "
            f"ELSE '(' || {deg} || ')' END)")


def apex(x: str, rules) -> str:
    """D1 in DuckDB SQL: longest public suffix over the same rule lists."""
    def lst(vals):
        return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in vals) + "]"
    t = f"lower(trim({x}))"
    u = f"(CASE WHEN starts_with({t}, 'http://') OR starts_with({t}, 'https://') THEN {t} ELSE 'http://' || {t} END)"
    rest = f"regexp_replace({u}, '^([a-z0-9+.-]+:)?//', '')"
    net = f"regexp_replace(regexp_extract({rest}, '^([^/?#]*)', 1), '^.*@', '')"
    labels = f"string_split(split_part({net}, ':', 1), '.')"
    suf = "array_to_string(lab[i + 1:], '.')"
    parent = "array_to_string(lab[i + 2:], '.')"
    below = "array_to_string(lab[i:], '.')"
    cond = f"list_contains({lst(rules.exact)}, {suf})"
    if rules.country_second:
        flat = f" AND NOT list_contains({lst(rules.country_flat)}, split_part({suf}, '.', 2))" if rules.country_flat else ""
        cond += (f" OR regexp_matches({suf}, '^[a-z]{{2}}$') OR (regexp_matches({suf}, '^[a-z]+\\.[a-z]{{2}}$')"
                 f" AND list_contains({lst(rules.country_second)}, split_part({suf}, '.', 1)){flat})")
    if rules.wildcard:
        cond += (f" OR (i + 1 < len(lab) AND list_contains({lst(rules.wildcard)}, {parent})"
                 + (f" AND NOT list_contains({lst(rules.exception)}, {suf})" if rules.exception else "") + ")")
    if rules.exception:
        cond += f" OR (i >= 1 AND list_contains({lst(rules.exception)}, {below}))"
    pos = f"list_position(list_transform(range(0, len(lab)), lambda i: coalesce({cond}, false)), true)"
    return f"""(SELECT CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL
        WHEN p >= 2 AND lab[p - 1] <> '' THEN lab[p - 1] || '.' || array_to_string(lab[p:], '.') END
      FROM (SELECT lab, {pos} AS p FROM (SELECT {labels} AS lab)))"""


def clean_company_name(x: str) -> str:
    n = f"trim(lower({x}))"
    for a, b in fixed.UMLAUT_REPLACEMENTS:
        n = f"replace({n}, '{a}', '{b}')"
    for s in fixed.NAME_LEGAL_SUFFIXES:
        n = f"replace(replace({n}, ' {s}', ''), ' & {s}', '')"
    n = f"trim(regexp_replace({n}, '[^a-z0-9\\s-]', '', 'g'))"
    return f"(CASE WHEN length({n}) BETWEEN 2 AND 50 THEN {n} END)"


def canonical_legal_form(x: str) -> str:
    t1 = f"regexp_replace(trim({x}), '^[\"'']+|[\"'']+$', '', 'g')"
    text = f"trim(regexp_replace({t1}, '\\s*\\([^)]*\\)\\s*', ' ', 'g'))"
    low = f"lower({text})"
    norm = f"replace(trim(regexp_replace(replace({low}, ',', ' '), '\\s+', ' ', 'g')), '& co kg', '& co. kg')"
    token = f"regexp_replace({low}, '[^a-z.]', '', 'g')"
    phrases = " ".join(f"WHEN contains({low}, '{p}') THEN '{s}'" for p, s in fixed.LEGAL_FORM_PHRASES)
    shorts_n = " ".join(f"WHEN {norm} = '{k}' THEN '{v}'" for k, v in fixed.LEGAL_FORM_SHORTS)
    shorts_t = " ".join(f"WHEN {token} = '{k}' THEN '{v}'" for k, v in fixed.LEGAL_FORM_SHORTS)
    return (f"(CASE WHEN {x} IS NULL OR {x} = '' THEN NULL {phrases} {shorts_n} {shorts_t} "
            f"ELSE nullif({text}, '') END)")


def legal_form_from_name(x: str) -> str:
    low = f"lower(trim({x}))"
    whens = " ".join(f"WHEN regexp_matches({low}, '{p}') THEN '{c}'"
                     for p, c in list(fixed.LEGAL_FORM_NAME_COMPOUND) + list(fixed.LEGAL_FORM_NAME_SIMPLE))
    return f"(CASE WHEN {x} IS NULL OR trim({x}) = '' THEN NULL {whens} END)"
