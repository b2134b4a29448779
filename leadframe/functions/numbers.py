"""Number column rules: shorthand integers (N2) and capped connections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.text import rule, col_, let, strip


@rule
def parse_int_shorthand(value) -> Column:
    """``'1.2K'`` -> 1200, ``'500+'`` -> 500, ``'1,234'`` -> 1234.

    Trimmed and upper-cased, one trailing '+' dropped; ``n[.n][KMB]`` is
    scaled and rounded half to even; otherwise all digits are concatenated;
    NULL if there are none. LONG, since ``B`` exceeds INT.
    """
    factors = F.create_map(*[x for k, v in fixed.SHORTHAND_FACTORS.items() for x in (F.lit(k), F.lit(v))])

    def on_s(s):
        num = F.regexp_extract(s, fixed.SHORTHAND_PATTERN, 1).try_cast("double")
        suf = F.regexp_extract(s, fixed.SHORTHAND_PATTERN, 2)
        scaled = F.bround(num * F.coalesce(F.try_element_at(factors, suf), F.lit(1)), 0).try_cast("long")
        digits = F.nullif(F.regexp_replace(s, r"\P{Nd}", ""), F.lit(""))
        return (F.when(s == "", F.lit(None).cast("long"))
                .when(s.rlike(fixed.SHORTHAND_PATTERN), scaled)
                .otherwise(digits.try_cast("long")))

    v = col_(value)
    s = F.regexp_replace(F.upper(strip(v.cast("string"))), r"(?d)\+$", "")
    return F.when(v.isNotNull(), let(s, on_s))


@rule
def parse_connections(value) -> Column:
    """Shorthand integer capped at 500; NULL stays NULL."""
    return let(parse_int_shorthand(value),
               lambda p: F.when(p.isNotNull(), F.least(p, F.lit(fixed.CONNECTIONS_CAP).cast("long"))))
