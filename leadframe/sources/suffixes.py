"""Public-suffix rules for the apex-domain rule.

The rules are a parameter: pass the official list (``load_suffix_rules``
reads the standard file format, without the country rule) or use the built-in
default below. A host under no suffix has no apex domain, so it is never merged
with another. ``load_suffix_rules`` reads a short file on the driver, and the
rule runs inside executors as hashed IN-sets; ``read_suffix_table`` reads a list
of any length with Spark, for the join in ``operators.domains``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default in the standard list format: generic suffixes, and one wildcard
# with its exception. Countries follow by rule (below): any two letters are a
# suffix, and so is a common second level under them.
DEFAULT_RULES_TEXT = """
com
net
org
edu
gov
mil
int
info
biz
name
pro
app
dev
tech
online
site
shop
store
cloud
agency
company
consulting
digital
email
group
gmbh
global
ltd
live
media
network
news
one
services
solutions
space
studio
systems
team
today
website
work
world
xyz
berlin
hamburg
koeln
cologne
bayern
ruhr
saarland
wien
tirol
paris
london
nyc
tokyo
amsterdam
swiss
asia
africa
ltd.uk
plc.uk
me.uk
sch.uk
asso.fr
tm.fr
in.th
in.ua
kiev.ua
com.de
*.ck
!www.ck
"""

# Second levels that registries of many countries use.
COUNTRY_SECOND = ("com", "co", "net", "org", "edu", "gov", "mil", "ac", "or", "ne", "go", "gob", "gouv", "nom")
# Countries that register names directly below the country, also under these labels.
COUNTRY_FLAT = ("de", "ch", "nl", "be", "dk", "se", "fi", "cz", "eu", "us", "ca", "li", "ie", "sk")


@dataclass(frozen=True)
class SuffixRules:
    exact: tuple = field(default_factory=tuple)
    wildcard: tuple = field(default_factory=tuple)    # parents of "*." rules
    exception: tuple = field(default_factory=tuple)   # names after "!"
    country_second: tuple = field(default_factory=tuple)  # non-empty: two letters are a suffix, and these below them
    country_flat: tuple = field(default_factory=tuple)    # countries without such second levels


def parse_suffix_rules(text: str) -> SuffixRules:
    exact, wildcard, exception = [], [], []
    for raw in text.splitlines():
        line = raw.strip().split()[0] if raw.strip() else ""
        if not line or line.startswith("//"):
            continue
        line = line.lower()
        if line.startswith("!"):
            exception.append(line[1:])
        elif line.startswith("*."):
            wildcard.append(line[2:])
        else:
            exact.append(line)
    return SuffixRules(tuple(dict.fromkeys(exact)), tuple(dict.fromkeys(wildcard)),
                       tuple(dict.fromkeys(exception)))


def load_suffix_rules(path: str | None = None) -> SuffixRules:
    """Rules from a file in the public-suffix list format, or the default."""
    if path is None:
        return DEFAULT_RULES
    with open(path, encoding="utf-8") as fh:
        return parse_suffix_rules(fh.read())


def read_suffix_table(spark: SparkSession, path: str) -> DataFrame:
    """Rules (name, kind) from files in the public-suffix list format, each once."""
    return suffix_table(spark.read.text(path))


def suffix_table(lines: DataFrame) -> DataFrame:
    """Rules (name, kind) from lines (column ``value``); kind: exact, wildcard or exception.

    Comments, blank and null lines give none; what follows a space is no part of a rule.
    """
    line = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    rule = lines.select(line.alias("r")).filter((F.col("r") != "") & ~F.startswith("r", F.lit("//")))
    kind = F.when(F.startswith("r", F.lit("!")), "exception").when(F.startswith("r", F.lit("*.")), "wildcard").otherwise("exact")
    return rule.select(F.regexp_replace("r", r"^(!|\*\.)", "").alias("name"), kind.alias("kind")).distinct()


DEFAULT_RULES = replace(parse_suffix_rules(DEFAULT_RULES_TEXT), country_second=COUNTRY_SECOND,
                        country_flat=COUNTRY_FLAT)
