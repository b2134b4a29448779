"""Domain jobs.

D1 is a column rule (``functions.urls.apex_domain``) for a short rule list, and
a join with a suffix table for a long one (``with_apex_domain_by_table``): the
hosts are made distinct first, so the join's work is that of the hosts, not of
the rows, and the plan stays the same for any number of rules. Guesses (D3) are built inside the row as an
ordered, de-duplicated array, so only the join with the live-domain table
(D4) shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe import fixed
from leadframe.functions.legal import clean_company_name
from leadframe.functions.text import first_truthy, nonempty, strip
from leadframe.functions.urls import apex_domain, host_of
from leadframe.session import fits_broadcast, materialize
from leadframe.sources.suffixes import DEFAULT_RULES


def with_apex_domain(df: DataFrame, col: str, out: str = "apex_domain", rules=DEFAULT_RULES) -> DataFrame:
    """Add the registrable domain of ``col``."""
    return df.withColumn(out, apex_domain(F.col(col), rules))


def apex_of_hosts(hosts: DataFrame, rules: DataFrame, country_second=(), country_flat=()) -> DataFrame:
    """D1 for distinct hosts (column ``host``): rows (host, apex), without the hosts that have none.

    ``rules``: rows (name, kind), kind ``exact``, ``wildcard`` (name: what
    follows ``*.``) or ``exception`` (``sources.suffixes.read_suffix_table``).
    Each host gives its trailing names, as many labels as the longest rule has;
    those that the table lists are its suffix candidates, and the longest wins:

    * an exact name is a suffix; the name one label longer than a wildcard's is
      one, but for an exception; an exception's suffix is one label shorter;
    * ``country_second`` / ``country_flat``: the country rule of
      ``SuffixRules``, none when empty.

    A name that most hosts share (``com``) is a hot key only if the table is too
    large for a broadcast by its bytes; then AQE splits it. No rules: no rows
    but by the country rule.
    """
    longest = rules.agg(F.max(F.size(F.split("name", r"\."))).alias("n")).first()["n"] or 1       # one row
    labels, n = F.split("host", r"\.", -1), F.size("labels")
    names = (hosts.select("host", labels.alias("labels"))
             .select("host", n.alias("n"), F.explode(F.transform(
                 F.sequence(F.greatest(n - max(longest, 2), F.lit(0)), n - 1),
                 lambda i: F.struct(i.alias("i"), F.array_join(F.slice("labels", i + 1, n - i), ".").alias("name")))).alias("x"))
             .select("host", "n", "x.*"))
    found = names.join(rules.select("name", "kind").distinct(), "name").select("host", "n", "i", "kind")
    if country_second:
        second = F.split("name", r"\.")
        listed = F.get(second, F.lit(0)).isin(*country_second)
        if country_flat:
            listed = listed & ~F.get(second, F.size(second) - 1).isin(*country_flat)
        country = F.col("name").rlike("^[a-z]{2}$") | (F.col("name").rlike(r"^[a-z]+\.[a-z]{2}$") & listed)
        found = found.unionByName(names.filter(country).select("host", "n", "i", F.lit("exact").alias("kind")))
    # at most as many positions a host as the longest rule has labels
    kind, i = F.col("kind"), F.col("i")
    at = found.groupBy("host").agg(
        F.min(F.when(kind == "exact", i).when((kind == "exception") & (i + 1 < F.col("n")), i + 1)).alias("sure"),
        F.collect_set(F.when((kind == "wildcard") & (i >= 1), i - 1)).alias("wild"),
        F.collect_set(F.when(kind == "exception", i)).alias("excepted"))
    first = F.least("sure", F.array_min(F.array_except("wild", "excepted")))
    return (at.select("host", first.alias("i"), labels.alias("labels"))
            .filter((F.col("i") >= 1) & (F.get("labels", F.col("i") - 1) != ""))
            .select("host", F.array_join(F.slice("labels", F.col("i"), n - F.col("i") + 1), ".").alias("apex")))


def with_apex_domain_by_table(df: DataFrame, col: str, rules: DataFrame, out: str = "apex_domain",
                              country_second=(), country_flat=()) -> DataFrame:
    """D1 with the rules as a table, see ``apex_of_hosts``; equal to ``with_apex_domain`` row by row.

    The hosts' domains are written once, so the planner knows their bytes: under
    the broadcast threshold the rows stay where they are, beyond it they cross
    the network once, and AQE splits a hot host's rows (both sides of the join
    are shuffles then, not the aggregate's own partitions). Null and blank values, and hosts under no rule, get NULL; repeated rows stay.
    """
    host, apex = _unused("host", df), _unused("apex", df)
    rows = df.withColumn(host, F.when(strip(F.col(col)) != "", host_of(F.col(col))))
    hosts = rows.filter(F.col(host).isNotNull()).select(F.col(host).alias("host")).distinct()
    found = materialize(apex_of_hosts(hosts, rules, country_second, country_flat), "host-domains")
    joined = rows.join(found.select(F.col("host").alias(host), F.col("apex").alias(apex)), host, "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col(apex).alias(out))


def _unused(name: str, df: DataFrame) -> str:
    """``name`` with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def guess_list(name_col, compat: bool = True):
    """D3 as a column: the ordered distinct guesses for one name."""
    clean = clean_company_name(name_col, compat)
    forms = {"raw": clean, "joined": F.replace(clean, F.lit(" "), F.lit("")),
             "dashed": F.replace(clean, F.lit(" "), F.lit("-"))}
    arr = F.array(*[F.concat(forms[f], F.lit("." + tld)) for f, tld in fixed.DOMAIN_GUESS_ORDER])
    return F.when(clean.isNotNull(), F.array_distinct(arr))


def domain_candidates(companies: DataFrame, key: str, name: str, compat: bool = True) -> DataFrame:
    """D3: one row per (company, guess) with its rank (1 = first tried)."""
    return (companies.select(key, F.posexplode(guess_list(F.col(name), compat)).alias("pos", "domain"))
            .select(key, (F.col("pos") + 1).alias("rank"), "domain"))


FILTER_BLOCKS = 1 << 20     # 64-bit blocks of the live filter at most: 16 MB of rows


def _bits(domain):
    """Three bits of a 64-bit block for a domain; the block's number comes from the hash's other bits."""
    h = F.xxhash64(domain)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int"))
            for i in range(3)]
    return h, bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def probably_live(candidates: DataFrame, live: DataFrame) -> DataFrame:
    """The candidates whose ``domain`` passes a Bloom filter of the live domains: no live one is lost.

    The filter is a table (block, bits) built by aggregation, a block per four
    live domains and at most FILTER_BLOCKS, so it may be broadcast whatever the
    number of domains; beyond four million it lets more dead guesses pass.
    Null domains, and all of them if ``live`` is empty, go.
    """
    blocks = min(FILTER_BLOCKS, 1 << max(0, (live.count() // 4).bit_length()))
    hashed, bits = _bits(F.col("domain"))
    block = F.shiftrightunsigned(hashed, 32).bitwiseAND(blocks - 1)
    table = (live.filter("domain IS NOT NULL").select(block.alias("_block"), bits.alias("_bits"))
             .groupBy("_block").agg(F.bit_or("_bits").alias("_held")))
    probe = candidates.filter("domain IS NOT NULL").withColumn("_block", block).withColumn("_bits", bits)
    return (probe.join(F.broadcast(table), "_block")        # at most FILTER_BLOCKS rows
            .filter(F.col("_bits").bitwiseAND(F.col("_held")) == F.col("_bits")).select(*candidates.columns))


def resolve_domains(candidates: DataFrame, live_domains: DataFrame, key: str) -> DataFrame:
    """The first guess (by rank) found in ``live_domains`` (column
    ``domain``), as ``https://domain``. The live table replaces the DNS /
    HTTP probe; it can be large, so it is joined, not broadcast by force. Where
    its bytes are beyond a broadcast, the guesses pass a Bloom filter first
    (``probably_live``), since nearly none is live: only what passes is shuffled."""
    live = live_domains.select(F.lower(F.col("domain")).alias("domain"))
    if not fits_broadcast(live):
        candidates = probably_live(candidates, live)
    hits = candidates.join(live.distinct(), "domain")
    return (hits.groupBy(key).agg(F.min_by("domain", "rank").alias("domain"))
            .select(key, F.concat(F.lit("https://"), F.col("domain")).alias("website")))


def attach_company_domain(profiles: DataFrame, live_domains: DataFrame, key: str = "ingest_seq",
                          rules=DEFAULT_RULES) -> DataFrame:
    """``company_domain`` from the apex of company_website, website or
    Website_Info; when none, guess from the company name (D3 + D4), which
    also fills a missing ``company_website``."""
    cols = set(profiles.columns)
    web = [c for c in ("company_website", "website", "mapped_website_info") if c in cols]
    existing = first_truthy(*web) if web else F.lit(None).cast("string")
    apex = apex_domain(existing, rules)
    p = profiles.withColumn("company_domain", F.coalesce(
        apex, F.col("company_domain") if "company_domain" in cols else F.lit(None).cast("string")))
    need = p.filter(F.col("company_domain").isNull() & nonempty("company").isNotNull())
    guessed = resolve_domains(domain_candidates(need, key, "company"), live_domains, key) \
        .withColumnRenamed("website", "_guess")
    if "company_website" not in cols:
        p = p.withColumn("company_website", F.lit(None).cast("string"))
    return (p.join(guessed, key, "left")
            .withColumn("company_website", F.coalesce("company_website", "_guess"))
            .withColumn("company_domain", F.coalesce("company_domain", apex_domain(F.col("_guess"), rules)))
            .drop("_guess"))
