"""URL filters: explicit host and path rules, and an empirical-Bayes host reputation where no rule fits. Plain SQL.

Reputation: page outcomes (1: bad) are counted by host, registered domain and public suffix. The suffix is the last label, or the
last two where the last has two letters and the one before is a registry's second level (``SECOND_LEVEL``, a parameter); the
registered domain is one label more. Ports and dots at the end are left out, and an address of numbers has itself as domain and an
empty suffix. At each level a beta prior's strength is fitted by moments of the beta-binomial; its mean is the posterior mean one
level up, from all pages through suffix and domain to host. A host is blocked if the lower bound of its posterior bad rate exceeds
``LIMIT``.

The totals of hosts, domains and suffixes (one row each) are written to the shared folder once, and the overall rate and the three
strengths, four numbers, are read from them.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged by the reputation of the empty host; a
null page_id never matches an outcome; repeated rows are judged one by one and repeated outcomes of a page count each; an url of any
length is judged whole; without outcomes nothing is blocked but by rules; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm.shared import BROADCAST_ROWS, spread_join, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LIMIT = 0.5
#: Standard deviations below the posterior mean at which the bound lies.
BOUND = 1.645
#: Least and largest strength of a prior, in pages.
STRENGTH = (1.0, 1000.0)
#: Labels under which registries of two-letter top levels register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    if "\\" in text:
        raise ValueError("no backslashes in rules")
    return "'" + text.replace("'", "''") + "'"


def _longest(rules: tuple, what: str) -> str:
    """CASE over the rules, the longest first; what: the rule's text or its verdict."""
    arms = ""
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = f"(host = {_quoted(host)} OR right(host, {len(host) + 1}) = {_quoted('.' + host)}) AND left(path, {len(path)}) = {_quoted(path)}"
        arms += f" WHEN {fits} THEN {_quoted(verdict if what == 'verdict' else host + path)}"
    return f"CASE{arms} ELSE NULL END" if arms else "CAST(NULL AS STRING)"


def parsed_sql(pages: str, rules: tuple = RULES) -> str:
    """page_id, host, path and the longest rule that fits, with its verdict."""
    return f"""
SELECT page_id, host, path, {_longest(rules, "rule")} AS rule, {_longest(rules, "verdict")} AS ruling FROM (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {pages}) cut) parts"""


def registered(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> tuple[Column, Column]:
    """The registered domain and the public suffix of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), "[.]+$", "")
    address = bare.rlike(r"^[0-9.]*[0-9][0-9.]*$|^\[")
    two = f"(?:{'|'.join(second_level)})[.][a-z]{{2}}" if second_level else "(?!)"
    suffix = F.when(address, "").otherwise(F.regexp_extract(bare, rf"(?:^|[.])({two}|[^.]*)$", 1))
    domain = F.when(address, bare).otherwise(F.regexp_extract(bare, rf"(?:^|[.])([^.]*[.](?:{two}|[^.]*)|[^.]*)$", 1))
    return domain, suffix


def _strength(totals: DataFrame, rate: float) -> float:
    """Of the prior that the spread of the units' rates around the overall rate suggests."""
    n, bad = F.col("n"), F.col("bad")
    found = totals.where("n > 0").agg(F.sum(n * (bad / n - rate) * (bad / n - rate)), F.count("*"), F.sum(n), F.sum(n * n)).first()
    around, units, pages, squares = found
    if not units or pages - squares / pages <= 0:
        return STRENGTH[1]
    between = (around - (units - 1) * rate * (1 - rate)) / (pages - squares / pages)
    return STRENGTH[1] if between <= 0 else max(STRENGTH[0], min(STRENGTH[1], rate * (1 - rate) / between - 1))


def poor_hosts(hosts: DataFrame) -> DataFrame:
    """The hosts (host, times, n, bad) that are blocked for their reputation, with their times."""
    domain, suffix = registered(F.col("host"))
    hosts = written(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    n, bad = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = written(hosts.groupBy("domain").agg(F.min("suffix").alias("suffix"), n, bad, F.count("*").alias("times")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(n, bad, F.count("*").alias("times")), "suffixes")
    pages, bad_pages = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    if not pages:
        return hosts.where("false").select("host", "times")
    rate = bad_pages / pages
    by_suffix, by_domain, by_host = (_strength(t, rate) for t in (suffixes, domains, hosts))
    shrunk = lambda strength, prior: (strength * prior + F.col("bad")) / (strength + F.col("n"))
    rated = suffixes.select("suffix", shrunk(by_suffix, F.lit(rate)).alias("prior"), "times")
    rated = spread_join(domains.select("domain", "suffix", "n", "bad", F.col("times").alias("hosts")), rated, "suffix", F.xxhash64("domain"))
    rated = written(rated.select("domain", shrunk(by_domain, F.col("prior")).alias("prior"), F.col("hosts").alias("times")), "rated")
    known = spread_join(hosts, rated, "domain", F.xxhash64("host"))
    a, b = by_host * F.col("prior") + F.col("bad"), by_host * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    bound = a / (a + b) - BOUND * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return known.where(bound > LIMIT).select("host", "times")


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. Only page_id and url are read; texts of pages never move."""
    spark = pages.sparkSession
    view = f"pages_{uuid.uuid4().hex}"
    pages.select("page_id", "url").createOrReplaceTempView(view)
    parsed = spark.sql(parsed_sql(view, rules))
    spark.catalog.dropTempView(view)
    counted = outcomes.where("page_id is not null").groupBy("page_id").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    told = parsed.join(counted, "page_id").groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("double").alias(c)
    hosts = parsed.groupBy("host").agg(F.count("*").alias("times")).join(told, "host", "left").select("host", "times", number("n"), number("bad"))
    poor = written(poor_hosts(hosts).withColumn("poor", F.lit(True)), "poor")
    few = poor.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = parsed.join(F.broadcast(poor.drop("times")), "host", "left") if few else spread_join(parsed, poor, "host", F.xxhash64("page_id", "path"), "left")
    verdict = F.coalesce("ruling", F.when(F.col("poor"), "block").otherwise("allow"))
    return known.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
