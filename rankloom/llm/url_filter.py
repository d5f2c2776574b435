"""URL filter: rules by longest match, and for the rest a block list in a Bloom filter cascade.

The first filter holds the listed keys. The keys of the corpus that it accepts wrongly go
into a second filter, the listed keys that the second one accepts wrongly into a third,
and so on until no key is left. Over the corpus's complete set of keys the cascade then
answers exactly: the depth at which a key is first refused tells whether it is listed. Its
filters are a few constants in the scan, so pages meet no join.

Keys are hosts. Filters are bitmaps of 64-bit words, built by aggregation; a list whose
first filter would pass ``bloom.MAX_WORDS`` words is looked up by a join instead.

Defined results: a null url, or one without ``://``, has an empty host and path; an empty
host is never listed; no rule and not listed means allow; repeated rows are judged one by
one; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import bloom
from rankloom.session import cut_lineage

# Fixed values: (host, path, verdict) of the rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
MAX_LEVELS = 64
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def page_hosts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def cascade(universe: DataFrame) -> list[bloom.Filter] | None:
    """Filters over ``(key, listed)``, every key of the corpus once; None where the first would be too large."""
    sizes = {row["listed"]: row["count"] for row in universe.groupBy("listed").count().collect()}
    encoded, tested = universe.filter("listed").select("key"), universe.filter("NOT listed").select("key")
    count = sizes.get(True, 0)
    filters: list[bloom.Filter] = []
    while count:
        if bloom.words_for(count, len(filters)) > bloom.MAX_WORDS or len(filters) == MAX_LEVELS:
            return None
        filters.append(bloom.Filter.build(encoded, count, len(filters)))
        wrong = cut_lineage(tested.filter(filters[-1].accepts(F.col("key"))))
        # What was encoded is asked next: it must be told from the wrongly accepted keys.
        encoded, tested, count = wrong, encoded, wrong.count()
    return filters


def listed_by(filters: list[bloom.Filter], key: Column) -> Column:
    """Exact for keys of the corpus: the parity of the first level that refuses."""
    answer = F.lit(len(filters) % 2 == 1)
    for filter_ in reversed(filters):
        refused = filter_.level % 2 == 1
        answer = F.when(filter_.accepts(key), answer).otherwise(F.lit(refused))
    return answer


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of pages ``(page_id, url)``; ``listed`` holds the block list's ``host``s."""
    hosts = page_hosts(pages)
    keys = hosts.filter(F.col("host") != "").select(F.col("host").alias("key")).distinct()
    held = listed.select(F.col("host").alias("key")).distinct().withColumn("listed", F.lit(True))
    universe = cut_lineage(keys.join(held, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    filters = cascade(universe)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = hosts.withColumn("rule", rule).withColumn("_verdict", verdict)
    if filters is None:
        blocked = universe.filter("listed").select(F.col("key").alias("host"), F.lit(True).alias("_listed"))
        judged = judged.join(blocked, "host", "left")
        found = F.coalesce("_listed", F.lit(False))
    else:
        found = (F.col("host") != "") & listed_by(filters, F.col("host"))
    own = F.when(found, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_verdict", own).alias("verdict"))
