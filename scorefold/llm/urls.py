r"""URL filters by a cascade of Bloom filters.

A rule is a key `host` + `path` with an action; it fits its host and all subdomains where the url's path starts with the rule's path, and the
longest fitting key wins (of equal ones, that with the longer host). The corpus's key universe is every (host suffix, path prefix) of every
url, for the path lengths that rules have. Level 0 of the cascade encodes the listed keys; level 1 the keys of the universe that level 0 lets
through wrongly; level 2 the listed keys that level 1 holds wrongly, and so on until none are left. The first level that lacks a key tells
exactly whether it is listed, for all keys of the universe, so urls are judged one by one with no join. A second cascade, over the listed keys
of the universe, tells the blocked ones. Filters are made by tasks and merged by Spark; their size follows the number of listed keys.

Defined results: null urls and urls without `://` have empty host and path and fit no rule; urls that no rule fits are allowed; keys listed
twice count once, and as blocked if one of them says so; repeated pages are judged each; an empty table or an empty list gives its rows with no
rule; further columns pass through `judge`.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorefold.llm import query
from scorefold.llm.common import ship, stored, table

#: Fixed rules of the query: (key, action).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BITS_PER_KEY = 10
HASHES = 7
DEFAULT = "allow"

ship(__name__)

Level = tuple[int, np.ndarray]  # bits, words


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """The keys that would fit a url, longest first, then longest host."""
    labels = host.split(".") if host else []
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    keys = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return [h + p for h, p in sorted(keys, key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0])))]


def _places(key: str, level: int, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key, level)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


def held(key: str, level: int, one: Level) -> bool:
    bits, words = one
    return all(int(words[p >> 6]) >> (p & 63) & 1 for p in _places(key, level, bits))


def listed(key: str, cascade: list[Level]) -> bool:
    """Whether a key of the universe is listed: the parity of the first level that lacks it."""
    for i, one in enumerate(cascade):
        if not held(key, i, one):
            return i % 2 == 1
    return len(cascade) % 2 == 1


def _level(keys: DataFrame, level: int) -> Level | None:
    """The Bloom filter of a table of keys; None without keys. Tasks give words of bits, Spark merges them."""
    n = keys.count()
    if not n:
        return None
    bits = -(-max(64, n * BITS_PER_KEY) // 64) * 64

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.array([p for k in b["key"] for p in _places(k, level, bits)], np.int64)
            yield pd.DataFrame({"word": at >> 6, "mask": np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64)})

    words = keys.mapInPandas(task, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow().to_pandas()  # bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"]] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return bits, out


def _passing(keys: DataFrame, level: int, one: Level) -> DataFrame:
    """The keys that a level lets through."""
    shared = keys.sparkSession.sparkContext.broadcast(one)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[held(k, level, shared.value) for k in b["key"]]]

    return keys.mapInPandas(task, "key string")


def build(universe: DataFrame, wanted: DataFrame) -> list[Level]:
    """The cascade that is exact on `universe` (key) for the listed keys `wanted` (key); wanted keys outside the universe are of no use and left out."""
    yes = stored(universe.join(wanted.distinct(), "key", "left_semi"), "listed-keys")
    cascade: list[Level] = []
    first = _level(yes, 0)
    if first is None:
        return cascade
    cascade.append(first)
    others = stored(_passing(universe, 0, first).join(yes, "key", "left_anti"), "false-keys")
    sides = [others, yes]  # what the next level encodes, and what it may hold wrongly
    while True:
        level = len(cascade)
        one = _level(sides[0], level)
        if one is None:
            return cascade
        cascade.append(one)
        sides = [stored(_passing(sides[1], level, one), "false-keys"), sides[0]]


def universe(pages: DataFrame, lengths: list[int]) -> DataFrame:
    """The distinct candidate keys of pages with `host` and `path`."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = set(zip(b["host"], b["path"]))
            yield pd.DataFrame({"key": sorted({k for h, p in pairs for k in candidates(h, p, lengths)})}, dtype=object)

    return pages.select("host", "path").mapInPandas(task, "key string").distinct()


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule (the winning key or null) and verdict; rules has key and action."""
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    lengths = sorted(r[0] for r in rules.select(F.length("key") - F.locate("/", "key") + 1).distinct().collect())  # path lengths, not rules
    keys = stored(universe(rows, lengths), "url-keys")
    known = build(keys, rules.select("key"))
    marked = stored(keys.join(rules.select("key").distinct(), "key", "left_semi"), "met-rules")
    blocked = build(marked, rules.where("action = 'block'").select("key"))
    shared = pages.sparkSession.sparkContext.broadcast((known, blocked))

    @F.pandas_udf("string")
    def winner(host: pd.Series, path: pd.Series) -> pd.Series:
        known, _ = shared.value
        return pd.Series([next((k for k in candidates(h, p, lengths) if listed(k, known)), None) for h, p in zip(host, path)], dtype=object)

    @F.pandas_udf("string")
    def action(rule: pd.Series) -> pd.Series:
        _, blocked = shared.value
        return pd.Series([DEFAULT if r is None else "block" if listed(r, blocked) else "allow" for r in rule], dtype=object)

    return rows.withColumn("rule", winner("host", "path")).withColumn("verdict", action("rule"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "key string, action string")


SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(h, q, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, h || q AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS k
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (page_id)
"""


@query("op7_url_filter", SQL)
def op7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
