"""URL filters: path rules, and exact list membership through a cascade of Bloom filters.

The first filter encodes the listed keys, the second the unlisted keys of the corpus that pass the first, the
third the listed keys that pass the second, and so on until none passes wrongly. Each level hashes the keys anew, so
keys that agree at one level part at a later one. Over the key universe it was built for, the cascade answers
exactly, so pages need no join with the list.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm import common
from docspark.packaging import ship

HASHES = 3
FIRST_BITS = 12  # a key, for the first level
MORE_BITS = 4  # a key, for the others
MOST_BYTES = 64 << 20

# The contract's rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words that put a host on the registered list, as in its SQL.
LISTED_WORDS = (
    "ads", "adult", "advert", "bet", "bets", "betting", "bingo", "casino", "dating", "escort", "gambling", "lottery", "pharma",
    "pills", "poker", "popup", "porn", "sex", "slots", "spam", "tracker", "tracking", "viagra", "warez", "xxx",
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return _lower(host)


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule (host and path) that fits, as struct ``rule, verdict``, or null."""
    found = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def level_hash(level: int, key: str = "host") -> Column:
    """A key's 64-bit hash at a level; levels are independent of each other."""
    return F.xxhash64(F.lit(level), F.col(key))


def slots(hashed: Column, bits: int) -> Column:
    """A key's bit numbers, from the two halves of its hash."""
    first, second = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32)
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: (first + i * second) % bits)


def _holds(words: np.ndarray, bits: int, hashed: np.ndarray) -> np.ndarray:
    """Which keys a filter lets pass."""
    first, second = hashed & np.int64(0xFFFFFFFF), (hashed.view(np.uint64) >> np.uint64(32)).view(np.int64)
    hit = np.ones(len(hashed), bool)
    for i in range(HASHES):
        at = (first + np.int64(i) * second) % np.int64(bits)
        hit &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
    return hit


class Cascade:
    """The filters of a key universe, level by level."""

    def __init__(self, filters: list[np.ndarray], bits: list[int]):
        self.filters, self.bits = filters, bits

    def listed(self, *hashed: np.ndarray) -> np.ndarray:
        """Walk the levels with each level's hashes: a key leaves at the first filter that misses it; the parity decides."""
        out = np.full(len(hashed[0]), len(self.filters) % 2 == 1)
        left = np.ones(len(out), bool)
        for level, (words, bits) in enumerate(zip(self.filters, self.bits, strict=True)):
            hit = _holds(words, bits, hashed[level])
            out[left & ~hit] = level % 2 == 1
            left &= hit
        return out


def _filter(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """Bits of all keys; words are combined before the shuffle, and their number is bounded by ``bits``."""
    at = keys.select(F.explode(slots(level_hash(level), bits)).alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set")).toArrow()
    out = np.zeros(bits // 64 + 1, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint64)
    return out


def build(universe: DataFrame) -> Cascade:
    """A cascade for distinct ``host`` with boolean ``listed``; each level reads only what passed wrongly."""
    filters: list[np.ndarray] = []
    bits: list[int] = []
    inside, outside = universe.where("listed").select("host"), universe.where("not listed").select("host")
    while (n := inside.count()) or not filters:
        level = len(filters)
        bits.append(max(64, (MORE_BITS if level else FIRST_BITS) * n))
        filters.append(_filter(inside, level, bits[-1]))
        one = universe.sparkSession.sparkContext.broadcast((filters[-1], bits[-1]))
        passed = common.stored(outside.where(_passes(one)(level_hash(level))), "passed")
        inside, outside = passed, inside
    return Cascade(filters, bits)


def _passes(sent):
    @F.pandas_udf("boolean")
    def passes(hashed: pd.Series) -> pd.Series:
        return pd.Series(_holds(*sent.value, hashed.to_numpy()))

    return passes


def _asks(sent):
    @F.pandas_udf("boolean")
    def asks(*hashed: pd.Series) -> pd.Series:
        return pd.Series(sent.value.listed(*[h.to_numpy() for h in hashed]))

    return asks


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Verdict on every url: ``page_id, host, path, rule, verdict, listed``.

    ``listed`` is a table of any size with a column ``host`` (A-Z count as lower case; nulls and repeated hosts don't matter).
    The key universe is all hosts of the pages; it meets the list once, when the cascade is built. The longest fitting
    rule decides, else the list: block when listed. Null urls and those without ``://`` have an empty host and path, fit no rule
    and are allowed unless the empty host is listed; repeated rows are judged each; urls of any length are read whole; an
    empty table gives an empty table; other columns are not read. Where the filters would exceed ``most_bytes`` the
    hosts are split by hash, each part with a cascade of its own and a pass over its pages.
    """
    spark = pages.sparkSession
    ship(spark)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    on_list = listed.select(_lower(F.col("host").cast("string")).alias("host")).where("host is not null").distinct().withColumn("listed", F.lit(True))
    universe = common.stored(rows.select("host").distinct().join(on_list, "host", "left").select("host", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    need = universe.where("listed").count() * (FIRST_BITS + MORE_BITS) / 8
    parts = max(1, math.ceil(need / most_bytes))
    out = None
    for k in range(parts):
        mine = F.pmod(level_hash(-1), F.lit(parts)) == k
        cascade = build(universe.where(mine) if parts > 1 else universe)
        asks = _asks(spark.sparkContext.broadcast(cascade))
        some = (rows.where(mine) if parts > 1 else rows).withColumn("listed", asks(*[level_hash(i) for i in range(len(cascade.filters))]))
        out = some if out is None else out.unionByName(some)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.withColumn("r", rule).select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "listed")


def hosts_with_words(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS, url_col: str = "url") -> DataFrame:
    """A list for pages that come without one: their hosts that have one of the words between dots, hyphens or digits."""
    hosts = pages.select(host_of(F.col(url_col).cast("string")).alias("host")).distinct()
    return hosts.where(F.arrays_overlap(F.split("host", "[-.0-9]+"), F.array(*map(F.lit, words))))


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_has_any(regexp_split_to_array(host, '[-.0-9]+'), ['ads', 'adult', 'advert', 'bet', 'bets', 'betting', 'bingo', 'casino', 'dating', 'escort', 'gambling', 'lottery', 'pharma',
        'pills', 'poker', 'popup', 'porn', 'sex', 'slots', 'spam', 'tracker', 'tracking', 'viagra', 'warez', 'xxx']) AS listed FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""
