"""URL filters by a cascade of Bloom filters, with DataFrame functions only.

A list of keys is encoded exactly over the corpus's complete key universe: level 0 is a Bloom filter of the
listed keys, level 1 one of level 0's false positives among all other keys of the corpus, level 2 one of the
listed keys that level 1 holds by mistake, and so on until a level has no false positive. The levels are
literals of the plan, so that a lookup is an expression over the row and needs no join. Their size follows
the list: level 0's error rate is set from the number of distinct keys of the corpus, so that its false
positives are about as many as the listed keys. Only bit positions of the levels come to the driver, WORD_BITS of them in a row; a list of more than MAX_LISTED keys is refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm.common import LOWER, UPPER, forget, fresh, save, table

#: Most listed keys: their levels take about 3 bytes a key, so the literals stay within some MB.
MAX_LISTED = 1_000_000
#: Bits of a level that come to the driver in one row.
WORD_BITS = 60
#: The rules of the registered query: host and path of each key, and what it says.
RULES = {"allow": ["org/", "com/fr/"], "block": ["example.org/es/", "example.org/en/1", "com/de/"]}


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    #: Six bits a byte, from "0" upwards, so that each byte is a character.
    packed: bytes


def _positions(key: Column, level: int, bits: int, hashes: int) -> Column:
    a = F.pmod(F.xxhash64(key, F.lit(2 * level)), F.lit(bits).cast("long"))
    b = F.pmod(F.xxhash64(key, F.lit(2 * level + 1)), F.lit(bits).cast("long"))
    return F.array(*[(a + b * F.lit(i)) % F.lit(bits) for i in range(hashes)])


def _holds(key: Column, number: int, level: Level) -> Column:
    def bit(p: Column) -> Column:
        char = F.substring(F.lit(level.packed), (p / 6).cast("int") + 1, F.lit(1)).cast("string")
        return F.shiftrightunsigned(F.ascii(char) - 48, 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(6)]), (p % 6).cast("int") + 1)) != 0

    return F.forall(_positions(key, number, level.bits, level.hashes), bit)


def _encode(keys: DataFrame, number: int, n: int, rate: float) -> Level:
    hashes = max(1, min(30, round(-math.log2(rate))))
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    at = keys.select(F.explode(_positions(F.col("key"), number, bits, hashes)).alias("at"))
    words = at.groupBy(F.expr(f"at div {WORD_BITS}").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(at % {WORD_BITS} AS int)))").alias("set"))
    packed = bytearray(b"0" * ((bits // WORD_BITS + 1) * WORD_BITS // 6))
    for w, held in words.collect():  # bits / WORD_BITS rows at most
        for i in range(WORD_BITS // 6):
            packed[w * WORD_BITS // 6 + i] += held >> 6 * i & 63
    return Level(bits, hashes, bytes(packed))


class Cascade:
    """Exact membership of a list for every key of a universe."""

    def __init__(self, levels: Sequence[Level] = ()):
        self.levels = list(levels)

    def contains(self, key: Column) -> Column:
        """True for the listed keys; a null key isn't listed."""
        inside: Column = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            inside = F.when(_holds(key, number, self.levels[number]), inside).otherwise(F.lit(number % 2 == 1))
        return F.coalesce(inside, F.lit(False))

    @classmethod
    def build(cls, universe: DataFrame, keys: str, listed: DataFrame) -> Cascade:
        """universe: rows with an array column of keys (null or empty: none). listed: a column key; nulls and repeats don't count."""
        listed = listed.where("key IS NOT NULL").select("key").distinct()
        n = listed.count()
        if n > MAX_LISTED:
            raise ValueError(f"{n} listed keys; a cascade takes {MAX_LISTED}")
        if not n:
            return cls()
        exploded = universe.select(F.explode(keys).alias("key"))
        distinct = exploded.agg(F.approx_count_distinct("key", 0.02)).first()[0]
        first = _encode(listed, 0, n, min(0.5, n * math.sqrt(0.5) / max(1, distinct)))
        levels = [first]
        passing = universe.select(F.explode(F.filter(keys, lambda k: _holds(k, 0, first))).alias("key"))
        wrong = save(
            passing.select("key", F.lit(0).alias("listed")).unionByName(listed.select("key", F.lit(1).alias("listed")))
            .groupBy("key").agg(F.max("listed").alias("listed"))
        )
        sides = [wrong.where("listed = 1"), wrong.where("listed = 0")]
        while left := sides[len(levels) % 2].count():
            number = len(levels)
            levels.append(_encode(sides[number % 2], number, left, 0.5))
            other = (number + 1) % 2
            sides[other] = sides[other].where(_holds(F.col("key"), number, levels[number]))
        forget(wrong)
        return cls(levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, listed: Sequence[str]) -> Column:
    """The keys that could list this url: host suffixes by whole labels and path prefixes, of the shapes that the list has."""
    shapes = {(key.partition("/")[0].count(".") + 1, len(key) - key.index("/")) for key in listed}
    every = [
        F.when(F.length(path) >= length, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))
        for labels, length in sorted(shapes)
    ]
    return F.array_distinct(F.array_compact(F.array(*every))) if every else F.array().cast("array<string>")


def _as_rows(spark: SparkSession, keys: Sequence[str]) -> DataFrame:
    """One literal of the plan, taken apart."""
    every = F.split(F.lit("\0".join(keys)), "\0") if keys else F.array().cast("array<string>")
    return spark.range(1).select(F.explode(every).alias("key"))


def judge_urls(pages: DataFrame, rules: dict[str, Sequence[str]], url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to pages; columns of those names are replaced.

    rules: keys host + path by verdict (allow, block). The longest key that fits wins; of equally long ones the one
    with the longer host, then block. A url that no key fits isn't listed and gets the default. Repeated rows are
    judged alike; an empty table stays empty.
    """
    spark = pages.sparkSession
    listed = {v: sorted({k for k in rules.get(v, []) if k is not None}) for v in ("allow", "block")}
    if bad := [k for keys in listed.values() for k in keys if "/" not in k]:
        raise ValueError(f"rules need a path: {bad}")
    host, path = url_parts(F.col(url))
    pages = pages.withColumns({"host": host, "path": path})
    keys = candidates(F.col("host"), F.col("path"), [k for v in listed.values() for k in v])
    universe = pages.select(keys.alias("keys"))
    cascade = {v: Cascade.build(universe, "keys", _as_rows(spark, ks)) for v, ks in listed.items()}

    def ranked(k: Column) -> Column:
        return F.struct(F.length(k).alias("n"), F.locate("/", k).alias("h"), cascade["block"].contains(k).alias("block"), k.alias("key"))

    fits = F.filter(keys, lambda k: cascade["allow"].contains(k) | cascade["block"].contains(k))
    name = fresh("_best", pages.columns)
    best = F.col(name)
    verdict = F.when(best.isNull(), default).otherwise(F.when(best["block"], "block").otherwise("allow"))
    return pages.withColumn(name, F.array_max(F.transform(fits, ranked))).withColumns({"rule": best["key"], "verdict": verdict}).drop(name)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rule, rhost, rpath, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block'))
SELECT page_id, host, path,
       (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
       coalesce((SELECT arg_max(verdict, length(rule)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM parts
"""
