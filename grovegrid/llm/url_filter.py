"""URL filter by cascades of Bloom filters, in DataFrame functions only.

A list of keys becomes a cascade: level 1 is a Bloom filter of the listed keys, level 2 one of those
other keys of the corpus that level 1 lets through, level 3 one of the listed keys that level 2 lets
through, and so on until nothing is let through. For the keys of that corpus, its complete universe,
membership is then exact: a key is listed if the number of levels that it passes in a row is odd.
Only level 1 meets the universe; the first level is sized so that about as many others pass as are
listed, so the cascade grows with the list alone. It is tested inside the projection, without a join;
its bits are a scalar subquery of checked size, beyond which a shuffled join takes over.

Here a url gives a key for each pair of a number of host labels and a length of path prefix that the
rules use. Rules that allow, rules that block and a list of blocked hosts are one cascade each. The
longest listed rule wins; without one, a url whose host or one of its parent domains is on the list is
blocked, and any other allowed.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize

#: Bits of a level that may be tested in a projection (16 MB); beyond it a join decides.
MOST_BITS = 1 << 27
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Blocked hosts of the query, with all their subdomains.
LISTED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _literals(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    """A column of a few given strings, as literals of the plan."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")).alias(name))


class Level:
    """A Bloom filter: words of 64 bits as one array that a scalar subquery gives."""

    def __init__(self, keys: DataFrame, n: int, rate: float, number: int):
        self.number = number
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(64, -(-math.ceil(n * self.hashes / math.log(2)) // 64) * 64)
        if self.bits > MOST_BITS:
            raise OverflowError(f"{n} keys need {self.bits} bits")
        places = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("p"))
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("v"))
        words = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
        self.words = words.select(F.transform(F.sequence(F.lit(0), F.lit(self.bits // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0).cast("long"))))

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * 1000 + j)), F.lit(self.bits)) for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        for p in self._places(key):
            word = F.get(self.column, F.shiftright(p, 6).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0)
        return out

    def fix(self) -> Level:
        self.column = F.array(*map(F.lit, self.words.first()[0])) if self.bits <= 4096 else self.words.scalar()
        return self


class Cascade:
    """Exact membership in `listed`(key) for the keys of `universe`(key), both of strings without nulls."""

    def __init__(self, listed: DataFrame, universe: DataFrame, size: int):
        self.levels: list[Level] = []
        listed = listed.distinct()
        mine, n = listed, listed.count()
        others = universe
        rate = min(0.5, max(1e-9, n / max(1, size)))
        while n:
            level = Level(mine, n, rate, len(self.levels) + 1).fix()
            self.levels.append(level)
            let = others.where(level.passes(F.col("key")))
            if len(self.levels) == 1:
                let = let.distinct().join(listed, "key", "left_anti")
            let = materialize(let, "cascade")
            mine, others, n, rate = let, mine, let.count(), 0.5
            if len(self.levels) > 200:
                raise RuntimeError("the cascade does not end")

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: it passes an odd number of levels, then fails."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: on up to ? # or the end. Else empty."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, form, 1), _UPPER, _LOWER), F.regexp_extract(url, form, 2)


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages plus host, path, rule, verdict. rules: (host, path, allow or block); listed(host): blocked hosts.

    Null urls and urls without :// have an empty host and path, fit no rule and are allowed. Rows that
    repeat are each judged. The result has the columns of pages but for those four names, which it sets.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    rows = pages.drop(*({"host", "path", "rule", "verdict"} - {url})).withColumns({"__host": host, "__path": path})
    depths = sorted({h.count(".") + 1 for h, _, _ in rules})
    lengths = sorted({len(p) for _, p, _ in rules})
    h, p = F.col("__host"), F.col("__path")
    keys = [F.when(F.length(p) >= n, F.concat(F.substring_index(h, ".", -d), F.substring(p, 1, n))) for d in depths for n in lengths]
    hosts = listed.select(F.translate(F.col("host"), _UPPER, _LOWER).alias("host")).where("host is not null and host <> ''").distinct()
    host_depths = [r[0] for r in hosts.select(F.size(F.split("host", r"\.")).alias("d")).distinct().orderBy("d").collect()]
    parents = [F.substring_index(h, ".", -d) for d in host_depths]
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"__keys": F.array_compact(F.array(*keys)) if keys else none, "__hosts": F.array(*parents) if parents else none})
    rule_keys = rows.select(F.explode("__keys").alias("key"))
    host_keys = rows.select(F.explode("__hosts").alias("key"))
    size = rows.count() * max(1, len(keys), len(parents))
    sets, verdicts = [], sorted({v for _, _, v in rules})
    for v in verdicts:
        table = _literals(spark, "key", [a + b for a, b, x in rules if x == v])
        sets.append(Cascade(table, rule_keys, size))
    # One expression for each key, as the subqueries of a cascade cannot stand within higher-order functions.
    fits = [F.when(k.isNotNull() & c.has(k), F.struct(F.length(k).alias("n"), k.alias("k"), F.lit(v).alias("v"))) for c, v in zip(sets, verdicts, strict=True) for k in keys]
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else None
    try:
        blocked = Cascade(hosts.select(F.col("host").alias("key")), host_keys, size)
    except OverflowError:  # too long a list for a projection
        bad = hosts.select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
        found = rows.select("__host", F.explode(F.array_distinct("__hosts")).alias("__parent")).distinct()
        bad = found.join(bad.withColumnRenamed("__host", "__parent"), "__parent").select("__host", "__bad").distinct()
        rows = rows.join(bad, "__host", "left")
        on_list = F.coalesce("__bad", F.lit(False))
    else:
        on_list = functools.reduce(Column.__or__, (blocked.has(x) for x in parents), F.lit(False))
    out = rows.withColumn("__best", best if fits else F.lit(None).cast("struct<n:int,k:string,v:string>"))
    out = out.withColumns({"host": h, "path": p, "rule": F.col("__best.k"), "verdict": F.coalesce("__best.v", F.when(on_list, "block").otherwise("allow"))})
    return out.drop("__host", "__path", "__keys", "__hosts", "__best", "__bad")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = _literals(spark, "host", LISTED)
    return url_filter(pages, RULES, listed).drop("url")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
l AS (SELECT n || '.example.' || t AS h FROM (VALUES ('ads-track'), ('adult-x'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(n), (VALUES ('com'), ('net'), ('org')) b(t)),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (
  SELECT u.*, (SELECT h || p FROM r WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
         EXISTS (SELECT 1 FROM l WHERE u.host = h OR ends_with(u.host, '.' || h)) AS bad
  FROM u)
SELECT page_id, host, path, rule, coalesce((SELECT v FROM r WHERE h || p = f.rule), CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""
