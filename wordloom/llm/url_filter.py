"""URL filtering by a cascade of Bloom filters, in DataFrame operations only.

Every URL has candidate keys: each suffix of its host (down to the last label) with each prefix of
its path that is as long as some rule's. A cascade is built over the complete universe of the
corpus's candidate keys: level 1 encodes the listed keys; each next level encodes the keys that
pass all levels so far but should not (false positives and listed keys in turn), until none is
left. The first level that rejects a key then tells whether it is listed - exactly, for every key of
the universe, without joining the corpus with the list. Level 1's false positive rate follows the
ratio of universe to list, so the cascade's size is bounded by the list's (MAX_BITS is checked).

Edge cases: a null URL, or one without `://`, has an empty host and path and fits no rule; a rule
that is listed twice must say the same; equally long rules: the one with the longer path wins.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """host suffix + path prefix, for every suffix and every length of a rule's path; longest first."""
    cut = F.filter(F.array(*[F.lit(n) for n in sorted(set(lengths), reverse=True)]), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes(host), lambda h: F.transform(cut, lambda n: F.struct((F.length(h) + n).alias("size"), n.alias("tail"), F.concat(h, F.lit("\t"), F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.reverse(F.array_sort(pairs)), lambda p: p["key"])


class Level:
    """One Bloom filter: `bits` bits as an array of longs in a column, and `hashes` places a key."""

    def __init__(self, n: int, rate: float, seed: int):
        self.bits = max(64, 64 * math.ceil(n * -math.log(max(rate, 1e-9)) / math.log(2) ** 2 / 64))
        self.hashes = max(1, round(self.bits / max(n, 1) * math.log(2)))
        self.hashes = min(self.hashes, 24)
        self.seed, self.words = seed, None
        if self.bits > MAX_BITS:
            raise ValueError(f"a level of {self.bits} bits is beyond MAX_BITS; split the list by host")

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(1000 * self.seed + i)), F.lit(self.bits)) for i in range(self.hashes)]

    def fill(self, keys: DataFrame) -> "Level":
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        set_ = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
        words = [0] * (self.bits // 64)
        for r in set_.collect():  # at most bits / 64 rows
            words[r.word] = r.bits
        self.words = words
        return self

    def passes(self, key: Column) -> Column:
        array = F.array(*[F.lit(w).cast("long") for w in self.words]) if len(self.words) <= 2048 else F.from_json(F.lit(str(self.words)), "array<bigint>")
        found = [F.getbit(F.element_at(array, (p.cast("long") / 64).cast("int") + 1), (p % 64).cast("int")) == 1 for p in self.places(key)]
        return reduce(lambda a, b: a & b, found)


class Cascade:
    """Exact membership in `listed` for every key of `universe` (both: key string)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, max_levels: int = 64):
        listed = listed.select("key").distinct()
        others = universe.select("key").distinct().join(F.broadcast(listed), "key", "left_anti") if listed.count() <= 1_000_000 else universe.select("key").distinct().join(listed, "key", "left_anti")
        others = others.persist()
        n, m = listed.count(), others.count()
        self.levels: list[Level] = []
        self.listed = n
        inside, outside = listed, others
        rate = min(0.5, max(1e-6, n / (math.sqrt(2) * m))) if m else 0.5
        while n:
            level = Level(n, rate, len(self.levels) + 1).fill(inside)
            self.levels.append(level)
            wrong = outside.filter(level.passes(F.col("key"))).persist()
            k = wrong.count()
            if not k:
                break
            if len(self.levels) >= max_levels:
                raise ValueError(f"{k} keys still clash after {max_levels} levels")
            inside, outside, n, rate = wrong, inside, k, 0.5
        others.unpersist()

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: by the parity of the first level that rejects it."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].passes(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict. rules: (verdict, host, path); the longest that fits wins, else `default`.

    Blocked and allowed keys have a cascade each; a URL's candidate keys are tried longest first.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url").cast("string"))
    hosts = pages.select("page_id", host.alias("host"), path.alias("path"))
    lengths = [len(p) for _, _, p in rules]
    keyed = hosts.withColumn("keys", F.when(F.col("host") != "", candidate_keys(F.col("host"), F.col("path"), lengths)).otherwise(F.array().cast("array<string>")))
    universe = keyed.select(F.explode("keys").alias("key"))
    verdicts = sorted({v for v, _, _ in rules})
    if len({(h, p) for _, h, p in rules}) != len({(v, h, p) for v, h, p in rules}):
        raise ValueError("a rule is listed with two verdicts")
    listed = lambda found: spark.range(1).select(F.explode(F.array(*map(F.lit, found))).alias("key"))
    by = {v: Cascade(listed([f"{h}\t{p}" for w, h, p in rules if w == v]), universe) for v in verdicts}
    said = lambda key: F.coalesce(*[F.when(by[v].has(key), F.lit(v)) for v in verdicts])
    tried = F.transform("keys", lambda k: F.struct(k.alias("key"), said(k).alias("verdict")))
    best = F.get(F.filter(tried, lambda t: t["verdict"].isNotNull()), 0) if rules else F.lit(None).cast("struct<key:string,verdict:string>")
    out = keyed.select("page_id", "host", "path", best.alias("best"))
    return out.select("page_id", "host", "path", F.regexp_replace("best.key", "\t", "").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
