"""URL lists as Bloom filter cascades: exact membership for every key of the corpus, without a join.

Level 1 encodes the listed keys, level 2 those other keys of the corpus that level 1 lets pass by mistake, level 3
the listed keys that level 2 lets pass, and so on until a level has no false positive. A key is listed if the
first level that doesn't have it is an even one. This is exact for the whole key universe that the cascade was built
over: the candidate keys of all URLs of the corpus. Only built-in functions run; a filter is a binary literal.

Size bound: filters are literals in the plan, so all levels of a cascade together may take ``max_bytes``. A list whose
filters are larger is looked up by an exact semi-join instead (``listed_by_join``).

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. Rules are literal: host
and path compare byte by byte after A-Z are lower-cased in the host. A rule in both lists blocks. Equal rules count once;
an empty list lists nothing. Of several rules that fit, the longest text wins, then the longest host. Repeated rows are
judged each; an empty table gives no rows. Columns named host, path, rule or verdict are replaced, all others stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import free_name, join_hot, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits in a byte of a filter: bytes below 128 are read back by ascii().
BITS = 7


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Filter:
    """One Bloom filter of ``bits`` bits and ``hashes`` hash functions."""

    data: bytes
    bits: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        """Whether all of the key's bits are set; the filter's bytes stand in the plan once."""
        data = F.lit(bytearray(self.data))

        def is_set(position: Column) -> Column:
            byte = F.ascii(F.substring(data, (F.floor(position / BITS) + 1).cast("int"), 1).cast("string"))
            return F.call_function("shiftright", byte, (position % BITS).cast("int")).bitwiseAND(F.lit(1)) == 1

        return F.forall(F.array(*positions(key, self.bits, self.hashes, self.seed)), is_set)


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    """The key's bits, by double hashing; both hashes have 31 bits, so no sum overflows."""
    low = F.lit((1 << 31) - 1)
    a, b = F.xxhash64(key, F.lit(2 * seed)).bitwiseAND(low), F.xxhash64(key, F.lit(2 * seed + 1)).bitwiseAND(low)
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(hashes)]


def build_filter(keys: DataFrame, count: int, false_positives: float, seed: int) -> Filter:
    """A filter of the column ``key``; each byte is made where its keys are, and only bytes go to the driver."""
    hashes = max(1, round(-math.log2(false_positives)))
    bits = max(64, math.ceil(count * -math.log(false_positives) / math.log(2) ** 2))
    at = F.explode(F.array(*positions(F.col("key"), bits, hashes, seed)))
    byte = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / BITS).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % BITS).cast("int"))).alias("value"))
    data = bytearray(bits // BITS + 1)
    for row in byte.toLocalIterator():
        data[row.byte] = row.value
    return Filter(bytes(data), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Filter, ...]

    def has(self, key: Column) -> Column:
        """Whether a key of the universe is listed: it passes level 1, and then level 2 fails or level 3 passes ..."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):
            out = F.when(self.levels[k - 1].has(key), out).otherwise(F.lit(k % 2 == 0))
        return out

    def size(self) -> int:
        return sum(len(x.data) for x in self.levels)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = 16 << 20, max_levels: int = 60) -> Cascade | None:
    """The cascade that has ``listed`` (column ``key``) among ``universe`` (distinct ``key``); None if too large.

    Keys that are in the list but not in the universe are never asked for and left out.
    """
    inside = materialize(universe.join(listed.distinct(), "key", "left_semi"))
    n, total = inside.count(), universe.count()
    if n == 0:
        return Cascade(())
    outside = universe.join(inside, "key", "left_anti") if total > n else None
    rate = min(0.5, max(1e-9, math.sqrt(0.5) * n / max(1, total - n)))
    levels: list[Filter] = []
    sets, counts = [inside, outside], [n, total - n]
    while len(levels) < max_levels:
        k = len(levels)
        keys, others = sets[k % 2], sets[1 - k % 2]
        if sum(len(x.data) for x in levels) + counts[k % 2] * 1.45 * -math.log2(rate) / BITS > max_bytes:
            return None
        levels.append(build_filter(keys, counts[k % 2], rate, k))
        if not counts[1 - k % 2]:
            return Cascade(tuple(levels))
        # of the other set, only what this level lets pass by mistake still matters
        passed = materialize(others.filter(levels[-1].has(F.col("key"))))
        sets[1 - k % 2], counts[1 - k % 2], rate = passed, passed.count(), 0.5
        if not counts[1 - k % 2]:
            return Cascade(tuple(levels))
    return None


@dataclass(frozen=True)
class Rules:
    """Listed rules: (host, path, verdict)."""

    rows: tuple[tuple[str, str, str], ...]

    @property
    def labels(self) -> int:
        return max((host.count(".") + 1 for host, _, _ in self.rows), default=0)

    @property
    def path_sizes(self) -> list[int]:
        return sorted({len(path) for _, path, _ in self.rows})

    def keys(self, spark: SparkSession, verdict: str) -> DataFrame:
        blocked = {(h, p) for h, p, v in self.rows if v == "block"}
        found = sorted({h + p for h, p, v in self.rows if v == verdict and (v == "block" or (h, p) not in blocked)})
        return spark.createDataFrame([(x,) for x in found], "key string")


def candidates(host: Column, path: Column, rules: Rules) -> Column:
    """The keys of a URL that a rule could have, the longest first.

    A key is the host's last labels, as many as any rule has at most, and a start of the path as long as any
    rule's; thus their number is bounded by the rules, not by the URL.
    """
    keys = []
    for labels in range(rules.labels, 0, -1):
        fits = F.size(F.split(host, r"\.", labels + 1)) >= labels
        end = F.substring_index(host, ".", -labels)
        for size in rules.path_sizes:
            keys.append(F.when(fits & (host != "") & (F.length(path) >= size), F.concat(end, F.substring(path, 1, size))))
    lengths = F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct((-F.length(k)).alias("n"), (-F.instr(k, "/")).alias("h"), k.alias("k")))
    return F.array_distinct(F.transform(F.array_sort(lengths), lambda x: x["k"]))


def judge(urls: DataFrame, rules: Rules, url: str = "url", unlisted: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``urls``; a URL that no rule fits isn't listed and gets ``unlisted``."""
    spark = urls.sparkSession
    host, path = url_host(F.col(url)), url_path(F.col(url))
    if not rules.rows:
        return urls.withColumns({"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit(unlisted)})
    universe = materialize(urls.select(F.explode(candidates(host, path, rules)).alias("key")).distinct())
    lists = {v: rules.keys(spark, v) for v in ("block", "allow")}
    cascades = {v: build_cascade(keys, universe) for v, keys in lists.items()}
    if None in cascades.values():
        return judge_by_join(urls, rules, url, unlisted)
    blocked, allowed = cascades["block"], cascades["allow"]
    keys = free_name(urls.columns, "_keys")
    keyed = urls.withColumn(keys, candidates(host, path, rules)).withColumns({"host": host, "path": path})
    judged = keyed.withColumn("rule", F.get(F.filter(keys, lambda k: blocked.has(k) | allowed.has(k)), F.lit(0)))
    verdict = F.when(F.col("rule").isNull(), F.lit(unlisted)).when(blocked.has(F.col("rule")), "block").otherwise("allow")
    return judged.withColumn("verdict", verdict).drop(keys)


def judge_by_join(urls: DataFrame, rules: Rules, url: str = "url", unlisted: str = "allow") -> DataFrame:
    """The same for lists whose filters exceed the bound: URLs that occur are looked up by a join, once each; the rows of
    a frequent URL stay where they are."""
    spark = urls.sparkSession
    host, path = url_host(F.col(url)), url_path(F.col(url))
    listed = rules.keys(spark, "block").withColumn("_v", F.lit("block")).unionByName(rules.keys(spark, "allow").withColumn("_v", F.lit("allow")))
    key = free_name(urls.columns, "_url")
    count, found = free_name(urls.columns, "_n"), free_name(urls.columns, "_best")
    distinct = urls.filter(F.col(url).isNotNull()).groupBy(F.col(url).alias(key)).agg(F.count("*").alias(count))
    distinct = materialize(distinct)
    keys = distinct.select(key, F.explode(candidates(url_host(F.col(key)), url_path(F.col(key)), rules)).alias("key"))
    best = keys.join(listed, "key").groupBy(key).agg(F.min(F.struct((-F.length("key")).alias("n"), (-F.instr("key", "/")).alias("h"), F.col("key"), F.col("_v"))).alias(found))
    out = join_hot(urls.withColumn(key, F.col(url)), materialize(distinct.join(best, key)), key, count)
    return out.withColumns({"host": host, "path": path}).withColumns({
        "rule": F.col(f"{found}.key"), "verdict": F.coalesce(F.col(f"{found}._v"), F.lit(unlisted))}).drop(key, found)


#: The rules of the query.
PAGE_RULES = Rules((
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
))
