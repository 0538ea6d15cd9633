"""URL filters by Bloom filter cascades.

A rule is a host, a path prefix and an action; it fits the host and its subdomains. A URL can only be
fitted by one of its own keys: a suffix of its host at a label boundary, followed by a prefix of its
path. Only the shapes (labels, path characters) that some rule has can match, so a URL has at most
one key per shape, and whether it is listed is a question of membership.

Membership is answered by one cascade per action. Its first filter holds the listed keys; the keys of
the whole corpus that pass it unlisted are its false positives, and the next filter holds those; then
the listed keys that pass that one, and so on, until a filter has no false positives left. A key is
walked down the filters, and the level that refuses it decides. Every key of the corpus was tested
while building, so the answer is exact for all of them, and judging is a map: no join and no shuffle.

A cascade grows with the list and the logarithm of the corpus, not with the corpus. Lists whose first
filter would pass `MAX_BITS` are dealt to parts by key hash, and each part is one more map.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import checkpointed, mixed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of one cascade's first filter: what is broadcast at once is 16 MB, and each further level
#: is smaller than the listed keys of its part need.
MAX_BITS = 1 << 27
#: Levels are halved in expectation; a cascade this deep means keys that no hash tells apart.
MAX_LEVELS = 64

ACTIONS = ("allow", "block")  # the first also wins over a key that is listed both ways


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(
        F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


# -- keys


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Distinct (labels of the host, characters of the path) of the rules: at most labels x path
    lengths, whatever the number of rules."""
    return sorted((r[0], r[1]) for r in rules.select(
        F.size(F.split("host", r"\.", -1)), F.length("path")).distinct().collect())


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The URL's keys as structs, longest first; of equal lengths the longer host comes first."""
    made = [F.when((F.size(F.split(host, r"\.", -1)) >= labels) & (F.length(path) >= chars),
                   F.struct(
                       (F.length(F.substring_index(host, ".", -labels)) + chars).alias("n"),
                       F.length(F.substring_index(host, ".", -labels)).alias("h"),
                       F.concat(F.substring_index(host, ".", -labels),
                                F.substring(path, 1, chars)).alias("key")))
            for labels, chars in shapes]
    return F.sort_array(F.array_compact(F.array(*made)), asc=False)


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("key", F.lit("part")), F.lit(parts)).cast("int")


# -- filters: (bits, number of hashes, words), numbers and arrays only


def _places(level: int, bits: int, n: int, first: np.ndarray, second: np.ndarray) -> list:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        at, step = mixed(first ^ salt), mixed(second + salt) | np.uint64(1)
        return [(at + np.uint64(j) * step) % np.uint64(bits) for j in range(n)]


def passes(level: int, bloom: tuple, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    bits, n, words = bloom
    ok = np.ones(len(first), bool)
    for at in _places(level, bits, n, first, second):
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _unsigned(array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).view(np.uint64)


def filter_of(keys: DataFrame, level: int, bits: int, n: int) -> tuple:
    """The filter of (h1, h2) rows. Bits are joined before the shuffle; bits / 64 words come back."""
    def places(batches):
        for batch in batches:
            put = _places(level, bits, n, _unsigned(batch.column(0)), _unsigned(batch.column(1)))
            at = np.unique(np.concatenate(put)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    found = (keys.select("h1", "h2").mapInArrow(places, "at long")
             .groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                           F.col("at").bitwiseAND(F.lit(63)).cast("int")))
                  .alias("bits"))).toArrow()
    words = np.zeros(-(-bits // 64), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return bits, n, words


def _passing(keys: DataFrame, level: int, bloom: tuple) -> DataFrame:
    """Rows of (key, h1, h2) that the filter lets through."""
    held = keys.sparkSession.sparkContext.broadcast(bloom)

    def tested(batches):
        for batch in batches:
            ok = passes(level, held.value, _unsigned(batch.column("h1")),
                         _unsigned(batch.column("h2")))
            yield batch.filter(ok)

    return keys.mapInArrow(tested, "key string, h1 long, h2 long")


def _size(listed: int, rate: float) -> tuple[int, int]:
    """Bits and hashes for a share `rate` of false positives."""
    bits = max(64, math.ceil(listed * math.log2(1 / rate) / math.log(2)))
    return bits, max(1, round(bits / listed * math.log(2)))


def _first_rate(listed: int, universe: int) -> float:
    """The share that leaves about as many false positives as there are listed keys."""
    return min(0.5, max(2.0 ** -40, listed * math.sqrt(0.5) / max(universe - listed, 1)))


def cascade(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> list[tuple]:
    """Filters that tell `listed` from the rest of `universe`, both as (key, h1, h2)."""
    if n_listed == 0:
        return []
    size = _size(n_listed, _first_rate(n_listed, n_universe))
    inside = listed
    levels = [filter_of(inside, 0, *size)]
    # The corpus is read once; no more than the false positives are kept and compared by key.
    false = checkpointed(_passing(universe, 0, levels[0]).dropDuplicates(["key"])
                         .join(inside.select("key"), "key", "left_anti"))
    while (n := false.count()) > 0:
        level = len(levels)
        if level == MAX_LEVELS:
            raise ValueError(f"{n} keys cannot be told apart by their hashes")
        inside, outside = false, inside
        levels.append(filter_of(inside, level, *_size(n, 0.5)))
        false = checkpointed(_passing(outside, level, levels[level]))
    return levels


def _listed(levels: list[tuple], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Membership of each key: the first filter to refuse it decides, even ones refuse strangers."""
    member = np.full(len(first), len(levels) % 2 == 1)
    open_ = np.arange(len(first))
    for level, bloom in enumerate(levels):
        ok = passes(level, bloom, first[open_], second[open_])
        member[open_[~ok]] = level % 2 == 1
        open_ = open_[ok]
    return member


# -- judging


def _matcher(spark: SparkSession, cascades: list[list[tuple]], part: int, parts: int):
    """Position of the first listed key of a row, times two, plus the place of its action."""
    held = spark.sparkContext.broadcast(cascades)

    @F.arrow_udf("int")
    def found(first: pa.Array, second: pa.Array, dealt: pa.Array) -> pa.Array:
        sizes = first.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        one, two = _unsigned(first.flatten()), _unsigned(second.flatten())
        mine = dealt.flatten().to_numpy(zero_copy_only=False) == part
        ends = np.cumsum(sizes)
        place = np.arange(len(one)) - np.repeat(ends - sizes, sizes)
        best = np.full(len(one), np.iinfo(np.int32).max, np.int64)
        for action, levels in enumerate(held.value):
            member = mine & _listed(levels, one, two) if levels else np.zeros(len(one), bool)
            best = np.where(member, np.minimum(best, place * 2 + action), best)
        out = np.full(len(sizes), -1, np.int64)
        some = np.flatnonzero(sizes > 0)
        if len(some):
            least = np.minimum.reduceat(best, (ends - sizes)[some])
            out[some] = np.where(least < np.iinfo(np.int32).max, least, -1)
        return pa.array(out.astype(np.int32))

    return found


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """`urls` with host, path, rule and verdict; columns of those names are replaced.

    `rules` has host, path (a prefix; empty fits all paths) and action (allow or block). Of the rules
    that fit a URL the longest (host and path together, then the host) decides; a URL that none fits
    is listed nowhere and allowed, its rule is null. A rule listed both ways allows. Rules with a null
    or an empty host, or another action, are errors; a null path is an empty one.

    Null URLs and those without `://` have an empty host and path, so no rule fits them. Repeated
    rows are judged each; an empty table gives no rows; without rules all is allowed. Other columns
    stay as they are. Long URLs are cut at the longest path among the rules, so a key is short.
    """
    spark = urls.sparkSession
    rules = checkpointed(rules.select(
        lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "action"))
    wrong = rules.where("host IS NULL OR host = '' OR action IS NULL OR action NOT IN "
                        "('allow', 'block')").count()
    if wrong:
        raise ValueError(f"{wrong} rules without a host or a known action")
    shapes = _shapes(rules)
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    source = F.col(url_col).cast("string")
    placed = urls.select(*kept, host_of(source).alias("host"), path_of(source).alias("path"))
    if not shapes:
        return placed.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"),
                             F.lit("allow").alias("verdict"))

    universe = placed.select(F.explode(F.transform(
        _keys(F.col("host"), F.col("path"), shapes), lambda k: k["key"])).alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    keyed = rules.select(F.concat("host", "path").alias("key"), "action")
    h1, h2 = _hashes(F.col("key"))
    listed = {
        "allow": keyed.where("action = 'allow'").select("key").distinct(),
        "block": keyed.where("action = 'block'").select("key").distinct()
                      .join(keyed.where("action = 'allow'"), "key", "left_anti")}
    listed = {a: checkpointed(k.select("key", h1.alias("h1"), h2.alias("h2")))
              for a, k in listed.items()}
    counts = {a: k.count() for a, k in listed.items()}
    bits = sum(_size(n, _first_rate(n, size))[0] for n in counts.values() if n)
    parts = max(1, math.ceil(bits / MAX_BITS))

    names = [f"__urlfilter_{n}" for n in ("keys", "at", "found")]
    keys = F.col(names[0])
    judged = placed.withColumn(names[0], _keys(F.col("host"), F.col("path"), shapes)).withColumn(
        names[1], F.lit(-1))
    for part in range(parts):
        whole = universe.select("key", h1.alias("h1"), h2.alias("h2"))
        filters = []
        for action in ACTIONS:
            own = listed[action]
            if parts > 1:
                own = checkpointed(own.where(_part(parts) == part))
            pool = whole.where(_part(parts) == part) if parts > 1 else whole
            filters.append(cascade(own, pool, own.count() if parts > 1 else counts[action],
                                   max(1, size // parts)))
        found = _matcher(spark, filters, part, parts)
        hashed = [F.transform(keys, lambda k: _hashes(k["key"])[0]),
                  F.transform(keys, lambda k: _hashes(k["key"])[1])]
        dealt = F.transform(keys, lambda k: F.pmod(
            F.xxhash64(k["key"], F.lit("part")), F.lit(parts)).cast("int"))
        # Keys are in order, so the smallest position over the parts is the longest rule.
        judged = judged.withColumn(names[2], found(*hashed, dealt)).withColumn(
            names[1], F.when(F.col(names[1]) < 0, F.col(names[2]))
            .when(F.col(names[2]) < 0, F.col(names[1]))
            .otherwise(F.least(names[1], names[2]))).drop(names[2])
        if parts > 1:
            judged = checkpointed(judged)
    at = F.col(names[1])
    return judged.select(
        *kept, "host", "path",
        F.when(at >= 0, F.get(keys, F.shiftright(at, 1))["key"]).alias("rule"),
        F.when((at >= 0) & (at % 2 == 1), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


# -- the registered query

# The rules of the query's contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def report(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, action string")
    return judge(pages.select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path,
    list(struct_pack(n := length(h) + length(p), rule := h || p, action := action)
         ORDER BY length(h) + length(p) DESC, length(h) DESC)[1] AS best
  FROM (SELECT DISTINCT page_id, host, path FROM parts), rules
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT parts.page_id, parts.host, parts.path, best.rule AS rule,
       coalesce(best.action, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path
     AND parts.page_id IS NOT DISTINCT FROM fits.page_id"""
