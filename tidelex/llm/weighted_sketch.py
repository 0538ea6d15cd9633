"""Fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a bag of words, each weighing its count times its length in code points. Weights are whole
numbers, so a word of weight w is the units (word, 1) to (word, w), and a sample is a unit drawn
evenly from all units of the text, by hashes of the unit alone: two texts agree in a sample with the
probability of their generalised Jaccard similarity, sum of min(w, w') over sum of max(w, w').

All samples are drawn together. In round r = 0, 1, ... each unit throws one dart: a hash of (unit, r)
names the sample it meets and its place in the round. In rounds `samples` to 2 * `samples` - 1 every
dart meets sample r - `samples`, so none stays without a dart. A sample keeps the unit of its first
dart. Of a text of W units only the darts before round `HORIZON` * `samples` / W are thrown (all, if W is
at most `HORIZON`): a sample meets none of them with a probability of e^-`HORIZON`, 6e-6, and then
repeats the one before it. So the work is a hash or two a unit and some `HORIZON` * `samples` darts,
not one draw for each word and sample.

With `SAMPLES` samples a likeness has a standard error of at most 0.5 / sqrt(SAMPLES): 0.031 for 256.
A sample is stored as 16 bits of the hash of its dart: chance agreement adds 1 / 65536. Two texts of
one pair are sketched together, so that a unit of both throws its darts once.

Everything after the co-location of a text with its edit runs in one stage: words are counted and
samples are taken on the partitioning by document, without a further shuffle, and no group but that
of a text's samples is ever gathered (sums and minima only).

Defined results: a text without words has the empty fingerprint; two of them are alike (1), one of
them and a text with words are not (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import checkpointed, partitions_for, text_or_empty

SAMPLES = 256
#: Darts a sample meets on average before a text's horizon.
HORIZON = 12
#: Low bits of a dart's time that hold its place in the round; the low 16 of them name the unit.
PLACE = 50
#: Shuffle partitions by document, times those of the session: a task holds the darts of its texts.
FINER = 4
#: Stands for a null id inside this module, and sorts first.
NO_ID = -(1 << 63)


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _limit(text: Column, samples: int, horizon: int = HORIZON) -> Column:
    """The time of a text's horizon."""
    units = F.length(F.regexp_replace(text, r"\s+", ""))
    rounds = F.when(units <= horizon, F.lit(2.0 * samples)).otherwise(
        F.lit(float(horizon * samples)) / units)
    return (rounds * F.lit(2.0 ** PLACE)).cast("long")


def _upto(first: int, count: Column) -> Column:
    """`count` whole numbers from `first`; null for none."""
    count = count.cast("long")
    return F.when(count > 0, F.sequence(F.lit(first).cast("long"), count + F.lit(first - 1)))


def darts(pairs: DataFrame, key: str, first: str, second: str, carried: list[str],
          samples: int = SAMPLES) -> DataFrame:
    """(`key`, row, j, a, b) of every dart that either text of a row throws: the sample it meets and
    its time in each text (null: not thrown). The row number keeps repeated rows apart. Column n of
    `carried` is value a of j = -2 - n. What throws no dart keeps a row with null for j."""
    at, limits = [key, "row"], ["limit_1", "limit_2"]
    numbered = pairs.select(key, *carried, F.monotonically_increasing_id().alias("row"), first, second,
                            _limit(F.col(first), samples).alias("limit_1"),
                            _limit(F.col(second), samples).alias("limit_2"))
    part = lambda side, text, value: F.struct(
        F.lit(side).alias("side"), text.alias("text"), value.alias("value"))
    sides = numbered.select(*at, *limits, F.explode(F.array(
        part(0, F.col(first), F.lit(0).cast("long")), part(1, F.col(second), F.lit(0).cast("long")),
        *[part(2 + n, F.lit(""), F.col(c)) for n, c in enumerate(carried)])).alias("x"))
    words = (sides.select(*at, *limits, "x.*")
             .select(*at, *limits, "side", "value", F.explode(_words(F.col("text"))).alias("w"))
             .select(*at, *limits, "side", F.greatest(F.col("side"), F.lit(1)).alias("kind"),
                     F.xxhash64("w").alias("word"), F.when(F.col("side") > 1, F.col("value"))
                     .otherwise(F.length("w")).alias("size")))
    counted = words.groupBy(*at, *limits, "kind", "word").agg(
        F.sum(F.when(F.col("side") != 1, F.col("size")).otherwise(0)).alias("w1"),
        F.sum(F.when(F.col("side") == 1, F.col("size")).otherwise(0)).alias("w2"))
    # Units of a round: as many as a side has whose horizon the round does not pass. What has none
    # keeps a row (outer).
    rounds = lambda n: F.when((F.col("kind") == 1) & (F.col(f"w{n}") > 0), F.ceil(
        F.col(f"limit_{n}") * F.lit(2.0 ** -PLACE))).otherwise(0)
    by_round = counted.select(*at, *limits, "kind", "word", "w1", "w2", F.explode_outer(
        _upto(0, F.greatest(rounds(1), rounds(2)))).alias("round"))
    start = F.shiftleft(F.col("round"), PLACE)
    reach = lambda n: F.when(start < F.col(f"limit_{n}"), F.col(f"w{n}")).otherwise(0)
    units = by_round.select(*at, *limits, "kind", "word", "w1", "w2", "round", F.explode_outer(
        _upto(1, F.greatest(reach(1), reach(2)))).alias("unit"))
    thrown = (units.withColumn("bits", F.xxhash64("word", "unit", "round"))
              .withColumn("time", start.bitwiseOR(F.shiftrightunsigned("bits", 64 - PLACE)))
              .where(F.col("unit").isNull() | (F.col("time") < F.greatest(*limits))))
    drawn = F.shiftright(F.col("bits").bitwiseAND(F.lit((1 << (64 - PLACE)) - 1)) * samples, 64 - PLACE)
    met = F.when(F.col("kind") > 1, -F.col("kind")).when(F.col("unit").isNotNull(), F.when(
        F.col("round") < samples, drawn).otherwise(F.col("round") - samples))
    time = lambda n: F.when((F.col("unit") <= F.col(f"w{n}"))
                            & (F.col("time") < F.col(f"limit_{n}")), F.col("time"))
    return thrown.select(*at, met.cast("long").alias("j"), F.when(
        F.col("kind") > 1, F.col("w1")).otherwise(time(1)).alias("a"), time(2).alias("b"))


def sketch_pairs(pairs: DataFrame, key: str, first: str, second: str, carried: list[str],
                 samples: int = SAMPLES) -> DataFrame:
    """(`key`, *`carried`, sketch_1, sketch_2) of both texts of each row; sketches are arrays of
    `samples` (at most 1,024) longs under 65536, empty for a text without words.

    With `pairs` partitioned by `key` this is one stage. `carried`, columns of longs, travel as
    samples of their own, so that the many darts stay narrow and nothing is joined afterwards.
    """
    at = [key, "row"]
    least = darts(pairs, key, first, second, carried, samples).groupBy(*at, "j").agg(
        F.min("a").alias("a"), F.min("b").alias("b"))
    # At most `samples` numbers of a text: a sample and its name.
    named = lambda side: F.sort_array(F.collect_list(F.when(
        F.col("j") >= 0, F.shiftleft("j", 16).bitwiseOR(F.col(side).bitwiseAND(F.lit(65535))))))
    found = least.groupBy(*at).agg(
        *[F.max(F.when(F.col("j") == -2 - n, F.col("a"))).alias(c) for n, c in enumerate(carried)],
        named("a").alias("a"), named("b").alias("b"))
    return found.select(key, *carried, _filled("a", samples).alias("sketch_1"),
                        _filled("b", samples).alias("sketch_2"))


def _filled(column: str, samples: int) -> Column:
    """The names alone; a sample that is not there repeats the one before it, the first ones the
    first that is."""
    there = F.col(column)
    name = lambda x: x.bitwiseAND(F.lit(65535))
    repeated = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda j: name(F.element_at(
        there, F.greatest(F.size(F.filter(there, lambda x: F.shiftright(x, 16) <= j)), F.lit(1)))))
    return F.when(F.size(there).isin(0, samples), F.transform(there, name)).otherwise(repeated)


def as_bytes(sketch: Column) -> Column:
    """A sketch as 2 bytes a sample; empty for a text without words."""
    return F.unhex(F.concat_ws("", F.transform(sketch, lambda x: F.lpad(F.hex(x), 4, "0"))))


def as_text(sketch: Column) -> Column:
    """Bytes as hexadecimal digits, 4 a sample."""
    return F.lower(F.hex(sketch))


def likeness(one: Column, other: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two sketches as bytes."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda total, j: (
        total + (one.substr(j * 2 + 1, F.lit(2)) == other.substr(j * 2 + 1, F.lit(2))).cast("int"))
    ) / F.lit(float(samples))
    none = F.lit(b"")
    return (F.when((one == none) & (other == none), F.lit(1.0))
            .when((one == none) | (other == none), F.lit(0.0)).otherwise(same))


def successors(keys: DataFrame, key: str) -> DataFrame:
    """(`key`, next) for distinct keys: the next larger one, null after the last.

    Keys are ordered inside range partitions; only the first and last key of each partition are
    ordered as a whole. Partition numbers are stored, as sampled bounds may differ when re-planned.
    """
    ranged = checkpointed(keys.select(key).repartitionByRange(key)
                          .withColumn("_range", F.spark_partition_id()))
    inside = ranged.withColumn("_next", F.lead(key).over(
        Window.partitionBy("_range").orderBy(key)))
    ends = ranged.groupBy("_range").agg(F.min(key).alias("_head"), F.max(key).alias("_last"))
    # One row a partition.
    following = ends.select(F.col("_last").alias(key), F.lead("_head").over(
        Window.orderBy("_range")).alias("_following"))
    return inside.join(following, key, "left").select(
        key, F.coalesce("_next", "_following").alias("next"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 samples: int = SAMPLES) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text (the last quarter of
    the code points replaced by the head of the next document), and their likenesses.

    Rows that share an id have the same next document; where that id has several rows, the smallest
    head and the smallest fingerprint count. A null id comes before all others. The last document is
    followed by the first (by itself, if it is the only one).
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k"),
                       text_or_empty(F.col(text_col)).alias("text"))
    sizes = checkpointed(rows.groupBy("k").agg(F.max(F.length("text")).alias("n")))
    first = sizes.agg(F.min("k")).first()[0]
    following = checkpointed(sizes.join(successors(sizes, "k"), "k").select(
        "k", "n", F.coalesce("next", F.lit(first).cast("long")).alias("next")))
    # The head of each document goes to the one before it; only that quarter is moved again.
    fine = FINER * partitions_for(docs)
    placed = rows.repartition(fine, "k")
    wanted = following.select(F.col("k").alias("to"), F.col("next").alias("k"),
                              F.floor(F.col("n") / 4).cast("int").alias("q"))
    heads = (placed.join(wanted, "k")
             .select(F.col("to").alias("k"), F.substring("text", F.lit(1), F.col("q"))
                     .alias("head"))
             .repartition(fine, "k").groupBy("k").agg(F.min("head").alias("head")))
    cut = F.floor(F.length("text") / 4).cast("int")
    pairs = placed.join(heads, "k", "left").select(
        "k", "text", F.length("text").cast("long").alias("n_chars"), F.concat(
            F.substring("text", F.lit(1), F.length("text") - cut),
            F.substring(F.coalesce("head", F.lit("")), F.lit(1), cut)).alias("edited"))
    # The digest of the edited text travels as four longs.
    digest = F.sha2(F.encode("edited", "UTF-8"), 256)
    quarters = [f"sha_{n}" for n in range(4)]
    pairs = pairs.select("*", *[F.conv(F.substring(digest, 16 * n + 1, 16), 16, -10).cast("long")
                                .alias(c) for n, c in enumerate(quarters)])
    sha = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in quarters])
    known = checkpointed(sketch_pairs(pairs, "k", "text", "edited", ["n_chars", *quarters], samples)
                         .select("k", "n_chars", F.unhex(sha).alias("sha"),
                                 as_bytes(F.col("sketch_1")).alias("one"),
                                 as_bytes(F.col("sketch_2")).alias("edited")))
    first_of = known.groupBy(F.col("k").alias("next")).agg(F.min("one").alias("following"))
    others = following.select("k", "next").join(first_of, "next").select("k", "following")
    return known.join(others, "k").select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "n_chars", as_text(F.col("sha")).alias("edited_sha256"),
        as_text(F.col("one")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("one"), F.col("edited"), samples).alias("near_edited"),
        likeness(F.col("one"), F.col("following"), samples).alias("near_next"))
