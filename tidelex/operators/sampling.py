"""Choosing sessions: bounds, a stride over the window, and a stratified draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidelex.operators.ordered import with_position
from tidelex.operators.regime import classify_panel, month_of
from tidelex.session import checkpointed

# Fixed value: the seed of the draw.
SEED = 20260808


def sessions_between(panel: DataFrame, start: str | None = None, end: str | None = None,
                     tickers: list[str] | None = None) -> DataFrame:
    """Distinct sessions per ticker inside the inclusive bounds."""
    chosen = panel.select("ticker", F.col("session_date").cast("date").alias("session_date"))
    if tickers is not None:
        chosen = chosen.where(F.col("ticker").isin(*tickers))
    if start:
        chosen = chosen.where(F.col("session_date") >= F.lit(start).cast("date"))
    if end:
        chosen = chosen.where(F.col("session_date") <= F.lit(end).cast("date"))
    return chosen.distinct()


def stride_sample(sessions: DataFrame, limit: int | None) -> DataFrame:
    """`limit` sessions per ticker, at places floor(i * n / limit) of its ordered sessions."""
    if not limit:
        return sessions
    placed = with_position(sessions, ["ticker"], ["session_date"], month_of("session_date"))
    sizes = sessions.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    step = F.col("n") / F.lit(limit)
    near = F.floor(F.col("position") / step)
    taken = F.lit(False)
    for shift in (-1, 0, 1):
        i = near + shift
        place = F.least(F.col("n") - 1, F.floor(i * step))
        taken = taken | ((i >= 0) & (i < limit) & (place == F.col("position")))
    return (placed.join(sizes, "ticker").where((F.col("n") <= limit) | taken)
            .select("ticker", "session_date"))


def draw(panel: DataFrame, per_ticker: int, balance: float = 0.5, seed: int = SEED) -> DataFrame:
    """About `per_ticker` sessions per instrument, split by regime and spread over its years.

    Each (ticker, regime) takes an equal share from every year that has candidates, then tops up
    from the rest. Candidates are ordered by a hash of (seed, ticker, date), so the draw needs no
    generator state and is the same whatever the partitioning.
    """
    marked = (
        classify_panel(panel.withColumn("session_date", F.col("session_date").cast("date")))
        .where(F.col("stressed").isNotNull())
        .select("ticker", "session_date", "trailing_vol", "stressed",
                F.year("session_date").alias("year"),
                F.sha2(F.concat_ws("|", F.lit(str(seed)), "ticker",
                                   F.date_format("session_date", "yyyy-MM-dd")), 256)
                .alias("draw_key")))
    years = marked.select("ticker", "year").distinct().groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_years"))
    # Python's round is half-even, which is what the shares are defined with.
    wants = {1.0: int(round(per_ticker * balance)), 0.0: int(round(per_ticker * (1 - balance)))}
    most = max(1, *wants.values())
    want = F.when(F.col("stressed") == 1.0, F.lit(wants[1.0])).otherwise(F.lit(wants[0.0]))
    quota = F.greatest(F.lit(1), F.floor(want / F.col("n_years")))

    in_year = Window.partitionBy("ticker", "stressed", "year").orderBy("draw_key")
    # No year gives more than its quota plus a full top-up: a constant limit Spark applies before
    # the shuffle.
    ranked = checkpointed(
        marked.withColumn("rank", F.row_number().over(in_year)).where(F.col("rank") <= 2 * most)
        .join(years, "ticker").withColumn("want", want).withColumn("quota", quota))
    taken = ranked.where(F.col("rank") <= F.col("quota"))
    sizes = taken.groupBy("ticker", "stressed").agg(F.count(F.lit(1)).alias("taken"))
    spare = Window.partitionBy("ticker", "stressed").orderBy("draw_key")
    topped = (ranked.where(F.col("rank") > F.col("quota"))
              .withColumn("spare", F.row_number().over(spare))
              .where(F.col("spare") <= most)
              .join(sizes, ["ticker", "stressed"])
              .where(F.col("spare") <= F.col("want") - F.col("taken")))
    out = ["ticker", "session_date", "trailing_vol", "stressed"]
    return taken.select(*out).unionByName(topped.select(*out))


def sample_table(sample: DataFrame) -> DataFrame:
    """Sessions drawn and stressed sessions per ticker and year."""
    return (sample.groupBy("ticker", F.year("session_date").alias("year"))
            .agg(F.count(F.lit(1)).alias("sessions"),
                 F.sum("stressed").cast("long").alias("stressed")))


#: Lines that one task may hold for the one-text hash: some 30 MB.
MAX_LINES = 1_000_000
#: Tickers meet in groups by this many hexadecimal digits of their hash, then 16 groups at a time.
TREE_DIGITS = 4


def fingerprint(sample: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """SHA-256 over the sorted `ticker|date` lines of a sampling frame, as one row.

    The hash is of one text by definition, made in one task: a frame of more lines has a null hash
    here, and is named by `tree_fingerprint`.
    """
    n = sample.count()
    if n > max_lines:
        return sample.sparkSession.createDataFrame([(None, n)], "sha256 string, n long")
    line = F.concat_ws("|", "ticker", F.date_format("session_date", "yyyy-MM-dd"))
    lines = F.array_sort(F.collect_list(line))
    return sample.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"),
                      F.count(F.lit(1)).alias("n"))


def tree_fingerprint(sample: DataFrame) -> DataFrame:
    """The root of a hash tree over a frame of any size, as one row (sha256, n).

    Leaves are the dates of a ticker's year, each with its number of rows; years hash to a ticker,
    tickers to groups by the head of their own hash, and 16 groups to one above, up to the root. What
    meets in a node is bounded by the calendar, by 16, or by the tickers over 16^TREE_DIGITS, and is
    ordered by what it is, so the root depends on the rows alone.
    """
    def joined(name: str, *order: str):
        return F.sha2(F.concat_ws("\n", F.transform(
            F.array_sort(F.collect_list(F.struct(*order, name))), lambda x: x[name])), 256)

    name = F.coalesce("ticker", F.lit(""))
    days = sample.groupBy(name.alias("ticker"), "session_date").agg(F.count(F.lit(1)).alias("rows"))
    lines = days.select("ticker", "session_date", "rows", F.coalesce(
        F.year("session_date"), F.lit(0)).alias("year"), F.concat_ws("|", F.coalesce(
            F.date_format("session_date", "yyyy-MM-dd"), F.lit("")), "rows").alias("line"))
    years = lines.groupBy("ticker", "year").agg(joined("line", "session_date").alias("hash"),
                                                F.sum("rows").alias("n"))
    # `path` is where a node hangs; each level takes one digit off.
    nodes = years.groupBy("ticker").agg(joined("hash", "year").alias("hash"), F.sum("n").alias("n"))
    nodes = nodes.select(F.sha2("ticker", 256).alias("own"), F.sha2(F.concat_ws(
        "|", F.sha2("ticker", 256), "hash"), 256).alias("hash"), "n").withColumn(
        "path", F.substring("own", 1, TREE_DIGITS))
    for level in range(TREE_DIGITS, 0, -1):
        nodes = nodes.groupBy("path").agg(joined("hash", "own").alias("hash"), F.sum("n").alias("n"))
        nodes = nodes.select(F.col("path").alias("own"), "hash", "n",
                             F.substring("path", 1, level - 1).alias("path"))
    return nodes.agg(joined("hash", "own").alias("sha256"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
