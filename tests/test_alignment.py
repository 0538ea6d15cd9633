import datetime as dt
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex import session
from tidelex.errors import AmbiguousZone, MissingColumn, MissingInput
from tidelex.functions import clock, text
from tidelex.operators import align, digest, neardup
from tidelex.sources import corpus
from tidelex.sources.tables import children

UTC = dt.timezone.utc
NEWS = ("doc_id string, ticker string, published_utc timestamp, title string, body string, "
        "source string")


def at(stamp):
    return dt.datetime.fromisoformat(stamp).replace(tzinfo=UTC)


def news(spark, rows):
    """Rows of (doc_id, stamp, body) or (doc_id, stamp, body, ticker)."""
    return spark.createDataFrame(
        [(r[0], r[3] if len(r) > 3 else "TTE.PA", at(r[1]), "t", r[2], "s") for r in rows], NEWS)


def sessions(spark, *days, ticker="TTE.PA"):
    return spark.createDataFrame([(ticker, dt.date.fromisoformat(d)) for d in days],
                                 "ticker string, session_date date")


def seen(spark, rows, *days, **settings):
    found = align.eligible_documents(news(spark, rows), sessions(spark, *days), **settings)
    return sorted((str(r["session_date"]), r["doc_id"]) for r in found.collect())


LONG = "x " * 150


@pytest.mark.parametrize("day,hour", [("2025-01-15", 16), ("2025-07-15", 15)])
def test_origin_follows_daylight_saving(spark, day, hour):
    got = spark.range(1).select(clock.origin_instant(F.lit(day).cast("date")).alias("o"))
    stamp = got.select(F.date_format("o", "HH:mm")).first()[0]
    assert stamp == f"{hour}:30"


def test_origin_itself_belongs_to_the_next_window(spark):
    rows = [("a", "2025-01-15 16:29:59", LONG), ("b", "2025-01-15 16:30:00", LONG),
            ("c", "2025-01-15 16:30:01", LONG)]
    assert seen(spark, rows, "2025-01-15", "2025-01-16") == [
        ("2025-01-15", "a"), ("2025-01-16", "b"), ("2025-01-16", "c")]


def test_lookback_is_one_day_unless_said_otherwise(spark):
    rows = [("near", "2025-01-14 17:00:00", LONG), ("far", "2025-01-08 17:00:00", LONG)]
    assert seen(spark, rows, "2025-01-15") == [("2025-01-15", "near")]
    assert len(seen(spark, rows, "2025-01-15", lookback_days=7)) == 2


def test_weekend_news_between_two_friday_closes_is_lost(spark):
    rows = [("sat", "2025-01-11 12:00:00", LONG), ("sun", "2025-01-12 17:00:00", LONG)]
    assert seen(spark, rows, "2025-01-10", "2025-01-13") == [("2025-01-13", "sun")]


@pytest.mark.parametrize("chars,kept", [(199, 0), (200, 1)])
def test_short_documents_are_dropped(spark, chars, kept):
    assert len(seen(spark, [("a", "2025-01-15 10:00:00", "é" * chars)], "2025-01-15")) == kept


def test_other_instruments_are_not_seen(spark):
    rows = [("a", "2025-01-15 10:00:00", LONG, "ATO.PA"), ("b", "2025-01-15 10:00:00", LONG)]
    assert seen(spark, rows, "2025-01-15") == [("2025-01-15", "b")]


@pytest.mark.parametrize("origin,lookback", [("17:30:00", 1), ("08:59:59", 1), ("17:30:00", 3)])
def test_window_equals_the_range_condition_across_clock_changes(spark, origin, lookback):
    from zoneinfo import ZoneInfo
    rng = random.Random(7)
    start = dt.datetime(2024, 3, 25, tzinfo=UTC)
    stamps = [start + dt.timedelta(seconds=rng.randrange(12 * 86400)) for _ in range(300)]
    autumn = dt.datetime(2024, 10, 21, tzinfo=UTC)
    stamps += [autumn + dt.timedelta(seconds=rng.randrange(12 * 86400)) for _ in range(300)]
    days = [dt.date(2024, 3, 25) + dt.timedelta(d) for d in range(14)]
    days += [dt.date(2024, 10, 21) + dt.timedelta(d) for d in range(14)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, ts timestamp")
    got = {(r["i"], r["d"]) for r in frame.select("i", F.explode(clock.sessions_seeing(
        F.col("ts"), lookback, origin)).alias("d")).collect() if r["d"] in days}
    wall = dt.time.fromisoformat(origin)
    expected = set()
    for (i, stamp), day in itertools.product(enumerate(stamps), days):
        end = dt.datetime.combine(day, wall, ZoneInfo("Europe/Paris")).astimezone(UTC)
        if end - dt.timedelta(hours=24 * lookback) <= stamp < end:
            expected.add((i, day))
    assert got == expected


def test_naive_timestamps_are_refused(spark):
    naive = spark.sql("SELECT 'a' doc_id, 'T' ticker, 'b' body, "
                      "TIMESTAMP_NTZ'2025-01-15 10:00:00' published_utc")
    with pytest.raises(AmbiguousZone):
        corpus.checked(naive)
    with pytest.raises(MissingColumn):
        corpus.checked(naive.drop("body"))


def test_streams_are_united_and_absence_is_an_error(spark, tmp_path):
    with pytest.raises(MissingInput):
        corpus.load_corpus(spark, str(tmp_path))
    news(spark, [("a", "2025-01-15 10:00:00", LONG)]).write.parquet(
        f"{tmp_path}/news_amf.parquet")
    news(spark, [("m", "2025-01-15 10:00:00", LONG)]).drop("title").write.parquet(
        f"{tmp_path}/news_macro_bfm.parquet")
    both = corpus.load_corpus(spark, str(tmp_path))
    assert {(r["doc_id"], r["title"]) for r in both.collect()} == {("a", "t"), ("m", None)}
    only = corpus.load_corpus(spark, str(tmp_path), corpus.ISSUER_STREAMS)
    assert [r["doc_id"] for r in only.collect()] == ["a"]


# -- near copies


def greedy(bodies, threshold=0.85):
    kept = []
    for at_, body in enumerate(bodies):
        w = body.lower().split()
        grams = {" ".join(w[i:i + 3]) for i in range(len(w) - 2)}
        if grams and not any(len(grams & k) / max(1, min(len(grams), len(k))) >= threshold
                             for _, k in kept):
            kept.append((at_, grams))
    return [at_ for at_, _ in kept]


def copies(seed, n=120):
    """Groups of near copies around a few originals, contained texts, short texts, exact copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 60]))]
                 for _ in range(8)]
    bodies = []
    for _ in range(n):
        words = list(rng.choice(originals))
        kind = rng.random()
        if kind < 0.3:
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.5:
            words = words[:rng.randrange(2, len(words))]
        elif kind < 0.6:
            words = words + [rng.choice(vocabulary) for _ in range(40)]
        bodies.append(" ".join(words))
    return bodies


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("cap", [32_000_000, 0])
def test_greedy_rule_within_and_across_tasks(spark, seed, cap):
    expected, rows = {}, []
    for unit in ("A", "B"):
        bodies = copies(seed * 10 + ord(unit), 60)
        expected[unit] = [f"{i:03d}" for i in greedy(bodies)]
        rows += [(f"{i:03d}", "2025-01-15 10:00:00", b, unit) for i, b in enumerate(bodies)]
    docs = align.eligible_documents(
        news(spark, rows), sessions(spark, "2025-01-15", ticker="A").union(
            sessions(spark, "2025-01-15", ticker="B")), min_chars=0)
    kept = neardup.keep_first(docs, max_unit_chars=cap).collect()
    got = {u: sorted(r["doc_id"] for r in kept if r["ticker"] == u) for u in expected}
    assert got == expected
    assert {(r["ticker"], r["n_documents"]) for r in kept} == {
        (u, len(ids)) for u, ids in expected.items()}


def test_a_chain_of_near_copies_is_resolved_in_logarithmic_rounds(spark, monkeypatch):
    """Each text is a copy of its neighbours only: every other one stays."""
    n, step, width = 400, 3, 26
    bodies = [" ".join(f"w{w}" for w in range(i * step, i * step + width)) for i in range(n)]
    docs = spark.createDataFrame(
        [(f"{i:04d}", "2025-01-15", b, "", "s", "t") for i, b in enumerate(bodies)],
        "doc_id string, published_utc string, body string, title string, source string, unit string")
    rounds = []
    whole = neardup._settle
    monkeypatch.setattr(neardup, "_settle", lambda *a: rounds.append(1) or whole(*a))
    kept = neardup.keep_first(docs, unit=["unit"], max_unit_chars=0).collect()
    assert sorted(r["doc_id"] for r in kept) == [f"{i:04d}" for i in greedy(bodies)]
    assert len(kept) == n // 2 and len(rounds) <= 6


def test_chain_ends(spark):
    links = [(f"{i:04d}", f"{i - 1:04d}") for i in range(1, 1000)] + [("a", "0007"), ("b", "x")]
    table = spark.createDataFrame([("u", *r) for r in links], "unit string, spot string, to string")
    got = {r["spot"]: (r["to"], r["odd"])
           for r in neardup._chain_ends(table, ["unit"]).collect()}
    assert got == {**{f"{i:04d}": ("0000", i % 2 == 1) for i in range(1, 1000)},
                   "a": ("0000", False), "b": ("x", True)}


def test_a_shared_phrase_links_in_proportion(spark):
    """Texts of their own words around one phrase, and the phrase alone once."""
    def linked(n):
        phrase = " ".join(f"p{i}" for i in range(12))
        rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + " " + phrase) for i in range(n)]
        rows.append((n, phrase))
        table = spark.createDataFrame(rows, "spot int, body string").select(
            "spot", F.lit("u").alias("unit"),
            text.trigrams(text.words(F.col("body"))).alias("grams")).withColumn(
            "n", F.size("grams")).where("n > 0")
        links = neardup._links(table, 0.85, ["unit"])
        alive = links.withColumn("fate", F.lit("open"))
        similar, beyond = neardup._compare(table, alive, 1_000_000, 0.85, ["unit"])
        assert beyond.isEmpty()
        return links.count(), similar.count()

    small, large = linked(100), linked(200)
    assert small[1] == 100 and large[1] == 200
    assert large[0] <= 2.1 * small[0]
    # Without the short text nothing is linked at all.
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)) + " p q r s t u") for i in range(50)]
    table = spark.createDataFrame(rows, "spot int, body string").select(
        "spot", F.lit("u").alias("unit"),
        text.trigrams(text.words(F.col("body"))).alias("grams")).withColumn("n", F.size("grams"))
    assert neardup._links(table, 0.85, ["unit"]).count() == 0


def test_trigram_sets_do_not_travel_whole(spark, monkeypatch):
    """Of long texts only a part of the trigrams is stored and shuffled, and a null unit is one."""
    long = [" ".join(f"{n}w{i}" for i in range(300)) for n in range(30)]
    bodies = long + [b + " more words" for b in long[:3]] + copies(7, 30)
    docs = spark.createDataFrame(
        [(f"{i:04d}", "2025-01-15", b, "", "s", "t", u) for i, b in enumerate(bodies)
         for u in ("u", None)], "doc_id string, published_utc string, body string, title string, "
        "source string, text_key string, unit string")
    stored, whole = [], neardup.checkpointed

    def counted(df):
        df = whole(df)
        arrays = [F.sum(F.coalesce(F.array_size(f.name), F.lit(0))) for f in df.schema
                  if f.dataType.typeName() == "array"]
        stored.append(sum(x or 0 for x in df.agg(*arrays).first()) if arrays else df.count())
        return df

    monkeypatch.setattr(neardup, "checkpointed", counted)
    kept = neardup.keep_first(docs, unit=["unit"], max_unit_chars=0).collect()
    expected = [f"{i:04d}" for i in greedy(bodies)]
    for unit in ("u", None):
        mine = [r for r in kept if r["unit"] == unit]
        assert sorted(r["doc_id"] for r in mine) == expected
        assert {r["n_documents"] for r in mine} == {len(expected)}
    assert max(stored) <= 0.5 * 2 * sum(max(0, len(b.split()) - 2) for b in bodies)


@pytest.mark.parametrize("grams", [64_000_000, 600])
def test_large_units_leave_little_on_disk_and_may_be_sliced(spark, monkeypatch, grams):
    """Tables go as soon as nothing reads them, and slices give the same documents."""
    bodies = copies(11, 60)
    docs = spark.createDataFrame(
        [(f"{i:04d}", "2025-01-15", b, "", "s", "t", u) for i, b in enumerate(bodies)
         for u in ("u", None)], "doc_id string, published_utc string, body string, title string, "
        "source string, text_key string, unit string")
    made, sliced = [], []

    class Watched(session.Scratch):
        def __init__(self, spark):
            super().__init__(spark)
            made.append(self)

    whole = neardup._slices
    monkeypatch.setattr(neardup, "Scratch", Watched)
    monkeypatch.setattr(neardup, "GRAMS_AT_ONCE", grams)
    monkeypatch.setattr(neardup, "_slices", lambda *a: sliced.append(whole(*a)) or sliced[-1])
    kept = neardup.keep_first(docs, unit=["unit"], max_unit_chars=0)
    assert sum(len(children(spark, scratch.folder)) for scratch in made) == 1
    assert {len(parts) > 1 for parts in sliced[:3]} == {grams == 600}
    rows, expected = kept.collect(), [f"{i:04d}" for i in greedy(bodies)]
    for unit in ("u", None):
        mine = [r for r in rows if r["unit"] == unit]
        assert sorted(r["doc_id"] for r in mine) == expected
        assert {r["n_documents"] for r in mine} == {len(expected)}


def test_a_table_of_a_scratch_takes_no_shuffle_with_it(spark):
    """The shuffles behind a table are gone when it is written, and the table when it is dropped."""
    def files():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(
            ).getAllFiles().size()

    setting, scratch = spark.conf.get(session.SHUFFLES_GO, None), session.Scratch(spark)
    before = files()
    table = scratch.keep(spark.range(1000).repartition(4).groupBy("id").count().repartition(3))
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before
    assert table.count() == 1000 and len(children(spark, scratch.folder)) == 1
    scratch.drop(table)
    assert children(spark, scratch.folder) == []
    assert spark.conf.get(session.SHUFFLES_GO, None) == setting


def test_units_may_span_batches_and_stay_in_arrow(spark):
    bodies = copies(5, 40)
    docs = spark.createDataFrame(
        [(f"{i:04d}", "2025-01-15", b, "", "s", "t", u) for i, b in enumerate(bodies)
         for u in ("u", "v", None)], "doc_id string, published_utc string, body string, "
        "title string, source string, text_key string, unit string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        kept = neardup.keep_first(docs, unit=["unit"])
        assert "MapInPandas" not in kept._jdf.queryExecution().toString()
        kept = kept.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = [f"{i:04d}" for i in greedy(bodies)]
    for unit in ("u", "v", None):
        mine = [r for r in kept if r["unit"] == unit]
        assert sorted(r["doc_id"] for r in mine) == expected
        assert {r["n_documents"] for r in mine} == {len(expected)}


@pytest.mark.parametrize("cap", [32_000_000, 0])
def test_identical_rows_and_wordless_texts(spark, cap):
    body = " ".join(f"w{i}" for i in range(200))
    rows = [("a", "2025-01-15 10:00:00", body), ("a", "2025-01-15 10:00:00", body),
            ("b", "2025-01-15 11:00:00", body), ("c", "2025-01-15 09:00:00", "x" * 300)]
    docs = align.eligible_documents(news(spark, rows), sessions(spark, "2025-01-15"))
    kept = neardup.keep_first(docs, max_unit_chars=cap).collect()
    assert [(r["doc_id"], r["n_documents"]) for r in kept] == [("a", 1)]


def test_trigram_codes_are_exact_for_small_and_large_vocabularies():
    bodies = copies(3, 50)
    assert np.flatnonzero(neardup.first_of_its_kind(bodies, 0.85)).tolist() == greedy(bodies)
    one, two = neardup._gram_codes(bodies), neardup._gram_codes(bodies, one_step=0)
    for a, b in itertools.combinations(range(len(bodies)), 2):
        assert len(np.intersect1d(one[a], one[b])) == len(np.intersect1d(two[a], two[b]))


def test_words_split_like_unicode_text(spark):
    body = "A b\x1cc\u0085D  e\n"
    row = spark.createDataFrame([(body,)], "b string").select(text.words(F.col("b"))).first()[0]
    assert row == body.lower().split()


# -- digests


def digest_of(spark, rows, **settings):
    s = sessions(spark, "2025-01-15")
    kept = neardup.keep_first(align.eligible_documents(news(spark, rows), s, min_chars=1))
    return digest.build_digests(kept, s, **settings).first()


def plain_digest(docs, max_tokens):
    """The layout as a loop over (stamp, title, source, body), newest first."""
    header = "Instrument: TTE.PA\nSession: 2025-01-15\n"
    budget, blocks, used = max_tokens * 4 - len(header) - 1, [], 0
    for rank, (stamp, body) in enumerate(reversed(docs), 1):
        top = f"[DOCUMENT {rank}]\nSource: s\nPublished: {at(stamp).isoformat()}\nTitle: t\n\n"
        block = f"{top}{body}\n"
        if used + len(block) > budget:
            if blocks:
                break
            room = max(0, budget - len(top) - len(text.EXCERPT_MARKER))
            head = body[:room]
            if head.rfind("\n\n") > room * 0.6:
                head = head[:head.rfind("\n\n")]
            block = top + head + text.EXCERPT_MARKER
        blocks.append(block)
        used += len(block)
    return header + "\n" + "\n".join(reversed(blocks))


def test_silent_session_has_a_header_only(spark):
    row = digest_of(spark, [("a", "2025-02-15 10:00:00", LONG)])
    assert row["digest"] == "Instrument: TTE.PA\nSession: 2025-01-15\n"
    assert row["n_documents"] == 0


@pytest.mark.parametrize("max_tokens", [30, 100, 160, 400, 3000])
def test_digest_layout_and_budget(spark, max_tokens):
    rng = random.Random(max_tokens)
    docs = []
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 120))]
        body = " ".join(words)
        if i % 3 == 0:
            body = body[:len(body) // 2] + "\n\n" + body[len(body) // 2:]
        docs.append((f"2025-01-15 {i + 2:02d}:00:00" + (".000250" if i == 5 else ""), body))
    row = digest_of(spark, [(f"{i:02d}", s, b) for i, (s, b) in enumerate(docs)],
                    max_tokens=max_tokens)
    assert row["digest"] == plain_digest(docs, max_tokens)
    assert row["n_documents"] == 12


def test_paragraph_break_ends_an_excerpt(spark):
    body = "a" * 150 + "\n\n" + "b " * 400
    row = digest_of(spark, [("a", "2025-01-15 10:00:00", body + " c d")], max_tokens=90)
    assert row["digest"] == plain_digest([("2025-01-15 10:00:00", body + " c d")], 90)
    assert "b " not in row["digest"].split("Title")[1]
