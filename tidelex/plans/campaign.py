"""Corpus to signals: build units, price them against the store, read, reduce, write."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelex.config import Config
from tidelex.errors import BudgetExceeded, EndpointRefused
from tidelex.functions import clock, fingerprint
from tidelex.operators import align, digest, neardup, quota
from tidelex.plans import calls, committee
from tidelex.plans.committee import KEY, Arm
from tidelex.plans.readers import Endpoint
from tidelex.session import checkpointed
from tidelex.sources import answers as store, ledger as ledgers


def stored_digests(kept: DataFrame, sessions: DataFrame) -> DataFrame:
    """Digests of the sessions, cut from the corpus behind them.

    Every tier keys on them and the sinks read them again; a digest is at most its budget long, so
    what is stored is a small part of the text it was built from.
    """
    return checkpointed(digest.build_digests(kept, sessions))


def units_of(digests: DataFrame, replicates: int) -> DataFrame:
    """Every (ticker, session, replicate), sharing the digest of its session."""
    named = digests.select("ticker", F.date_format("session_date", "yyyy-MM-dd").alias("session"),
                           "n_documents", "digest", "digest_sha256")
    return committee.with_replicates(named, replicates)


def build_units(corpus: DataFrame, sessions: DataFrame, replicates: int,
                origin: str = clock.DAILY_ORIGIN) -> DataFrame:
    kept = neardup.keep_first(align.eligible_documents(corpus, sessions, origin))
    return units_of(stored_digests(kept, sessions), replicates)


def price(units: DataFrame, arm: Arm, answers: DataFrame, tier: str = "analyst",
          seat: str = "analyst_fundamentals") -> DataFrame:
    """One row before anything is sent: units, units with a document, units whose first call is
    not stored, calls to pay, and the upper median and maximum of the digest length."""
    per_unit = committee.calls_per_unit(arm.debate_rounds, arm.panel_rounds) if tier == "analyst" else 1
    filled = F.col("n_documents") > 0
    asked = units.where(filled).withColumn("context_sha", F.col("digest_sha256")).select(
        arm.key(tier, seat).alias("cache_key"))
    stored = store.matching(answers, asked).select("cache_key", F.lit(True).alias("stored"))
    # Units are counted per digest length first. No digest is longer than its budget, so the table
    # of lengths has a fixed size.
    lengths = (
        units.select(*KEY, "n_documents", F.col("digest_sha256").alias("context_sha"),
                     F.length("digest").alias("chars"))
        .withColumn("cache_key", F.when(filled, arm.key(tier, seat)))
        .join(stored, "cache_key", "left")
        .groupBy("chars").agg(
            F.count(F.lit(1)).alias("units"), F.count_if(filled).alias("with_document"),
            F.count_if(filled & F.col("stored").isNull()).alias("units_to_pay")))
    held = F.when(F.col("with_document") > 0, F.struct("chars", "with_document"))
    total = lengths.agg(
        *[F.sum(c).alias(c) for c in ("units", "with_document", "units_to_pay")],
        F.array_sort(F.collect_list(held)).alias("steps"))
    median = F.expr(
        "aggregate(steps, struct(cast(null as int) as at, cast(0 as bigint) as seen), "
        "(a, s) -> struct(if(a.at is null and a.seen + s.with_document > with_document div 2, "
        "s.chars, a.at) as at, a.seen + s.with_document as seen)).at")
    return total.select(
        "units", "with_document", "units_to_pay",
        F.try_element_at("steps", F.lit(-1))["chars"].alias("digest_max"),
        median.alias("digest_median"), (F.col("units_to_pay") * per_unit).alias("calls_to_pay"))


class Asking:
    """Sends a stage's missing requests and stores what comes back.

    The stage is priced first: requests are admitted in a fixed order while total spend stays
    within the cap, and the run stops where they no longer fit. Admitted ones go through
    `calls.CallStage`, micro-batch by micro-batch, each logged before the next is sent, and billed and
    stored by itself or with some others. What broken runs have logged is stored when this is made.
    """

    def __init__(self, spark: SparkSession, arm: Arm, endpoint: Endpoint, config: Config,
                 progress: Callable[[str, int, int, dict], None] | None = None):
        self.spark, self.arm, self.endpoint, self.config = spark, arm, endpoint, config
        self.progress = progress
        self.name = f"{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
        self.stage = 0
        self.recovered = calls.recover(spark, config.call_log(), self._commit)

    def __call__(self, asked: DataFrame, contexts: DataFrame, known: DataFrame) -> DataFrame | None:
        config, arm = self.config, self.arm
        missing = store.to_pay(asked, known)
        # Equal keys of one stage are one call, paid by the first unit that needs it.
        others = [c for c in missing.columns if c not in (*KEY, "cache_key")]
        first = missing.groupBy("cache_key").agg(
            F.min(F.struct(*KEY, *others)).alias("first")).select("cache_key", "first.*")
        priced = first.withColumn(
            "estimate", fingerprint.cost_estimate(F.col("context_chars"), F.col("system_chars"),
                                                  arm.max_output_tokens))
        spent = ledgers.total_cost(self.spark, config.ledger_path, config.prior_ledgers)
        planned = checkpointed(quota.admit_within_budget(
            checkpointed(priced), "estimate", spent, config.budget_usd, "ticker",
            ["session", "replicate", "mandate"], F.col("session")))
        if planned.isEmpty():
            return None
        self.stage += 1
        tier = planned.first()["tier"]
        told = self.progress and (lambda *seen: self.progress(tier, *seen))
        sent = calls.CallStage(
            self.spark, self.endpoint, f"{config.call_log()}/{self.name}/s{self.stage}-{tier}",
            self._commit, config.calls_per_worker, told)
        attempts = sent.run(self._requests(planned.where("admitted"), contexts))
        if sent.stopped:
            raise EndpointRefused("the endpoint refuses durably; stored answers are kept")
        if not planned.where("NOT admitted").isEmpty():
            raise BudgetExceeded(f"{spent:.4f} USD are spent and the remaining calls do not fit "
                                 f"under {config.budget_usd:.2f}; stored answers are kept")
        payers = planned.select("cache_key", F.struct(*KEY).alias("payer"))
        return attempts.where("parse_ok").join(payers, "cache_key").select(
            "cache_key", "raw", "cost_usd", "payer")

    def _own_log(self) -> DataFrame:
        found = calls.logged(self.spark, "")
        for folder in calls.stages(self.spark, self.config.call_log(), self.name):
            found = found.unionByName(calls.logged(self.spark, folder))
        return found

    def refused(self) -> DataFrame:
        """Keys that this run asked for in vain. A call whose attempts ran out is settled, unlike one
        that was never reached."""
        return self._own_log().where("event = 'refused'").select("cache_key")

    def own_answers(self) -> DataFrame:
        return checkpointed(self._own_log().where("parse_ok").select("cache_key", "raw", "cost_usd"))

    def _requests(self, admitted: DataFrame, contexts: DataFrame) -> DataFrame:
        """What is sent, with what the ledger wants to know of it."""
        route = committee.route(self.arm.debate_rounds, self.arm.panel_rounds, self.arm.analysts)
        route = [*dict.fromkeys(route), ("single", committee.SINGLE_READER)]
        known = [(tier, seat) for tier, seat in route
                 if committee.mandate_of(tier, seat) in self.arm.mandates]
        systems = F.create_map(*[F.lit(part) for tier, seat in known
                                 for part in (f"{tier}|{seat}", self.arm.system(tier, seat))])
        shas = F.create_map(*[F.lit(part) for name, m in self.arm.mandates.items()
                              for part in (name, m.sha)])
        return admitted.join(contexts.select(*KEY, "context"), KEY).select(
            "cache_key", "tier", "seat",
            systems[F.concat_ws("|", "tier", "seat")].alias("system"), "context", *KEY, "mandate",
            F.lit(self.arm.model).alias("model_requested"),
            fingerprint.short(shas[F.col("mandate")]).alias("mandate_sha256"),
            fingerprint.short(F.col("context_sha")).alias("context_sha256"))

    def _commit(self, attempts: DataFrame, requests: DataFrame, name: str) -> None:
        known = requests.drop("tier", "seat", "system", "context")
        rows = (attempts.join(known, "cache_key")
                .withColumn("cache_key", fingerprint.short(F.col("cache_key")))
                .withColumn("parse_ok", F.col("parse_ok").cast("int")))
        ledgers.append_ledger(rows, self.config.ledger_path, name)
        store.append_answers(attempts.where("parse_ok"), self.config.answers_path, name)


def run(units: DataFrame, arm: Arm, answers: DataFrame, ask=None,
        single: bool = False) -> DataFrame:
    """Raw rows of a campaign: the nine-call chain, or the one-call control."""
    return committee.summarise(units, _readings(units, arm, answers, ask, single), single)


def run_in_instalments(units: DataFrame, arm: Arm, answers, asking_of: Callable[[int], Asking],
                       single: bool = False) -> tuple[DataFrame, list[Asking]]:
    """Raw rows of a campaign that may cost more than one budget, and who asked.

    `asking_of(n)` opens instalment n: a ledger and a budget of its own on the same answer store.
    An instalment that meets its cap hands on the units it did not reach; one that reaches none
    raises, since the next could not either. Every unit has the row of the instalment that settled it.
    """
    askings, parts, left = [], [], units
    while True:
        askings.append(asking_of(len(askings)))
        try:
            parts.append(checkpointed(run(left, arm, answers, askings[-1], single)))
            return reduce(DataFrame.unionByName, parts), askings
        except BudgetExceeded:
            rows = checkpointed(finished(left, arm, askings[-1], single))
            if rows.where("calls > 0 OR n_failures > 0").isEmpty():
                raise
            parts.append(rows)
            left = checkpointed(left.join(rows.select(*KEY), KEY, "left_anti"))


def finished(units: DataFrame, arm: Arm, asking: Asking, single: bool = False) -> DataFrame:
    """Raw rows of a stopped run: units whose every call was answered or refused, and silent ones.

    A unit with refused calls has its failures counted, as in a run that was not stopped; a unit
    with a call that was never reached has no row. What this run has answered counts as billed.
    """
    own, refused = asking.own_answers(), asking.refused()

    def stored(asked: DataFrame) -> DataFrame:
        return store.lookup(asking.spark, asking.config.answers_path, asked).join(
            own, "cache_key", "left_anti")

    def replay(asked: DataFrame, contexts: DataFrame, known: DataFrame) -> DataFrame:
        payers = asked.groupBy("cache_key").agg(F.min(F.struct(*KEY)).alias("payer"))
        return own.join(payers, "cache_key")

    readings = checkpointed(_readings(units, arm, stored, replay, single))
    unreached = (readings.where("NOT parse_ok AND NOT cache_hit")
                 .join(refused, "cache_key", "left_anti").select(*KEY).distinct())
    return committee.summarise(units.join(unreached, KEY, "left_anti"),
                               readings.join(unreached, KEY, "left_anti"), single)


def _readings(units: DataFrame, arm: Arm, answers, ask, single: bool) -> DataFrame:
    read = committee.read_singles if single else committee.read_units
    return read(units, arm, answers, ask)


def report(raw: DataFrame, signals: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows, units kept and dropped, billed calls, cost and cost per kept unit."""
    parts = [
        raw.select(F.lit(1).alias("raw_rows"), "calls", "cost_usd"),
        signals.select(F.lit(1).alias("combined_units")),
        dropped.select(F.lit(1).alias("rejected_units"))]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("raw_rows", "combined_units", "rejected_units")],
        F.sum("calls").alias("billed_calls"), F.sum("cost_usd").alias("cost_usd")).withColumn(
        "cost_per_unit", F.col("cost_usd") / F.greatest(F.lit(1), F.col("combined_units")))
