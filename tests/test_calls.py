"""Durable calls: broken runs, durable refusals, the shared quota, the store they fill."""

import json
import os
import sys
import time
import uuid
from collections import Counter
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelex.config import Config
from tidelex.errors import BudgetExceeded, EndpointRefused
from tidelex.functions.governor import Limits, RateGovernor, Use
from tidelex.operators import quota
from tidelex.plans import calls, campaign, committee
from tidelex.plans.readers import Endpoint
from tidelex.sources import answers, ledger
from tidelex.sources.prompts import Mandate
from tidelex.sources.tables import children, exists

# The endpoints below run in Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SINGLE = {"relevance": .8, "polarity": .5, "intensity": .6, "ambiguity": .3, "log_amplitude": .5,
          "shock_kind": "issuer_results", "is_new_information": True, "evidence": "words"}
UNIT = ("ticker string, session string, replicate int, digest string, digest_sha256 string, "
        "n_documents int")


class Paid:
    """An endpoint whose sends leave a file each, so that all processes can be counted."""

    def __init__(self, folder, outcome=None):
        self.folder, self.outcome = str(folder), outcome
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, **payload):
        text = payload["messages"][1]["content"]
        with open(f"{self.folder}/{text}-{uuid.uuid4().hex}", "w"):
            pass
        if self.outcome is not None:
            self.outcome(self.folder, text)
        usage = SimpleNamespace(prompt_tokens=1000, completion_tokens=100, prompt_tokens_details=None)
        body = SimpleNamespace(message=SimpleNamespace(content=json.dumps(SINGLE)))
        return SimpleNamespace(choices=[body], usage=usage, model="m")

    def sent(self):
        return Counter(name.split("-")[0] for name in os.listdir(self.folder))


def _still(_):
    pass


def endpoint(send, workers=2):
    return Endpoint("MiniMax-M2", send=send, sleep=_still, min_interval_s=0, workers=workers,
                    limits=Limits(1e9, 1e6))


def arm():
    return committee.Arm({committee.SINGLE_READER: Mandate("Read.", "sha")})


def units(spark, n):
    return spark.createDataFrame([(f"T{i % 3}", f"2025-01-{i + 1:02d}", 0, f"text{i}", f"sha{i}", 1)
                                  for i in range(n)], UNIT)


@pytest.fixture
def config(tmp_path):
    return Config(answers_path=f"{tmp_path}/answers", ledger_path=f"{tmp_path}/ledger",
                  calls_per_worker=2)


def run(spark, config, send, n=12, progress=None, workers=2):
    asking = campaign.Asking(spark, arm(), endpoint(send, workers), config, progress)
    return asking, campaign.run(units(spark, n), arm(),
                                answers.StoredAnswers(spark, config.answers_path), asking, True)


def ledger_rows(spark, config):
    return ledger.read_ledger(spark, config.ledger_path)


def die_at_the_sixth(folder, text):
    if len(os.listdir(folder)) >= 6:
        os._exit(1)


def test_a_broken_run_pays_only_its_open_batch_again(spark, config, tmp_path):
    broken = Paid(tmp_path / "sent", die_at_the_sixth)
    with pytest.raises(Exception):
        run(spark, config, broken)[1].collect()
    first = broken.sent()
    stored = {r.cache_key for r in answers.load_answers(spark, config.answers_path).collect()}
    assert len(stored) == 4, "the first micro-batch is stored, the open one is not"
    assert ledger_rows(spark, config).count() == 4

    again = Paid(tmp_path / "sent")
    _, rows = run(spark, config, again)
    rows = {r.session: r for r in rows.collect()}
    assert len(rows) == 12 and all(r.n_failures == 0 for r in rows.values())
    assert sum(r.calls for r in rows.values()) == 8
    total = again.sent()
    assert set(total) == {f"text{i}" for i in range(12)}
    assert sum(n - 1 for n in total.values()) <= 4, "at most the open batch is paid twice"
    assert sum(first.values()) + 8 == sum(total.values())
    assert ledger_rows(spark, config).count() == 12


def test_what_was_logged_is_committed_by_the_next_run(spark, config, tmp_path, monkeypatch):
    send, commits = Paid(tmp_path / "sent"), []
    whole = campaign.Asking._commit

    def failing(self, attempts, requests, name):
        commits.append(name)
        if len(commits) == 2:
            raise RuntimeError("the driver is gone")
        whole(self, attempts, requests, name)

    monkeypatch.setattr(campaign.Asking, "_commit", failing)
    with pytest.raises(Exception):
        run(spark, config, send)[1].collect()
    monkeypatch.setattr(campaign.Asking, "_commit", whole)
    assert ledger_rows(spark, config).count() == 4 and sum(send.sent().values()) == 8
    asking, rows = run(spark, config, send)
    assert asking.recovered == 2
    assert rows.count() == 12 and set(send.sent().values()) == {1}, "nothing is paid twice"
    assert ledger_rows(spark, config).count() == 12
    assert ledger.total_cost(spark, config.ledger_path) == pytest.approx(12 * .00042)
    # Committed again, a batch replaces itself.
    assert calls.recover(spark, config.call_log(), asking._commit) == 0


def test_later_batches_are_committed_in_groups(spark, config, tmp_path, monkeypatch):
    """Three batches, of which the last two are one group; a group that is repeated replaces itself."""
    monkeypatch.setattr(calls, "ALONE", 1)
    monkeypatch.setattr(calls, "GROUP", 3)
    whole, commits = campaign.Asking._commit, []

    def failing(self, attempts, requests, name):
        commits.append(name)
        if len(commits) == 2:
            raise RuntimeError("the driver is gone")
        whole(self, attempts, requests, name)

    monkeypatch.setattr(campaign.Asking, "_commit", failing)
    send = Paid(tmp_path / "sent")
    with pytest.raises(RuntimeError):
        run(spark, config, send)[1].collect()
    assert sum(send.sent().values()) == 12 and ledger_rows(spark, config).count() == 4
    asking, rows = run(spark, config, send)
    assert asking.recovered == 3 and commits[2:] == commits[:2]
    assert [name.split("-")[-1] for name in commits[:2]] == ["b00000000", "b00000001"]
    assert rows.count() == 12 and set(send.sent().values()) == {1}
    assert ledger_rows(spark, config).count() == 12
    assert [calls.group_of(n) for n in range(6)] == [0, 1, 1, 1, 4, 4]


def die_at_the_tenth(folder, text):
    if len(os.listdir(folder)) >= 10:
        os._exit(1)


def test_a_stage_that_fails_commits_what_it_has_logged(spark, config, tmp_path, monkeypatch):
    monkeypatch.setattr(calls, "ALONE", 0)
    with pytest.raises(Exception):
        run(spark, config, Paid(tmp_path / "sent", die_at_the_tenth))[1].collect()
    assert ledger_rows(spark, config).count() == 8, "two batches of an open group"


def no_credit(folder, text):
    error = Exception("Error code: 402 - no credit")
    error.status_code = 402
    raise error


@pytest.mark.parametrize("workers,per_worker", [(1, 7), (2, 4)])
def test_a_durable_refusal_ends_every_worker(spark, config, tmp_path, workers, per_worker):
    config.calls_per_worker = per_worker
    send = Paid(tmp_path / "sent", no_credit)
    with pytest.raises(EndpointRefused):
        run(spark, config, send, 14, workers=workers)
    assert 1 <= sum(send.sent().values()) <= workers
    rows = ledger_rows(spark, config)
    assert {(r.event, r.status) for r in rows.collect()} == {("stopped", "terminal")}
    # The next run asks again, and gets its answers.
    send = Paid(tmp_path / "later")
    assert run(spark, config, send, 14)[1].where("n_failures = 0").count() == 14


def refuse_some(folder, text):
    if text in ("text3", "text4"):
        raise ValueError("no such model")
    if len(os.listdir(folder)) > 8:
        no_credit(folder, text)


def test_a_stopped_run_keeps_refused_units_and_drops_unreached_ones(spark, config, tmp_path):
    send = Paid(tmp_path / "sent", refuse_some)
    asking = campaign.Asking(spark, arm(), endpoint(send, 1), config)
    table = units(spark, 12).unionByName(spark.createDataFrame(
        [("T9", "2025-02-01", 0, "", "none", 0)], UNIT))
    with pytest.raises(EndpointRefused):
        campaign.run(table, arm(), answers.StoredAnswers(spark, config.answers_path), asking, True)
    rows = {r.session: r for r in campaign.finished(table, arm(), asking, True).collect()}
    reached = set(send.sent())
    silent = rows.pop("2025-02-01")
    assert not silent.has_document and silent.calls == 0
    refused = {f"2025-01-{i + 1:02d}" for i in (3, 4) if f"text{i}" in reached}
    assert {s for s, r in rows.items() if r.n_failures} == refused
    assert len(rows) == 8, "the ninth send met the refusal, the rest was never sent"
    assert all(r.calls == 1 for r in rows.values())
    assert sum(r.cost_usd for r in rows.values()) == pytest.approx((8 - len(refused)) * .00042)


def test_a_campaign_beyond_one_budget_is_paid_in_instalments(spark, config, tmp_path):
    """Each instalment has a ledger and a budget of its own; every unit is asked once."""
    table = units(spark, 12).unionByName(spark.createDataFrame(
        [("T9", "2025-02-01", 0, "", "none", 0)], UNIT))
    send = Paid(tmp_path / "sent", refuse_one)
    # One call is estimated at a little over 0.00108 USD and costs 0.00042 USD.
    rows, askings = campaign.run_in_instalments(
        table, arm(), answers.StoredAnswers(spark, config.answers_path),
        lambda n: campaign.Asking(spark, arm(), endpoint(send), replace(
            config, ledger_path=f"{tmp_path}/ledger/{n}", budget_usd=0.0062)), True)
    rows = {r.session: r for r in rows.collect()}
    assert len(askings) == 3 and len(rows) == 13 and rows["2025-02-01"].calls == 0
    assert set(send.sent()) == {f"text{i}" for i in range(12)}
    assert sum(r.calls for r in rows.values()) == 12
    assert [s for s, r in rows.items() if r.n_failures] == ["2025-01-04"]
    assert {n: c for n, c in send.sent().items() if c > 1 and n != "text3"} == {}
    for asking in askings:
        assert ledger.total_cost(spark, asking.config.ledger_path) <= 0.0062
    # A budget that pays no call at all is still an error.
    with pytest.raises(BudgetExceeded):
        campaign.run_in_instalments(
            units(spark, 3), arm(), committee.no_answers(spark),
            lambda n: campaign.Asking(spark, arm(), endpoint(send), replace(
                config, answers_path=f"{tmp_path}/none", ledger_path=f"{tmp_path}/none/{n}",
                budget_usd=0.0001)), True)


def refuse_one(folder, text):
    if text == "text3":
        raise ValueError("no such model")


def test_progress_comes_from_observed_metrics(spark, config, tmp_path):
    seen = []
    run(spark, config, Paid(tmp_path / "sent"), 10, lambda *told: seen.append(told))
    assert [t[:3] for t in seen] == [("single", n, 10) for n in (4, 8, 10)]
    assert [t[3]["answered"] for t in seen] == [4, 4, 2]
    assert sum(t[3]["cost_usd"] for t in seen) == pytest.approx(10 * .00042)
    assert children(spark, config.call_log()) and not any(
        exists(spark, f"{s}/requests") for s in calls.stages(spark, config.call_log()))


def test_the_last_minute_of_all_workers_counts(spark, config, tmp_path):
    now = time.time()
    shared = Endpoint("m", limits=Limits(10_000, 10, 1.0), workers=2,
                      earlier=tuple(Use(now - 50, 900.0) for _ in range(8)))
    governor = shared._governor()
    # Half of 8 calls and 7,200 tokens are this worker's; its share is 5 calls and 5,000 tokens.
    assert governor.wait_for(1400) == 0.0
    assert governor.wait_for(1500) == pytest.approx(10, abs=1)
    assert governor.wait_for(6000) == -1.0
    governor.reserve(10)
    assert governor.wait_for(10) == pytest.approx(10, abs=1), "the fifth call was the last"
    stage = calls.CallStage(spark, endpoint(None), f"{tmp_path}/x", None)
    rows = spark.createDataFrame([("call", now - 5, 10, 5), ("call", now - 100, 7, 7),
                                  ("refused", now, 0, 0)],
                                 "event string, sent_at double, tokens_in long, tokens_out long")
    stage._remember(rows)
    assert [(u.tokens, u.requests) for u in stage._uses] == [(15, 1.0)]


def test_waiting_counts_the_uses_that_must_leave():
    now = [100.0]
    slept = []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    uses = [Use(50.0, 400.0), Use(60.0, 300.0), Use(90.0, 200.0)]
    governor = RateGovernor(Limits(1000, 4, 1.0), lambda: now[0], reversed(uses), sleep)
    assert governor.wait_for(100) == 0.0
    assert governor.wait_for(101) == pytest.approx(10.0)
    assert governor.wait_for(501) == pytest.approx(20.0)
    assert governor.wait_for(801) == pytest.approx(50.0)
    assert governor.reserve(501) == 4 and slept == [20.0]
    assert governor.snapshot()["waited_seconds"] == 20.0


def test_far_below_its_ceilings_a_governor_does_not_count_again(monkeypatch):
    clock = [100.0]
    governor = RateGovernor(Limits(1e12, 1e9), lambda: clock[0], [Use(90.0, 5.0)] * 1000)
    monkeypatch.setattr(governor, "_in_window", None)
    tickets = [governor.reserve(10) for _ in range(3)]
    governor.settle(tickets[0], 7)
    governor.release(tickets[1])
    monkeypatch.undo()
    assert (governor._most_tokens, governor._most_requests) == (5017.0, 1002.0)
    assert governor.snapshot()["tokens_in_window"] == 5017.0
    clock[0] = 155.0
    assert governor.snapshot()["requests_in_window"] == 2.0
    assert (governor._most_tokens, governor._most_requests) == (17.0, 2.0)


def test_the_store_is_compacted_and_lookups_read_their_partitions(spark, tmp_path):
    path = f"{tmp_path}/store"
    keys = [f"{i:02x}{i * 7919:08x}" for i in range(200)]
    for start in range(0, 200, 50):
        answers.append_answers(spark.createDataFrame(
            [(k, f"r{k}", "m", "s", .1) for k in keys[start:start + 60]], answers.ANSWER_SCHEMA),
            path, f"b{start}")
    answers.append_answers(answers.load_answers(spark, path).limit(5), path, "b0")  # replaced
    want = {k for k in keys if k in {r.cache_key for r in answers.load_answers(spark, path).collect()}}
    assert answers.compact(spark, path) == 4 and answers.compact(spark, path) == 0
    assert children(spark, f"{path}/recent") == []
    answers.append_answers(spark.createDataFrame(
        [("ffnew", "new", "m", "s", .1), (max(want), "old", "m", "s", .1)], answers.ANSWER_SCHEMA), path)
    asked = spark.createDataFrame([(k,) for k in ("ffnew", max(want), "zz")] * 2, "cache_key string")
    found = answers.lookup(spark, path, asked)
    assert sorted(r.cache_key for r in found.collect()) == sorted(["ffnew", max(want)])
    plan = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in plan and "k2" in plan.split("PartitionFilters: [")[1][:200]
    assert answers.compact(spark, path) == 1
    assert len(children(spark, f"{path}/base")) == 1
    again = answers.load_answers(spark, path)
    assert again.count() == again.select("cache_key").distinct().count() == len(want) + 1


def test_worker_report_names_the_ceiling(spark):
    rows = spark.createDataFrame([("a", 3000, 10.0), ("a", 3300, 10.0), ("b", 100, 5.0)],
                                 "m string, tokens int, latency double")
    got = {r.m: r for r in quota.worker_report(rows, ["m"], F.col("tokens"),
                                               F.col("latency")).collect()}
    assert got["a"].bound_by == "tokens" and got["b"].bound_by == "requests"
    assert got["a"].useful_workers == pytest.approx(quota.useful_workers(3150, 10))
    assert got["b"].useful_workers == pytest.approx(quota.useful_workers(100, 5))
