import datetime as dt
import hashlib
import json
import sys
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidelex.config import Config, load_env
from tidelex.errors import BudgetExceeded, EndpointRefused, MissingInput
from tidelex.functions import contracts, fingerprint, provider_errors, replies
from tidelex.functions.governor import Limits, RateGovernor
from tidelex.operators import quota
from tidelex.plans import campaign, cli, committee
from tidelex.plans.readers import Endpoint, backoff_seconds, response_format
from tidelex.sources import answers, ledger, panel, prompts, signals
from tidelex.streaming import ledger_totals

# The scripted endpoint below runs in Python workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANALYST = {"relevance": .8, "polarity": .5, "intensity": .6, "ambiguity": .3,
           "forward_looking": .5, "is_new_information": True, "shock_kind": "issuer_results",
           "stance": "neutral", "evidence": "word for word"}
VIEW = {"log_amplitude": .7, "lower": .4, "upper": 1.0, "driver": "d"}


# -- finding and checking an answer


@pytest.mark.parametrize("text,expected", [
    ('{"a": 1}', {"a": 1}), ("[1]", [1]), ("no json", None), ("", None),
    ('draft {"a": 1} final {"a": 2}', {"a": 2}),
    ('text {"a": {"b": 1}} end', {"b": 1}),
    ('{"a": "}{"} tail', {"a": "}{"}),
    ('say {"a": "quote \\" }"} x', {"a": 'quote " }'}),
    ('```json\n{"a": 1}\n```', {"a": 1}), ('```json {"a": 1}```', {"a": 1}),
    ('{"a": 1', None), ('{"a": 1} {"b": ', {"a": 1}), ("null", None)])
def test_find_object(text, expected):
    assert replies.find_object(text) == expected


@pytest.mark.parametrize("raw,left", [
    ("<think>x</think> a", "a"), ("<THINK>x\ny</think>b<analysis>z</Analysis>", "b"),
    ("a <reasoning> cut", "a"), ("<scratchpad>all of it", ""), ("\n a b \t", "a b"),
    ("<thinking>a</thinking><think>b", ""), (None, "")])
def test_scratchpads_are_stripped_alike_in_both_forms(spark, raw, left):
    frame = spark.createDataFrame([(raw,)], "r string")
    assert frame.select(replies.strip_reasoning(F.col("r"))).first()[0] == left
    assert replies.strip_text(raw or "") == left


def test_envelopes():
    for wrapped in ([ANALYST], {"result": ANALYST}, [{"answer": [ANALYST]}]):
        assert replies.unwrap(wrapped, "analyst") == ANALYST
    assert replies.unwrap({"relevance": {"x": 1}}, "analyst") == {"relevance": {"x": 1}}
    assert replies.unwrap([1, 2], "analyst") == [1, 2]
    deep = [[[[ANALYST]]]]
    assert replies.unwrap(deep, "analyst") == [ANALYST]


@pytest.mark.parametrize("change,ok", [
    ({}, True), ({"relevance": "0.5"}, True), ({"relevance": True}, True),
    ({"relevance": 1.01}, False), ({"relevance": float("nan")}, False),
    ({"relevance": None}, False), ({"relevance": "high"}, False), ({"relevance": [1]}, False),
    ({"is_new_information": "yes"}, True), ({"is_new_information": 1}, True),
    ({"is_new_information": 2}, False), ({"is_new_information": None}, False),
    ({"shock_kind": "NONE"}, False), ({"stance": "supportive"}, True), ({"extra": 1}, True),
    ({"evidence": None}, True), ({"evidence": 5}, False)])
def test_fields_are_checked_and_never_repaired(change, ok):
    fields, reason = replies.validate({**ANALYST, **change}, "analyst")
    assert (fields is not None) is ok and (reason == "") is ok


def test_missing_fields_are_named_and_texts_clipped():
    fields, reason = replies.validate({k: v for k, v in ANALYST.items() if k != "polarity"},
                                      "analyst")
    assert fields is None and "polarity" in reason
    assert replies.validate({}, "analyst")[1].startswith("relevance") and len(
        replies.validate({}, "analyst")[1]) <= 220
    assert replies.validate(None, "analyst")[0] is None
    long = replies.validate({**ANALYST, "evidence": "x" * 500}, "analyst")[0]
    assert len(long["evidence"]) == 240
    for word in (" N/A ", "Inconnu", "-", ""):
        assert replies.validate({**ANALYST, "evidence": word}, "analyst")[0]["evidence"] == ""
    # Other prose has no placeholder rule.
    assert replies.validate({**VIEW, "driver": None}, "panel")[0] is None
    assert replies.validate({**VIEW, "driver": "none"}, "panel")[0]["driver"] == "none"


def test_a_range_holds_its_own_level():
    assert replies.validate(VIEW, "forecast")[0] == VIEW
    assert replies.validate({**VIEW, "upper": .6}, "panel")[0] is None
    assert replies.validate({**VIEW, "lower": .8}, "panel")[0] is None


def test_verdict_schema():
    verdict = {"direction": "adverse", "log_amplitude": 0, "position": -1, "rationale": "r" * 700}
    fields = replies.validate(verdict, "verdict")[0]
    assert fields["position"] == -1 and len(fields["rationale"]) == 600
    assert replies.validate({**verdict, "position": 2}, "verdict")[0] is None


def test_lines_shown_to_the_next_tier():
    line = replies.line_of("analyst", "analyst_tone", ANALYST)
    assert line == ("- analyst_tone: relevance 0.80, polarity +0.50, intensity 0.60, ambiguity "
                    '0.30, cause issuer_results, new information yes\n  quotation: "word for word"')
    assert replies.line_of("analyst", "x", None) == "- x: reading unavailable"
    side = {"polarity": -.125, "conviction": .285, "strongest_point": "p", "concession": ""}
    assert replies.line_of("debate", "adverse", side) == (
        "- unfavourable: polarity -0.12, conviction 0.28\n  strongest point: p\n"
        "  concession: none")
    assert replies.line_of("forecast", "forecaster", None) == "AMPLITUDE FORECAST: unavailable"
    assert "range +0.40 to +1.00" in replies.line_of("forecast", "forecaster", VIEW)


def test_wire_schema_and_contract():
    wire = contracts.wire_schema("analyst")
    assert wire["required"] == list(ANALYST) and wire["additionalProperties"] is False
    assert "$ref" not in json.dumps(wire)
    for tier in contracts.TIERS:
        text = contracts.contract(tier)
        assert text == contracts.contract(tier)
        assert all(f'"{f.name}"' in text for f in contracts.TIERS[tier])
        assert max(map(len, text.splitlines())) <= 160


# -- errors, rates, money


@pytest.mark.parametrize("name,message,status,meaning", [
    ("APIStatusError", "", 402, "terminal"), ("X", "Error code: 401 - key", None, "terminal"),
    ("BadRequestError", "", None, "schema"), ("X", "", 400, "schema"),
    ("X", "Error code: 400", None, "other"), ("X", "", 429, "transient"),
    ("X", "Error code: 503", None, "transient"), ("X", "", 404, "other"),
    ("ReadTimeout", "", None, "transient"), ("ValueError", "", None, "other")])
def test_error_meanings(spark, name, message, status, meaning):
    assert provider_errors.classify(name, message, status) == meaning
    if status is None:
        frame = spark.createDataFrame([(f"{name}: {message}",)], "e string")
        assert frame.select(provider_errors.classify_column(F.col("e"))).first()[0] == meaning


def test_governor_waits_for_the_window_and_knows_when_waiting_is_useless():
    now = [0.0]
    gov = RateGovernor(Limits(1000, 10, 1.0), clock=lambda: now[0])
    first = gov.reserve(600)
    assert gov.wait_for(300) == 0.0
    now[0] = 20.0
    assert gov.wait_for(500) == pytest.approx(40.0)
    assert gov.wait_for(1001) == -1.0
    gov.settle(first, 100)
    assert gov.wait_for(500) == 0.0
    second = gov.reserve(800)
    assert gov.snapshot()["tokens_in_window"] == 900
    gov.release(second)
    assert gov.snapshot()["requests_in_window"] == 1
    now[0] = 60.5
    assert gov.snapshot()["tokens_in_window"] == 0
    with pytest.raises(ValueError):
        gov.reserve(1001)
    for _ in range(10):
        gov.reserve(1)
    assert gov.wait_for(1) == pytest.approx(60.0)
    assert quota.useful_workers(3150, 10) == pytest.approx(90_000 / 3150 / 60 * 10)


def test_prices_and_keys(spark):
    row = spark.range(1).select(
        fingerprint.call_cost(F.lit(1e6), F.lit(5e5)), fingerprint.cost_estimate(
            F.lit(2700.0), F.lit(300.0)), fingerprint.token_estimate(F.lit(2700.0), F.lit(300.0)),
        fingerprint.cache_key("m", F.lit("a"), F.lit("s"), F.lit(2), 0.0, F.lit("c")),
        fingerprint.cache_key("m", F.lit("a"), F.lit("s"), F.lit(2), 0.0, F.lit("c"),
                              F.lit("k"))).first()
    assert row[0] == pytest.approx(.9) and row[1] == pytest.approx(.0003 + .00108)
    assert row[2] == 1900
    assert row[3] == hashlib.sha256(b"m|a|s|2|0.0000|c").hexdigest()
    assert row[4] == hashlib.sha256(b"m|a|s|2|0.0000|c|k").hexdigest()


def test_budget_stops_at_the_first_call_that_does_not_fit(spark):
    calls = spark.createDataFrame([("b", 1, .4), ("a", 1, .3), ("a", 2, .5), ("b", 2, .01)],
                                  "lane string, i int, estimate double")
    got = quota.admit_within_budget(calls, "estimate", 1.0, 2.0, "lane", ["i"], F.lit(0))
    assert {(r["lane"], r["i"]): r["admitted"] for r in got.collect()} == {
        ("a", 1): True, ("a", 2): True, ("b", 1): False, ("b", 2): False}


# -- stores


def test_mandates_are_hashed_with_plain_newlines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\nx\ry\n".encode())
    got = prompts.load_mandates(spark, str(tmp_path), ["a"])
    assert got["a"].text == "é\nx\ny\n"
    assert got["a"].sha == hashlib.sha256("é\nx\ny\n".encode()).hexdigest()
    with pytest.raises(MissingInput, match="b"):
        prompts.load_mandates(spark, str(tmp_path), ["a", "b"])


def test_answer_store(spark, tmp_path):
    path = f"{tmp_path}/answers"
    assert answers.load_answers(spark, path).isEmpty()
    rows = spark.createDataFrame([("abc", "r", "m", "s", .1), ("xyz", None, "m", "s", .1)],
                                 answers.ANSWER_SCHEMA)
    answers.append_answers(rows, path)
    answers.append_answers(rows, path)
    stored = answers.load_answers(spark, path)
    assert [r["cache_key"] for r in stored.collect()] == ["abc"]
    asked = spark.createDataFrame([("abc",), ("new",)], "cache_key string")
    assert [r[0] for r in answers.to_pay(asked, stored).collect()] == ["new"]
    assert [r[0] for r in answers.in_cache(asked, stored).collect()] == ["abc"]
    for key, body in (("ab1", '{"raw": "x", "cost_usd": 0.5}'), ("cd2", '{"raw": ')):
        (tmp_path / "json" / key[:2]).mkdir(parents=True)
        (tmp_path / "json" / key[:2] / f"{key}.json").write_text(body)
    old = answers.load_json_answers(spark, f"{tmp_path}/json").collect()
    assert [(r["cache_key"], r["raw"], r["cost_usd"]) for r in old] == [("ab1", "x", .5)]


def test_ledgers_add_up_and_streams_agree(spark, tmp_path):
    path, prior = f"{tmp_path}/ledger", f"{tmp_path}/old.csv"
    rows = spark.createDataFrame([("T", .25, 'bad, "quoted"'), ("T", .5, "")],
                                 "ticker string, cost_usd double, error string")
    ledger.append_ledger(rows, path)
    with open(prior, "w") as old:
        old.write("mandate,cout_usd\na,1.5\nb,n/a\nc,\n")
    assert ledger.read_ledger(spark, path).columns == list(ledger.LEDGER_COLUMNS)
    assert ledger.total_cost(spark, path, (prior, path)) == pytest.approx(2.25)
    assert ledger.total_cost(spark, f"{tmp_path}/none") == 0.0

    seen = []

    def publish(frame, _):
        seen.extend(r["cost_usd"] for r in frame.collect())

    for _ in range(2):
        totals = ledger_totals.running_total(ledger_totals.ledger_stream(spark, path))
        query = ledger_totals.follow(totals, f"{tmp_path}/checkpoint", publish, once=True)
        assert query.awaitTermination(120) and query.exception() is None
        ledger.append_ledger(rows, path)
    assert seen == pytest.approx([.75, 1.5])


def test_config_and_env(monkeypatch, tmp_path):
    monkeypatch.setenv("TIDELEX_REPLICATES", "5")
    monkeypatch.setenv("TIDELEX_BUDGET_USD", "1.5")
    config = Config()
    assert (config.replicates, config.budget_usd, config.calls_per_unit()) == (5, 1.5, 9)
    assert "K=5" in config.describe()
    monkeypatch.setenv("TIDELEX_REPLICATES", "five")
    with pytest.raises(ValueError, match="TIDELEX_REPLICATES"):
        Config()
    (tmp_path / ".env").write_text("# c\nTIDELEX_A = 'x'\nTIDELEX_REPLICATES=9\nbroken\n")
    monkeypatch.delenv("TIDELEX_A", raising=False)
    monkeypatch.setenv("TIDELEX_A", "")
    assert load_env(str(tmp_path / ".env")) == {"TIDELEX_A": "x"}
    assert load_env(str(tmp_path / "none")) == {}


def test_signals_keep_the_order_of_their_tags(spark, tmp_path):
    with pytest.raises(MissingInput):
        signals.load_signals(spark, str(tmp_path), ["a"])
    for tag in "ab":
        spark.createDataFrame([(tag, "2025-01-15")], "ticker string, session string"
                              ).write.parquet(f"{tmp_path}/signals_{tag}.parquet")
    got = signals.load_signals(spark, str(tmp_path), ["b", "none", "a"]).collect()
    assert {(r["ticker"], r["tag_order"]) for r in got} == {("b", 0), ("a", 2)}
    empty = spark.createDataFrame([], "ticker string")
    assert signals.save_results(empty, str(tmp_path), "x", 3) is False


# -- the endpoint and whole runs


class Refusal(Exception):
    status_code = None


def response(body):
    usage = SimpleNamespace(prompt_tokens=1000, completion_tokens=100,
                            prompt_tokens_details=SimpleNamespace(cached_tokens=10))
    message = SimpleNamespace(message=SimpleNamespace(content=body))
    return SimpleNamespace(choices=[message], usage=usage, model="returned")


def attempts(*outcomes):
    """Rows of one call whose sends have these outcomes (exceptions are raised)."""
    left, sent, slept = list(outcomes), [], []

    def send(**payload):
        sent.append(payload)
        outcome = left.pop(0)
        if isinstance(outcome, Exception):
            raise outcome
        return response(outcome)

    call = pd.DataFrame([("k", "analyst", "a", "sys", "ctx")],
                        columns=["cache_key", "tier", "seat", "system", "context"])
    endpoint = Endpoint("m", send=send, sleep=slept.append, min_interval_s=0)
    return next(endpoint.read(iter([call]))), sent, slept


def test_an_answer_is_billed_and_validated():
    rows, sent, _ = attempts(json.dumps(ANALYST))
    assert rows[["event", "status", "parse_ok", "structure_mode"]].values.tolist() == [
        ["call", "ok", True, "json_schema|contract"]]
    assert rows["cost_usd"][0] == pytest.approx(.0003 + .00012)
    assert sent[0]["response_format"]["json_schema"]["schema"]["required"] == list(ANALYST)


def test_schema_refusals_step_down_and_transient_ones_wait():
    bad = type("BadRequestError", (Exception,), {})("no")
    busy = type("RateLimitError", (Exception,), {})("busy")
    rows, sent, slept = attempts(bad, busy, bad, json.dumps(ANALYST))
    assert rows["structure_mode"].tolist() == ["tolerant|contract"]
    assert "response_format" not in sent[-1] and max(slept) >= 2.0
    assert response_format("analyst", "json_object") == {"type": "json_object"}
    assert .5 * 45 <= backoff_seconds(9) <= 1.5 * 45


def test_unreadable_answers_are_refused_and_terminal_errors_stop():
    rows, _, _ = attempts(*["prose"] * 6)
    assert rows["event"].tolist() == ["call"] * 6 + ["refused"]
    assert rows["status"].iloc[-1] == "refused_parse"
    busy = type("APITimeoutError", (Exception,), {})
    rows, _, _ = attempts(*[busy("late") for _ in range(6)])
    assert rows["status"].tolist() == ["refused_transport"]
    stop = Refusal("Error code: 402 - no credit")
    rows, _, _ = attempts(stop)
    assert rows["status"].tolist() == ["terminal"]
    rows, _, _ = attempts(ValueError("odd"))
    assert rows["status"].tolist() == ["refused_parse"]
    with pytest.raises(EndpointRefused):
        next(Endpoint("m").read(iter([pd.DataFrame(
            [("k", "analyst", "a", "s", "c")],
            columns=["cache_key", "tier", "seat", "system", "context"])])))


def scripted(**payload):
    """Answers that fit every tier; a panel seat answers by its own mandate."""
    system = payload["messages"][0]["content"]
    level = 2.0 if "extreme" in system else .5
    both = {**ANALYST, **VIEW, "log_amplitude": level, "lower": 0.0, "upper": 2.5,
            "conviction": .5, "strongest_point": "p", "concession": ""}
    return response("<think>hm</think>" + json.dumps(both))


@pytest.fixture
def project(spark, tmp_path, monkeypatch):
    body = " ".join(f"w{i}" for i in range(80))
    news = [(str(d), "TTE.PA", dt.datetime(2025, 1, d, 10, tzinfo=dt.timezone.utc), "t",
             f"{body} {d} {d + 1} " + f"x{d} " * 40, "s") for d in (13, 14, 16)]
    spark.createDataFrame(news, "doc_id string, ticker string, published_utc timestamp, "
                                "title string, body string, source string").write.parquet(
        f"{tmp_path}/data/news_amf.parquet")
    days = pd.bdate_range("2024-11-01", "2025-01-31").date
    spark.createDataFrame([("TTE.PA", d, 1e-4 * (1 + i % 5)) for i, d in enumerate(days)],
                          "ticker string, session_date date, rv_gk double").write.parquet(
        f"{tmp_path}/data/panel.parquet")
    names = [committee.mandate_of(t, s) for t, s in committee.route()] + ["single_reader"]
    (tmp_path / "mandates").mkdir()
    for name in names:
        (tmp_path / "mandates" / f"{name}.txt").write_text(f"Read as {name}.")
    for field, value in {"DATA_DIR": "data", "ANSWERS_PATH": "answers", "LEDGER_PATH": "ledger",
                         "MANDATES_DIR": "mandates", "RESULTS_DIR": "results"}.items():
        monkeypatch.setenv(f"TIDELEX_{field}", f"{tmp_path}/{value}")
    return str(tmp_path)


def fake():
    return Endpoint("MiniMax-M2", send=scripted, sleep=_no_sleep, min_interval_s=0, workers=2,
                    limits=Limits(1e9, 1e6))


def _no_sleep(_):
    pass


def test_campaign_pays_once_and_resumes_from_its_answers(spark, project):
    flags = ["campaign", "--start", "2025-01-13", "--end", "2025-01-15", "--replicates", "2",
             "--tickers", "TTE.PA"]
    args = cli.parser().parse_args(flags)
    assert cli.run_arm(spark, cli.parser().parse_args([*flags, "--dry-run"])) is False
    assert cli.run_arm(spark, args, fake()) is True
    raw = spark.read.parquet(f"{project}/results/raw_run.parquet").collect()
    by_day = {(r["session"], r["replicate"]): r for r in raw}
    assert len(raw) == 6
    busy, silent = by_day["2025-01-13", 0], by_day["2025-01-15", 1]
    assert (busy["calls"], busy["n_failures"], busy["n_documents"]) == (9, 0, 1)
    assert (by_day["2025-01-14", 0]["calls"], by_day["2025-01-14", 0]["n_failures"]) == (3, 0)
    assert busy["amplitude"] == .5 and busy["panel_dispersion"] > 0
    assert (silent["calls"], silent["has_document"], silent["amplitude_multiple"]) == (0, False, 1)
    kept = spark.read.parquet(f"{project}/results/signals_run.parquet").collect()
    assert [(r["session"], r["calls"]) for r in kept] == [
        ("2025-01-13", 18), ("2025-01-14", 6), ("2025-01-15", 0)]
    spent = ledger.total_cost(spark, f"{project}/ledger")
    # Both days are answered alike, so from the second tier on they ask the same: 12 + 3 * 2 * 2.
    assert spent == pytest.approx(24 * .00042)
    assert sum(r["calls"] for r in raw) == 24
    assert cli.run_arm(spark, args, fake()) is True
    assert ledger.total_cost(spark, f"{project}/ledger") == pytest.approx(spent)
    again = spark.read.parquet(f"{project}/results/raw_run.parquet")
    assert again.agg(F.sum("calls")).first()[0] == 0


def test_a_stopped_run_reports_what_is_stored(spark, project):
    flags = ["single", "--start", "2025-01-13", "--end", "2025-01-15", "--replicates", "1",
             "--tickers", "TTE.PA", "--tag", "one"]
    args = cli.parser().parse_args([*flags, "--budget", "0.0018"])
    assert cli.run_arm(spark, args, fake()) is True
    rows = spark.read.parquet(f"{project}/results/raw_one.parquet").collect()
    assert {r["session"] for r in rows} == {"2025-01-13", "2025-01-15"}
    assert cli.run_arm(spark, cli.parser().parse_args(flags), fake()) is True
    rows = {r["session"]: r for r in spark.read.parquet(
        f"{project}/results/raw_one.parquet").collect()}
    assert len(rows) == 3 and rows["2025-01-14"]["calls"] == 1
    assert rows["2025-01-14"]["tone"] == pytest.approx(.3)


def test_sample_command_writes_a_frame_and_its_manifest(spark, project):
    out = f"{project}/results/perimeter.csv"
    manifest = cli.main(["sample", "--per-ticker", "10", "--out", out], spark)
    frame, sha = panel.load_perimeter(spark, out)
    assert manifest["sha256"] == sha and manifest["n"] == frame.count() == 10
    args = cli.parser().parse_args(["campaign", "--perimeter", out])
    assert cli.chosen_sessions(spark, args, Config()).count() == 10


def test_budget_error_is_raised_by_the_asking_stage(spark, project):
    config = Config(budget_usd=0.0001)
    arm = committee.Arm(prompts.load_mandates(spark, f"{project}/mandates", ["single_reader"]))
    units = spark.createDataFrame([("T", "2025-01-13", 0, "text", "sha", 1)],
                                  "ticker string, session string, replicate int, digest string, "
                                  "digest_sha256 string, n_documents int")
    with pytest.raises(BudgetExceeded):
        campaign.run(units, arm, committee.no_answers(spark),
                     campaign.Asking(spark, arm, fake(), config), single=True)


@pytest.mark.parametrize("body", [
    '{"relevance": ' + "1" * 400 + "}", '{"a":' * 100_000 + "1" + "}" * 100_000, "[" * 100_000])
def test_no_answer_ends_a_job(body):
    fields, reason = replies.validate(replies.find_object(body), "analyst")
    assert fields is None and reason


def test_a_share_below_one_call_admits_nothing():
    from tidelex.functions.governor import Limits, RateGovernor

    with pytest.raises(ValueError, match="no call"):
        RateGovernor(Limits(requests_per_minute=5).share(5)).reserve(10)


def test_placeholders_in_any_white_space_are_blank(spark):
    df = spark.createDataFrame([("\tN/A\n",), (" none ",), ("kept",)], "t string")
    got = [r[0] for r in df.select(replies.blank_if_nullish(df.t, 10)).collect()]
    assert got == ["", "", "kept"]


def test_printed_reports_are_whole(spark, capsys):
    from tidelex.plans.cli import print_all

    print_all(spark.range(1500).toDF("n"))
    assert capsys.readouterr().out.split() == ["n", *map(str, range(1500))]


def test_plain_answers_read_the_same_in_the_jvm(spark, monkeypatch):
    """Every tier, with values at the edge of each rule: the two ways agree, and the first is used."""
    side = {"polarity": -.125, "conviction": .285, "strongest_point": "p" * 400, "concession": ""}
    one = {**ANALYST, "log_amplitude": .1}
    verdict = {"direction": "adverse", "log_amplitude": 0.3, "position": -1, "rationale": "r" * 700}
    changes = [
        {}, {"relevance": 1}, {"relevance": 0}, {"polarity": -0.001}, {"polarity": -0.0},
        {"polarity": -1}, {"ambiguity": 0.005}, {"ambiguity": 0.015}, {"intensity": 0.994999999},
        {"intensity": 1e-9}, {"relevance": 1.0000001}, {"relevance": "0.5"}, {"relevance": True},
        {"relevance": None}, {"relevance": float("nan")}, {"is_new_information": "yes"},
        {"is_new_information": False}, {"shock_kind": "NONE"}, {"evidence": None},
        {"evidence": "\x1c N/A\t"}, {"evidence": "é 😀" * 100}, {"evidence": "a\"b\\\n{x}"},
        {"evidence": 5}, {"extra": {"relevance": 2}}, {"extra": [1]}, {"odd, evidence: STRING": 1},
        {"conviction": .125}, {"concession": "none"}, {"strongest_point": "-0 "}, {"lower": .9},
        {"log_amplitude": -0.375}, {"upper": 3}, {"position": 1}, {"position": 1.0},
        {"position": 2}, {"driver": None}, {"evidence": "\ud83d"}]
    rows = []
    for tier, seat, base in (("analyst", "a", ANALYST), ("debate", "adverse", side),
                             ("debate", "supportive", {**side, "concession": "c"}),
                             ("forecast", "forecaster", VIEW), ("panel", "extreme", VIEW),
                             ("single", "s", one), ("verdict", "v", verdict)):
        for change in changes:
            text = json.dumps({**base, **change})
            rows += [(tier, seat, text), (tier, seat, f"```json\n{text}\n```"),
                     (tier, seat, f"so: {text}.")]
        rows += [(tier, seat, json.dumps(base, ensure_ascii=False)), (tier, seat, "[" + text + "]"),
                 (tier, seat, ""), (tier, seat, text[:-1]), (tier, seat, text + "x"),
                 (tier, seat, text[:-1] + ', "relevance": 0.1, "relevance": 0.2}'),
                 (tier, seat, '{"answer": ' + text + "}"), (tier, seat, "null")]
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)],
                                  "n int, tier string, seat string, body string")
    columns = F.col("body"), F.col("tier"), F.col("seat")
    got = {r.n: r.reading for r in replies.with_readings(table, *columns).collect()}
    want = {r.n: r.reading for r in table.select(
        "n", replies.parsed(*columns).alias("reading")).collect()}
    for n, row in enumerate(rows):
        assert repr(got[n]) == repr(want[n]), row
    assert sum(r.parse_ok for r in got.values()) > 300
    # Without the Python side, plain answers still have their readings and no others have one.
    monkeypatch.setattr(replies, "parsed", lambda *_: F.lit(None).cast(
        f"struct<{replies.READING_TYPE.replace(' ', ':').replace(',:', ',')}>"))
    alone = {r.n: r.reading for r in replies.with_readings(table, *columns).collect()}
    for n, (tier, seat, text) in enumerate(rows):
        assert alone[n] is None or repr(alone[n]) == repr(want[n])
        if text in [json.dumps(r) for r in (ANALYST, VIEW, one, verdict)]:
            assert alone[n] is not None
    assert sum(r is not None for r in alone.values()) > 150


def test_the_search_for_an_object_stays_linear():
    nested = '{"a":' * 50_000 + "}"
    started = dt.datetime.now()
    assert replies.find_object(nested) is None
    assert replies.find_object("{" * 200_000) is None
    assert replies.find_object('{"a": "' + "{" * 100_000) is None
    assert replies.find_object("x" + '{"a": {"b": 1}} {"c": "}{"} {') == {"c": "}{"}
    assert (dt.datetime.now() - started).total_seconds() < 5


def test_order_of_stored_files_is_checked(spark, tmp_path):
    rows = spark.range(500).select(F.format_string("T%02d", F.col("id") % 7).alias("ticker"),
                                   F.col("id").alias("session"))
    keys = ["ticker", "session"]
    rows.orderBy(*keys).write.option("maxRecordsPerFile", 40).parquet(f"{tmp_path}/ordered")
    rows.repartition(3).write.parquet(f"{tmp_path}/not")
    good = signals.order_report(spark, f"{tmp_path}/ordered", keys).first()
    assert good["files"] > 5 and (good["rows"], good["turned"], good["overlapping"]) == (500, 0, 0)
    bad = signals.order_report(spark, f"{tmp_path}/not", keys).first()
    assert bad["turned"] > 0 and bad["overlapping"] == 2
