"""Command line: campaign, single, sample, contrast, oos."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidelex.config import Config, load_env
from tidelex.errors import BudgetExceeded, EndpointRefused
from tidelex.functions.governor import Limits
from tidelex.operators import rollup, sampling
from tidelex.plans import campaign, committee, verdict
from tidelex.plans.readers import Endpoint
from tidelex.session import build_session, require_utc
from tidelex.sources import answers as store, corpus, ledger, panel, prompts, signals

# Fixed value: the instruments read when none are named.
INSTRUMENTS = ("TTE.PA", "ATO.PA", "AI.PA")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidelex", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, tag in (("campaign", "run"), ("single", "unique")):
        run = commands.add_parser(name)
        run.add_argument("--limit", type=int, help="sessions per instrument, on a stride")
        run.add_argument("--start", help="first session, YYYY-MM-DD")
        run.add_argument("--end", help="last session, YYYY-MM-DD")
        run.add_argument("--tickers", default=",".join(INSTRUMENTS))
        run.add_argument("--no-macro", action="store_true", help="leave the macro stream out")
        run.add_argument("--budget", type=float, help="cap on total spend, USD")
        run.add_argument("--workers", type=int)
        run.add_argument("--replicates", type=int)
        run.add_argument("--tag", default=tag, help="names the result tables")
        run.add_argument("--perimeter", help="CSV of sessions drawn in advance; replaces "
                                             "--start, --end, --limit and --tickers")
        run.add_argument("--dry-run", action="store_true", help="price the run and stop")
    sample = commands.add_parser("sample")
    sample.add_argument("--per-ticker", type=int, default=189)
    sample.add_argument("--balance", type=float, default=0.5)
    sample.add_argument("--out", default="results/perimeter.csv")
    contrast = commands.add_parser("contrast")
    contrast.add_argument("--signals", nargs="+", required=True)
    oos = commands.add_parser("oos")
    oos.add_argument("--signals", nargs="+", required=True)
    oos.add_argument("--min-train", type=int, default=80)
    return top


def configured(args: argparse.Namespace) -> Config:
    load_env()
    config = Config()
    for flag, field in (("budget", "budget_usd"), ("workers", "workers"),
                        ("replicates", "replicates")):
        if getattr(args, flag, None) is not None:
            setattr(config, field, getattr(args, flag))
    return config


def chosen_sessions(spark: SparkSession, args, config: Config) -> DataFrame:
    if args.perimeter:
        frame, sha = panel.load_perimeter(spark, args.perimeter)
        print(f"perimeter {args.perimeter}: fingerprint {sha[:32]}")
        return frame.select("ticker", "session_date").distinct()
    tickers = [t.strip() for t in args.tickers.split(",") if t.strip()]
    bounded = sampling.sessions_between(panel.load_panel(spark, config.data_dir), args.start,
                                        args.end, tickers)
    return sampling.stride_sample(bounded, args.limit)


def run_arm(spark: SparkSession, args, endpoint: Endpoint | None = None) -> bool:
    """Either arm end to end. True if results were written."""
    config, single = configured(args), args.command == "single"
    streams = corpus.ISSUER_STREAMS if args.no_macro else corpus.DEFAULT_STREAMS
    news = corpus.load_corpus(spark, config.data_dir, streams)
    arm = committee.Arm({}, config.model, config.temperature, config.max_output_tokens,
                        config.analyst_mandates, config.max_debate_rounds,
                        config.max_panel_rounds)
    names = [committee.SINGLE_READER] if single else arm.names()
    arm.mandates = prompts.load_mandates(spark, config.mandates_dir, names)
    answers = store.StoredAnswers(spark, config.answers_path)
    units = campaign.build_units(news, chosen_sessions(spark, args, config), config.replicates)

    print(config.describe())
    spent = ledger.total_cost(spark, config.ledger_path, config.prior_ledgers)
    print(f"paid so far: {spent:.4f} USD")
    seat = (("single", committee.SINGLE_READER) if single else ("analyst", arm.analysts[0]))
    campaign.price(units, arm, answers, *seat).show(truncate=False)
    if args.dry_run:
        return False

    endpoint = endpoint or Endpoint(
        config.model, temperature=config.temperature, max_output_tokens=config.max_output_tokens,
        min_interval_s=float(os.environ.get("LLM_MIN_INTERVAL_S", 0.05)),
        limits=Limits(config.tokens_per_minute, config.requests_per_minute),
        workers=config.workers)
    started = time.time()
    asking = campaign.Asking(spark, arm, endpoint, config, print_progress)
    if asking.recovered:
        print(f"{asking.recovered} batches of a broken run are stored now")
    try:
        rows = campaign.run(units, arm, answers, asking, single)
    except (BudgetExceeded, EndpointRefused) as stop:
        print(f"stopped: {stop}")
        rows = campaign.finished(units, arm, asking, single)
    if not signals.save_results(rows, config.results_dir, args.tag, config.replicates):
        print("no unit produced, nothing is written")
        return False
    raw = spark.read.parquet(f"{config.results_dir}/raw_{args.tag}.parquet")
    campaign.report(raw, rollup.combine_replicates(raw, config.replicates),
                    rollup.dropped_units(raw, config.replicates)).show(truncate=False)
    store.compact(spark, config.answers_path)
    spent = ledger.total_cost(spark, config.ledger_path, config.prior_ledgers)
    print(f"finished in {(time.time() - started) / 60:.1f} min, project total {spent:.4f} USD")
    return True


def print_progress(tier: str, done: int, expected: int, metrics: dict) -> None:
    print(f"{tier}: {done} of {expected} calls, {metrics.get('answered', 0)} of the last batch "
          f"answered for {metrics.get('cost_usd') or 0.0:.4f} USD")


def print_all(table: DataFrame) -> None:
    """Print every row, as they come to the driver one partition at a time."""
    print("\t".join(table.columns))
    for row in table.toLocalIterator():
        print("\t".join("" if value is None else str(value) for value in row))


def run_sample(spark: SparkSession, args) -> dict:
    prices = panel.load_panel(spark, configured(args).data_dir)
    manifest = panel.save_perimeter(sampling.draw(prices, args.per_ticker, args.balance),
                                    args.out, args.per_ticker, args.balance)
    frame, _ = panel.load_perimeter(spark, args.out)
    table = sampling.sample_table(frame)
    wide = table.groupBy("ticker").pivot("year").agg(
        F.first("sessions").alias("sessions"), F.first("stressed").alias("stressed")
    ).na.fill(0).orderBy("ticker")
    print_all(wide)
    print(manifest)
    return manifest


def run_verdict(spark: SparkSession, args) -> dict[str, DataFrame]:
    config = configured(args)
    read = signals.load_signals(spark, config.results_dir, args.signals)
    prices = panel.load_panel(spark, config.data_dir)
    tables = (verdict.contrast_report(read, prices) if args.command == "contrast"
              else verdict.forecast_report(read, prices, args.min_train))
    for name, table in tables.items():
        print(f"-- {name}")
        print_all(table)
    return tables


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    spark = spark or build_session()
    require_utc(spark)
    if args.command in ("campaign", "single"):
        return run_arm(spark, args)
    return run_sample(spark, args) if args.command == "sample" else run_verdict(spark, args)
