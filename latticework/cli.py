"""Commands: python -m latticework.cli backtest | search | validate."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .operators import recursive
from .plans import candidates, scoring, style, validation
from .plans.backtest import Backtest, backtest
from .plans.dsl import evaluate, process_factor
from .plans.search import Search
from .sources import market
from .sources.panels import event_panel, user_panel, week_panel

PANELS = {"week": (week_panel, "1w"), "event": (event_panel, "1h"), "user": (user_panel, "1d")}
#: Figures that a table shows as a share of a hundred.
SHARES = ("cagr", "returns", "drawdown", "win_rate", "turnover", "annual_cost_drag", "funding_annual", "avg_long_funding", "avg_short_funding", "single_side_fee", "round_trip_fee")


def table(title: str, rows: dict) -> str:
    """Figures one below the other."""
    def shown(k, v):
        if isinstance(v, float):
            return f"{v * 100:.3f}%" if k.startswith(SHARES) else f"{v:.4f}"
        return str(v)

    wide = max(map(len, rows), default=0)
    return "\n".join([title, *(f"  {k:<{wide}}  {shown(k, v):>12}" for k, v in rows.items())])


def _panel(spark: SparkSession, a) -> tuple:
    """(panel, length of its bars)."""
    if a.panel:
        make, freq = PANELS[a.panel]
        return make(spark, a.data), freq
    config = market.load_config(a.config) if a.config or os.environ.get("LATTICEWORK_CONFIG") else market.Config(data_dir=a.data, timeframe=a.timeframe)
    path = a.data or config.data_dir
    funding = market.read_funding(spark, a.funding, a.format) if a.funding else None
    supply = market.read_market_caps(spark, a.caps) if a.caps else None
    return market.load_panel(spark, path, config, funding, supply, a.format), config.timeframe


def run_backtest(spark: SparkSession, a) -> dict:
    """Evaluates a formula, writes its curve if asked to, and shows its figures."""
    panel, freq = _panel(spark, a)
    factor = process_factor(evaluate(panel, a.expression), "factor", a.delay, a.decay)
    if a.specific:
        left = style.residualize(style.build_style_factors(factor), "factor", a.styles)
        factor = factor.drop("factor").join(left.withColumnRenamed("residual", "factor"), ["ts", "symbol"], "left")
    config = Backtest(n_quantiles=a.quantiles, long_group=a.long_group or a.quantiles, short_group=a.short_group, k_bars=a.k_bars, factor_agg=a.factor_agg, freq=freq, single_side_fee=a.fee)
    curve, figures = backtest(factor, config=config)
    out = {"metrics": figures.first().asDict()}
    print(table("Backtest", out["metrics"]))
    if a.output:
        curve.write.mode("overwrite").parquet(a.output)
    if a.view:
        out["latest"] = [r.asDict() for r in scoring.latest_view(factor).orderBy("rank", "symbol").collect()]
        print(table("Latest ranks", {r["symbol"]: r["rank"] for r in out["latest"]}))
    if a.adf:
        out["adf"] = style.adf_summary(recursive.adf(factor, "factor")).first().asDict()
        print(table("Unit root", out["adf"]))
    if a.exposure:
        shown = style.style_exposures(style.build_style_factors(factor), "factor", a.styles)
        out["exposure"] = [r.asDict() for r in style.summarize_exposures(shown, a.styles).orderBy("style").collect()]
        for r in out["exposure"]:
            print(table(r.pop("style"), r))
    if a.market:
        d = curve.select(curve["date"].alias("ts"), curve["pnl_net"].alias("strategy")).join(panel.groupBy("ts").agg({"market_return": "max"}).toDF("ts", "market"), "ts")
        out["market"] = style.market_exposure(d).first().asDict()
        print(table("Market", out["market"]))
    return out


def run_search(spark: SparkSession, a) -> list[dict]:
    """A genetic search; a file for each generation, a manifest and a summary in the output folder."""
    panel, freq = _panel(spark, a)
    found = Search(panel, q=a.quantiles, annualization=scoring.periods_per_year(freq, 1), seed=a.seed, second_q=a.second_quantiles, folder=a.output, pnl_every=a.pnl_every, validate_every=a.validate_every).run(a.population, a.generations, tuple(a.expression))
    for r in found[:10]:
        print(f"{r['selection_fitness']:10.4f}  {r['expression']}")
    return found


def run_validate(spark: SparkSession, a) -> list[dict]:
    """Validates candidates of a summary, a list and the command line on folds, and writes the report."""
    panel, freq = _panel(spark, a)
    chosen = [(f"manual_{i:03d}", e) for i, e in enumerate(a.expression, 1)] + (candidates.read_list(a.list) if a.list else [])
    rows = candidates.given(spark, chosen).collect() if chosen else []
    if a.summary:
        rows += candidates.select_candidates(candidates.read_summary(spark, a.summary), a.most, a.robust_complexity, a.complexity).orderBy(*candidates.by_merit()).collect()
    by = {}
    for r in rows:
        by.setdefault(r["expression"], r.asDict())
    names = {f"c{i:03d}": e for i, e in enumerate(by)}
    panel = style.build_style_factors(panel) if a.specific else panel
    done = validation.cross_validate(
        panel, names, a.quantiles, annualization=scoring.periods_per_year(freq, 1), n_time=a.time_folds, n_universe=a.universe_folds,
        valid_sharpe={n: by[e]["valid_sharpe"] for n, e in names.items()}, second_q=a.second_quantiles, styles=a.styles if a.specific else None, mode=a.mode,
    )
    found = candidates.records(done, list(by.values()))
    about = {"report_mode": a.mode, "final_evaluation": a.mode == "final", "bars": freq, "dates": panel.select("ts").distinct().count(), "symbols": panel.select("symbol").distinct().count()}
    for k, path in candidates.write_report(found, a.output or ".", candidates.sources(a.summary, a.expression, a.list), about).items():
        print(f"{k}: {path}")
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latticework", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, run, about in (("backtest", run_backtest, "one formula"), ("search", run_search, "a genetic search"), ("validate", run_validate, "candidates on folds")):
        c = sub.add_parser(name, help=about)
        c.set_defaults(run=run)
        c.add_argument("expression", nargs=None if name == "backtest" else "*", help="formula" if name == "backtest" else "formulas to start from")
        c.add_argument("--data", default="", help="folder of bars, or of tables with --panel")
        c.add_argument("--panel", choices=sorted(PANELS), help="a panel made of tables instead of bars")
        c.add_argument("--format", default="parquet")
        c.add_argument("--timeframe", default="4h", choices=list(market.TIMEFRAMES))
        c.add_argument("--config", help="JSON configuration")
        c.add_argument("--funding", help="folder of funding")
        c.add_argument("--caps", help="cache of market capitalisations")
        c.add_argument("--quantiles", type=int, default=5)
        c.add_argument("--second-quantiles", type=int)
        c.add_argument("--output", help="where results go")
        c.add_argument("--json", action="store_true", help="the result as JSON too")
        c.add_argument("--specific", action="store_true", help="take out styles first")
        c.add_argument("--styles", nargs="+", default=["momentum", "volatility"])
        if name == "backtest":
            for flag, kind, default in (("--delay", int, 0), ("--decay", int, 0), ("--k-bars", int, 1), ("--fee", float, 0.0005), ("--long-group", int, None), ("--short-group", int, 1)):
                c.add_argument(flag, type=kind, default=default)
            c.add_argument("--factor-agg", default="ewma", choices=("ewma", "mean", "std"))
            for flag in ("--view", "--adf", "--exposure", "--market"):
                c.add_argument(flag, action="store_true")
        if name == "search":
            for flag, default in (("--population", 30), ("--generations", 5), ("--seed", 0), ("--pnl-every", 1), ("--validate-every", 5)):
                c.add_argument(flag, type=int, default=default)
        if name == "validate":
            c.add_argument("--summary", help="a search's summary")
            c.add_argument("--list", help="formulas, one a line or as CSV")
            c.add_argument("--mode", default="validation", choices=("validation", "final"))
            for flag, kind, default in (("--most", int, 20), ("--robust-complexity", float, 10.0), ("--complexity", float, 12.0), ("--time-folds", int, 6), ("--universe-folds", int, 3)):
                c.add_argument(flag, type=kind, default=default)
    return p


def main(argv: list[str] | None = None):
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("latticework").getOrCreate()
    out = a.run(spark, a)
    if a.json:
        json.dump(out, sys.stdout, default=str)
    return out


if __name__ == "__main__":
    main()
