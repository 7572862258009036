"""Readers, candidate selection, reports and commands."""

import json

import numpy as np
import pandas as pd
import pyarrow.feather as pf
import pytest
from latticework import cli
from latticework.plans import backtest, candidates, validation
from latticework.plans.dsl import evaluate
from latticework.plans.search import Search
from latticework.queries import ORACLES, QUERIES
from latticework.sources import market
from latticework.sources.panels import user_panel, week_panel
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ROW = "factor_name string, expression string, valid_sharpe double, train_sharpe double, valid_ic_ir double, complexity_score double"


def chosen(spark, rows, *a):
    df = spark.createDataFrame([(f"n{i}", *r) for i, r in enumerate(rows)], ROW)
    return [r["expression"] for r in candidates.select_candidates(df, *a).orderBy("expression").collect()]


def test_thresholds_of_selection(spark):
    robust = [("rank(close)", 1.5, 0.5, 0.2, 9.0)]
    assert chosen(spark, robust, 0, 6.0, 12.0) == [] and chosen(spark, robust, 0, 10.0, 12.0) == ["rank(close)"]
    top = [("rank(vwap)", 0.8, 0.4, 0.05, 11.0)]
    assert chosen(spark, top, 1, 10.0, 8.0) == [] and chosen(spark, top, 1, 10.0, 12.0) == ["rank(vwap)"]
    rows = [("a", 0.5, 0.1, 0.0, 3.0), ("b", 0.9, 0.1, 0.0, 3.0), ("b", 0.9, 0.1, 0.0, 3.0), ("c", float("nan"), 9.0, 0.0, 1.0), ("d", None, None, None, None), ("e", 0.9, 0.1, 0.0, 2.0)]
    assert chosen(spark, rows, 1) == ["e"] and chosen(spark, rows, 4) == ["a", "b", "e"] and chosen(spark, rows[:0], 4) == []


def test_lists_and_sources(tmp_path):
    (tmp_path / "a.txt").write_text("# note\nrank(close)\n\n-returns\n")
    (tmp_path / "a.csv").write_text("name,expression\nx,rank(close)\n,\n,volume\n")
    assert [e for _, e in candidates.read_list(str(tmp_path / "a.txt"))] == ["rank(close)", "-returns"]
    assert candidates.read_list(str(tmp_path / "a.csv")) == [("x", "rank(close)"), ("manual_file_003", "volume")]
    got = candidates.sources(None, ["rank(close)"], str(tmp_path / "a.txt"))
    assert [s["type"] for s in got] == ["expressions_file", "manual_expressions"] and all(len(s["sha256"]) == 64 for s in got)


def test_feather_bars_funding_and_caps(spark, tmp_path):
    day = pd.date_range("2024-01-01", periods=6, freq="D", tz="UTC")
    (tmp_path / "bars").mkdir(), (tmp_path / "fund").mkdir()
    for k, s in enumerate(("BTC_USDT_USDT", "ETH_USDT_USDT")):
        price = np.arange(6) + 10.0 * (k + 1)
        pf.write_feather(pd.DataFrame({"date": day, "open": price, "high": price + 1, "low": price - 1, "close": price, "volume": price}), str(tmp_path / "bars" / f"{s}-1d-futures.feather"))
    pf.write_feather(pd.DataFrame({"date": day[1:3], "open": [0.1, 0.2]}), str(tmp_path / "fund" / "BTC_USDT_USDT-8h-funding_rate.feather"))
    config = market.Config(timeframe="1d", start="2024-01-02", end="2024-01-04")
    caps = market.market_caps(spark.createDataFrame([("BTC_USDT_USDT", "BTC_USDT_USDT", 10.0, 2e11)], "pair string, symbol string, price_usd double, market_cap_usd double"))
    told = market.write_market_caps(caps, str(tmp_path / "caps.json"))
    assert told["large_cap_count"] == 1 and told["micro_cap_count"] == 0
    supply = market.read_market_caps(spark, str(tmp_path / "caps.json"))
    panel = market.load_panel(spark, str(tmp_path / "bars"), config, market.read_funding(spark, str(tmp_path / "fund")), supply, "feather")
    rows = {(r["symbol"], r["ts"].day): r for r in panel.collect()}
    assert len(rows) == 2 * 4 and max(d for _, d in rows) == 5
    assert rows["BTC_USDT_USDT", 5]["target"] == pytest.approx(15 / 14 - 1) and rows["BTC_USDT_USDT", 4]["funding"] == 0.2
    assert rows["BTC_USDT_USDT", 4]["cap"] == pytest.approx(13 * 2e10) and rows["ETH_USDT_USDT", 4]["cap"] is None
    with pytest.raises(ValueError):
        (tmp_path / "bad.json").write_text('{"x": 1}')
        market.read_market_caps(spark, str(tmp_path / "bad.json"))


def test_fixed_values_and_shapes(spark):
    assert market.days_to_bars(-1, "4h") == 0 and {"USTC", "USD1"} < set(market.STABLECOINS) and "USDE" not in market.STABLECOINS
    p = user_panel(spark, SF).select("ts", "symbol", "close", "volume")
    wide = market.long_to_wide(p, ["close", "volume"], ["0", "1"], 2)
    assert wide.count() == p.select("ts").distinct().count() - 2
    long = market.wide_to_long(wide)
    assert long.columns == ["ts", "symbol", "close", "volume"] and long.join(p, ["ts", "symbol", "close", "volume"]).count() == long.where("close is not null and volume is not null").count()
    with pytest.raises(ValueError):
        backtest.backtest(evaluate(user_panel(spark, SF).where("symbol in ('0', '1')"), "rank(close)"))


def test_folds_in_one_pass(spark):
    df = spark.createDataFrame([("f", i, s, 1.0) for i in range(12) for s in "abc"], "factor string, ts int, symbol string, value double")
    got = validation.by_folds(df, 6, 3, 4).groupBy("fold_type", "fold").count().toPandas()
    n = got.groupby("fold_type")["count"].agg(["size", "sum"])
    assert n.loc["full"].tolist() == [1, 36] and n.loc["time"].tolist() == [6, 36] and n.loc["walk", "size"] == 4 and n.loc["universe", "sum"] == 36


def test_second_quantiles_and_styles(spark):
    panel = user_panel(spark, SF).withColumn("style", F.col("volume"))
    rows = validation.cross_validate(panel, {"a": "rank(close)", "b": "returns"}, q=3, n_time=2, n_universe=2, second_q=2, styles=["style"], mode="validation")
    assert {r["factor"] for r in rows} == {"a", "b"} and all(r["mode"] == "specific" and r["nq_pass"] in (True, False) for r in rows)
    with pytest.raises(ValueError):
        validation.cross_validate(panel, {"a": "close"}, mode="test")


def test_search_writes_its_files(spark, tmp_path):
    Search(week_panel(spark, SF).cache(), seed=2, pnl_every=0, validate_every=1, second_q=2, q=3, folder=str(tmp_path / "run")).run(3, 2, ("rank(close)",))
    names = {p.name for p in (tmp_path / "run").iterdir()}
    assert {"generation_000.csv", "generation_000.json", "generation_001.csv", "manifest.json", "summary.csv"} <= names
    got = candidates.read_summary(spark, str(tmp_path / "run" / "summary.csv"))
    assert got.count() >= 1 and dict(got.dtypes)["valid_sharpe"] == "double"
    assert json.loads((tmp_path / "run" / "manifest.json").read_text())["generations"] == 2


def test_commands(spark, tmp_path, capsys):
    out = cli.main(["backtest", "rank(close)", "--data", SF, "--panel", "user", "--quantiles", "3", "--long-group", "3", "--view", "--market", "--adf", "--exposure", "--output", str(tmp_path / "curve")])
    assert out["metrics"]["symbols"] == 12 and len(out["latest"]) and "sharpe" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "curve")).count() == out["metrics"]["obs_count"]
    (tmp_path / "l.txt").write_text("-rank(close)\n")
    found = cli.main(["validate", "rank(close)", "--list", str(tmp_path / "l.txt"), "--data", SF, "--panel", "user", "--quantiles", "3", "--time-folds", "2", "--universe-folds", "2", "--mode", "final", "--output", str(tmp_path / "v")])
    assert {r["name"] for r in found} == {"manual_001", "manual_file_001"}
    text = (tmp_path / "v" / "cross_validation_report.md").read_text()
    assert "manual_file_001" in text and "High-Correlation" in text
    assert json.loads((tmp_path / "v" / "cross_validation_manifest.json").read_text())["candidates"] == 2


def test_correlations_match_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    a, b = QUERIES["corr_clusters"](spark, SF).toPandas(), con.sql(ORACLES["corr_clusters"]).df()
    key = lambda d: sorted(map(tuple, d[["a", "b", "corr", "n"]].itertuples(index=False)))
    assert key(a) == key(b)
