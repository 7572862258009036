"""Scores, backtests, folds, redundancy and search."""

import pytest
from latticework.plans import backtest as bt
from latticework.plans import scoring, style, validation
from latticework.plans.search import Generator, Search, complexity, normalized, semantically_valid
from latticework.queries import ORACLES, QUERIES
from latticework.sources import market
from latticework.sources.panels import user_panel, week_panel
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arrays(spark):
    ratios, base = [1, 0.6, 1.2, 0.8, 1.4, 0.9], [-0.01, -0.005, 0.005, 0.01]
    rows = [("f", i, f"s{j}", float(j), base[j] * r) for i, r in enumerate(ratios) for j in range(4)]
    return spark.createDataFrame(rows, "factor string, ts int, symbol string, value double, target double")


def test_score_closed_form(arrays):
    r = scoring.score(arrays, ["factor"], q=4, cost=0.0, annualization=24.0).first()
    assert r["returns"] == pytest.approx(0.02 * 5.9) and r["turnover"] == 0 and r["obs_count"] == 6
    day = scoring.score(arrays, ["factor"], q=4, cost=0.0, annualization=1.0).first()
    assert r["sharpe_ratio"] == pytest.approx(day["sharpe_ratio"] * 24**0.5)


def test_test_dates_stay_hidden(arrays):
    names = scoring.score_search(arrays, q=4, min_obs=1).columns
    assert not any(n.startswith("test_") for n in names)
    assert any(n.startswith("test_") for n in scoring.score_search(arrays, q=4, min_obs=1, final=True).columns)


def test_backtest_columns_and_groups(spark):
    panel = week_panel(spark, SF).withColumn("factor", F.col("volume"))
    curve, figures = bt.backtest(panel, config=bt.Backtest(n_quantiles=2, long_group=2, freq="1w"))
    assert {"date", "pnl", "cum_pnl_net", "q2_cum"} <= set(curve.columns) and len(figures.columns) == 30
    with pytest.raises(ValueError):
        bt.Backtest(long_group=1, short_group=1)
    assert scoring.periods_per_year("8h") == 1095


def test_known_betas(spark):
    rows = [(i, s, b * (m := (i * 7 % 5 - 2) / 100), m) for i in range(20) for s, b in (("a", 2.0), ("b", -0.5))]
    df = spark.createDataFrame(rows, "ts int, symbol string, r double, m double")
    out = df.withColumn("beta", style.rolling_market_beta(F.col("r"), F.col("m"), 8)).where("ts = 19")
    assert {r["symbol"]: pytest.approx(r["beta"]) for r in out.collect()} == {"a": 2.0, "b": -0.5}
    d = spark.createDataFrame([(0.001 + 1.5 * x / 100, x / 100) for x in range(-15, 15)], "strategy double, market double")
    e = style.market_exposure(d).first()
    assert e["beta"] == pytest.approx(1.5) and e["alpha"] == pytest.approx(0.001) and e["r2"] == pytest.approx(1.0)


def test_style_exposures_recover(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for i in range(6):
        a, b = rng.normal(size=(2, 10))
        rows += [(f"2024-01-0{i + 1}", f"s{j}", float(0.8 * a[j] - 0.4 * b[j]), float(a[j]), float(b[j])) for j in range(10)]
    df = spark.createDataFrame(rows, "ts string, symbol string, f double, a double, b double").withColumn("ts", F.col("ts").cast("timestamp"))
    res = style.residualize(df, "f", ["a", "b"]).agg(F.max(F.abs("residual"))).first()[0]
    assert res < 1e-9


def test_redundancy_is_greedy():
    corr = {("a", "b"): 0.95, ("a", "c"): 0.1, ("b", "c"): -0.2}
    assert validation.greedy_clusters(["a", "b", "c"], corr, 0.9) == [["a", "b"], ["c"]]
    out = validation.greedy_redundancy(["a", "b", "c"], corr, 0.85)
    assert out["b"] == (0.95, "a", True) and not out["c"][2]


def test_formulas_are_normal_and_seeded():
    assert normalized("--close + 0") == "close"
    assert not semantically_valid("close")[0] and not semantically_valid("rank(rank(close))")[0]
    assert semantically_valid("ts_rank(rank(close), 5)")[0]
    assert Generator(5).new() == Generator(5).new()
    assert all("cap" not in Generator(i, ("cap",)).new() for i in range(20))
    c = complexity("ts_mean(close, 3)")
    assert c["total_operators"] == 1 and c["complexity_score"] == pytest.approx(1 + 0.5 * c["max_depth"] + 0.17)


def test_search_runs_and_caches(spark):
    s = Search(user_panel(spark, SF).cache(), seed=1, pnl_every=1, validate_every=2)
    best = s.run(4, 2, ("rank(close)",))
    assert best and "rank(close)" in s.cache and not any(k.startswith("test_") for b in best for k in b)


def test_cross_validation(spark):
    rows = validation.cross_validate(user_panel(spark, SF), {"a": "rank(close)", "b": "-rank(close)", "bad": "oops"}, q=3, n_time=3, n_universe=2)
    assert {r["factor"] for r in rows} == {"a", "b"} and all(r["decision"] in ("accepted_candidate", "watchlist", "rejected") for r in rows)
    assert sum(r["redundant_by_pnl"] for r in rows) == 1


def test_loader_arithmetic(tmp_path, spark):
    assert market.days_to_bars(2.5, "4h") == 15
    a, b = market.data_window("2024-01-10", "2024-01-20", "1d", 2, 3, 4)
    assert (a.day, b.day) == (1, 21) and market.data_window(None, None, "1d") == (None, None)
    (tmp_path / "c.json").write_text('{"exchange": {"pair_whitelist": ["BTC/USDT:USDT"]}, "n_quantiles": 4}')
    assert market.load_config(str(tmp_path / "c.json")).pairs == ["BTC_USDT_USDT"]
    with pytest.raises(ValueError):
        market.Config(ratios=(1, 0, 1))
    bars = user_panel(spark, SF).select("ts", "symbol", "open", "high", "low", "close", "volume").where("close is not null")
    bars.write.parquet(str(tmp_path / "bars"))
    panel = market.load_panel(spark, str(tmp_path / "bars"), market.Config(timeframe="1d", buffer_bars=2))
    assert panel.select("ts").distinct().count() == bars.select("ts").distinct().count() - 2


def test_stream_of_bars(spark, tmp_path):
    from latticework.streaming.bars import stream_bars

    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0, 2.0), ("2024-01-01 00:50:00", "a", 3.0, 1.0)], "at string, symbol string, price double, size double").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("at timestamp, symbol string, price double, size double").parquet(str(tmp_path / "in"))
    q = stream_bars(source).writeStream.outputMode("update").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("select * from bars").first()
    assert (r["open"], r["high"], r["close"], r["volume"]) == (1.0, 3.0, 3.0, 3.0)


SAMPLE = ["bt_curve", "ts_rank_gaps", "cs_neutralize", "score_search", "ts_ema"]


@pytest.mark.parametrize("name", SAMPLE)
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
