"""Operators against pandas, on a panel with gaps, ties, a constant column and infinities."""

import numpy as np
import pandas as pd
import pytest
from latticework.operators import recursive
from latticework.plans.dsl import ParseError, evaluate, evaluate_batch, lookback, parse
from latticework.plans.scoring import forward_compound
from latticework.sources.panels import densify, with_fields
from pyspark.sql import functions as F

SYMBOLS = ["a", "b", "c", "d", "e"]


def wide(seed=1, n=40):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame(rng.normal(0, 1, (n, 5)).round(1), columns=SYMBOLS)
    x["d"] = 2.0
    x = x.mask(rng.random(x.shape) < 0.15)
    x.iloc[5, 0] = np.inf
    return x, pd.DataFrame(rng.integers(1, 6, (n, 5)).astype(float), columns=SYMBOLS)


@pytest.fixture(scope="module")
def panel(spark):
    x, y = wide()
    ts = pd.date_range("2024-01-01", periods=len(x), freq="D")
    rows = [(t.to_pydatetime(), s, *map(lambda v: None if np.isnan(v) else float(v), (x[s].iloc[i], y[s].iloc[i]))) for i, t in enumerate(ts) for s in SYMBOLS]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, close double, volume double")
    return df.withColumn("returns", F.col("close")).cache()


def got(panel, text):
    pdf = evaluate(panel, text, "v").select("ts", "symbol", "v").toPandas()
    return pdf.pivot(index="ts", columns="symbol", values="v")[SYMBOLS].reset_index(drop=True).astype(float)


def finite(x):
    return x.replace([np.inf, -np.inf], np.nan)


CASES = {
    "ts_sum(returns, 5)": lambda x, y: finite(x).rolling(5).sum(),
    "ts_std(returns, 5)": lambda x, y: finite(x).rolling(5).std(),
    "ts_median(returns, 5)": lambda x, y: finite(x).rolling(5).median(),
    "ts_quantile(returns, 5, 0.3)": lambda x, y: finite(x).rolling(5).quantile(0.3),
    "ts_skewness(returns, 6)": lambda x, y: finite(x).rolling(6).skew(),
    "ts_kurtosis(returns, 6)": lambda x, y: finite(x).rolling(6).kurt(),
    "ts_covariance(returns, volume, 5)": lambda x, y: pd.DataFrame({c: finite(x)[c].rolling(5).cov(y[c], ddof=0) for c in x}),
    "ts_ema(returns, 4)": lambda x, y: finite(x).ewm(span=4, adjust=False, min_periods=4).mean(),
    "ts_ewma(returns, 4)": lambda x, y: finite(x).ewm(span=4, adjust=False).mean(),
    "rank(returns)": lambda x, y: x.rank(axis=1, pct=True),
    "delta(volume, 2)": lambda x, y: y - y.shift(2),
    "zscore(volume)": lambda x, y: y.sub(y.mean(axis=1), axis=0).div(y.std(axis=1).replace(0, np.nan), axis=0).fillna(0),
    "max(returns, volume)": lambda x, y: pd.DataFrame(np.maximum(x, y)),
    "ts_rank(returns, 4)": lambda x, y: pd.DataFrame({c: [np.nan if i < 3 else float((x[c].iloc[i - 3 : i + 1] <= x[c].iloc[i]).sum()) / 4 for i in range(len(x))] for c in x}),
    "ts_argmax(returns, 4)": lambda x, y: pd.DataFrame({c: [np.nan if i < 3 else float(np.argmax(x[c].iloc[i - 3 : i + 1].to_numpy())) + 1 for i in range(len(x))] for c in x}),
    "ts_argmin(returns, 4)": lambda x, y: pd.DataFrame({c: [np.nan if i < 3 else float(np.argmin(x[c].iloc[i - 3 : i + 1].to_numpy())) + 1 for i in range(len(x))] for c in x}),
    "decay_linear(volume, 4)": lambda x, y: y.rolling(4).apply(lambda v: v @ [4, 3, 2, 1] / 10, raw=True),
}


@pytest.mark.parametrize("text", CASES)
def test_against_pandas(panel, text):
    x, y = wide()
    pd.testing.assert_frame_equal(got(panel, text), CASES[text](x, y).astype(float), check_names=False, atol=1e-9)


def test_identities(panel):
    beta, alpha, resid = (got(panel, f"ts_{k}(volume, returns, 6)") for k in ("beta", "alpha", "resid"))
    x, y = wide()
    left = (y - (alpha + beta * finite(x))).to_numpy()
    assert np.nanmax(np.abs(left - resid.to_numpy())) < 1e-9
    r2 = got(panel, "ts_r2(volume, returns, 6)").to_numpy()
    assert np.nanmin(r2) >= -1e-12 and np.nanmax(r2) <= 1 + 1e-12


def test_formula_language(panel):
    x, y = wide()
    assert got(panel, "a = volume * 2; a > 6 ? a : -a").equals(got(panel, "if_else(volume * 2 > 6, volume * 2, -(volume * 2))"))
    assert got(panel, "or(volume > 3, volume < 2)").equals(got(panel, "(volume > 3) | (volume < 2)"))
    assert np.allclose(got(panel, "-2 ** 2 + 0 * volume"), -4)
    for bad in ("", "__import__('os')", "volume.mean()", "nosuch(volume)", "volume +", "ts_mean()", "1 2"):
        with pytest.raises(ParseError):
            parse(bad)
    assert lookback(parse("ts_mean(ts_delay(volume, 3), 20)")) == 23
    _, errors = evaluate_batch(panel, {"good": "ts_mean(volume, 3)", "bad": "oops"})
    assert list(errors) == ["bad"]


def test_shared_shuffles(panel):
    df, _ = evaluate_batch(panel, {str(i): f"ts_mean(volume, {i + 2})" for i in range(6)}, prepare=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_keys_must_be_unique(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 1.0)] * 2, "ts string, symbol string, close double")
    with pytest.raises(ValueError):
        densify(df)


def test_densify_fills_the_grid(spark):
    rows = [("2024-01-01 00:00:00", "a", 1.0), ("2024-01-02 00:00:00", "b", 2.0)]
    df = spark.createDataFrame(rows, "ts string, symbol string, close double").withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.select("*", *[F.col("close").alias(c) for c in ("open", "high", "low", "volume")])
    out = with_fields(densify(df))
    assert out.count() == 4 and out.where("close is null").count() == 2


def test_compounding(spark):
    df = spark.createDataFrame([(i, "a", (i + 1) / 100) for i in range(5)], "ts int, symbol string, target double")
    out = [r[0] for r in forward_compound(df, 3).orderBy("ts").select("forward").collect()]
    assert out[0] == pytest.approx(1.01 * 1.02 * 1.03 - 1) and out[3] is None


def test_unit_root():
    rng = np.random.default_rng(7)
    noise = rng.normal(size=120)
    assert recursive.adf_values(noise)[0] < recursive.adf_values(noise.cumsum())[0]
    assert recursive.student_t_cdf(0.0, 5) == pytest.approx(0.5)
    assert recursive.student_t_cdf(2.015048, 5) == pytest.approx(0.95, abs=1e-6)
    assert recursive.student_t_cdf(-12.0, 40) == pytest.approx(4.0e-15, rel=0.2)
