"""Recursive operators and per-date least squares: Arrow-batched, one group for each symbol or date."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType


def ema_values(x: np.ndarray, span: float, least: int, adjust: bool = False) -> np.ndarray:
    """Exponential mean; old weight decays over gaps; from the least-th value on."""
    a = 2 / (span + 1)
    out, mean, old, seen = np.full(len(x), np.nan), np.nan, 1.0, 0
    for i, v in enumerate(x):
        ok = math.isfinite(v)
        seen += ok
        if math.isnan(mean):
            mean = v if ok else mean
        else:
            old *= 1 - a
            if ok:
                new = 1.0 if adjust else a
                mean = (old * mean + new * v) / (old + new)
                old = old + new if adjust else 1.0
        if seen >= max(least, 1):
            out[i] = mean
    return out


def wilder_values(tr: np.ndarray, w: int) -> np.ndarray:
    """Wilder's smoothing: the mean of the first w, then 1 / w of each new value."""
    out, mean = np.full(len(tr), np.nan), np.nan
    for i, v in enumerate(tr):
        if i == w - 1:
            mean = np.nanmean(tr[:w])
        elif i >= w and math.isfinite(v):
            mean += (v - mean) / w
        out[i] = mean
    return out


def per_symbol(df: DataFrame, name: str, cols: list[str], values) -> DataFrame:
    """df with a column of values(*arrays of cols) of each symbol in ts order."""
    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pdf.assign(**{name: values(*[pdf[c].to_numpy(float) for c in cols])})

    return df.groupBy("symbol").applyInPandas(run, schema)


def ema(df: DataFrame, name: str, col: str, span: float, least: int = 0, adjust: bool = False) -> DataFrame:
    return per_symbol(df, name, [col], lambda x: ema_values(x, span, least, adjust))


def atr(df: DataFrame, name: str, w: int = 14) -> DataFrame:
    def values(h, lo, c):
        before = np.concatenate([[np.nan], c[:-1]])
        return wilder_values(np.nanmax([h - lo, abs(h - before), abs(lo - before)], axis=0), w)

    return per_symbol(df, name, ["high", "low", "close"], values)


def date_ols(df: DataFrame, y: str, xs: list[str], intercept: bool = True, min_count: int = 8) -> DataFrame:
    """(ts, symbol, residual, each beta) of y on xs at each date; NULL where too few or dependent."""
    names = (["intercept"] if intercept else []) + xs

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf[[y, *xs]].to_numpy(float)
        ok = np.isfinite(m).all(1)
        res, beta = np.full(len(pdf), np.nan), np.full(len(names), np.nan)
        if ok.sum() >= max(min_count, len(names) + 1):
            d = np.column_stack([np.ones(ok.sum()), m[ok, 1:]]) if intercept else m[ok, 1:]
            b, _, r, _ = np.linalg.lstsq(d, m[ok, 0], rcond=None)
            if r == d.shape[1]:
                beta, res[ok] = b, m[ok, 0] - d @ b
        return pdf[["ts", "symbol"]].assign(residual=res, **dict(zip(names, beta)))

    schema = "ts timestamp, symbol string, residual double, " + ", ".join(f"`{n}` double" for n in names)
    return df.select("ts", "symbol", y, *xs).groupBy("ts").applyInPandas(run, schema)


def _beta_cf(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > 1e-300 else 1e-300), c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def student_t_cdf(t: float, dof: float) -> float:
    x = dof / (dof + t * t)
    front = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - math.lgamma(0.5) + dof / 2 * math.log(x) + 0.5 * math.log1p(-x)) if 0 < x < 1 else 0.0
    a, b = dof / 2, 0.5
    tail = front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b
    return tail / 2 if t < 0 else 1 - tail / 2


def adf_values(values: np.ndarray, lag: int = 1, regression: str = "c") -> tuple[float, float, int]:
    """(statistic, p by Student's t, observations) of a unit-root regression."""
    if regression not in ("n", "c", "ct"):
        raise ValueError("regression must be n, c or ct")
    y = values[np.isfinite(values)]
    if len(y) < lag + 4 + {"n": 0, "c": 1, "ct": 2}[regression]:
        return math.nan, math.nan, len(y)
    dy = np.diff(y)
    r = dy[lag:]
    cols = [y[lag:-1], *[dy[lag - k : len(dy) - k] for k in range(1, lag + 1)]]
    cols += [np.ones(len(r))] * (regression != "n") + [np.arange(1.0, len(r) + 1)] * (regression == "ct")
    x = np.column_stack(cols)
    dof = len(r) - x.shape[1]
    if dof <= 0:
        return math.nan, math.nan, len(r)
    b = np.linalg.lstsq(x, r, rcond=None)[0]
    e = r - x @ b
    se = math.sqrt(max(0.0, np.linalg.pinv(x.T @ x)[0, 0] * (e @ e) / dof))
    t = b[0] / se if se > 0 else math.nan
    return t, student_t_cdf(t, dof) if math.isfinite(t) else math.nan, len(r)


def adf(df: DataFrame, col: str, lag: int = 1, regression: str = "c", least: int = 20) -> DataFrame:
    """(symbol, statistic, pvalue, used_lag, nobs) of each symbol with enough values."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("ts")[col].to_numpy(float)
        t, p, n = adf_values(v, lag, regression) if np.isfinite(v).sum() >= least else (math.nan, math.nan, int(np.isfinite(v).sum()))
        return pd.DataFrame({"symbol": [key[0]], "statistic": [t], "pvalue": [p], "used_lag": [lag], "nobs": [n]})

    return df.select("ts", "symbol", col).groupBy("symbol").applyInPandas(run, "symbol string, statistic double, pvalue double, used_lag int, nobs int")
