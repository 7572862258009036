"""Operators that are Columns over a dense panel. Inputs are materialised columns."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.missing import INF, both, div, div0, fin, nn, truth


def along():
    return Window.partitionBy("symbol").orderBy("ts")

def of_date():
    return Window.partitionBy("ts")


def over(w: int):
    return along().rowsBetween(-(int(w) - 1), 0)


def positive(w, least: int = 1) -> int:
    if int(w) != w or w < least:
        raise ValueError(f"window must be a whole number from {least}: {w}")
    return int(w)


def full(x: Column, w: int, value: Column) -> Column:
    """value where all of the window is present."""
    return F.when(F.count(x).over(over(w)) == w, value)


def _agg(f):
    def op(x: Column, w: int = 10) -> Column:
        x, w = fin(x), positive(w)
        return full(x, w, f(x).over(over(w)))

    return op


ts_sum, ts_mean, ts_min, ts_max = map(_agg, (F.sum, F.avg, F.min, F.max))
ts_median = _agg(lambda x: F.percentile(x, 0.5))
ts_product = _agg(F.product)


def ts_std_dev(x: Column, w: int = 10) -> Column:
    x, w = fin(x), positive(w)
    return full(x, w, F.stddev_samp(x).over(over(w))) if w > 1 else F.lit(None).cast("double")


def ts_quantile(x: Column, w: int = 7, q: float = 0.5) -> Column:
    x, w = fin(x), positive(w)
    return full(x, w, F.percentile(x, float(q)).over(over(w)))


def ts_delay(x: Column, p: int = 1) -> Column:
    return F.lag(x, int(p)).over(along()) if p >= 0 else F.lead(x, -int(p)).over(along())


def ts_delta(x: Column, p: int = 1) -> Column:
    return nn(x - ts_delay(x, p))


def ts_pctchange(x: Column, p: int = 1) -> Column:
    """Change against p bars before, of values carried forward."""
    f = F.last(x, True).over(along().rowsBetween(Window.unboundedPreceding, 0))
    return nn(div(f, F.lag(f, int(p)).over(along())) - 1)


def _window(x: Column, w: int) -> Column:
    """All of a window's values in order, missing ones as NaN."""
    return F.collect_list(F.coalesce(x, F.lit(float("nan")))).over(over(w))


def _filled(w: int) -> Column:
    return F.row_number().over(along()) >= w


def ts_rank(x: Column, w: int = 10) -> Column:
    """Share of the window not above the current value; 0 where that is missing."""
    w = positive(w)
    n = F.size(F.filter(F.collect_list(x).over(over(w)), lambda v: v <= x))
    return F.when(_filled(w), F.when(x.isNull(), 0.0).otherwise(n / F.lit(float(w))))


def ts_percentile(x: Column, w: int = 10) -> Column:
    x, w = fin(x), positive(w)
    if w <= 1:
        return F.lit(None).cast("double")
    return full(x, w, F.size(F.filter(F.collect_list(x).over(over(w)), lambda v: v < x)) / F.lit(float(w - 1)))


def ts_arg_max(x: Column, w: int = 10) -> Column:
    """Place of the maximum, 1 the oldest; the first missing value counts as the extreme."""
    w = positive(w)
    a = _window(x, w)
    return F.when(_filled(w), F.array_position(a, F.array_max(a)).cast("double"))


def ts_arg_min(x: Column, w: int = 10) -> Column:
    w = positive(w)
    a = _window(x, w)
    gap = F.array_position(a, F.lit(float("nan")))
    return F.when(_filled(w), F.when(gap > 0, gap).otherwise(F.array_position(a, F.array_min(a))).cast("double"))


def ts_decay_linear(x: Column, w: int = 10, newest_first: bool = False) -> Column:
    """Linear weights; as is customary here the oldest bar weighs most unless newest_first."""
    x, w = fin(x), positive(w)
    a = F.collect_list(x).over(over(w))
    weight = (lambda i: i + 1) if newest_first else (lambda i: F.lit(w) - i)
    total = F.aggregate(F.transform(a, lambda v, i: v * weight(i)), F.lit(0.0), lambda s, v: s + v)
    return full(x, w, total / (w * (w + 1) / 2))


def ts_skewness(x: Column, w: int = 7) -> Column:
    x, w = fin(x), positive(w)
    if w < 3:
        return F.lit(None).cast("double")
    flat = F.max(x).over(over(w)) == F.min(x).over(over(w))
    return full(x, w, F.when(flat, 0.0).otherwise(F.skewness(x).over(over(w)) * ((w * (w - 1)) ** 0.5 / (w - 2))))


def ts_kurtosis(x: Column, w: int = 10) -> Column:
    x, w = fin(x), positive(w)
    if w < 4:
        return F.lit(None).cast("double")
    flat = F.max(x).over(over(w)) == F.min(x).over(over(w))
    value = (F.kurtosis(x).over(over(w)) * (w + 1) + 6) * ((w - 1) / ((w - 2) * (w - 3)))
    return full(x, w, F.when(flat, -3.0).otherwise(value))


def ts_zscore(x: Column, w: int = 10, eps: float = 1e-8) -> Column:
    x, w = fin(x), positive(w)
    sd = F.stddev_samp(x).over(over(w))
    return full(x, w, F.when(F.abs(sd) > eps, (x - F.avg(x).over(over(w))) / sd))


def ts_volatility(x: Column, w: int = 10) -> Column:
    return ts_std_dev(div(x, F.lag(x).over(along())) - 1, w)


def ts_vwap(vwap: Column, volume: Column, w: int = 10) -> Column:
    return div0(ts_sum(nn(vwap * volume), w), ts_sum(volume, w))


def ts_pos(x: Column, w: int = 7) -> Column:
    low, high = ts_min(x, w), ts_max(x, w)
    return div0(x - low, high - low)


def ts_drawdown(x: Column, w: int = 7) -> Column:
    top = ts_max(x, w)
    d = div0(x, top) - 1
    return F.when(d > 0, 0.0).otherwise(d)


def ts_slope(x: Column, w: int = 7) -> Column:
    """Least-squares slope over the window's bars."""
    x, w = fin(x), positive(w, 2)
    a = F.collect_list(x).over(over(w))
    mid = (w - 1) / 2
    total = F.aggregate(F.transform(a, lambda v, i: v * (i - F.lit(mid))), F.lit(0.0), lambda s, v: s + v)
    return full(x, w, total / (w * (w * w - 1) / 12))


def atr_sma(high: Column, low: Column, close: Column, w: int = 14) -> Column:
    return ts_mean(true_range(high, low, close), w)


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = F.lag(close).over(along())
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def _pair(y: Column, x: Column, w: int, lag: int = 0):
    y, x = fin(y), fin(x)
    if lag:
        y, x = ts_delay(y, lag), ts_delay(x, lag)
    ok = both(x, y)
    y, x = F.when(ok, y), F.when(ok, x)
    return y, x, F.covar_pop(y, x).over(over(w)), F.var_pop(x).over(over(w)), F.var_pop(y).over(over(w)), lambda v: full(y, w, v)


def ts_corr(x: Column, y: Column, w: int = 10) -> Column:
    w = positive(w)
    _, _, c, vx, vy, ok = _pair(x, y, w)
    return ok(F.when((vx > 0) & (vy > 0), c / F.sqrt(vx * vy)))


def ts_covariance(x: Column, y: Column, w: int = 10) -> Column:
    w = positive(w)
    return (p := _pair(x, y, w))[5](p[2])


def make_ts_regression(kind: str):
    """beta, alpha, resid or r2 of y on x over d bars, both lagged."""

    def op(y: Column, x: Column, d: int = 10, lag: int = 0) -> Column:
        d = positive(d, 2)
        y, x, c, vx, vy, ok = _pair(y, x, d, int(lag))
        beta = div0(c, vx)
        alpha = F.avg(y).over(over(d)) - beta * F.avg(x).over(over(d))
        value = {"beta": beta, "alpha": alpha, "resid": y - (alpha + beta * x), "r2": F.when((vx > 0) & (vy > 0), c * c / (vx * vy))}[kind]
        return ok(value)

    return op


ts_beta, ts_alpha, ts_resid, ts_r2 = map(make_ts_regression, ("beta", "alpha", "resid", "r2"))


def rank(x: Column) -> Column:
    """Share of the date's values not above, ties at their mean place."""
    ties = F.count("*").over(Window.partitionBy("ts", x))
    place = F.rank().over(of_date().orderBy(x.asc_nulls_last())) + (ties - 1) / F.lit(2.0)
    return F.when(x.isNotNull(), place / F.count(x).over(of_date()))


def scale(x: Column, longscale: float = 1.0, shortscale: float | None = None) -> Column:
    if shortscale is None:
        return div0(x, F.sum(F.abs(x)).over(of_date())) * float(longscale)
    up, down = F.sum(F.when(x > 0, x)).over(of_date()), F.sum(F.when(x < 0, -x)).over(of_date())
    return F.when(x > 0, x / up * float(longscale)).when(x < 0, x / down * float(shortscale)).otherwise(0.0)


def zscore(x: Column) -> Column:
    """Against the date's mean and sample deviation; missing values and flat dates give 0."""
    wild = F.max(F.when(F.abs(x) == INF, 1)).over(of_date()).isNotNull()
    f = fin(x)
    return F.when(wild, 0.0).otherwise(F.coalesce(div0(f - F.avg(f).over(of_date()), F.stddev_samp(f).over(of_date())), F.lit(0.0)))


def _clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def winsorize(x: Column, std: float = 4.0) -> Column:
    m, s = F.avg(x).over(of_date()), F.stddev_pop(x).over(of_date())
    return F.when(s > 0, _clip(x, m - s * float(std), m + s * float(std))).otherwise(x)


def winsorize_mad(x: Column, n: float = 3.0) -> Column:
    m = F.percentile(x, 0.5).over(of_date())
    mad = F.percentile(F.abs(x - m), 0.5).over(of_date()) * (1.4826 * float(n))
    return _clip(x, m - mad, m + mad)


def winsorize_group(x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    return _clip(x, F.percentile(x, low).over(of_date()), F.percentile(x, high).over(of_date()))


def neutralize(y: Column, x: Column, add_intercept: bool = True, min_count: int = 3) -> Column:
    """What a date's least-squares line on x leaves of y."""
    ok = both(fin(y), fin(x))
    y, x = F.when(ok, y), F.when(ok, x)
    enough = F.count(y).over(of_date()) >= int(min_count)
    if not add_intercept:
        return F.when(enough, y - x * div0(F.sum(x * y).over(of_date()), F.sum(x * x).over(of_date())))
    beta = div0(F.covar_pop(y, x).over(of_date()), F.var_pop(x).over(of_date()))
    return F.when(enough, y - F.avg(y).over(of_date()) - beta * (x - F.avg(x).over(of_date())))


def log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def sqrt(x: Column) -> Column:
    return F.sqrt(F.when(x < 0, 0.0).otherwise(x))


def maximum(x: Column, y: Column) -> Column:
    return F.when(both(x, y), F.greatest(x, y))


def minimum(x: Column, y: Column) -> Column:
    return F.when(both(x, y), F.least(x, y))


def signed_power(x: Column, p) -> Column:
    return nn(F.signum(x) * F.pow(F.abs(x), F.lit(p) if not isinstance(p, Column) else p))


def compare(op: str):
    return lambda a, b: F.coalesce({"lt": a < b, "gt": a > b, "eq": a == b, "le": a <= b, "ge": a >= b}[op], F.lit(False))


def logical_or(a: Column, b: Column) -> Column:
    return a | b


def if_else(c: Column, t: Column, f: Column) -> Column:
    return F.when(c, t).otherwise(f)


def trade_when(c: Column, alpha: Column, leave: Column | None = None) -> Column:
    return F.when(c, alpha).otherwise(F.lit(None).cast("double") if leave is None else leave)


add, sub, mul = (lambda a, b: nn(a + b)), (lambda a, b: nn(a - b)), (lambda a, b: nn(a * b))
neg = lambda a: -a
__all__ = ["div", "truth"]
