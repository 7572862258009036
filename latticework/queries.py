"""A query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import recursive
from .plans import backtest as bt
from .plans import scoring, style, validation
from .plans.dsl import Compiler, evaluate, evaluate_batch, process_factor, stack
from .plans.search import Search
from .sources import market
from .sources.panels import event_panel, user_panel, week_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "-ts_mean(zscore(volume), 28)"
DAY = "yyyy-MM-dd HH"

_TAIL = """
g AS (SELECT t.ts, s.symbol FROM (SELECT DISTINCT ts FROM b) t, (SELECT DISTINCT symbol FROM b) s),
d AS (SELECT g.ts, g.symbol, open, high, low, close, volume, funding, cap FROM g LEFT JOIN b ON g.ts = b.ts AND g.symbol = b.symbol),
f AS (SELECT *, (high + low + close) / 3 AS vwap, close / nullif(lag(close) OVER s, 0) - 1 AS returns, lead(close) OVER s / nullif(close, 0) - 1 AS target,
 row_number() OVER (PARTITION BY ts ORDER BY cap DESC NULLS LAST, symbol) AS place FROM d WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
f2 AS (SELECT *, CASE WHEN place <= 15 THEN cap END AS w FROM f),
f3 AS (SELECT *, sum(w) OVER (PARTITION BY ts) AS tw FROM f2),
p AS (SELECT *, CASE WHEN (SELECT max(cap) FROM f) IS NOT NULL THEN sum(returns * w / nullif(tw, 0)) OVER (PARTITION BY ts) ELSE avg(returns) OVER (PARTITION BY ts) END AS market_return FROM f3)"""
_WEEK = (
    """WITH raw AS (SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts, CAST(l_suppkey % 10 AS VARCHAR) AS symbol, l_extendedprice / l_quantity AS price, l_quantity, l_discount,
 (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey) AS k FROM lineitem),
b0 AS (SELECT ts, symbol, min_by(price, k) AS open, max(price) AS high, min(price) AS low, max_by(price, k) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume, avg(l_discount) - 0.05 AS funding, count(*) AS n FROM raw GROUP BY ts, symbol),
b AS (SELECT *, close * CAST(sum(n) OVER (PARTITION BY symbol) AS DOUBLE) AS cap FROM b0),"""
    + _TAIL
)


def _events(unit: str, symbol: str) -> str:
    return (
        f"""WITH raw AS (SELECT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts, {symbol} AS symbol, value, (ts, event_id) AS k FROM events),
b AS (SELECT ts, symbol, min_by(value, k) AS open, max(value) AS high, min(value) AS low, max_by(value, k) AS close, CAST(count(*) AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS funding, CAST(NULL AS DOUBLE) AS cap FROM raw GROUP BY 1, 2),"""
        + _TAIL
    )


PANELS = {"week": (week_panel, _WEEK), "event": (event_panel, _events("hour", "event_type")), "user": (user_panel, _events("day", "CAST(user_id % 12 AS VARCHAR)"))}


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Times as text, numbers rounded, so that engines that add in another order agree."""
    out = []
    for c, t in df.dtypes:
        out.append(F.date_format(c, DAY).alias(c) if t == "timestamp" else (F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c))
    return df.select(*out)


def _sql(with_: str, body: str, cols: dict[str, str], digits: int = 6) -> str:
    """cols: name to t (time), d (double) or another type's letter for as it is."""
    out = [f"strftime({c}, '%Y-%m-%d %H') AS {c}" if t == "t" else f"round({c}, {digits}) + 0.0 AS {c}" if t == "d" else c for c, t in cols.items()]
    return f"{with_}\nSELECT {', '.join(out)} FROM ({body}) x"


def query(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


def W(w: int) -> str:  # noqa: N802
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


S, D, RN = "OVER (PARTITION BY symbol ORDER BY ts)", "OVER (PARTITION BY ts)", "row_number() OVER (PARTITION BY symbol ORDER BY ts)"


def full(x: str, w: int, e: str) -> str:
    return f"CASE WHEN count({x}) {W(w)} = {w} THEN {e} END"


def formula(name: str, text: str, sql: str, *layers: str, panel: str = "week") -> None:
    """A query of a formula's values; sql: its value over the panel p and the layers of columns that it builds on."""
    make, with_ = PANELS[panel]
    QUERIES[name] = lambda spark, sf, m=make, t=text: _round(evaluate(m(spark, sf), t, "value").select("ts", "symbol", "value"))
    src = "p"
    for i, layer in enumerate(layers):
        with_ += f",\nl{i} AS (SELECT *, {layer} FROM {src})"
        src = f"l{i}"
    ORACLES[name] = _sql(with_, f"SELECT ts, symbol, CAST({sql} AS DOUBLE) AS value FROM {src}", {"ts": "t", "symbol": "s", "value": "d"})


x = "returns"
# Fields and scalar functions.
formula("field_returns", "returns", "returns")
formula("field_market_return", "market_return", "market_return")
formula("field_market_return_mean", "market_return", "market_return", panel="event")
formula("field_adv", "adv20 / 1000", full("a", 20, f"avg(a) {W(20)}") + " / 1000", "vwap * volume AS a")
formula("scalar_log", "log(returns)", "sign(returns) * ln(1 + abs(returns))")
formula("scalar_sqrt", "sqrt(returns)", "sqrt(CASE WHEN returns < 0 THEN 0 ELSE returns END)")
formula("scalar_sign_abs_exp", "sign(returns) * abs(returns) + exp(-abs(returns))", "sign(returns) * abs(returns) + exp(-abs(returns))")
formula("scalar_max_min", "max(returns, market_return) - min(returns, 0)", "(CASE WHEN returns IS NOT NULL AND market_return IS NOT NULL THEN greatest(returns, market_return) END) - (CASE WHEN returns IS NOT NULL THEN least(returns, 0) END)")
formula("scalar_signed_power", "signed_power(returns, 2) + returns ** 2", "sign(returns) * pow(abs(returns), 2) + pow(returns, 2)")
formula("scalar_div", "div(returns, volume) + returns / 2", "returns / volume + returns / 2")
formula("scalar_functions", "neg(add(sub(mul(returns, 2), 1), returns))", "-(returns * 2 - 1 + returns)")
formula("cmp_lt_gt_eq", "lt(returns, 0) + gt(returns, 0.1) * 2 + eq(volume, 1) * 4", "CAST(coalesce(returns < 0, false) AS INT) + CAST(coalesce(returns > 0.1, false) AS INT) * 2 + CAST(coalesce(volume = 1, false) AS INT) * 4", panel="event")
formula("cmp_or_and_not", "or(returns < 0, volume > 20) + (~(returns > 0) & volume > 10) * 2", "CAST(coalesce(returns < 0, false) OR coalesce(volume > 20, false) AS INT) + CAST(NOT coalesce(returns > 0, false) AND coalesce(volume > 10, false) AS INT) * 2", panel="event")
formula("if_else", "if_else(returns > 0, volume, -volume)", "CASE WHEN returns > 0 THEN volume ELSE -volume END", panel="event")
formula("ternary_statements", "a = returns * 2; # twice\n(a > 0) ? a : market_return", "CASE WHEN returns * 2 > 0 THEN returns * 2 ELSE market_return END")
formula("trade_when", "trade_when(returns > 0, volume)", "CASE WHEN returns > 0 THEN volume END", panel="event")
# Along a symbol, one input.
formula("ts_sum", "ts_sum(returns, 10)", full(x, 10, f"sum({x}) {W(10)}"))
formula("ts_mean", "ts_mean(returns, 20)", full(x, 20, f"avg({x}) {W(20)}"))
formula("ts_mean_gaps", "sma(volume, 3)", full("volume", 3, f"avg(volume) {W(3)}"), panel="event")
formula("ts_std_dev", "ts_std_dev(returns, 20)", full(x, 20, f"stddev_samp({x}) {W(20)}"))
formula("ts_median", "ts_median(returns, 9)", full(x, 9, f"median({x}) {W(9)}"))
formula("ts_quantile", "ts_quantile(returns, 10, 0.25)", full(x, 10, f"quantile_cont({x}, 0.25) {W(10)}"))
formula("ts_pctchange", "ts_pctchange(close, 3)", "CASE WHEN fl = 0 THEN NULL ELSE ff / fl - 1 END", f"last_value(close IGNORE NULLS) {S} AS ff", f"lag(ff, 3) {S} AS fl", panel="week")
formula("ts_rank", "ts_rank(volume, 10)", f"CASE WHEN {RN} >= 10 THEN len(list_filter(a, lambda v: v <= volume)) / 10.0 END", f"list(volume) {W(10)} AS a")
formula("ts_rank_gaps", "ts_rank(volume, 5)", f"CASE WHEN {RN} >= 5 THEN CASE WHEN volume IS NULL THEN 0 ELSE len(list_filter(a, lambda v: v <= volume)) / 5.0 END END", f"list(volume) {W(5)} AS a", panel="event")
formula("ts_percentile", "ts_percentile(volume, 10)", full("volume", 10, "len(list_filter(a, lambda v: v < volume)) / 9.0"), f"list(volume) {W(10)} AS a")
formula("ts_product", "ts_product(1 + returns, 5)", full("a", 5, f"product(a) {W(5)}"), "1 + returns AS a")
formula("ts_min", "ts_min(returns, 7)", full(x, 7, f"min({x}) {W(7)}"))
formula("ts_max", "ts_max(returns, 7)", full(x, 7, f"max({x}) {W(7)}"))
formula("ts_delta", "delta(returns, 3)", f"returns - lag(returns, 3) {S}")
formula("ts_delay", "ts_delay(returns, 5)", f"lag(returns, 5) {S}")
formula("ts_arg_max", "ts_arg_max(volume, 7)", f"CASE WHEN {RN} >= 7 THEN list_position(a, list_max(a)) END", f"list(volume) {W(7)} AS a")
formula("ts_arg_min", "ts_argmin(volume, 7)", f"CASE WHEN {RN} >= 7 THEN list_position(a, list_min(a)) END", f"list(volume) {W(7)} AS a")
formula("ts_decay_linear", "decay_linear(returns, 6)", full(x, 6, " + ".join(f"lag(returns, {k}) {S} * {k + 1}" for k in range(6)) .join("()") + " / 21.0"))
formula("ts_skewness", "ts_skewness(returns, 20)", full(x, 20, f"skewness({x}) {W(20)}"))
formula("ts_kurtosis", "ts_kurtosis(returns, 20)", full(x, 20, f"kurtosis({x}) {W(20)}"))
formula("ts_zscore", "ts_zscore(returns, 14)", full(x, 14, f"CASE WHEN stddev_samp({x}) {W(14)} > 1e-8 THEN ({x} - avg({x}) {W(14)}) / stddev_samp({x}) {W(14)} END"))
formula("ts_volatility", "ts_volatility(close, 14)", full(x, 14, f"stddev_samp({x}) {W(14)}"))
formula("ts_vwap", "ts_vwap(10)", full("volume", 10, f"sum(vwap * volume) {W(10)} / sum(volume) {W(10)}"))
formula("ts_pos", "ts_pos(returns, 14)", full(x, 14, f"({x} - min({x}) {W(14)}) / nullif(max({x}) {W(14)} - min({x}) {W(14)}, 0)"))
formula("ts_drawdown", "ts_drawdown(close, 14)", full("close", 14, f"least(close / max(close) {W(14)} - 1, 0)"))
formula("ts_slope", "ts_slope(returns, 12)", full(x, 12, f"regr_slope({x}, i) {W(12)}"), f"CAST({RN} AS DOUBLE) AS i")
formula("ts_ema", "ts_ema(close, 6)", f"CASE WHEN {RN} >= 6 THEN list_reduce(a, lambda m, v: m * (1 - 2.0/7) + v * (2.0/7)) END", f"list(close) {S} AS a")
formula("ts_ewma", "ts_ewma(close, 12)", "list_reduce(a, lambda m, v: m * (1 - 2.0/13) + v * (2.0/13))", f"list(close) {S} AS a")
formula("atr_sma", "atr_sma(high, low, close, 14)", full("a", 14, f"avg(a) {W(14)}"), f"greatest(high - low, abs(high - lag(close) {S}), abs(low - lag(close) {S})) AS a")
# Two inputs.
for _n, _e in (
    ("ts_corr", "corr(returns, m) {w}"),
    ("ts_covariance", "covar_pop(returns, m) {w}"),
    ("ts_beta", "regr_slope(returns, m) {w}"),
    ("ts_alpha", "regr_intercept(returns, m) {w}"),
    ("ts_resid", "(returns - regr_intercept(returns, m) {w} - regr_slope(returns, m) {w} * m)"),
    ("ts_r2", "regr_r2(returns, m) {w}"),
):
    formula(_n, f"{_n}(returns, market_return, 20)", full("returns", 20, _e.format(w=W(20))), "market_return AS m")
formula("ts_beta_lag", "ts_beta(returns, market_return, 20, 2)", full("a", 20, f"regr_slope(a, m) {W(20)}"), f"lag(returns, 2) {S} AS a, lag(market_return, 2) {S} AS m")
# Across a date.
formula("cs_rank", "rank(volume)", f"CASE WHEN volume IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY volume NULLS LAST) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0) / count(volume) {D} END", panel="event")
formula("cs_scale", "scale(returns)", f"returns / nullif(sum(abs(returns)) {D}, 0)")
formula("cs_scale_ls", "scale(returns, 1, 0.5)", f"CASE WHEN returns > 0 THEN returns / sum(CASE WHEN returns > 0 THEN returns END) {D} WHEN returns < 0 THEN returns / sum(CASE WHEN returns < 0 THEN -returns END) {D} * 0.5 ELSE 0 END")
_Z = "coalesce(({c} - avg({c}) OVER (PARTITION BY ts)) / nullif(stddev_samp({c}) OVER (PARTITION BY ts), 0), 0)"
formula("cs_zscore", "zscore(volume)", _Z.format(c="volume"), panel="event")
formula("cs_winsorize", "winsorize(returns, 1)", "CASE WHEN sd > 0 THEN least(greatest(returns, m - sd), m + sd) ELSE returns END", f"avg(returns) {D} AS m, stddev_pop(returns) {D} AS sd")
formula("cs_winsorize_mad", "winsorize_mad(returns, 1)", "CASE WHEN returns IS NOT NULL THEN least(greatest(returns, m - 1.4826 * mad), m + 1.4826 * mad) END", f"median(returns) {D} AS m", f"median(abs(returns - m)) {D} AS mad")
formula("cs_winsorize_group", "winsorize_group(returns)", "CASE WHEN returns IS NOT NULL THEN least(greatest(returns, lo), hi) END", f"quantile_cont(returns, 0.01) {D} AS lo, quantile_cont(returns, 0.99) {D} AS hi")
formula("cs_neutralize", "neutralize(returns, volume)", f"CASE WHEN count(r) {D} >= 3 THEN r - regr_intercept(r, v) {D} - regr_slope(r, v) {D} * v END", "CASE WHEN volume IS NOT NULL THEN returns END AS r, CASE WHEN returns IS NOT NULL THEN volume END AS v")
formula("nested_stages", "rank(ts_mean(zscore(returns), 5)) - ts_rank(rank(volume), 5)", f"(CASE WHEN m IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY m NULLS LAST) + (count(*) OVER (PARTITION BY ts, m) - 1) / 2.0) / count(m) {D} END) - CASE WHEN {RN} >= 5 THEN len(list_filter(a, lambda v: v <= rv)) / 5.0 END", _Z.format(c="returns") + f" AS z, (rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0) / count(volume) {D} AS rv", f"round({full('z', 5, f'avg(z) {W(5)}')}, 12) AS m, list(rv) {W(5)} AS a")

# The prepared flagship factor, as layers over p.
_FACTOR = f""",
z0 AS (SELECT *, {_Z.format(c="volume")} AS z FROM p),
z1 AS (SELECT *, -({full("z", 28, f"avg(z) {W(28)}")}) AS m FROM z0),
z2 AS (SELECT *, median(m) {D} AS med FROM z1),
z3 AS (SELECT *, median(abs(m - med)) {D} * (1.4826 * 3) AS mad FROM z2),
z4 AS (SELECT *, CASE WHEN m IS NULL THEN NULL WHEN m < med - mad THEN med - mad WHEN m > med + mad THEN med + mad ELSE m END AS c FROM z3),
fac AS (SELECT * REPLACE (funding AS funding), {_Z.format(c="c")} AS factor FROM z4)"""


def _flagship(spark: SparkSession, sf: str) -> DataFrame:
    return process_factor(evaluate(week_panel(spark, sf), FLAGSHIP), "factor")


@query("process_factor")
def _q(spark, sf):
    return _round(_flagship(spark, sf).select("ts", "symbol", "factor"))


ORACLES["process_factor"] = _sql(_WEEK + _FACTOR, "SELECT ts, symbol, factor FROM fac", {"ts": "t", "symbol": "s", "factor": "d"})


@query("panel_ohlcv")
def _q(spark, sf):
    return _round(week_panel(spark, sf).select("ts", "symbol", "open", "high", "low", "close", "volume", "cap", "funding"))


ORACLES["panel_ohlcv"] = _sql(_WEEK, "SELECT * FROM p", {"ts": "t", "symbol": "s"} | dict.fromkeys(("open", "high", "low", "close", "volume", "cap", "funding"), "d"))


@query("panel_dense")
def _q(spark, sf):
    return _round(event_panel(spark, sf).select("ts", "symbol", "close", "volume", "vwap", "returns", "target"))


ORACLES["panel_dense"] = _sql(PANELS["event"][1], "SELECT * FROM p", {"ts": "t", "symbol": "s"} | dict.fromkeys(("close", "volume", "vwap", "returns", "target"), "d"))


@query("panel_user")
def _q(spark, sf):
    return _round(user_panel(spark, sf).select("ts", "symbol", "open", "close", "returns", "market_return"))


ORACLES["panel_user"] = _sql(PANELS["user"][1], "SELECT * FROM p", {"ts": "t", "symbol": "s"} | dict.fromkeys(("open", "close", "returns", "market_return"), "d"))


@query("funding_ffill")
def _q(spark, sf):
    panel = event_panel(spark, sf)
    rates = panel.where("hour(ts) % 8 = 0 and close is not null").select("ts", "symbol", F.col("close").alias("open"))
    return _round(market.align_funding(panel, rates).select("ts", "symbol", "funding"))


ORACLES["funding_ffill"] = _sql(PANELS["event"][1], f"SELECT ts, symbol, coalesce(last_value(CASE WHEN hour(ts) % 8 = 0 THEN close END IGNORE NULLS) {S}, 0) AS funding FROM p", {"ts": "t", "symbol": "s", "funding": "d"})


@query("filter_missing")
def _q(spark, sf):
    return market.filter_missing(event_panel(spark, sf), 15).groupBy("symbol").agg(F.count("open").alias("n"))


ORACLES["filter_missing"] = PANELS["event"][1] + "\nSELECT symbol, n FROM (SELECT symbol, count(open) AS n FROM p GROUP BY symbol) x WHERE n >= (SELECT max(n) FROM (SELECT count(open) AS n FROM p GROUP BY symbol) y) - 15"


@query("topk_universe")
def _q(spark, sf):
    panel = week_panel(spark, sf)
    traded = panel.groupBy("symbol").agg(F.sum("volume").alias("quote_volume"))
    return market.universe(traded, panel.where("symbol <> '3'"), 5)


ORACLES["topk_universe"] = _WEEK + "\nSELECT symbol, sum(volume) AS quote_volume FROM p WHERE symbol <> '3' GROUP BY symbol ORDER BY 2 DESC, 1 LIMIT 5"


@query("market_caps")
def _q(spark, sf):
    q = week_panel(spark, sf).where("close is not null").select("symbol", F.col("close").alias("price_usd"), F.col("cap").alias("market_cap_usd"))
    return _round(market.market_caps(q))


ORACLES["market_caps"] = _WEEK + "\nSELECT symbol, round(close, 6) + 0.0 AS price_usd, round(cap, 6) + 0.0 AS market_cap_usd, round(cap / close, 6) + 0.0 AS circulating_supply, CASE WHEN cap > 1e10 THEN 'mega' WHEN cap > 1e8 THEN 'large' WHEN cap > 1e7 THEN 'mid' WHEN cap > 1e6 THEN 'small' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY cap DESC, close) AS r FROM p WHERE close IS NOT NULL) x WHERE r = 1"


@query("forward_returns")
def _q(spark, sf):
    return _round(scoring.forward_returns(week_panel(spark, sf), 3, "forward").select("ts", "symbol", "forward"))


ORACLES["forward_returns"] = _sql(_WEEK, f"SELECT ts, symbol, lead(close, 3) {S} / nullif(close, 0) - 1 AS forward FROM p", {"ts": "t", "symbol": "s", "forward": "d"})


@query("forward_compound")
def _q(spark, sf):
    return _round(scoring.forward_compound(week_panel(spark, sf), 3).select("ts", "symbol", "forward"))


_K = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
ORACLES["forward_compound"] = _sql(_WEEK, f"SELECT ts, symbol, CASE WHEN count(target) {_K} = 3 THEN product(1 + target) {_K} - 1 END AS forward FROM p", {"ts": "t", "symbol": "s", "forward": "d"})


@query("factor_agg_mean")
def _q(spark, sf):
    return _round(bt.aggregate_factor(week_panel(spark, sf).withColumn("factor", F.col("returns")), "factor", 4, "mean").select("ts", "symbol", "factor"))


ORACLES["factor_agg_mean"] = _sql(_WEEK, f"SELECT ts, symbol, {full('returns', 4, f'avg(returns) {W(4)}')} AS factor FROM p", {"ts": "t", "symbol": "s", "factor": "d"})


@query("factor_agg_ewma")
def _q(spark, sf):
    return _round(bt.aggregate_factor(week_panel(spark, sf).withColumn("factor", F.col("close")), "factor", 3, "ewma").select("ts", "symbol", "factor"))


ORACLES["factor_agg_ewma"] = _sql(_WEEK + f", e AS (SELECT *, list(close) {S} AS a, {RN} AS i FROM p)", "SELECT ts, symbol, CASE WHEN i >= 3 THEN list_sum(list_transform(a, lambda v, k: v * pow(0.5, i - k))) / list_sum(list_transform(a, lambda v, k: pow(0.5, i - k))) END AS factor FROM e", {"ts": "t", "symbol": "s", "factor": "d"})


@query("atr")
def _q(spark, sf):
    return _round(recursive.atr(week_panel(spark, sf).select("ts", "symbol", "high", "low", "close"), "atr", 14).select("ts", "symbol", F.nanvl("atr", F.lit(None)).alias("atr")))


ORACLES["atr"] = _sql(_WEEK + f", t0 AS (SELECT *, greatest(high - low, abs(high - lag(close) {S}), abs(low - lag(close) {S})) AS tr, {RN} AS i FROM p), t1 AS (SELECT *, list(tr) {S} AS a FROM t0)", "SELECT ts, symbol, CASE WHEN i >= 14 THEN list_reduce(list_concat([list_avg(a[1:14])], a[15:]), lambda m, v: (m * 13 + v) / 14) END AS atr FROM t1", {"ts": "t", "symbol": "s", "atr": "d"})

_CELLS = """,
cells AS (SELECT *, count(*) OVER (PARTITION BY {k}ts) AS n, ntile({q}) OVER (PARTITION BY {k}ts ORDER BY v, symbol) AS bucket FROM ({src}) y WHERE v IS NOT NULL AND t IS NOT NULL),
dates AS (SELECT {k}ts, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(v) > 1e-300 AND var_pop(t) > 1e-300 THEN covar_pop(v, t) / sqrt(var_pop(v) * var_pop(t)) END AS ic, avg(CASE WHEN bucket = {q} THEN t END) AS lr, avg(CASE WHEN bucket = 1 THEN t END) AS sr,
 avg(CASE WHEN bucket = {q} THEN funding END) AS lf, avg(CASE WHEN bucket = 1 THEN funding END) AS sf, list(symbol) FILTER (bucket = {q}) AS ls, list(symbol) FILTER (bucket = 1) AS ss{more} FROM cells GROUP BY {k}ts),
turn AS (SELECT *, CASE WHEN pl IS NOT NULL THEN (len(list_filter(ls, lambda s: NOT list_contains(pl, s))) / len(ls) + len(list_filter(ss, lambda s: NOT list_contains(ps, s))) / len(ss)) / 2 END AS turnover FROM (SELECT *, lag(ls) OVER (PARTITION BY {p}n >= {q} ORDER BY ts) AS pl, lag(ss) OVER (PARTITION BY {p}n >= {q} ORDER BY ts) AS ps FROM dates) y)"""


def _cells(src: str, q: int = 5, keys: str = "", more: str = "") -> str:
    return _CELLS.format(src=src, q=q, k=keys, p=keys, more=more)


_ONE = "SELECT ts, symbol, factor AS v, target AS t, funding FROM fac"


@query("ic_series")
def _q(spark, sf):
    return _round(bt.ic_series(_flagship(spark, sf)))


ORACLES["ic_series"] = _sql(_WEEK + _FACTOR + _cells(_ONE), "SELECT ts, n, ic FROM dates", {"ts": "t", "n": "n", "ic": "d"})


@query("factor_pnl")
def _q(spark, sf):
    df = stack(_flagship(spark, sf), ["factor"], "target")
    return _round(scoring.factor_pnl(df, ["factor"]))


ORACLES["factor_pnl"] = _sql(_WEEK + _FACTOR + _cells(_ONE), "SELECT 'factor' AS factor, g.ts, lr - sr - coalesce(turnover, 0) * 0.001 AS pnl FROM (SELECT DISTINCT ts FROM fac) g LEFT JOIN (SELECT * FROM turn WHERE n >= 5) u ON g.ts = u.ts", {"factor": "s", "ts": "t", "pnl": "d"})

_SCORED = ("returns_before_cost", "returns_after_cost", "sharpe_before_cost", "sharpe_after_cost", "ic_mean", "ic_std", "ic_ir", "turnover", "win_rate", "drawdown", "obs_count", "fitness", "nan_ratio")


def _score_sql(keys: str) -> str:
    k, p = keys, f"PARTITION BY {keys.rstrip(', ')} " if keys else ""
    return f""",
net AS (SELECT *, lr - sr AS gross, coalesce(turnover, 0) AS tn, lr - sr - coalesce(turnover, 0) * 0.001 AS net FROM turn WHERE n >= 5),
eq AS (SELECT *, 1 + sum(net) OVER ({p}ORDER BY ts) AS equity FROM net),
top AS (SELECT *, max(equity) OVER ({p}ORDER BY ts) AS top FROM eq),
ics AS (SELECT {k}coalesce(avg(ic), 0) AS ic_mean, coalesce(stddev_samp(ic), 0) AS ic_std FROM dates{' GROUP BY ' + k.rstrip(', ') if k else ''}),
sc AS (SELECT {k}sum(gross) AS returns_before_cost, sum(net) AS returns_after_cost, avg(gross) / stddev_samp(gross) * sqrt(365.0 / 7) AS sharpe_before_cost, avg(net) / stddev_samp(net) * sqrt(365.0 / 7) AS sharpe_after_cost,
 avg(tn) AS turnover, avg(CAST(net > 0 AS DOUBLE)) AS win_rate, min(equity / top - 1) AS drawdown, CAST(count(*) AS BIGINT) AS obs_count FROM top{' GROUP BY ' + k.rstrip(', ') if k else ''})"""


@query("score_segment")
def _q(spark, sf):
    df = stack(_flagship(spark, sf), ["factor"], "target")
    return _round(scoring.score(df, ["factor"], annualization=365 / 7).select("factor", *_SCORED))


_FIT = "CASE WHEN returns_after_cost > 0 THEN sharpe_after_cost * sqrt(returns_after_cost / greatest(turnover, 0.15)) ELSE 0 END AS fitness"
ORACLES["score_segment"] = _sql(
    _WEEK + _FACTOR + _cells(_ONE) + _score_sql(""),
    f"SELECT 'factor' AS factor, *, ic_mean / (ic_std + 1e-8) AS ic_ir, {_FIT}, (SELECT avg(CAST(factor IS NULL AS DOUBLE)) FROM fac) AS nan_ratio FROM sc, ics",
    {"factor": "s"} | {c: "n" if c == "obs_count" else "d" for c in _SCORED},
)

_SEGMENT = ", seg AS (SELECT ts, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END AS segment FROM (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM p) a) b)"


@query("segments")
def _q(spark, sf):
    return scoring.segments(week_panel(spark, sf)).groupBy("segment").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), DAY).alias("first"))


ORACLES["segments"] = _WEEK + _SEGMENT + "\nSELECT segment, count(*) AS n, strftime(min(p.ts), '%Y-%m-%d %H') AS first FROM p JOIN seg ON p.ts = seg.ts GROUP BY segment"


@query("score_search")
def _q(spark, sf):
    df = stack(_flagship(spark, sf), ["factor"], "target")
    return _round(scoring.score_search(df, annualization=365 / 7, min_obs=1).select("factor", "train_fitness", "valid_fitness", "train_sharpe", "valid_sharpe", "valid_turnover", "robust", "stability", "fitness"))


_BY_SEG = _cells("SELECT segment, f.ts, symbol, factor AS v, target AS t, funding FROM fac f JOIN seg ON f.ts = seg.ts WHERE segment <> 'test'", keys="segment, ") + _score_sql("segment, ")
ORACLES["score_search"] = _sql(
    _WEEK + _SEGMENT + _FACTOR + _BY_SEG + f", a AS (SELECT *, {_FIT} FROM sc), two AS (SELECT t.fitness AS train_fitness, v.fitness AS valid_fitness, t.sharpe_after_cost AS train_sharpe, v.sharpe_after_cost AS valid_sharpe, v.turnover AS valid_turnover FROM a t, a v WHERE t.segment = 'train' AND v.segment = 'valid')",
    "SELECT 'factor' AS factor, *, least(train_fitness, valid_fitness) AS robust, coalesce(least(abs(train_fitness), abs(valid_fitness)) / nullif(greatest(abs(train_fitness), abs(valid_fitness)), 0), 0) AS stability, least(train_fitness, valid_fitness) * coalesce(least(abs(train_fitness), abs(valid_fitness)) / nullif(greatest(abs(train_fitness), abs(valid_fitness)), 0), 0) AS fitness FROM two",
    {"factor": "s"} | dict.fromkeys(("train_fitness", "valid_fitness", "train_sharpe", "valid_sharpe", "valid_turnover", "robust", "stability", "fitness"), "d"),
)

_BT = bt.Backtest(freq="1w")
_DAILY = """,
dd AS (SELECT g.ts, coalesce(lr - sr, 0) AS pnl, coalesce(turnover * 0.001, 0) AS trading_cost, coalesce(CASE WHEN epoch(g.ts) % 28800 = 0 THEN lf - sf END, 0) AS funding_cost, turnover, lf, sf, coalesce(q1, 0) AS q1_pnl, coalesce(q2, 0) AS q2_pnl, coalesce(q3, 0) AS q3_pnl, coalesce(q4, 0) AS q4_pnl, coalesce(q5, 0) AS q5_pnl
 FROM (SELECT DISTINCT ts FROM fac) g LEFT JOIN (SELECT * FROM turn WHERE n >= 5) u ON g.ts = u.ts),
d2 AS (SELECT *, pnl - trading_cost - funding_cost AS pnl_net FROM dd)"""
_TAME = "SELECT ts, symbol, factor AS v, target * 0.01 AS t, funding FROM fac"
_BACK = _WEEK + _FACTOR + _cells(_TAME, more="".join(f", avg(CASE WHEN bucket = {i} THEN t END) AS q{i}" for i in range(1, 6))) + _DAILY


def _tame(spark: SparkSession, sf: str) -> DataFrame:
    """The prices aren't those of a market: a hundredth of their returns keeps growth within what rounding shows."""
    return _flagship(spark, sf).withColumn("target", F.col("target") * 0.01)


@query("bt_daily")
def _q(spark, sf):
    return _round(bt.daily(_tame(spark, sf), config=_BT).select("ts", "pnl", "pnl_net", "trading_cost", "funding_cost", "turnover"))


ORACLES["bt_daily"] = _sql(_BACK, "SELECT * FROM d2", {"ts": "t"} | dict.fromkeys(("pnl", "pnl_net", "trading_cost", "funding_cost", "turnover"), "d"))


@query("bt_curve")
def bt_curve(spark, sf):
    """The flagship: formula, preparation, quantile backtest and curve."""
    return _round(bt.curve(bt.daily(_tame(spark, sf), config=_BT)))


_CURVE = ["pnl", "cum_pnl", "pnl_net", "cum_pnl_net", "trading_cost", "funding_cost", *[f"q{i}_{k}" for i in range(1, 6) for k in ("pnl", "cum")]]
_GROWN = ", ".join(f"product(1 + {a}) OVER (ORDER BY ts) AS {b}" for a, b in [("pnl", "cum_pnl"), ("pnl_net", "cum_pnl_net"), *[(f"q{i}_pnl", f"q{i}_cum") for i in range(1, 6)]])
ORACLES["bt_curve"] = _sql(_BACK, f"SELECT *, ts AS date, {_GROWN} FROM d2", {"date": "t"} | dict.fromkeys(_CURVE, "d"))
_METRICS = ("sharpe", "sharpe_after_cost", "cagr", "returns", "returns_after_cost", "turnover", "win_rate", "profit_loss_ratio", "drawdown", "drawdown_before_cost", "ic_mean", "ic_std", "ic_ir", "margin", "avg_long_funding", "avg_short_funding", "funding_annual", "annual_cost_drag")


@query("bt_metrics")
def _q(spark, sf):
    df = _tame(spark, sf)
    return _round(bt.metrics(df, bt.daily(df, config=_BT), config=_BT).select("obs_count", "symbols", *_METRICS))


ORACLES["bt_metrics"] = _sql(
    _BACK
    + """,
gr AS (SELECT *, product(1 + pnl) OVER (ORDER BY ts) AS g, product(1 + pnl_net) OVER (ORDER BY ts) AS h FROM d2),
gt AS (SELECT *, max(g) OVER (ORDER BY ts) AS gm, max(h) OVER (ORDER BY ts) AS hm FROM gr),
yr AS (SELECT count(*) * 7 * 86400 / (365.25 * 86400) AS y FROM d2),
ics AS (SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std FROM dates),
mm AS (SELECT count(*) AS obs_count, avg(pnl) / stddev_samp(pnl) * sqrt(365.0 / 7) AS sharpe, avg(pnl_net) / stddev_samp(pnl_net) * sqrt(365.0 / 7) AS sharpe_after_cost, pow(product(1 + pnl), 1 / max(y)) - 1 AS cagr, sum(pnl) / max(y) AS returns, sum(pnl_net) / max(y) AS returns_after_cost,
 avg(turnover) AS turnover, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, avg(CASE WHEN pnl > 0 THEN pnl END) / abs(avg(CASE WHEN pnl < 0 THEN pnl END)) AS profit_loss_ratio, min((h - hm) / hm) AS drawdown, min((g - gm) / gm) AS drawdown_before_cost, avg(pnl) * 1000 AS margin,
 avg(lf) AS avg_long_funding, avg(sf) AS avg_short_funding, sum(funding_cost) / max(y) AS funding_annual FROM gt, yr)""",
    "SELECT *, (SELECT count(DISTINCT symbol) FROM p) AS symbols, returns - returns_after_cost AS annual_cost_drag, ic_mean / (ic_std + 1e-8) AS ic_ir FROM mm, ics",
    {"obs_count": "n", "symbols": "n"} | dict.fromkeys(_METRICS, "d"),
)


@query("factor_view")
def _q(spark, sf):
    return _round(scoring.factor_view(evaluate(week_panel(spark, sf), "returns")))


ORACLES["factor_view"] = _sql(_WEEK, f"SELECT ts, symbol, returns AS value, CAST(rank() OVER (PARTITION BY ts ORDER BY returns DESC) AS INT) AS rank, count(*) {D} AS total FROM p WHERE returns IS NOT NULL", {"ts": "t", "symbol": "s", "value": "d", "rank": "n", "total": "n"})


@query("latest_view")
def _q(spark, sf):
    return _round(scoring.latest_view(evaluate(week_panel(spark, sf), "returns")))


ORACLES["latest_view"] = _sql(_WEEK, "SELECT ts, symbol, returns AS value, CAST(rank() OVER (PARTITION BY ts ORDER BY returns DESC) AS INT) AS rank, count(*) OVER (PARTITION BY ts) AS total FROM p WHERE returns IS NOT NULL AND ts = (SELECT max(ts) FROM p WHERE returns IS NOT NULL)", {"ts": "t", "symbol": "s", "value": "d", "rank": "n", "total": "n"})


@query("style_factors")
def _q(spark, sf):
    return _round(style.build_style_factors(week_panel(spark, sf)).select("ts", "symbol", *style.STYLES))


_STYLES = f"""SELECT ts, symbol, ln(cap) AS size, close / lag(close, 20) {S} - 1 AS momentum, {full('returns', 20, f'stddev_samp(returns) {W(20)}')} AS volatility,
 CASE WHEN count(returns) {W(60)} = 60 THEN covar_samp(returns, market_return) {W(60)} / var_samp(market_return) {W(60)} END AS beta, ln(avg(close * volume) {W(20)}) + 0 * (CASE WHEN count(close * volume) {W(20)} = 20 THEN 1 END) AS liquidity,
 -(close / lag(close, 5) {S} - 1) AS reversal, {full('funding', 3, f'avg(funding) {W(3)}')} AS funding_style FROM p"""
ORACLES["style_factors"] = _sql(_WEEK, _STYLES, {"ts": "t", "symbol": "s"} | dict.fromkeys(style.STYLES, "d"))


@query("style_exposure")
def _q(spark, sf):
    """SQL has no least squares on several variables."""
    df = style.build_style_factors(_flagship(spark, sf))
    return _round(style.style_exposures(df, "factor", ["size", "momentum", "volatility"]))


@query("style_residual")
def _q(spark, sf):
    df = style.build_style_factors(_flagship(spark, sf))
    return _round(style.residualize(df, "factor", ["size", "momentum", "volatility"]))


@query("exposure_summary")
def _q(spark, sf):
    df = week_panel(spark, sf).groupBy("ts").agg(F.avg("returns").alias("a"), F.stddev_samp("returns").alias("b"))
    return _round(style.summarize_exposures(df, ["a", "b"]))


ORACLES["exposure_summary"] = _sql(
    _WEEK + ", e AS (SELECT ts, avg(returns) AS a, stddev_samp(returns) AS b FROM p GROUP BY ts), u AS (SELECT 'a' AS style, a AS x FROM e UNION ALL SELECT 'b', b FROM e)",
    'SELECT style, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std, avg(abs(x)) AS abs_mean, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS t_stat, count(x) AS obs_count FROM u WHERE x IS NOT NULL GROUP BY style',
    {"style": "s", "mean": "d", "median": "d", "std": "d", "abs_mean": "d", "t_stat": "d", "obs_count": "n"},
)


@query("market_exposure")
def _q(spark, sf):
    d = week_panel(spark, sf).where("symbol = '1'").select(F.col("returns").alias("strategy"), F.col("market_return").alias("market"))
    return _round(style.market_exposure(d))


ORACLES["market_exposure"] = _sql(
    _WEEK + ", e AS (SELECT returns AS y, market_return AS x FROM p WHERE symbol = '1' AND returns IS NOT NULL AND market_return IS NOT NULL)",
    "SELECT regr_intercept(y, x) AS alpha, regr_slope(y, x) AS beta, regr_r2(y, x) AS r2, corr(y, x) AS corr, regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t_stat, count(*) AS obs_count FROM e",
    {"alpha": "d", "beta": "d", "r2": "d", "corr": "d", "t_stat": "d", "obs_count": "n"},
)


@query("adf")
def _q(spark, sf):
    """SQL has no unit-root test."""
    return _round(recursive.adf(week_panel(spark, sf), "close"))


@query("folds_time")
def _q(spark, sf):
    return _round(validation.time_folds(week_panel(spark, sf), 6))


ORACLES["folds_time"] = _sql(_WEEK, "SELECT ts, CAST(ntile(6) OVER (ORDER BY ts) AS INT) AS fold FROM (SELECT DISTINCT ts FROM p) a", {"ts": "t", "fold": "n"})


@query("folds_walk_forward")
def _q(spark, sf):
    return _round(validation.walk_forward_folds(week_panel(spark, sf), 4))


ORACLES["folds_walk_forward"] = _sql(_WEEK, "SELECT ts, CAST(k - 1 AS INT) AS fold FROM (SELECT ts, ntile(5) OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM p) a) b WHERE k > 1", {"ts": "t", "fold": "n"})


@query("folds_universe")
def _q(spark, sf):
    return week_panel(spark, sf).select("symbol").distinct().withColumn("fold", validation.universe_fold("symbol", 3))


ORACLES["folds_universe"] = _WEEK + "\nSELECT symbol, CAST(list_reduce([CAST('0x' || substr(md5(symbol), i * 8 + 1, 8) AS BIGINT) FOR i IN range(4)], lambda a, b: (a % 3 * (4294967296 % 3) + b) % 3) % 3 AS INT) AS fold FROM (SELECT DISTINCT symbol FROM p) a"


@query("fold_scores")
def _q(spark, sf):
    df = stack(_flagship(spark, sf), ["factor"], "target")
    s = scoring.score(df.join(F.broadcast(validation.time_folds(df, 6)), "ts"), ["factor", "fold"], annualization=365 / 7)
    return _round(s.select("factor", "fold", "sharpe_after_cost", "returns_after_cost", "turnover", "obs_count"))


ORACLES["fold_scores"] = _sql(
    _WEEK + _FACTOR + ", fo AS (SELECT ts, CAST(ntile(6) OVER (ORDER BY ts) AS INT) AS fold FROM (SELECT DISTINCT ts FROM p) a)" + _cells("SELECT fold, f.ts, symbol, factor AS v, target AS t, funding FROM fac f JOIN fo ON f.ts = fo.ts", keys="fold, ") + _score_sql("fold, "),
    "SELECT 'factor' AS factor, * FROM sc",
    {"factor": "s", "fold": "n", "sharpe_after_cost": "d", "returns_after_cost": "d", "turnover": "d", "obs_count": "n"},
)
_SOME = {"a": FLAGSHIP, "b": "ts_rank(returns, 10)", "c": "-ts_mean(returns, 5)"}


@query("robustness")
def _q(spark, sf):
    """Scores of three formulas on all folds in one plan, and decisions; SQL would repeat fold_scores."""
    df = stack(evaluate_batch(week_panel(spark, sf), _SOME)[0], list(_SOME), "target")
    r = validation.robustness(validation.fold_scores(df, annualization=365 / 7, n_walk=4)).withColumn("summary_valid_sharpe", F.lit(None).cast("double"))
    return _round(r.withColumn("decision", validation.decision()))


@query("corr_clusters")
def _q(spark, sf):
    """Correlations of the ranks of three formulas, as clusters use them."""
    df = stack(evaluate_batch(week_panel(spark, sf), {"a": "returns", "b": "volume", "c": "ts_delay(returns, 1)"}, prepare=False)[0], ["a", "b", "c"])
    return _round(validation.rank_correlations(df))


_R = f"CASE WHEN {{c}} IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY {{c}} NULLS LAST) + (count(*) OVER (PARTITION BY ts, {{c}}) - 1) / 2.0) / count({{c}}) {D} END"
ORACLES["corr_clusters"] = _sql(
    _WEEK + f", v AS (SELECT *, lag(returns) {S} AS c0 FROM p), r AS (SELECT {_R.format(c='returns')} AS a, {_R.format(c='volume')} AS b, {_R.format(c='c0')} AS c FROM v)",
    "SELECT 'a' AS a, 'b' AS b, corr(r.a, r.b) AS corr, regr_count(r.a, r.b) AS n FROM r UNION ALL SELECT 'a', 'c', corr(r.a, r.c), regr_count(r.a, r.c) FROM r UNION ALL SELECT 'b', 'c', corr(r.b, r.c), regr_count(r.b, r.c) FROM r",
    {"a": "s", "b": "s", "corr": "d", "CAST(n AS BIGINT) AS n": "n"},
)


@query("pnl_redundancy")
def _q(spark, sf):
    """Which of three formulas' returns are redundant, by order; the greedy choice is on the driver."""
    df = stack(evaluate_batch(week_panel(spark, sf), _SOME)[0], list(_SOME), "target")
    found = validation.pnl_redundancy(scoring.factor_pnl(df, ["factor"]), list(_SOME))
    return _round(spark.createDataFrame([(k, *v) for k, v in found.items()], "factor string, max_pnl_corr double, nearest string, redundant boolean"))


@query("batch_formulas")
def _q(spark, sf):
    df = Compiler().compile(week_panel(spark, sf), {"a": "ts_mean(returns, 5)", "b": "rank(ts_mean(returns, 5))", "c": "ts_std(returns, 5)"})
    return _round(stack(df, ["a", "c"]).where("value is not null").groupBy("factor").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


ORACLES["batch_formulas"] = _sql(_WEEK + f", v AS (SELECT {full('returns', 5, f'avg(returns) {W(5)}')} AS a, {full('returns', 5, f'stddev_samp(returns) {W(5)}')} AS c FROM p)", "SELECT 'a' AS factor, count(a) AS n, avg(a) AS mean FROM v UNION ALL SELECT 'c', count(c), avg(c) FROM v", {"factor": "s", "n": "n", "mean": "d"})


@query("genetic_search")
def _q(spark, sf):
    """A small search; random, so without SQL."""
    best = Search(week_panel(spark, sf).cache(), annualization=365 / 7, seed=3, pnl_every=0, validate_every=0).run(6, 2, (FLAGSHIP,))
    return _round(spark.createDataFrame([(b["expression"], b["status"], float(b["fitness"] or 0.0), float(b["complexity_score"])) for b in best], "expression string, status string, fitness double, complexity double"))
