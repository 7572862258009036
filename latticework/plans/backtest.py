"""Quantile long-short backtests: a row a date, then curves and one row of figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import fin
from ..operators import recursive
from ..operators.columns import ts_mean, ts_std_dev
from ..sources.market import TIMEFRAMES
from .scoring import cells, forward_compound, pearson, periods_per_year, turnover


@dataclass(frozen=True)
class Backtest:
    n_quantiles: int = 5
    long_group: int = 5
    short_group: int = 1
    leverage: float = 1.0
    k_bars: int = 1
    factor_agg: str = "ewma"
    freq: str = "1d"
    single_side_fee: float = 0.0005

    def __post_init__(self):
        q = self.n_quantiles
        if q < 2 or not 1 <= self.long_group <= q or not 1 <= self.short_group <= q or self.long_group == self.short_group:
            raise ValueError("groups must be two different ones of at least 2 quantiles")
        if self.factor_agg not in ("ewma", "mean", "std"):
            raise ValueError("factor_agg must be ewma, mean or std")

    @property
    def round_trip_fee(self) -> float:
        return 2 * self.single_side_fee


def aggregate_factor(df: DataFrame, col: str, k: int, how: str) -> DataFrame:
    """The factor over k bars: mean, sample deviation, or exponential mean with summed weights."""
    if k <= 1:
        return df
    if how == "ewma":
        return recursive.ema(df.withColumnRenamed(col, "_f"), col, "_f", k, k, adjust=True).drop("_f")
    return df.withColumn(col, ts_mean(F.col(col), k) if how == "mean" else ts_std_dev(F.col(col), k))


def sampled(df: DataFrame, k: int) -> DataFrame:
    """Every k-th date from the k-th on."""
    if k <= 1:
        return df
    dates = df.select("ts").distinct().withColumn("i", F.row_number().over(Window.orderBy("ts")))
    return df.join(F.broadcast(dates.where(F.col("i") % k == 0).select("ts")), "ts", "left_semi")


def daily(df: DataFrame, factor: str = "factor", config: Backtest = Backtest(), target: str = "target") -> DataFrame:
    """A row for each date: pnl, costs, turnover and each quantile's return; dates with too few symbols have 0 and count."""
    q = config.n_quantiles
    df = df.withColumn("funding", F.col("funding") if "funding" in df.columns else F.lit(None).cast("double"))
    prepared = forward_compound(aggregate_factor(df, factor, config.k_bars, config.factor_agg), config.k_bars, target, "_t")
    prepared = sampled(prepared, config.k_bars)
    c = cells(prepared, [], q, factor, "_t").where(F.col("n") >= q)
    long, short = F.col("bucket") == config.long_group, F.col("bucket") == config.short_group
    part = lambda x, g: F.avg(F.when(g, F.col(x)))
    d = c.groupBy("ts").agg(
        *[part("t", F.col("bucket") == i).alias(f"q{i}_pnl") for i in range(1, q + 1)],
        ((part("t", long) - part("t", short)) * config.leverage).alias("pnl"),
        part("funding", long).alias("long_funding"),
        part("funding", short).alias("short_funding"),
        F.collect_set(F.when(long, F.col("symbol"))).alias("longs"),
        F.collect_set(F.when(short, F.col("symbol"))).alias("shorts"),
    )
    w = Window.orderBy("ts")  # a row a date
    d = d.select("*", ((turnover("longs", F.lag("longs").over(w)) + turnover("shorts", F.lag("shorts").over(w))) / 2).alias("turnover"))
    at = (F.col("ts").cast("long") % 28800) == 0
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    d = prepared.select("ts").distinct().join(d, "ts", "left")
    d = d.select(
        "ts",
        zero(F.col("pnl")).alias("pnl"),
        zero(F.col("turnover") * config.round_trip_fee * config.leverage).alias("trading_cost"),
        zero(F.when(at, (F.col("long_funding") - F.col("short_funding")) * config.leverage)).alias("funding_cost"),
        "turnover",
        "long_funding",
        "short_funding",
        *[zero(F.col(f"q{i}_pnl")).alias(f"q{i}_pnl") for i in range(1, q + 1)],
    )
    return d.withColumn("pnl_net", F.col("pnl") - F.col("trading_cost") - F.col("funding_cost"))


def curve(d: DataFrame, q: int = 5) -> DataFrame:
    """date, pnl, cum_pnl, pnl_net, cum_pnl_net, costs, and each quantile's return and growth."""
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = lambda c: F.product(F.col(c) + 1).over(w)
    return d.select(
        F.col("ts").alias("date"),
        "pnl",
        grown("pnl").alias("cum_pnl"),
        "pnl_net",
        grown("pnl_net").alias("cum_pnl_net"),
        "trading_cost",
        "funding_cost",
        *[c for i in range(1, q + 1) for c in (F.col(f"q{i}_pnl"), grown(f"q{i}_pnl").alias(f"q{i}_cum"))],
    )


def ic_series(df: DataFrame, factor: str = "factor", target: str = "target") -> DataFrame:
    ok = df.select("ts", fin(F.col(factor)).alias("v"), fin(F.col(target)).alias("t")).where("v is not null and t is not null")
    return ok.groupBy("ts").agg(F.count("*").alias("n"), pearson("v", "t").alias("ic"))


def metrics(df: DataFrame, d: DataFrame, factor: str = "factor", config: Backtest = Backtest(), target: str = "target") -> DataFrame:
    """One row of 30 figures. Years have 365.25 days; annualisation has 365; the IC is of the plain factor and one bar."""
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = d
    for c in ("pnl", "pnl_net"):
        grown = grown.withColumn(f"{c}_g", F.product(F.col(c) + 1).over(w))
        grown = grown.withColumn(f"{c}_top", F.max(f"{c}_g").over(w))
    bar = TIMEFRAMES.get(config.freq, 604_800) * config.k_bars
    years = F.greatest(F.count("*") * (bar / (365.25 * 86400)), F.lit(0.01))
    scale = periods_per_year(config.freq, config.k_bars) ** 0.5

    def sharpe(c: str) -> Column:
        sd = F.stddev_samp(c)
        return F.when(sd > 1e-12, F.avg(c) / sd * scale).otherwise(0.0)

    def drop(c: str) -> Column:
        return F.min((F.col(f"{c}_g") - F.col(f"{c}_top")) / F.greatest(f"{c}_top", F.lit(1e-8)))

    def ratio(c: str) -> Column:
        up, down = F.avg(F.when(F.col(c) > 0, F.col(c))), F.abs(F.avg(F.when(F.col(c) < 0, F.col(c))))
        return F.coalesce(F.when(down > 1e-12, up / F.when(down > 1e-12, down)), F.lit(0.0))

    def figures(c: str, end: str) -> list[Column]:
        return [
            sharpe(c).alias(f"sharpe{end}"),
            (F.pow(F.product(F.col(c) + 1), F.lit(1.0) / years) - 1).alias(f"cagr{end}"),
            (F.sum(c) / years).alias(f"returns{end}"),
            F.avg((F.col(c) > 0).cast("double")).alias(f"win_rate{end}"),
            ratio(c).alias(f"profit_loss_ratio{end}"),
            (F.avg(c) * 1000).alias(f"margin{end}"),
        ]

    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = grown.agg(
        *figures("pnl", ""),
        *figures("pnl_net", "_after_cost"),
        zero(F.avg("turnover")).alias("turnover"),
        drop("pnl_net").alias("drawdown"),
        drop("pnl").alias("drawdown_before_cost"),
        drop("pnl_net").alias("drawdown_after_cost"),
        F.count("*").alias("obs_count"),
        zero(F.avg("long_funding")).alias("avg_long_funding"),
        zero(F.avg("short_funding")).alias("avg_short_funding"),
        (F.sum("funding_cost") / years).alias("funding_annual"),
    )
    m, sd = F.coalesce(F.avg("ic"), F.lit(0.0)), F.coalesce(F.stddev_samp("ic"), F.lit(0.0))
    ic = ic_series(df, factor, target).agg(m.alias("ic_mean"), sd.alias("ic_std"), (m / (sd + 1e-8)).alias("ic_ir"))
    symbols = df.agg(F.countDistinct("symbol").alias("symbols"))
    fixed = {"single_side_fee": config.single_side_fee, "round_trip_fee": config.round_trip_fee, "leverage": config.leverage, "long_group": config.long_group, "short_group": config.short_group}
    return out.crossJoin(ic).crossJoin(symbols).select("*", (F.col("returns") - F.col("returns_after_cost")).alias("annual_cost_drag"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def backtest(df: DataFrame, factor: str = "factor", config: Backtest = Backtest(), target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(curve, figures) of a long-short backtest. Fewer symbols than quantiles are an error."""
    if df.select("symbol").distinct().limit(config.n_quantiles).count() < config.n_quantiles:
        raise ValueError(f"{config.n_quantiles} quantiles need as many symbols")
    d = daily(df, factor, config, target)
    return curve(d, config.n_quantiles), metrics(df, d, factor, config, target)
