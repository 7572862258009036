"""Style factors, exposures, neutral factors and exposure statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import div0, fin, nn
from ..operators import recursive
from ..operators.columns import both, of_date, full, over, ts_delay, ts_mean, ts_std_dev

STYLES = ("size", "momentum", "volatility", "beta", "liquidity", "reversal", "funding_style")


@dataclass(frozen=True)
class StyleConfig:
    momentum_window: int = 20
    volatility_window: int = 20
    beta_window: int = 60
    liquidity_window: int = 20
    reversal_window: int = 5
    funding_window: int = 3
    min_count: int = 8


def rolling_market_beta(r: Column, m: Column, w: int = 60) -> Column:
    r, m = fin(r), fin(m)
    ok = both(r, m)
    cov = full(F.when(ok, r), w, F.covar_samp(r, m).over(over(w)))
    return div0(cov, full(m, w, F.var_samp(m).over(over(w))))


def build_style_factors(panel: DataFrame, config: StyleConfig = StyleConfig()) -> DataFrame:
    """panel with a column for each style; the size is that of the close where no cap is known."""
    close, traded = F.col("close"), F.col("close") * F.col("volume")
    log = lambda x: F.log(F.when(x > 0, x))
    capped = F.max(F.when(F.col("cap").isNotNull(), 1)).over(Window.partitionBy("symbol"))
    return panel.select(
        "*",
        log(F.when(capped == 1, F.col("cap")).otherwise(close)).alias("size"),
        nn(div0(close, ts_delay(close, config.momentum_window)) - 1).alias("momentum"),
        ts_std_dev(F.col("returns"), config.volatility_window).alias("volatility"),
        rolling_market_beta(F.col("returns"), F.col("market_return"), config.beta_window).alias("beta"),
        log(ts_mean(F.when(traded > 0, traded), config.liquidity_window)).alias("liquidity"),
        nn(-(div0(close, ts_delay(close, config.reversal_window)) - 1)).alias("reversal"),
        ts_mean(F.col("funding"), config.funding_window).alias("funding_style"),
    )


def date_zscore(x: Column) -> Column:
    """Against the date's mean and population deviation; NULL stays."""
    x = fin(x)
    return div0(x - F.avg(x).over(of_date()), F.stddev_pop(x).over(of_date()))


def _regressed(df: DataFrame, factor: str, styles: list[str], min_count: int) -> DataFrame:
    z = df.select("ts", "symbol", date_zscore(F.col(factor)).alias("_y"), *[date_zscore(F.col(s)).alias(s) for s in styles])
    return recursive.date_ols(z, "_y", styles, True, min_count)


def style_exposures(df: DataFrame, factor: str, styles: list[str], min_count: int = 8) -> DataFrame:
    """A row a date: the coefficients of the standardised factor on standardised styles."""
    r = _regressed(df, factor, styles, min_count)
    return r.groupBy("ts").agg(*[F.first(nn(F.col(c))).alias(c) for c in ("intercept", *styles)])


def residualize(df: DataFrame, factor: str, styles: list[str], min_count: int = 8) -> DataFrame:
    """(ts, symbol, residual): what styles leave of the standardised factor."""
    return _regressed(df, factor, styles, min_count).select("ts", "symbol", nn(F.col("residual")).alias("residual"))


def summarize_exposures(exposures: DataFrame, styles: list[str]) -> DataFrame:
    """A row a style: mean, median, population deviation, mean size, t of the mean, observations."""
    long = exposures.select(F.explode(F.array(*[F.struct(F.lit(s).alias("style"), F.col(s).alias("x")) for s in styles])).alias("e")).select("e.*").where("x is not null")
    sd = F.stddev_samp("x")
    return long.groupBy("style").agg(
        F.avg("x").alias("mean"),
        F.percentile("x", 0.5).alias("median"),
        F.stddev_pop("x").alias("std"),
        F.avg(F.abs("x")).alias("abs_mean"),
        F.when(sd > 0, F.avg("x") / (sd / F.sqrt(F.count("x")))).alias("t_stat"),
        F.count("x").alias("obs_count"),
    )


def market_exposure(d: DataFrame, strategy: str = "strategy", market: str = "market") -> DataFrame:
    """One row: alpha, beta, r2, corr and t of beta of strategy on market returns."""
    x, y = fin(F.col(market)), fin(F.col(strategy))
    a = d.select(x.alias("x"), y.alias("y")).where("x is not null and y is not null").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c")
    )
    ok = (F.col("n") >= 3) & (F.col("vx") > 0)
    beta = F.when(ok, F.col("c") / F.when(F.col("vx") > 0, F.col("vx")))
    a = a.withColumn("beta", beta).withColumn("rest", (F.col("vy") - F.col("beta") * F.col("c")) * F.col("n"))
    se = F.sqrt(F.greatest("rest", F.lit(0.0)) / F.when(F.col("n") > 2, F.col("n") - 2) / (F.col("n") * F.when(F.col("vx") > 0, F.col("vx"))))
    return a.select(
        (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"),
        "beta",
        F.when(ok & (F.col("vy") > 0), 1 - F.col("rest") / (F.col("n") * F.when(F.col("vy") > 0, F.col("vy")))).alias("r2"),
        F.when(ok & (F.col("vy") > 0), F.col("c") / F.sqrt(F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.col("vx") * F.col("vy")))).alias("corr"),
        F.when(se > 0, F.col("beta") / F.when(se > 0, se)).alias("t_stat"),
        F.col("n").alias("obs_count"),
    )


def adf_summary(rows: DataFrame, level: float = 0.05) -> DataFrame:
    ok = rows.where("not isnan(statistic)")
    return ok.agg(F.avg("statistic").alias("mean_statistic"), F.percentile("statistic", 0.5).alias("median_statistic"), F.avg("pvalue").alias("mean_pvalue"), F.avg((F.col("pvalue") < level).cast("double")).alias("reject_ratio"), F.count("*").alias("symbols"))
