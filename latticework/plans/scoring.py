"""Scores of factors against forward returns: cells, then dates, then one row a factor and segment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import fin
from ..sources.market import TIMEFRAMES


def along():
    return Window.partitionBy("symbol").orderBy("ts")


def periods_per_year(freq: str = "1d", periods: int = 1) -> float:
    if freq not in TIMEFRAMES and freq != "1w":
        raise ValueError(f"unknown bar length {freq}")
    return 365 * 86400 / (TIMEFRAMES.get(freq, 604_800) * max(periods, 1))


def forward_returns(df: DataFrame, periods: int = 1, name: str = "target") -> DataFrame:
    c = F.col("close")
    return df.withColumn(name, F.lead("close", periods).over(along()) / F.when(c != 0, c) - 1)


def forward_compound(df: DataFrame, k: int, col: str = "target", name: str = "forward") -> DataFrame:
    """The product of 1 + return over this and the next k - 1 bars, less 1; NULL near the end."""
    w = along().rowsBetween(0, k - 1)
    return df.withColumn(name, F.when(F.count(col).over(w) == k, F.product(F.col(col) + 1).over(w) - 1))


def cells(df: DataFrame, keys: list[str], q: int, value: str = "value", target: str = "target") -> DataFrame:
    """Cells with a value and a target, on dates that have q of them, with their place and group."""
    w = Window.partitionBy(*keys, "ts")
    ok = df.select(*keys, "ts", "symbol", fin(F.col(value)).alias("v"), fin(F.col(target)).alias("t"), *[c for c in ("funding",) if c in df.columns]).where("v is not null and t is not null")
    order = w.orderBy("v", "symbol")
    return ok.select("*", F.count("*").over(w).alias("n"), F.row_number().over(order).alias("place"), F.ntile(q).over(order).alias("bucket"))


def pearson(x: str, y: str, least: int = 3) -> Column:
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((F.count("*") >= least) & (vx > 1e-300) & (vy > 1e-300), F.covar_pop(x, y) / F.sqrt(vx * vy))


def turnover(cur, prev) -> Column:
    """Share of a set that the one before lacks."""
    return F.size(F.array_except(cur, prev)) / F.greatest(F.size(cur), F.lit(1))


def by_date(c: DataFrame, keys: list[str], q: int) -> DataFrame:
    """A row a date: n, ic, and on dates of q cells or more the long-short return and turnover against the valid date before.

    Groups are ntiles in order of value and then symbol; the last is long, the first short.
    """
    long, short = F.col("bucket") == q, F.col("bucket") == 1
    d = c.groupBy(*keys, "ts").agg(
        F.count("*").alias("n"),
        pearson("v", "t").alias("ic"),
        (F.avg(F.when(long, F.col("t"))) - F.avg(F.when(short, F.col("t")))).alias("gross"),
        F.collect_set(F.when(long, F.col("symbol"))).alias("longs"),
        F.collect_set(F.when(short, F.col("symbol"))).alias("shorts"),
    )
    w = Window.partitionBy(*keys, "valid").orderBy("ts")
    d = d.withColumn("valid", F.col("n") >= q).select("*", F.lag("longs").over(w).alias("pl"), F.lag("shorts").over(w).alias("ps"))
    change = (turnover("longs", "pl") + turnover("shorts", "ps")) / 2
    return d.select(*keys, "ts", "n", "ic", "valid", F.when(F.col("valid"), F.col("gross")).alias("gross"), F.when(F.col("valid"), F.coalesce(change, F.lit(0.0))).alias("turnover"))


def _ratio(mean: Column, sd: Column, scale: float) -> Column:
    return F.when(sd > 1e-12, mean / sd * scale).otherwise(0.0)


def summarize(d: DataFrame, keys: list[str], cost: float, annualization: float, nans: DataFrame | None = None) -> DataFrame:
    """One row for each key: the score's figures, from dates."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    net = F.col("gross") - F.col("turnover") * cost
    d = d.withColumn("net", net)
    d = d.withColumn("equity", F.lit(1.0) + F.sum(F.coalesce("net", F.lit(0.0))).over(w))
    d = d.withColumn("top", F.max(F.when(F.col("valid"), F.col("equity"))).over(w))
    scale = math.sqrt(annualization)
    m, sd = F.coalesce(F.avg("ic"), F.lit(0.0)), F.coalesce(F.stddev_samp("ic"), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = d.groupBy(*keys).agg(
        zero(F.sum("gross")).alias("returns_before_cost"),
        zero(F.sum("net")).alias("returns_after_cost"),
        _ratio(F.avg("gross"), F.stddev_samp("gross"), scale).alias("sharpe_before_cost"),
        _ratio(F.avg("net"), F.stddev_samp("net"), scale).alias("sharpe_after_cost"),
        m.alias("ic_mean"),
        sd.alias("ic_std"),
        (m / (sd + 1e-8)).alias("ic_ir"),
        zero(F.min(F.when(F.col("valid") & (F.col("top") != 0), F.col("equity") / F.when(F.col("top") != 0, F.col("top")) - 1))).alias("drawdown"),
        zero(F.avg("turnover")).alias("turnover"),
        zero(F.avg(F.when(F.col("valid"), (F.col("net") > 0).cast("double")))).alias("win_rate"),
        F.sum(F.col("valid").cast("long")).alias("obs_count"),
    )
    out = out.select(
        "*",
        F.col("returns_after_cost").alias("returns"),
        F.col("sharpe_after_cost").alias("sharpe_ratio"),
        F.lit(float(cost)).alias("transaction_cost"),
        F.when(F.col("returns_after_cost") > 0, F.col("sharpe_after_cost") * F.sqrt(F.greatest("returns_after_cost", F.lit(0.0)) / F.greatest("turnover", F.lit(0.15)))).otherwise(0.0).alias("fitness"),
    )
    if nans is not None:
        out = out.join(nans, keys) if keys else out.crossJoin(nans)
    return out


def missing_share(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(value).isNull().cast("double")).alias("nan_ratio"))


def score(df: DataFrame, keys: list[str], q: int = 5, cost: float = 0.001, annualization: float = 365.0, value: str = "value", target: str = "target") -> DataFrame:
    """The 16 figures of each key of a stacked frame."""
    return summarize(by_date(cells(df, keys, q, value, target), keys, q), keys, cost, annualization, missing_share(df, keys, value))


def segments(df: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """df with segment train, valid or test, by each date's number among all dates. The window is over dates, not cells."""
    dates = df.select("ts").distinct()
    n = F.count("*").over(Window.partitionBy())
    total = sum(ratios)
    if total <= 0 or min(ratios) < 0:
        raise ValueError("ratios must not be negative and sum to over 0")
    a, b = ratios[0] / total, ratios[1] / total
    t = F.least(F.greatest(F.floor(n * a), F.lit(1)), F.greatest(n - 2, F.lit(1)))
    v = F.floor(n * a) + F.floor(n * b)
    v = F.least(F.greatest(v, t + 1), F.greatest(n - 1, t + 1))
    i = F.row_number().over(Window.orderBy("ts")) - 1
    return df.join(F.broadcast(dates.withColumn("segment", F.when(i < t, "train").when(i < v, "valid").otherwise("test"))), "ts")


def score_search(df: DataFrame, q: int = 5, cost: float = 0.001, annualization: float = 365.0, ratios=(0.7, 0.15, 0.15), min_obs: int = 5, final: bool = False) -> DataFrame:
    """A row for each factor of (factor, ts, symbol, value, target): train and valid figures (test in final mode only), and the fitness from both.

    robust is the lower of the two fitnesses, stability the ratio of the smaller to the larger in size.
    """
    shown = ("train", "valid", "test") if final else ("train", "valid")
    s = score(segments(df, ratios).where(F.col("segment").isin(*shown)), ["factor", "segment"], q, cost, annualization)
    figures = ["fitness", "returns", "sharpe_ratio", "ic_ir", "ic_mean", "ic_std", "drawdown", "turnover", "win_rate", "obs_count"]
    wide = s.groupBy("factor").agg(*[F.max(F.when(F.col("segment") == g, F.col(c))).alias(f"{g}_{c.replace('_ratio', '')}") for g in shown for c in figures])
    t, v = F.col("train_fitness"), F.col("valid_fitness")
    high = F.greatest(F.abs(t), F.abs(v))
    robust, stable = F.least(t, v), F.when(high > 0, F.least(F.abs(t), F.abs(v)) / F.when(high > 0, high)).otherwise(0.0)
    enough = (F.col("train_obs_count") >= min_obs) & (F.col("valid_obs_count") >= min_obs)
    return wide.select("*", robust.alias("robust"), stable.alias("stability"), (robust * stable).alias("fitness"), F.when(enough, "success").otherwise("failed").alias("status"))


def factor_pnl(df: DataFrame, keys: list[str], q: int = 5, cost: float = 0.001, value: str = "value", target: str = "target") -> DataFrame:
    """Net return of each key and date; NULL on dates without q cells."""
    d = by_date(cells(df, keys, q, value, target), keys, q)
    all_dates = df.select(*keys, "ts").distinct()
    return all_dates.join(d, [*keys, "ts"], "left").select(*keys, "ts", (F.col("gross") - F.col("turnover") * cost).alias("pnl"))


def factor_view(df: DataFrame, value: str = "factor") -> DataFrame:
    """Rank from the largest and number of values at each date, for the research view."""
    w = Window.partitionBy("ts")
    return df.where(F.col(value).isNotNull()).select("ts", "symbol", F.col(value).alias("value"), F.rank().over(w.orderBy(F.desc(value))).alias("rank"), F.count("*").over(w).alias("total"))


def latest_view(df: DataFrame, value: str = "factor") -> DataFrame:
    v = factor_view(df, value)
    return v.join(F.broadcast(v.agg(F.max("ts").alias("ts"))), "ts", "left_semi")
