"""Long panels: one row for each of all (ts, symbol), with prices, volume and derived fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume", "returns", "vwap", "market_return", "funding", "cap")

def along():
    return Window.partitionBy("symbol").orderBy("ts")

def of_date():
    return Window.partitionBy("ts")


def densify(bars: DataFrame) -> DataFrame:
    """Every ts with every symbol; missing cells are NULL. Raises if a key repeats.

    The grid has distinct dates times distinct symbols; the symbols, a dimension that was
    counted to be small, are broadcast.
    """
    keys = bars.groupBy("ts", "symbol").agg(F.count("*").alias("n")).cache()
    bad = keys.where("n > 1 or ts is null or symbol is null").limit(1).collect()
    if bad:
        raise ValueError(f"keys (ts, symbol) must be unique and not null: {bad[0]}")
    symbols = keys.select("symbol").distinct()
    small = symbols.count() <= 1_000_000
    grid = keys.select("ts").distinct().crossJoin(F.broadcast(symbols) if small else symbols)
    return grid.join(bars, ["ts", "symbol"], "left")


def with_fields(panel: DataFrame, top: int = 15) -> DataFrame:
    """Adds vwap, returns, target and market_return to a dense panel of open, high, low, close, volume, cap, funding.

    market_return weighs the `top` symbols of each date by cap; where no cap is known at all, it is the plain mean.
    """
    close = F.col("close")
    before = F.lag("close").over(along())
    for c in ("cap", "funding"):
        if c not in panel.columns:
            panel = panel.withColumn(c, F.lit(None).cast("double"))
    capped = panel.agg(F.max(F.when(F.col("cap").isNotNull(), 1)).alias("_capped"))
    df = panel.select(
        "*",
        ((F.col("high") + F.col("low") + close) / 3).alias("vwap"),
        (close / F.when(before != 0, before) - 1).alias("returns"),
        (F.lead("close").over(along()) / F.when(close != 0, close) - 1).alias("target"),
    ).crossJoin(F.broadcast(capped))
    rank = F.row_number().over(of_date().orderBy(F.col("cap").desc_nulls_last(), "symbol"))
    df = df.withColumn("_w", F.when((rank <= top) & F.col("cap").isNotNull(), F.col("cap")))
    df = df.withColumn("_t", F.sum("_w").over(of_date()))
    weighted = F.sum(F.col("returns") * F.col("_w") / F.when(F.col("_t") != 0, F.col("_t"))).over(of_date())
    mean = F.avg("returns").over(of_date())
    return df.withColumn("market_return", F.when(F.col("_capped") == 1, weighted).otherwise(mean)).drop("_w", "_t", "_capped")


def _bars(rows: DataFrame, price: str, volume, key: list[str], *more) -> DataFrame:
    order = F.struct(*key)
    return rows.groupBy("ts", "symbol").agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        volume.cast("double").alias("volume"),
        *more,
    )


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of unit prices in lineitem for ten symbols."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.date_trunc("week", "l_shipdate").alias("ts"),
        (F.col("l_suppkey") % 10).cast("string").alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_quantity", "l_discount",
    )
    key = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey"]
    bars = _bars(li, "price", F.sum("l_quantity"), key, (F.avg("l_discount") - 0.05).alias("funding"), F.count("*").alias("rows"))
    supply = bars.groupBy("symbol").agg(F.sum("rows").cast("double").alias("supply"))
    bars = bars.join(supply, "symbol").withColumn("cap", F.col("close") * F.col("supply")).drop("rows", "supply")
    return with_fields(densify(bars))


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by event type; cells are missing."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("symbol"), "value", "ts", "event_id")
    bars = _bars(ev.withColumnRenamed("ts", "at").withColumnRenamed("hour", "ts"), "value", F.count("*"), ["at", "event_id"])
    return with_fields(densify(bars))


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event values by user modulo 12."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("day", "ts").alias("day"), (F.col("user_id") % 12).cast("string").alias("symbol"), "value", "ts", "event_id")
    bars = _bars(ev.withColumnRenamed("ts", "at").withColumnRenamed("day", "ts"), "value", F.count("*"), ["at", "event_id"])
    return with_fields(densify(bars))
