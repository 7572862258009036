"""Readers and writers of market data, configuration and results."""

from __future__ import annotations

import hashlib
import json
import math
import os
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .panels import densify, with_fields

# Bar lengths that a panel may have, in seconds.
TIMEFRAMES = {"1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400}
# Symbols that a universe leaves out, as they are pegged.
STABLECOINS = ("USDT", "USDC", "BUSD", "FDUSD", "TUSD", "USDP", "DAI", "USTC", "USD1")
TIERS = (("mega", 1e10, None), ("large", 1e8, 1e10), ("mid", 1e7, 1e8), ("small", 1e6, 1e7))
# The cache's names of the tiers.
CACHE_TIERS = {"mega": "large", "large": "medium", "mid": "small", "small": "micro"}


@dataclass
class Config:
    data_dir: str = "data"
    timeframe: str = "4h"
    pairs: list[str] = field(default_factory=list)
    start: str | None = None
    end: str | None = None
    train_days: int = 0
    lookback_days: int = 0
    buffer_bars: int = 0
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    n_quantiles: int = 5
    long_group: int = 5
    short_group: int = 1
    single_side_fee: float = 0.0005
    leverage: float = 1.0
    k_bars: int = 1
    max_missing: int = 465

    def __post_init__(self):
        self.ratios = tuple(self.ratios)
        self.pairs = [normalize_pair(p) for p in self.pairs]
        if len(self.ratios) != 3 or min(self.ratios) <= 0:
            raise ValueError("ratios must be three positive numbers")
        if self.timeframe not in TIMEFRAMES:
            raise ValueError(f"unknown timeframe {self.timeframe}")


def normalize_pair(pair: str) -> str:
    return pair.replace("/", "_").replace(":", "_")


def load_config(path: str | None = None) -> Config:
    with open(path or os.environ["LATTICEWORK_CONFIG"]) as f:
        raw = json.load(f)
    listed = raw.pop("exchange", {}).get("pair_whitelist")
    return Config(**{**raw, **({"pairs": listed} if listed else {})})


def bar_length(timeframe: str) -> timedelta:
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe}")
    return timedelta(seconds=TIMEFRAMES[timeframe])


def days_to_bars(days: float, timeframe: str) -> int:
    """Bars that cover so many days; none for a negative number."""
    return math.ceil(max(days, 0) * 86400 / TIMEFRAMES[timeframe])


def data_window(start: str | None, end: str | None, timeframe: str, train_days: int = 0, lookback_days: int = 0, buffer_bars: int = 0) -> tuple[datetime | None, datetime | None]:
    """The range to load: bars for training, lookback and buffer before the start, one bar after the end."""
    bar, at = bar_length(timeframe), lambda s: datetime.fromisoformat(s).replace(tzinfo=timezone.utc) if s else None
    a, b = at(start), at(end)
    early = days_to_bars(train_days, timeframe) + days_to_bars(lookback_days, timeframe) + buffer_bars
    return (a - early * bar if a else None), (b + bar if b else None)


def read_feather(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """(ts, symbol, the columns as double) of Feather files, each read by the task that holds it. The symbol is the file's name up to its first hyphen."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.feather").load(path).select("path", "content")
    schema = "ts timestamp, symbol string, " + ", ".join(f"`{c}` double" for c in columns)

    def parse(batches):
        import pyarrow as pa
        import pyarrow.feather as pf

        stamp = pa.timestamp("us", "UTC")
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                own = pf.read_table(pa.BufferReader(content.as_buffer()))
                lacks = {"date", *columns} - set(own.column_names)
                if lacks:
                    raise ValueError(f"{file} lacks {sorted(lacks)}")
                at = own.column("date")
                at = at.cast(pa.timestamp("us")).cast(stamp) if pa.types.is_timestamp(at.type) and at.type.tz is None else at.cast(stamp)
                symbol = pa.array([os.path.basename(file).split("-")[0]] * len(own), pa.string())
                table = pa.table([at, symbol, *[own.column(c).cast(pa.float64()) for c in columns]], names=["ts", "symbol", *columns])
                yield from table.to_batches(max_chunksize=1 << 16)

    return files.mapInArrow(parse, schema)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars (ts, symbol, open, high, low, close, volume) from Parquet, CSV, JSON or a folder of Feather files, one for each symbol."""
    if fmt == "feather":
        return read_feather(spark, path, ("open", "high", "low", "close", "volume"))
    df = spark.read.option("header", True).option("inferSchema", True).format(fmt).load(path)
    if "date" in df.columns:
        df = df.withColumnRenamed("date", "ts")
    missing = {"ts", "symbol", "open", "high", "low", "close", "volume"} - set(df.columns)
    if missing:
        raise ValueError(f"bars lack {sorted(missing)}")
    return df


def read_funding(spark: SparkSession, path: str, fmt: str = "feather") -> DataFrame:
    """Funding (ts, symbol, open) from a folder of Feather files, one for each symbol, or from Parquet, CSV or JSON."""
    if fmt == "feather":
        return read_feather(spark, path, ("open",))
    df = spark.read.option("header", True).option("inferSchema", True).format(fmt).load(path)
    df = df.withColumnRenamed("date", "ts") if "date" in df.columns else df
    df = df.withColumnRenamed("funding", "open") if "open" not in df.columns and "funding" in df.columns else df
    return df.select("ts", "symbol", "open")


def align_funding(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """Funding of equal stamps, carried forward within a symbol, 0 before the first."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    joined = bars.drop("funding").join(funding.select("ts", "symbol", F.col("open").alias("funding")), ["ts", "symbol"], "left")
    return joined.withColumn("funding", F.coalesce(F.last("funding", True).over(w), F.lit(0.0)))


def filter_missing(panel: DataFrame, most: int = 465) -> DataFrame:
    """Without symbols that have over `most` fewer opens than the fullest symbol."""
    have = panel.groupBy("symbol").agg(F.count("open").alias("n"))
    kept = have.crossJoin(F.broadcast(have.agg(F.max("n").alias("top")))).where(F.col("n") >= F.col("top") - most)
    return panel.join(kept.select("symbol"), "symbol", "left_semi")


def load_panel(spark: SparkSession, path: str, config: Config, funding: DataFrame | None = None, supply: DataFrame | None = None, fmt: str = "parquet") -> DataFrame:
    """A dense panel with all fields: the padded range and one bar more are filtered at the scan, so that the last bar has a target too; that bar, and buffer bars, are then dropped."""
    a, b = data_window(config.start, config.end, config.timeframe, config.train_days, config.lookback_days, config.buffer_bars)
    bars = read_bars(spark, path, fmt)
    if config.pairs:
        bars = bars.where(F.col("symbol").isin(config.pairs))
    if a:
        bars = bars.where(F.col("ts") >= F.lit(a))
    if b:
        bars = bars.where(F.col("ts") <= F.lit(b + bar_length(config.timeframe)))
    if funding is not None:
        bars = align_funding(bars, funding)
    if supply is not None:
        bars = bars.join(supply.select("symbol", F.col("circulating_supply").alias("_s")), "symbol", "left").withColumn("cap", F.col("close") * F.col("_s")).drop("_s")
    panel = with_fields(densify(filter_missing(bars, config.max_missing)))
    if b:
        panel = panel.where(F.col("ts") <= F.lit(b))
    if config.buffer_bars:
        dates = panel.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts")))
        panel = panel.join(dates.where(F.col("n") > config.buffer_bars).select("ts"), "ts", "left_semi")
    return panel


def long_to_wide(panel: DataFrame, fields: list[str], symbols: list[str], buffer: int = 0) -> DataFrame:
    """(ts, a column `field.symbol` for each) of a panel; the first `buffer` dates are dropped. One aggregate, with the symbols given."""
    cells = [F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{f}.{s}") for f in fields for s in symbols]
    wide = panel.groupBy("ts").agg(*cells)
    if buffer:
        dates = wide.select("ts").withColumn("n", F.row_number().over(Window.orderBy("ts")))
        wide = wide.join(F.broadcast(dates.where(F.col("n") > buffer).select("ts")), "ts", "left_semi")
    return wide


def wide_to_long(wide: DataFrame) -> DataFrame:
    """(ts, symbol, a column for each field) of what long_to_wide gives."""
    names = [c for c in wide.columns if c != "ts"]
    fields, symbols = list(dict.fromkeys(c.split(".", 1)[0] for c in names)), list(dict.fromkeys(c.split(".", 1)[1] for c in names))
    rows = F.array(*[F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{f}.{s}`").alias(f) for f in fields]) for s in symbols])
    return wide.select("ts", F.explode(rows).alias("x")).select("ts", "x.*")


def write_market_caps(caps: DataFrame, path: str) -> dict:
    """Writes the cache of market_caps(), a row a listed pair, as one JSON file: rows from the largest cap, and count and symbols of each tier. Returns what it wrote."""
    rows = [r.asDict() for r in caps.orderBy(F.col("market_cap_usd").desc_nulls_last(), "symbol").collect()]
    if all(r["market_cap_usd"] is None for r in rows):
        raise ValueError("no market cap is known")
    full = lambda s: f"{s}/USDT:USDT"
    out = {"timestamp": datetime.now().isoformat(timespec="seconds"), "count": len(rows), "data": rows, "pair_list": [r.get("pair") for r in rows], "symbol_list": [full(r["symbol"]) for r in rows]}
    for name, key in CACHE_TIERS.items():
        own = [full(r["symbol"]) for r in rows if r.get("tier") == name]
        out |= {f"{key}_cap_count": len(own), f"{key}_cap_symbols": own}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, ensure_ascii=False, indent=2, default=str)
    return out


def read_market_caps(spark: SparkSession, path: str) -> DataFrame:
    """(pair, symbol, price_usd, market_cap_usd, circulating_supply) of such a file, or of a plain list of rows."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    rows = raw.get("data") if isinstance(raw, dict) else raw
    if not isinstance(rows, list):
        raise ValueError("the cache must be a list or have a list as data")
    number = lambda x: None if x is None else float(x)
    own = [(r.get("pair"), r.get("symbol"), number(r.get("price_usd")), number(r.get("market_cap_usd")), number(r.get("circulating_supply"))) for r in rows]
    return spark.createDataFrame(own, "pair string, symbol string, price_usd double, market_cap_usd double, circulating_supply double")


def market_caps(quotes: DataFrame) -> DataFrame:
    """(symbol, price_usd, market_cap_usd, circulating_supply, tier): the largest cap of each symbol; supply is cap / price."""
    w = Window.partitionBy("symbol").orderBy(F.desc("market_cap_usd"), "price_usd")
    tier = None
    for name, low, high in TIERS:
        inside = (F.col("market_cap_usd") > low) & (F.lit(True) if high is None else F.col("market_cap_usd") <= high)
        tier = F.when(inside, name) if tier is None else tier.when(inside, name)
    one = quotes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return one.withColumn("circulating_supply", F.col("market_cap_usd") / F.when(F.col("price_usd") != 0, F.col("price_usd"))).withColumn("tier", tier)


def universe(perpetual: DataFrame, spot: DataFrame, top: int) -> DataFrame:
    """The `top` perpetual symbols by quote volume that are also traded spot and are no stablecoin."""
    return perpetual.join(spot.select("symbol").distinct(), "symbol", "left_semi").where(~F.col("symbol").isin(*STABLECOINS)).orderBy(F.desc("quote_volume"), "symbol").limit(top)


def successes(summary: DataFrame) -> DataFrame:
    """Rows of status success, metrics as numbers."""
    text = {"factor_name", "expression", "status", "error"}
    return summary.where("status = 'success'").select(*[F.col(c) if c in text else F.expr(f"try_cast(`{c}` as double)").alias(c) for c in summary.columns])


def best_by_expression(rows: DataFrame, by: str = "fitness") -> DataFrame:
    w = Window.partitionBy("expression_norm").orderBy(F.col(by).desc_nulls_last(), "expression")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def write_results(rows: DataFrame, path: str, fmt: str = "csv", digits: int = 3) -> None:
    rounded = rows.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes])
    rounded.write.mode("overwrite").option("header", True).format(fmt).save(path)


def manifest(path: str, **what) -> str:
    """Writes a JSON manifest and returns its SHA-256."""
    text = json.dumps(what, indent=1, sort_keys=True, default=str)
    with open(path, "w") as f:
        f.write(text)
    return hashlib.sha256(text.encode()).hexdigest()
