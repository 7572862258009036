"""The operators by name, and which the generator may use with which windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..functions.missing import div
from . import columns as c

#: kind: scalar, ts (along a symbol), cs (across a date), or udf (its own stage along a symbol).
@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    inputs: int
    lower: Callable | None
    boolean: bool = False


OPERATORS: dict[str, Operator] = {}


def register_operator(name: str, kind: str, inputs: int, lower: Callable | None, boolean: bool = False) -> None:
    OPERATORS[name] = Operator(name, kind, inputs, lower, boolean)


def _add(kind: str, inputs: int, names: str, lower, boolean: bool = False) -> None:
    for n in names.split():
        register_operator(n, kind, inputs, lower, boolean)


for _n in ("ts_sum ts_median ts_quantile ts_pctchange ts_rank ts_percentile ts_min ts_max ts_skewness ts_kurtosis ts_zscore ts_volatility ts_pos ts_drawdown ts_slope").split():
    _add("ts", 1, _n, getattr(c, _n))
_add("ts", 1, "ts_mean sma", c.ts_mean)
_add("ts", 1, "ts_std_dev ts_std", c.ts_std_dev)
_add("ts", 1, "ts_product product rolling_prod", c.ts_product)
_add("ts", 1, "ts_delta delta", c.ts_delta)
_add("ts", 1, "ts_delay delay", c.ts_delay)
_add("ts", 1, "ts_arg_max ts_argmax", c.ts_arg_max)
_add("ts", 1, "ts_arg_min ts_argmin", c.ts_arg_min)
_add("ts", 1, "ts_decay_linear decay_linear", c.ts_decay_linear)
_add("udf", 1, "ts_ema", lambda w=10: (w, w))
_add("udf", 1, "ts_ewma", lambda w=10: (w, 0))
_add("ts", 2, "ts_corr correlation", c.ts_corr)
_add("ts", 2, "ts_covariance ts_cov", c.ts_covariance)
_add("ts", 2, "ts_vwap", c.ts_vwap)
_add("ts", 3, "atr_sma", c.atr_sma)
for _n in ("ts_beta", "ts_alpha", "ts_resid", "ts_r2"):
    _add("ts", 2, _n, getattr(c, _n))
for _n in ("rank", "scale", "zscore", "winsorize", "winsorize_mad", "winsorize_group"):
    _add("cs", 1, _n, getattr(c, _n))
_add("cs", 2, "neutralize", c.neutralize)
for _n in ("add", "sub", "mul"):
    _add("scalar", 2, _n, getattr(c, _n))
_add("scalar", 2, "div", div)
_add("scalar", 1, "neg", c.neg)
for _n in ("lt", "gt", "eq", "le", "ge"):
    _add("scalar", 2, _n, c.compare(_n), True)
_add("scalar", 2, "logical_or", c.logical_or, True)
_add("scalar", 3, "if_else", c.if_else)
_add("scalar", 3, "trade_when", c.trade_when)
_add("scalar", 1, "log", c.log)
_add("scalar", 1, "sqrt", c.sqrt)
_add("scalar", 1, "abs", c.F.abs)
_add("scalar", 1, "sign", c.F.signum)
_add("scalar", 1, "exp", c.F.exp)
_add("scalar", 2, "max", c.maximum)
_add("scalar", 2, "min", c.minimum)
_add("scalar", 1, "signed_power", c.signed_power)


@dataclass(frozen=True)
class Spec:
    name: str
    category: str
    windows: tuple[int, ...] = ()


# The windows that generated formulas use.
_WINDOWS = (
    ("time_series", (3, 12, 20, 30, 60), "ts_mean"),
    ("time_series", (3, 5, 7, 10, 14, 20, 30), "ts_rank ts_min ts_max ts_percentile"),
    ("time_series", (7, 14, 21, 28, 54), "ts_std ts_std_dev"),
    ("time_series", (7, 14, 21, 28), "ts_argmax ts_arg_max ts_argmin ts_arg_min decay_linear ts_decay_linear ts_drawdown ts_pos ts_volatility ts_zscore"),
    ("time_series", (5, 10, 20, 30, 60), "ts_sum"),
    ("time_series", (5, 10, 20), "product ts_product"),
    ("time_series", (10, 20, 30, 60), "ts_skewness ts_kurtosis"),
    ("time_series", (6, 12, 24, 48), "ts_ema ts_slope"),
    ("time_series_dual", (7, 14, 21, 28), "ts_alpha ts_r2 ts_beta"),
    ("time_series_dual", (5, 10, 20, 30, 60), "ts_corr ts_cov ts_covariance"),
    ("time_series_dual", (6, 12, 24, 48), "ts_resid"),
    ("lag", (1, 3, 5, 7, 10, 14, 20), "delay ts_delay"),
    ("lag", (1, 3, 5, 7, 10), "delta ts_delta"),
    ("cross_section", (), "rank scale zscore winsorize"),
)
SPECS = {n: Spec(n, k, w) for k, w, names in _WINDOWS for n in names.split()}
ADV_WINDOWS = (3, 5, 6, 7, 8, 10, 12, 14, 15, 20, 21, 24, 28, 30, 40, 48, 54, 60)


def names_by_category(category: str) -> list[str]:
    return [s.name for s in SPECS.values() if s.category == category]


def windows_by_category(category: str) -> dict[str, tuple[int, ...]]:
    return {s.name: s.windows for s in SPECS.values() if s.category == category}
