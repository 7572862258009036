"""Folds over time, walks forward and universes; robustness, decisions and redundancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dsl import evaluate_batch, stack
from .scoring import factor_pnl, score, segments
from .style import residualize


def time_folds(df: DataFrame, n: int = 6) -> DataFrame:
    """(ts, fold): dates in n chronological parts, larger ones first. The window is over dates."""
    return df.select("ts").distinct().withColumn("fold", F.ntile(n).over(Window.orderBy("ts")))


def walk_forward_folds(df: DataFrame, n: int = 4) -> DataFrame:
    """(ts, fold): n + 1 parts without the first."""
    return time_folds(df, n + 1).where("fold > 1").withColumn("fold", F.col("fold") - 1)


def universe_fold(symbol: str | Column, n: int = 3) -> Column:
    """md5 of the symbol, modulo n."""
    h = F.md5(F.col(symbol).cast("binary") if isinstance(symbol, str) else symbol.cast("binary"))
    step = 4294967296 % n
    out = F.lit(0).cast("long")
    for i in range(4):
        out = (out * step + F.conv(F.substring(h, i * 8 + 1, 8), 16, 10).cast("long")) % n
    return out.cast("int")


def by_folds(df: DataFrame, n_time: int = 6, n_universe: int = 3, n_walk: int = 0) -> DataFrame:
    """Each cell of a stacked frame with every (fold_type, fold) it belongs to, in one pass over the cells; the windows are over dates."""
    dates = df.select("ts").distinct()
    for name, n in (("time", n_time), ("walk", n_walk and n_walk + 1)):
        dates = dates.withColumn(f"{name}_fold", F.ntile(n).over(Window.orderBy("ts")) if n else F.lit(None).cast("int"))
    fold = lambda kind, n, ok: F.when(ok, F.struct(F.lit(kind).alias("fold_type"), n.cast("int").alias("fold")))
    found = [
        fold("full", F.lit(0), F.lit(True)),
        fold("time", F.col("time_fold"), F.col("time_fold").isNotNull()),
        fold("walk", F.col("walk_fold") - 1, F.col("walk_fold") > 1),
        fold("universe", universe_fold("symbol", n_universe) + 1 if n_universe else F.lit(0), F.lit(bool(n_universe))),
    ]
    own = df.join(F.broadcast(dates), "ts").withColumn("own", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return own.select(*df.columns, "own.fold_type", "own.fold")


def fold_scores(df: DataFrame, q: int = 5, cost: float = 0.001, annualization: float = 365.0, **folds) -> DataFrame:
    return score(by_folds(df, **folds), ["factor", "fold_type", "fold"], q, cost, annualization)


def robustness(scores: DataFrame) -> DataFrame:
    """A row a factor: positive folds, median and least Sharpe for each type of fold, and whether it passes."""
    s = F.col("sharpe_ratio")
    aggs = [F.max(F.when(F.col("fold_type") == "full", s)).alias("full_sharpe")]
    for t in ("time", "universe", "walk"):
        own = F.when(F.col("fold_type") == t, s)
        aggs += [
            F.count(own).alias(f"{t}_folds"),
            F.count(F.when((F.col("fold_type") == t) & (s > 0), 1)).alias(f"{t}_pos_folds"),
            F.percentile(own, 0.5).alias(f"{t}_median_sharpe"),
            F.min(own).alias(f"{t}_min_sharpe"),
        ]
    out = scores.groupBy("factor").agg(*aggs)
    half = lambda t: F.col(f"{t}_pos_folds") >= F.greatest(F.lit(1), F.ceil(F.col(f"{t}_folds") / 2))
    passed = half("time") & (F.col("universe_pos_folds") >= F.greatest(F.lit(1), F.col("universe_folds") - 1)) & half("walk") & (F.col("time_median_sharpe") > 0) & (F.col("walk_median_sharpe") > 0)
    return out.withColumn("pass", F.coalesce(passed, F.lit(False)))


def decision(universe_folds: int = 3) -> Column:
    """accepted_candidate, watchlist or rejected, of a robustness row with summary_valid_sharpe."""
    ok = F.col("summary_valid_sharpe").isNull() | F.isnan("summary_valid_sharpe") | (F.col("summary_valid_sharpe") >= 1)
    good = ok & (F.col("time_pos_folds") >= 5) & (F.col("universe_pos_folds") == universe_folds) & (F.col("time_median_sharpe") > 1) & (F.col("universe_min_sharpe") > 0) & (F.col("full_sharpe") >= 2)
    fair = ok & (F.col("time_pos_folds") >= 4) & (F.col("universe_pos_folds") >= max(1, universe_folds - 1)) & (F.col("time_median_sharpe") > 0)
    return F.when(good, "accepted_candidate").when(fair, "watchlist").otherwise("rejected")


def report_slice(df: DataFrame, mode: str = "validation", ratios=(0.7, 0.15, 0.15)) -> DataFrame:
    """Only the validation dates, or all in final mode."""
    if mode not in ("validation", "final"):
        raise ValueError("mode must be validation or final")
    return df if mode == "final" else segments(df, ratios).where("segment = 'valid'").drop("segment")


def correlations(stacked: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(a, b, corr, n) of all pairs of factors that share a key, over their common keys; 0 with less than three of them or without variance.

    Pairs are built key by key and summed before they are shuffled, so there is no limit on factors and no plan that grows with them.
    """
    x = stacked.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("factor", F.col(value).cast("double").alias("v")))).alias("all"))
    pair = x.select(F.posexplode("all").alias("i", "p"), "all").select("p", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("q"))
    p, q = F.col("p.v"), F.col("q.v")
    sums = pair.groupBy(F.col("p.factor").alias("a"), F.col("q.factor").alias("b")).agg(F.count("*").alias("n"), F.var_pop(p).alias("vx"), F.var_pop(q).alias("vy"), F.covar_pop(p, q).alias("c"))
    corr = F.when((F.col("n") >= 3) & (F.col("vx") > 1e-300) & (F.col("vy") > 1e-300), F.col("c") / F.sqrt(F.col("vx") * F.col("vy"))).otherwise(0.0)
    return sums.where("a <> b").select("a", "b", corr.alias("corr"), "n")


def rank_correlations(stacked: DataFrame) -> DataFrame:
    """Of the factors' ranks within each date, ties at their mean place."""
    w = Window.partitionBy("factor", "ts")
    v = F.col("value")
    place = F.rank().over(w.orderBy(v)) + (F.count("*").over(Window.partitionBy("factor", "ts", "value")) - 1) / F.lit(2.0)
    ranked = stacked.where(v.isNotNull()).withColumn("r", place / F.count("*").over(w))
    return correlations(ranked, "r", ["ts", "symbol"])


def greedy_clusters(names: list[str], corr: dict[tuple[str, str], float], threshold: float) -> list[list[str]]:
    """Each name, in order, takes all later ones that correlate with it; always itself too."""
    at = lambda a, b: abs(corr.get((a, b), corr.get((b, a), 0.0)))
    out, seen = [], set()
    for a in names:
        if a not in seen:
            own = [b for b in names if b == a or (b not in seen and at(a, b) >= threshold)]
            seen.update(own)
            out.append(own)
    return out


def correlation_clusters(stacked: DataFrame, order: list[str], threshold: float = 0.9) -> list[list[str]]:
    corr = {(r["a"], r["b"]): r["corr"] for r in rank_correlations(stacked).collect()}
    return greedy_clusters(order, corr, threshold)


def greedy_redundancy(order: list[str], corr: dict[tuple[str, str], float], threshold: float) -> dict[str, tuple[float, str, bool]]:
    """For each name in order of merit: the largest correlation with a kept one, which, and whether it is redundant."""
    kept, out = [], {}
    for a in order:
        best, near = 0.0, ""
        for b in kept:
            c = corr.get((a, b), corr.get((b, a), 0.0))
            if abs(c) > abs(best):
                best, near = c, b
        out[a] = (best, near, bool(near) and abs(best) >= threshold)
        if not out[a][2]:
            kept.append(a)
    return out


def pnl_redundancy(pnl: DataFrame, order: list[str], threshold: float = 0.85) -> dict[str, tuple[float, str, bool]]:
    """Of returns (factor, ts, pnl), always matched by ts."""
    corr = {(r["a"], r["b"]): r["corr"] for r in correlations(pnl, "pnl", ["ts"]).collect()}
    return greedy_redundancy(order, corr, threshold)


def cross_validate(panel: DataFrame, formulas: dict[str, str], q: int = 5, cost: float = 0.001, annualization: float = 365.0, n_time: int = 6, n_universe: int = 3, corr_threshold: float = 0.9, pnl_threshold: float = 0.85, valid_sharpe: dict[str, float] | None = None, second_q: int | None = None, styles: list[str] | None = None, mode: str = "final", ratios=(0.7, 0.15, 0.15)) -> list[dict]:
    """A record a formula: fold figures, decision, cluster and redundancy; one plan scores all of them on all folds.

    Formulas are evaluated on all dates; only the validation dates are scored unless mode is final. second_q: another number of quantiles, whose verdict on the
    same folds is added as nq_pass. styles: columns of the panel whose part, date by date, is taken out of each factor first.
    """
    df, errors = evaluate_batch(panel, formulas)
    names = [k for k in formulas if k not in errors]
    if not names:
        return []
    if styles:
        for n in names:
            df = df.drop(n).join(residualize(df, n, styles).withColumnRenamed("residual", n), ["ts", "symbol"], "left")
    stacked = report_slice(stack(df, names, "target"), mode, ratios).cache()
    try:
        table = robustness(fold_scores(stacked, q, cost, annualization, n_time=n_time, n_universe=n_universe, n_walk=4))
        known = panel.sparkSession.createDataFrame([(n, (valid_sharpe or {}).get(n)) for n in names], "factor string, summary_valid_sharpe double")
        rows = [r.asDict() for r in table.join(known, "factor").withColumn("decision", decision(n_universe)).collect()]
        if second_q:
            again = {r["factor"]: r["pass"] for r in robustness(fold_scores(stacked, second_q, cost, annualization, n_time=n_time, n_universe=n_universe, n_walk=4)).collect()}
            for r in rows:
                r["nq_pass"] = again.get(r["factor"], False)
        rank = {"accepted_candidate": 0, "watchlist": 1, "rejected": 2}
        rows.sort(key=lambda r: (rank[r["decision"]], -(r["time_median_sharpe"] or 0.0), r["factor"]))
        clusters = correlation_clusters(stacked, names, corr_threshold)
        where = {n: i for i, own in enumerate(clusters) for n in own}
        near = pnl_redundancy(factor_pnl(stacked, ["factor"], q, cost), [r["factor"] for r in rows], pnl_threshold)
    finally:
        stacked.unpersist()
    for r in rows:
        c, other, red = near[r["factor"]]
        r |= {"expression": formulas[r["factor"]], "mode": "specific" if styles else "raw", "report_mode": mode, "cluster": where[r["factor"]], "max_pnl_corr": c, "nearest_pnl_corr_expression": formulas.get(other, ""), "redundant_by_pnl": red}
    return rows
