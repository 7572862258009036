"""Candidates for validation: read from summaries or lists, selected, and reported with where they came from."""

from __future__ import annotations

import csv
import hashlib
import json
import math
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.market import successes

# What a summary must show of a robust candidate, and the figures that it has as numbers.
ROBUST = {"valid_sharpe": 1.0, "train_sharpe": 0.0, "valid_ic_ir": 0.1}
FIGURES = ("valid_sharpe", "train_sharpe", "test_sharpe", "valid_ic_ir", "test_ic_ir", "complexity_score")
REPORT = (
    "decision", "mode", "report_mode", "name", "expression", "summary_train_sharpe", "summary_valid_sharpe", "summary_test_sharpe", "summary_test_ic_ir", "summary_complexity",
    "full_sharpe", "time_pos_folds", "time_median_sharpe", "time_min_sharpe", "universe_pos_folds", "universe_median_sharpe", "universe_min_sharpe",
    "walk_pos_folds", "walk_median_sharpe", "walk_min_sharpe", "max_pnl_corr", "nearest_pnl_corr_expression", "redundant_by_pnl", "cluster",
)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The successful rows of a search's summary, figures as numbers; those that it lacks are null."""
    rows = successes(spark.read.option("header", True).csv(path))
    return rows.select("*", *[F.lit(None).cast("double").alias(c) for c in FIGURES if c not in rows.columns])


def read_list(path: str) -> list[tuple[str, str]]:
    """(name, formula) of a CSV with a column expression, or of a text file with one formula a line; lines that start with # are notes."""
    with open(path, newline="", encoding="utf-8") as f:
        if path.lower().endswith(".csv"):
            rows = [(r.get("name") or r.get("factor_name"), r.get("expression")) for r in csv.DictReader(f)]
        else:
            rows = [(None, line) for line in f if not line.strip().startswith("#")]
    return [((name or f"manual_file_{i:03d}").strip(), text.strip()) for i, (name, text) in enumerate(rows, 1) if text and text.strip()]


def given(spark: SparkSession, formulas: list[tuple[str, str]]) -> DataFrame:
    """Candidates without a summary, in their order."""
    none = [F.lit(None).cast("double").alias(c) for c in FIGURES]
    return spark.createDataFrame([(n, e) for n, e in formulas], "factor_name string, expression string").select("*", *none)


def merit(c: str) -> Column:
    """A figure as a key to sort by: what is missing or not finite is the least."""
    x = F.col(c)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), float("-inf")).otherwise(x)


def by_merit() -> list[Column]:
    """Validation Sharpe first, then that of training, then the simpler; ties by the formula."""
    simple = F.when(merit("complexity_score") > float("-inf"), -F.col("complexity_score")).otherwise(float("-inf"))
    return [merit("valid_sharpe").desc(), merit("train_sharpe").desc(), simple.desc(), F.col("expression")]


def select_candidates(rows: DataFrame, most: int, robust_complexity: float = 10.0, complexity: float = 12.0) -> DataFrame:
    """A row a formula: all robust ones that are simple enough, and of the `most` best rows those that are; column reason says which."""
    robust = F.lit(True)
    for c, least in ROBUST.items():
        robust = robust & F.coalesce((F.col(c) > least) & ~F.isnan(c), F.lit(False))
    robust = robust & F.coalesce(F.col("complexity_score") <= robust_complexity, F.lit(False))
    best = rows.orderBy(*by_merit()).limit(most).where(F.col("complexity_score") <= complexity).withColumn("reason", F.lit("best"))
    both = rows.where(robust).withColumn("reason", F.lit("robust")).unionByName(best)
    w = Window.partitionBy("expression").orderBy(F.desc("reason"), *by_merit()[:3], "factor_name")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sources(summary: str | None = None, formulas: list[str] = (), listed: str | None = None) -> list[dict]:
    """Where candidates came from, with the SHA-256 of each file or of the formulas given."""
    def digest(path: str) -> str:
        h = hashlib.sha256()
        files = sorted(os.path.join(d, x) for d, _, names in os.walk(path) for x in names) if os.path.isdir(path) else [path]
        for name in files:
            with open(name, "rb") as f:
                for block in iter(lambda: f.read(1 << 20), b""):
                    h.update(block)
        return h.hexdigest()

    out = [{"type": kind, "path": path, "sha256": digest(path)} for kind, path in (("summary_csv", summary), ("expressions_file", listed)) if path]
    if formulas:
        out.append({"type": "manual_expressions", "count": len(formulas), "sha256": hashlib.sha256("\n".join(formulas).encode()).hexdigest()})
    return out


def _number(x) -> str:
    return "nan" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.3f}"


def records(validated: list[dict], candidates: list[dict]) -> list[dict]:
    """What cross_validate() found, with each candidate's name and figures from its summary."""
    by = {c["expression"]: c for c in candidates}
    out = []
    for r in validated:
        c = by.get(r["expression"], {})
        told = {f"summary_{k}": c.get(v) for k, v in (("train_sharpe", "train_sharpe"), ("valid_sharpe", "valid_sharpe"), ("test_sharpe", "test_sharpe"), ("test_ic_ir", "test_ic_ir"), ("complexity", "complexity_score"))}
        out.append({**r, **told, "name": c.get("factor_name") or r["factor"]})
    return out


def write_report(found: list[dict], folder: str, origin: list[dict], about: dict, suffix: str = "") -> dict[str, str]:
    """Writes the records as CSV, a report as Markdown and a manifest as JSON; gives their paths. `about` says what was evaluated, on which data."""
    os.makedirs(folder, exist_ok=True)
    at = {k: os.path.join(folder, n) for k, n in (("csv", f"cross_validation_candidates{suffix}.csv"), ("report", f"cross_validation_report{suffix}.md"), ("manifest", f"cross_validation_manifest{suffix}.json"))}
    with open(at["csv"], "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, REPORT, extrasaction="ignore")
        out.writeheader()
        for r in found:
            out.writerow({c: _number(r.get(c)) if isinstance(r.get(c), float) else r.get(c) for c in REPORT})
    final = about.get("report_mode") == "final"
    lines = ["# Cross Validation Report", ""]
    lines += [f"Source: {s['type']} `{s.get('path', s.get('count'))}`, SHA-256 {s['sha256']}" for s in origin]
    lines += [f"{k}: `{v}`" for k, v in about.items()] + ["", "## Decisions", ""]
    for r in found:
        test = f" test_sh={_number(r.get('summary_test_sharpe'))}" if final else ""
        lines.append(
            f"- {r['decision']} | {r['name']} | mode={r['mode']} valid_sh={_number(r.get('summary_valid_sharpe'))}{test} | time_pos={r['time_pos_folds']} time_med={_number(r['time_median_sharpe'])} "
            f"time_min={_number(r['time_min_sharpe'])} | universe_pos={r['universe_pos_folds']} universe_min={_number(r['universe_min_sharpe'])} | pnl_corr={_number(r['max_pnl_corr'])} redundant={r['redundant_by_pnl']} | `{r['expression']}`"
        )
    lines += ["", "## High-Correlation Clusters", ""]
    clusters: dict[int, list[dict]] = {}
    for r in found:
        clusters.setdefault(r["cluster"], []).append(r)
    lines += ["- " + "; ".join(f"{r['name']} ({r['decision']})" for r in own) for own in clusters.values() if len(own) > 1]
    with open(at["report"], "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    with open(at["manifest"], "w", encoding="utf-8") as f:
        json.dump({"sources": origin, **about, "candidates": len(found)}, f, indent=1, default=str)
    return at
