"""Genetic search for formulas: the loop is on the driver, each generation is scored in one job."""

from __future__ import annotations

import csv
import json
import math
import os
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.registry import SPECS, names_by_category, windows_by_category
from ..sources.panels import FIELDS
from .dsl import Call, Field, Number, ParseError, evaluate_batch, parse, stack
from .scoring import factor_pnl, score_search, segments
from .validation import fold_scores, pnl_redundancy, robustness

# The generator's shape.
BINARY, UNARY, MAX_DEPTH, MAX_OPERATORS = ("add", "sub", "mul", "div"), ("log", "neg", "abs", "sqrt", "sign"), 4, 8
WEIGHTS = {"ts": 0.30, "simple": 0.17, "dual": 0.17, "cross": 0.15, "binary": 0.15, "lag": 0.03, "unary": 0.03}
NESTED = ("ts_mean", "ts_rank", "rank", "scale", "abs", "ts_std_dev", "ts_corr", "ts_covariance")
_SIGN = {"add": "+", "sub": "-", "mul": "*", "div": "/"}


def to_text(node) -> str:
    if isinstance(node, Number):
        return f"{node.value:g}"
    if isinstance(node, Field):
        return node.name
    if node.name in _SIGN:
        return f"({to_text(node.args[0])} {_SIGN[node.name]} {to_text(node.args[1])})"
    if node.name == "neg":
        return f"-{to_text(node.args[0])}"
    return f"{node.name}({', '.join(map(to_text, node.args))})"


def walk(node):
    yield node
    if isinstance(node, Call):
        for a in node.args:
            yield from walk(a)


def replaced(node, old, new):
    """node with the part that is `old` (by identity) exchanged."""
    if node is old:
        return new
    if isinstance(node, Call):
        return Call(node.name, tuple(replaced(a, old, new) for a in node.args), node.options)
    return node


def simplified(node):
    """Without double negation, and without 0 and 1 where they change nothing; for generated formulas only."""
    if not isinstance(node, Call):
        return node
    a = [simplified(x) for x in node.args]
    is_ = lambda x, v: isinstance(x, Number) and x.value == v
    if node.name == "neg" and isinstance(a[0], Call) and a[0].name == "neg":
        return a[0].args[0]
    if node.name == "abs" and isinstance(a[0], Call) and a[0].name == "abs":
        return a[0]
    if node.name in ("add", "sub") and is_(a[1], 0):
        return a[0]
    if node.name == "add" and is_(a[0], 0):
        return a[1]
    if node.name in ("mul", "div") and is_(a[1], 1):
        return a[0]
    if node.name == "mul" and is_(a[0], 1):
        return a[1]
    if (node.name == "mul" and (is_(a[0], 0) or is_(a[1], 0))) or (node.name == "div" and is_(a[0], 0)):
        return Number(0.0)
    return Call(node.name, tuple(a), node.options)


def normalized(text: str) -> str:
    """One spelling for equal formulas; windows are whole positive numbers, inputs that are constants become the first field."""

    def clean(n):
        if not isinstance(n, Call):
            return n
        args = [clean(a) for a in n.args]
        if n.name in SPECS:
            dual = 2 if SPECS[n.name].category == "time_series_dual" else 1
            args = [Field(FIELDS[0]) if i < dual and isinstance(a, Number) else Number(float(max(1, abs(int(a.value))))) if isinstance(a, Number) else a for i, a in enumerate(args)]
        return Call(n.name, tuple(args), n.options)

    return to_text(simplified(clean(parse(text))))


def complexity(text: str) -> dict:
    tree = parse(text)
    kinds = {"ts_operators": "time_series", "ts_dual_operators": "time_series_dual", "cross_operators": "cross_section", "delay_delta_operators": "lag"}
    calls = [n for n in walk(tree) if isinstance(n, Call)]
    out = {k: sum(n.name in SPECS and SPECS[n.name].category == c for n in calls) for k, c in kinds.items()}
    out["unary_operators"], out["binary_operators"] = sum(n.name in UNARY for n in calls), sum(n.name in BINARY for n in calls)

    def depth(n):
        return 1 + max(map(depth, n.args), default=0) if isinstance(n, Call) else 1

    total, deep = sum(out.values()), depth(tree)
    return out | {"total_operators": total, "max_depth": deep, "expression_length": len(text), "complexity_score": total + 0.5 * deep + 0.01 * len(text)}


def semantically_valid(text: str) -> tuple[bool, str]:
    try:
        tree = parse(text)
    except ParseError as e:
        return False, str(e)
    if isinstance(tree, (Field, Number)):
        return False, "a single field is too simple"
    for n in walk(tree):
        if isinstance(n, Call):
            if n.name in NESTED and any(isinstance(a, Call) and a.name == n.name for a in n.args[:1]):
                return False, f"{n.name} within itself"
            if n.name in BINARY and any(isinstance(x, Call) and x.name in ("ts_arg_max", "ts_arg_min") for x in walk(n.args[0])) and any(isinstance(x, Call) and x.name == "ts_mean" for x in walk(n.args[1])):
                return False, "place of an extreme with a mean"
    if not any(isinstance(n, Call) and n.name in SPECS for n in walk(tree)):
        return False, "no operator"
    return True, ""


class Generator:
    """Random formulas, mutations and crossovers from a seed of its own."""

    def __init__(self, seed: int = 0, exclude: tuple[str, ...] = ()):
        self.rng = random.Random(seed)
        self.fields = [f for f in FIELDS if f not in exclude]

    def _windowed(self, category: str, inputs):
        w = windows_by_category(category)
        name = self.rng.choice(sorted(w))
        return Call(name, (*inputs, Number(float(self.rng.choice(w[name])))))

    def tree(self, depth: int = 0):
        field = lambda: Field(self.rng.choice(self.fields))
        kind = self.rng.choices(list(WEIGHTS), list(WEIGHTS.values()))[0] if depth < MAX_DEPTH else "simple"
        if kind == "ts":
            return self._windowed("time_series", (self.tree(depth + 1),))
        if kind == "dual":
            return self._windowed("time_series_dual", tuple(map(Field, self.rng.sample(self.fields, 2))))
        if kind == "cross":
            return Call(self.rng.choice(names_by_category("cross_section")), (self.tree(depth + 1),))
        if kind == "lag":
            return self._windowed("lag", (self.tree(depth + 1),))
        if kind == "binary":
            return Call(self.rng.choice(BINARY), (self.tree(depth + 1), self.tree(depth + 1)))
        if kind == "unary":
            return Call(self.rng.choice(UNARY), (self.tree(depth + 1),))
        return field()

    def new(self, tries: int = 200) -> str:
        for _ in range(tries):
            text = normalized(to_text(self.tree()))
            if semantically_valid(text)[0] and complexity(text)["total_operators"] <= MAX_OPERATORS:
                return text
        return f"ts_mean({self.rng.choice(self.fields)}, 20)"

    def mutate(self, text: str) -> str:
        """A new window (30 %), another operator of the same sort (30 %), or one more layer."""
        tree, r = parse(text), self.rng.random()
        spots = [n for n in walk(tree) if isinstance(n, Call) and n.name in SPECS and SPECS[n.name].windows]
        if r < 0.3 and spots:
            n = self.rng.choice(spots)
            tree = replaced(tree, n, Call(n.name, (*n.args[:-1], Number(float(self.rng.choice(SPECS[n.name].windows))))))
        elif r < 0.6 and spots:
            n = self.rng.choice(spots)
            name = self.rng.choice(names_by_category(SPECS[n.name].category))
            tree = replaced(tree, n, Call(name, (*n.args[:-1], Number(float(self.rng.choice(SPECS[name].windows))))))
        else:
            tree = Call(self.rng.choice(names_by_category("cross_section")), (tree,)) if self.rng.random() < 0.5 else self._windowed("time_series", (tree,))
        return self._accept(tree, text)

    def crossover(self, a: str, b: str) -> str:
        x, y = parse(a), parse(b)
        parts = lambda t: [n for n in walk(t) if not isinstance(n, Number)]
        for _ in range(8):
            out = replaced(x, self.rng.choice(parts(x)), self.rng.choice(parts(y)))
            text = normalized(to_text(out))
            if text not in (a, b) and semantically_valid(text)[0] and complexity(text)["total_operators"] <= MAX_OPERATORS:
                return text
        return self._accept(Call(self.rng.choice(BINARY), (x, y)), a)

    def _accept(self, tree, other: str) -> str:
        text = normalized(to_text(tree))
        return text if semantically_valid(text)[0] and complexity(text)["total_operators"] <= MAX_OPERATORS else other


@dataclass
class Search:
    """A search over a panel; evaluates what it hasn't seen, a generation at a time. Test dates are never looked at."""

    panel: DataFrame
    q: int = 5
    cost: float = 0.001
    annualization: float = 365.0
    seed: int = 0
    max_complexity: float = 36.0
    complexity_penalty: float = 0.0
    gap_penalty: float = 0.0
    failure_penalty: float = 0.0
    diversity_penalty: float = 0.0
    min_valid_sharpe: float | None = None
    min_valid_ic_ir: float | None = None
    pnl_threshold: float = 0.85
    pnl_penalty: float = 999.0
    pnl_every: int = 1
    validate_every: int = 5
    cv_penalty: float = 0.5
    second_q: int | None = None
    folder: str | None = None
    exclude: tuple[str, ...] = ()
    cache: dict = field(default_factory=dict)
    pnl: dict = field(default_factory=dict)

    def __post_init__(self):
        self.generator = Generator(self.seed, self.exclude)

    def evaluate(self, texts: list[str]) -> dict[str, dict]:
        """Figures of each formula, cached by its normal spelling."""
        todo = {}
        for t in texts:
            if t in self.cache:
                continue
            ok, why = semantically_valid(t)
            score = complexity(t)["complexity_score"] if ok else 0.0
            if not ok or score > self.max_complexity:
                self.cache[t] = {"expression": t, "status": "invalid", "error": why or "too complex", "fitness": -999.0, "complexity_score": score}
            else:
                todo[f"f{len(todo)}"] = t
        if todo:
            df, errors = evaluate_batch(self.panel, todo)
            names = [k for k in todo if k not in errors]
            rows = {r["factor"]: r.asDict() for r in score_search(stack(df, names, "target"), self.q, self.cost, self.annualization).collect()} if names else {}
            for k, t in todo.items():
                r = rows.get(k, {"status": "failed", "fitness": -999.0})
                self.cache[t] = {**r, "expression": t, "complexity_score": complexity(t)["complexity_score"]}
        return {t: self.cache[t] for t in texts}

    def selection_fitness(self, m: dict) -> float:
        raw = m.get("fitness", -999.0)
        raw = -999.0 if raw is None else raw
        if m.get("status") != "success":
            return raw
        valid, train, ir = m.get("valid_sharpe") or 0.0, m.get("train_sharpe") or 0.0, m.get("valid_ic_ir") or 0.0
        low = (self.min_valid_sharpe is not None and valid < self.min_valid_sharpe) or (self.min_valid_ic_ir is not None and ir < self.min_valid_ic_ir)
        return raw - self.complexity_penalty * m.get("complexity_score", 0.0) - self.gap_penalty * max(0.0, train - valid) - self.failure_penalty * low

    def visible_pnl(self, texts: list[str]) -> DataFrame:
        """Returns (factor, ts, pnl) of formulas on train and validation dates."""
        df, errors = evaluate_batch(self.panel, {t: t for t in texts})
        stacked = segments(stack(df, [t for t in texts if t not in errors], "target")).where("segment <> 'test'")
        return factor_pnl(stacked, ["factor"], self.q, self.cost)

    def validate(self, texts: list[str], n_time: int = 4, n_universe: int = 3) -> dict[str, dict]:
        """Robustness of formulas on validation dates; with second_q also with that number of quantiles, as nq_ figures, and pass asks for both."""
        df, errors = evaluate_batch(self.panel, {t: t for t in texts})
        stacked = segments(stack(df, [t for t in texts if t not in errors], "target")).where("segment = 'valid'").drop("segment")
        told = lambda q: {r["factor"]: r.asDict() for r in robustness(fold_scores(stacked, q, self.cost, self.annualization, n_time=n_time, n_universe=n_universe, n_walk=4)).collect()}
        out = told(self.q)
        if self.second_q:
            for t, r in told(self.second_q).items():
                out[t] |= {f"nq_{k}": v for k, v in r.items() if k != "factor"}
                out[t]["pass"] = out[t]["pass"] and r["pass"]
        return out

    def run(self, population: int = 30, generations: int = 5, seeds: tuple[str, ...] = ()) -> list[dict]:
        """Best formulas, the best first. Elites of 20 % stay, parents win tournaments of 3."""
        g = self.generator
        texts = list(dict.fromkeys(normalized(s) for s in seeds))[:population]
        while len(texts) < population:
            texts.append(g.new())
        failed: dict[str, bool] = {}
        for generation in range(generations):
            found = self.evaluate(texts)
            base = {t: self.selection_fitness(m) - self.cv_penalty * failed.get(t, False) for t, m in found.items()}
            family = {t: "(".join(t.split("(")[:2]) for t in base}
            fit = {t: f - self.diversity_penalty * (sum(x == family[t] for x in family.values()) - 1) for t, f in base.items()}
            order = sorted(fit, key=lambda t: (-fit[t], t))
            good = [t for t in order if found[t].get("status") == "success"]
            if self.pnl_every and generation % self.pnl_every == 0 and len(good) > 1:
                for t, (_, _, redundant) in pnl_redundancy(self.visible_pnl(good), good, self.pnl_threshold).items():
                    fit[t] -= self.pnl_penalty * redundant
                order.sort(key=lambda t: (-fit[t], t))
            elite = order[: max(1, population // 5)]
            if self.validate_every and (generation + 1) % self.validate_every == 0:
                failed.update({t: not r["pass"] for t, r in self.validate(elite).items()})
            if generation == generations - 1:
                break
            self._save(generation, [self.cache[t] | {"selection_fitness": fit[t]} for t in order])
            pick = lambda: min(g.rng.sample(order, min(3, len(order))), key=order.index)
            texts = list(elite)
            for _ in range(50 * population):
                if len(texts) >= population:
                    break
                r = g.rng.random()
                t = g.crossover(pick(), pick()) if r < 0.5 else g.mutate(pick()) if r < 0.8 else g.new()
                if t not in texts:
                    texts.append(t)
        found = [self.cache[t] | {"selection_fitness": fit[t]} for t in order]
        self._save(generations - 1, found)
        self._finish(population, generations, seeds)
        return found

    def _save(self, generation: int, rows: list[dict]) -> None:
        """A generation's rows as CSV and JSON, if there is a folder for them."""
        if self.folder:
            write_rows(rows, os.path.join(self.folder, f"generation_{generation:03d}"))

    def _finish(self, population: int, generations: int, seeds: tuple[str, ...]) -> None:
        """The manifest, and a summary: the best row of each normal spelling, by its fitness."""
        if not self.folder:
            return
        kept = {k: v for k, v in vars(self).items() if isinstance(v, (int, float, str, tuple, type(None)))}
        with open(os.path.join(self.folder, "manifest.json"), "w", encoding="utf-8") as f:
            json.dump({**kept, "population": population, "generations": generations, "seeds": list(seeds), "evaluated": len(self.cache)}, f, indent=1, default=str)
        good = [m | {"selection_fitness": self.selection_fitness(m), "expression_norm": normalized(m["expression"])} for m in self.cache.values() if m.get("status") == "success"]
        good.sort(key=lambda m: (-m["selection_fitness"], m["expression"]))
        write_rows(list({m["expression_norm"]: m for m in reversed(good)}.values())[::-1], os.path.join(self.folder, "summary"))


# The columns that stand first in a search's files.
FRONT = ("factor", "expression", "status", "fitness", "valid_fitness", "valid_sharpe", "valid_returns", "selection_fitness", "train_fitness", "train_sharpe", "train_returns")


def write_rows(rows: list[dict], path: str, digits: int = 3) -> None:
    """Rows as path.csv and path.json, numbers rounded; nothing for no rows."""
    if not rows:
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = [{k: round(v, digits) if isinstance(v, float) and math.isfinite(v) else v for k, v in r.items()} for r in rows]
    every = list(dict.fromkeys(k for r in own for k in r))
    columns = [c for c in FRONT if c in every] + [c for c in every if c not in FRONT]
    with open(f"{path}.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, columns)
        out.writeheader()
        out.writerows(own)
    with open(f"{path}.json", "w", encoding="utf-8") as f:
        json.dump(own, f, indent=1, default=str)
