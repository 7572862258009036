"""The formula language: a parser of its own, and a compiler of batches of formulas to one plan.

Statements end at ';', `name = expr` binds a temporary, '#' starts a comment, `c ? a : b`
and `or(a, b)` are operators, names are lower-cased. Nothing is evaluated as Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import div, nn, truth
from ..operators import recursive
from ..operators.registry import ADV_WINDOWS, OPERATORS
from ..sources.panels import FIELDS

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:e[+-]?\d+)?|\.\d+)|([a-z_]\w*)|(\*\*|<=|>=|==|[-+*/<>&|~()?:,;=]))")


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    options: tuple = ()


class ParseError(ValueError):
    pass


class _Parser:
    """Precedence climbing; each level holds its operators, the loosest first."""

    LEVELS = (("|",), ("&",), ("<", ">", "<=", ">=", "=="), ("+", "-"), ("*", "/"))
    NAMES = {"|": "logical_or", "&": "and", "<": "lt", ">": "gt", "<=": "le", ">=": "ge", "==": "eq", "+": "add", "-": "sub", "*": "mul", "/": "div"}

    def __init__(self, text: str):
        text = re.sub(r"#[^\n]*", "", text).lower()
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"can't read {text[at:at + 20]!r}")
            self.tokens.append(next((k, g) for k, g in zip("nio", m.groups()) if g))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at, self.names = 0, {}

    def peek(self, k: int = 0) -> str:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)][1]

    def take(self, want: str | None = None) -> tuple[str, str]:
        t = self.tokens[self.at]
        if want is not None and t[1] != want:
            raise ParseError(f"expected {want!r}, found {t[1]!r}")
        self.at += 1
        return t

    def program(self):
        result = None
        while self.tokens[self.at][0] != "end":
            if self.peek() == ";":
                self.take()
                continue
            bind = None
            if self.tokens[self.at][0] == "i" and self.peek(1) == "=":
                bind = self.take()[1]
                self.take("=")
            result = self.choice()
            if bind:
                self.names[bind] = result
            if self.tokens[self.at][0] != "end":
                self.take(";")
        if result is None:
            raise ParseError("empty formula")
        return result

    def choice(self):
        c = self.level(0)
        if self.peek() != "?":
            return c
        self.take()
        a = self.choice()
        self.take(":")
        return Call("if_else", (c, a, self.choice()))

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.tokens[self.at][0] == "o" and self.peek() in self.LEVELS[k]:
            op = self.NAMES[self.take()[1]]
            left = Call(op, (left, self.level(k + 1)))
        return left

    def unary(self):
        if self.peek() in ("-", "+", "~"):
            op = self.take()[1]
            x = self.unary()
            if op == "+":
                return x
            return Number(-x.value) if op == "-" and isinstance(x, Number) else Call("neg" if op == "-" else "not", (x,))
        x = self.atom()
        if self.peek() == "**":
            self.take()
            return Call("power", (x, self.unary()))
        return x

    def atom(self):
        kind, t = self.take()
        if kind == "n":
            return Number(float(t))
        if t == "(":
            x = self.choice()
            self.take(")")
            return x
        if kind != "i":
            raise ParseError(f"unexpected {t!r}")
        if self.peek() != "(":
            return self.name(t)
        self.take("(")
        args, options = [], []
        while self.peek() != ")":
            if self.tokens[self.at][0] == "i" and self.peek(1) == "=":
                key = self.take()[1]
                self.take("=")
                value = self.choice()
                options.append((key, value.value if isinstance(value, Number) else {"true": True, "false": False}.get(getattr(value, "name", ""))))
            else:
                args.append(self.choice())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return self.call("logical_or" if t == "or" else t, args, options)

    def name(self, t: str):
        if t in self.names:
            return self.names[t]
        if t in FIELDS or t in ("true", "false", "target"):
            return Field(t)
        if t == "volume_weighted_price":
            return Call("mul", (Field("close"), Field("volume")))
        m = re.fullmatch(r"adv(\d+)", t)
        if m and int(m[1]) in ADV_WINDOWS:
            return self.call("adv", [Number(int(m[1]))], [])
        raise ParseError(f"unknown name {t!r}")

    def call(self, t: str, args, options):
        if t == "adv":
            return Call("ts_mean", (Call("mul", (Field("vwap"), Field("volume"))), *args))
        if t == "ts_vwap" and len(args) == 1:
            args = [Field("vwap"), Field("volume"), *args]
        if t not in OPERATORS:
            raise ParseError(f"unknown operator {t!r}")
        if len(args) < OPERATORS[t].inputs and t != "trade_when":
            raise ParseError(f"{t} takes {OPERATORS[t].inputs} inputs")
        return Call(t, tuple(args), tuple(options))


def parse(text: str):
    return _Parser(text).program()


_INNER = {"and": ("scalar", 2), "not": ("scalar", 1), "power": ("scalar", 2)}


def _kind(node) -> str:
    return "scalar" if node.name in _INNER else OPERATORS[node.name].kind


def _inputs(node) -> int:
    return _INNER[node.name][1] if node.name in _INNER else min(OPERATORS[node.name].inputs, len(node.args))


def is_boolean(node) -> bool:
    if isinstance(node, Field):
        return node.name in ("true", "false")
    return isinstance(node, Call) and (node.name in ("and", "not") or (node.name in OPERATORS and OPERATORS[node.name].boolean))


def _children(node) -> tuple:
    return node.args[: _inputs(node)] if isinstance(node, Call) else ()


def lookback(node) -> int:
    """Bars before the first that a formula looks at, along its deepest path."""
    if not isinstance(node, Call):
        return 0
    own = 0
    if _kind(node) in ("ts", "udf"):
        own = int(sum(a.value for a in node.args[_inputs(node) :] if isinstance(a, Number) and a.value > 0)) or 10
    return own + max([lookback(c) for c in _children(node)], default=0)


class Compiler:
    """Lowers formulas to columns, equal parts once.

    Parts are laid out by stages that alternate between along symbols and
    across dates; all formulas of a batch share a stage's shuffle. Within a stage, parts that feed
    others come first.
    """

    def __init__(self):
        self.place: dict = {}

    def _visit(self, node) -> tuple[int, int]:
        if not isinstance(node, Call):
            return 0, 0
        if node in self.place:
            return self.place[node]
        below = [self._visit(c) for c in _children(node)]
        stage = max([s for s, _ in below], default=0)
        kind = _kind(node)
        if (kind in ("ts", "udf") and stage % 2) or (kind == "cs" and not stage % 2):
            stage += 1
        depth = 1 + max([d for s, d in below if s == stage], default=0)
        self.place[node] = (stage, depth)
        return self.place[node]

    def compile(self, df: DataFrame, formulas: dict[str, str]) -> DataFrame:
        """df with a double column for each formula."""
        trees = {k: parse(v) if isinstance(v, str) else v for k, v in formulas.items()}
        for t in trees.values():
            self._visit(t)
        names: dict = {}

        def value(x) -> Column:
            if isinstance(x, Number):
                return F.lit(x.value)
            if isinstance(x, Field):
                return F.lit(x.name == "true") if x.name in ("true", "false") else F.col(x.name)
            return F.col(names[x])

        def number(x) -> Column:
            return value(x).cast("double") if is_boolean(x) else value(x)

        def lower(x) -> Column:
            kids, rest = x.args[: _inputs(x)], [a.value if isinstance(a, Number) else value(a) for a in x.args[_inputs(x) :]]
            if x.name == "and":
                return truth(value(kids[0]), is_boolean(kids[0])) & truth(value(kids[1]), is_boolean(kids[1]))
            if x.name == "not":
                return ~truth(value(kids[0]), is_boolean(kids[0]))
            if x.name == "power":
                return nn(F.pow(number(kids[0]), number(kids[1])))
            if x.name == "logical_or":
                return truth(value(kids[0]), is_boolean(kids[0])) | truth(value(kids[1]), is_boolean(kids[1]))
            if x.name in ("if_else", "trade_when"):
                return OPERATORS[x.name].lower(truth(value(kids[0]), is_boolean(kids[0])), *[number(k) for k in kids[1:]])
            out = OPERATORS[x.name].lower(*[number(k) for k in kids], *rest, **dict(x.options))
            return out if OPERATORS[x.name].boolean else nn(out)

        for at in sorted(set(self.place.values())):
            layer = [n for n, p in self.place.items() if p == at]
            for n in layer:
                names[n] = f"_n{len(names)}"
            plain = [n for n in layer if _kind(n) != "udf"]
            if plain:
                df = df.select("*", *[lower(n).alias(names[n]) for n in plain])
            for n in layer:
                if _kind(n) == "udf":
                    span, least = OPERATORS[n.name].lower(*[a.value for a in n.args[1:]], **dict(n.options))
                    inner = n.args[0]
                    if not isinstance(inner, Call):
                        df = df.withColumn("_in", number(inner).cast("double"))
                    df = recursive.ema(df, names[n], names.get(inner, "_in"), span, int(least)).withColumn(names[n], nn(F.col(names[n])))
                    df = df.drop("_in")
        out = df.select("*", *[number(t).cast("double").alias(k) for k, t in trees.items()])
        return out.drop(*names.values())


def evaluate(panel: DataFrame, formula: str, name: str = "factor") -> DataFrame:
    """panel with the formula's value."""
    return Compiler().compile(panel, {name: formula})


def process_factor(df: DataFrame, col: str, delay: int = 0, decay: int = 0) -> DataFrame:
    """The customary preparation of a factor: clip by MAD, z-score, delay, optional linear decay."""
    tree = Call("zscore", (Call("winsorize_mad", (Field(col), Number(3.0))),))
    if delay:
        tree = Call("ts_delay", (tree, Number(delay)))
    if decay > 1:
        tree = Call("ts_decay_linear", (tree, Number(decay)))
    return Compiler().compile(df, {"_p": tree}).drop(col).withColumnRenamed("_p", col)


def evaluate_batch(panel: DataFrame, formulas: dict[str, str], prepare: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """(panel with a column for each formula that parses, errors of the others), in one plan."""
    good, errors = {}, {}
    for k, v in formulas.items():
        try:
            tree = parse(v)
            good[k] = Call("zscore", (Call("winsorize_mad", (tree, Number(3.0))),)) if prepare else tree
        except ValueError as e:
            errors[k] = str(e)
    return (Compiler().compile(panel, good) if good else panel), errors


def stack(df: DataFrame, factors: list[str], *keep: str) -> DataFrame:
    """Long form (factor, ts, symbol, value) of several factor columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors])
    return df.select("ts", "symbol", *keep, F.explode(pairs).alias("_x")).select("_x.factor", "ts", "symbol", *keep, "_x.value")
