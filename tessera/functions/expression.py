"""The factor language: parsing, checks and compilation to window plans.

Expressions are metadata and live on the driver.  Compilation numbers equal
subtrees once, over all expressions asked for, and adds their columns level by
level: all trailing windows of a level in one projection, then all
cross-sections, so adjacent windows share an exchange.

Missing values are NULL.  A window of w bars is w places of the panel's
calendar, not w rows, and is NULL unless all are there.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields and the functions (arguments) of the language.
FIELDS = ("open", "high", "low", "close", "volume", "amount", "return", "industry", "net_mf_amount")
TRAILING = {"TS_MEAN": 2, "TS_STD": 2, "TS_MIN": 2, "TS_MAX": 2, "TS_SUM": 2, "TS_PCTCHANGE": 2, "DELAY": 2, "DELTA": 2}
ACROSS = {"RANK": 1, "INDUSTRY_NEUTRALIZE": 2}
SCALAR = {"LOG": 1, "ABS": 1, "SIGN": 1}
ARITY = TRAILING | ACROSS | SCALAR
LISTED = (*ARITY, "COUNT")  # COUNT is listed but cannot be evaluated
MAX_LENGTH, MAX_WINDOW = 4096, 504


class ExpressionError(ValueError):
    """The expression is not one of the language."""


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Sign:
    symbol: str
    of: object


@dataclass(frozen=True)
class Binary:
    symbol: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


_MARKS = frozenset("+-*/(),")


class _Scanner:
    """Cuts a text to (kind, text) pieces: number, field, name or mark."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def run(self, good) -> str:
        """The longest run from here of characters that are ``good``."""
        begin = self.at
        while self.at < len(self.text) and good(self.text[self.at]):
            self.at += 1
        return self.text[begin : self.at]

    def word(self) -> str:
        """A name, or nothing if none begins here."""
        here = self.text[self.at : self.at + 1]
        return self.run(lambda c: c.isascii() and (c.isalnum() or c == "_")) if here.isascii() and (here.isalpha() or here == "_") else ""

    def number(self) -> str:
        """Digits with at most one point and an exponent; nothing if no digit comes."""
        begin, digit = self.at, lambda c: c in "0123456789"
        whole = self.run(digit)
        if self.text[self.at : self.at + 1] == ".":
            self.at += 1
            whole += self.run(digit)
        if not whole:
            self.at = begin
            return ""
        end = self.at
        if self.run(lambda c: c in "eE") in ("e", "E"):
            if self.text[self.at : self.at + 1] in ("+", "-"):
                self.at += 1
            if self.run(digit):
                end = self.at
        self.at = end
        return self.text[begin:end]

    def pieces(self) -> list[tuple[str, str]]:
        out = []
        while self.at < len(self.text):
            self.run(str.isspace)
            begin, mark = self.at, self.text[self.at : self.at + 1]
            if mark in _MARKS and mark:
                self.at += 1
                out.append(("mark", mark))
            elif mark == "$":
                self.at += 1
                out.append(("field", self.word()))
            elif found := self.number():
                out.append(("number", found))
            else:
                out.append(("name", self.word()))
            if not out[-1][1]:
                raise ExpressionError(f"unexpected text at {begin}: {self.text[begin : begin + 12]!r}")
        return out


class _Reader:
    def __init__(self, text: str):
        self.pieces, self.at = _Scanner(text).pieces(), 0

    def next(self, *marks: str) -> str | None:
        if self.at < len(self.pieces) and self.pieces[self.at][0] == "mark" and self.pieces[self.at][1] in marks:
            self.at += 1
            return self.pieces[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.next(mark):
            raise ExpressionError(f"expected {mark!r}")

    def sum(self):
        left = self.product()
        while symbol := self.next("+", "-"):
            left = Binary(symbol, left, self.product())
        return left

    def product(self):
        left = self.signed()
        while symbol := self.next("*", "/"):
            left = Binary(symbol, left, self.signed())
        return left

    def signed(self):
        symbol = self.next("+", "-")
        return Sign(symbol, self.signed()) if symbol else self.atom()

    def atom(self):
        if self.next("("):
            inner = self.sum()
            self.need(")")
            return inner
        if self.at >= len(self.pieces):
            raise ExpressionError("the expression ends early")
        kind, text = self.pieces[self.at]
        self.at += 1
        if kind == "number":
            return Number(float(text))
        if kind == "field":
            if text not in FIELDS:
                raise ExpressionError(f"unknown field ${text}")
            return Field(text)
        if kind != "name":
            raise ExpressionError(f"unexpected {text!r}")
        name = text.upper()
        if name not in ARITY:
            raise ExpressionError(f"unknown function {text}")
        self.need("(")
        args = [self.sum()]
        while self.next(","):
            args.append(self.sum())
        self.need(")")
        if len(args) != ARITY[name]:
            raise ExpressionError(f"{name} takes {ARITY[name]} arguments, not {len(args)}")
        return Call(name, tuple(args))


def parse(text: str):
    """The tree of an expression; :class:`ExpressionError` if it has none."""
    if not text or len(text) > MAX_LENGTH:
        raise ExpressionError(f"an expression has 1 to {MAX_LENGTH} characters")
    reader = _Reader(text)
    tree = reader.sum()
    if reader.at != len(reader.pieces):
        raise ExpressionError(f"unexpected {reader.pieces[reader.at][1]!r}")
    return tree


def evaluable(tree):
    """The tree, if its windows are in bounds and no constant in it is without a value."""
    for node in walk(tree):
        if isinstance(node, Call) and node.name in TRAILING:
            window(node)
        constant(node)
    return tree


def parts(node) -> tuple:
    return {Sign: lambda n: (n.of,), Binary: lambda n: (n.left, n.right), Call: lambda n: n.args}.get(type(node), lambda n: ())(node)


def walk(node):
    for p in parts(node):
        yield from walk(p)
    yield node


def window(node: Call) -> int:
    """The literal window of a trailing function."""
    w = node.args[1]
    if not (isinstance(w, Number) and w.value.is_integer() and 1 <= w.value <= MAX_WINDOW):
        raise ExpressionError(f"the window of {node.name} is a whole number from 1 to {MAX_WINDOW}")
    return int(w.value)


def constant(node) -> float | None:
    """The value of a subtree without fields; raises where it has none."""
    if isinstance(node, Number):
        return node.value
    if isinstance(node, Field) or isinstance(node, Call) and node.name not in SCALAR:
        return None
    values = [constant(p) for p in parts(node)]
    if isinstance(node, Binary) and node.symbol == "/" and values[1] == 0:
        raise ExpressionError("division by a constant zero")
    if isinstance(node, Call) and node.name == "LOG" and values[0] is not None and values[0] <= 0:
        raise ExpressionError("LOG of a constant that is not positive")
    if None in values:
        return None
    if isinstance(node, Sign):
        return -values[0] if node.symbol == "-" else values[0]
    if isinstance(node, Binary):
        a, b = values
        return {"+": a + b, "-": a - b, "*": a * b}[node.symbol] if node.symbol != "/" else a / b
    import math

    return {"LOG": math.log, "ABS": abs, "SIGN": lambda x: float((x > 0) - (x < 0))}[node.name](values[0])


def fields(tree) -> set[str]:
    return {n.name for n in walk(tree) if isinstance(n, Field)}


def lookback(tree) -> int:
    """The windows that lie within each other, summed along the longest path."""
    inner = max((lookback(p) for p in parts(tree)), default=0)
    return inner + (window(tree) if isinstance(tree, Call) and tree.name in TRAILING else 0)


def reach(tree) -> int:
    """Bars before a date that the value there depends on: a window of w bars reaches w - 1 back."""
    inner = max((reach(p) for p in parts(tree)), default=0)
    if not (isinstance(tree, Call) and tree.name in TRAILING):
        return inner
    return inner + window(tree) - (0 if tree.name in ("TS_PCTCHANGE", "DELAY", "DELTA") else 1)


def validate(text: str | None) -> dict:
    """{ok, fields, max_lookback} or {ok, error}.

    Says whether the text is of the language; a constant without a value, such
    as ``1 / 0``, is only refused when it is computed.
    """
    try:
        tree = parse(text or "")
        return {"ok": True, "fields": sorted(fields(tree)), "max_lookback": lookback(tree)}
    except ExpressionError as e:
        return {"ok": False, "error": str(e)}


_VERDICT = T.StructType().add("ok", "boolean").add("fields", T.ArrayType(T.StringType())).add("max_lookback", "integer").add("error", "string")


@F.pandas_udf(_VERDICT)
def validated(texts: pd.Series) -> pd.DataFrame:
    """:func:`validate` of a column of expressions; each distinct text is parsed once a batch."""
    known = {t: validate(t) for t in texts.unique()}
    columns = ("ok", "fields", "max_lookback", "error")
    return pd.DataFrame([[known[t].get(c) for c in columns] for t in texts], columns=columns).astype({"max_lookback": "Int32"})


def neutralized(tree):
    """The tree within INDUSTRY_NEUTRALIZE unless it has one already."""
    if any(isinstance(n, Call) and n.name == "INDUSTRY_NEUTRALIZE" for n in walk(tree)):
        return tree
    return Call("INDUSTRY_NEUTRALIZE", (tree, Field("industry")))


def numeric(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(F.isnan(c), None).otherwise(c)


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def delayed(c: Column, bars: int, instrument: str = "instrument", day: str = "day_idx") -> Column:
    """The value ``bars`` calendar places before; NULL where there is no such row."""
    return F.max(c).over(W.partitionBy(instrument).orderBy(day).rangeBetween(-bars, -bars))


def _trailing(name: str, x: Column, w: int) -> Column:
    if name in ("TS_PCTCHANGE", "DELAY", "DELTA"):
        base = delayed(x, w)
        if name == "DELAY":
            return base
        if name == "DELTA":
            return numeric(x - base)
        inf = F.lit(float("inf"))
        at_zero = F.when(x > 0, inf).when(x < 0, -inf)
        return F.when(base == 0, at_zero).otherwise(numeric(F.try_divide(x, base) - 1))
    over, x = W.partitionBy("instrument").orderBy("day_idx").rangeBetween(1 - w, 0), finite(x)
    value = {"TS_MEAN": F.avg, "TS_STD": F.stddev_pop, "TS_MIN": F.min, "TS_MAX": F.max, "TS_SUM": F.sum}[name](x)
    return F.when(F.count(x).over(over) == w, value.over(over))


def _across(name: str, args: list[Column]) -> Column:
    x, day = args[0], W.partitionBy("datetime")
    if name == "RANK":  # share of the values below, ties in their middle
        place = F.rank().over(day.orderBy(x.asc_nulls_last())) + (F.count(x).over(W.partitionBy("datetime", x)) - 1) / 2
        return F.when(x.isNotNull(), F.try_divide(place, F.count(x).over(day)))
    group = args[1]
    x = finite(x)
    own = W.partitionBy("datetime", group)
    return F.when(group.isNotNull(), F.try_divide(x - F.avg(x).over(own), F.stddev_pop(x).over(own)))


def with_signals(panel: DataFrame, signals: dict[str, str | object]) -> DataFrame:
    """``panel`` with a column for each expression.

    The panel has datetime, instrument, day_idx (place in the calendar) and the
    fields; NaN and infinite inputs are taken as missing only where the
    language says so.  Equal subtrees of all expressions are computed once.
    """
    trees = {n: evaluable(parse(t) if isinstance(t, str) else t) for n, t in signals.items()}
    missing = set().union(*map(fields, trees.values())) - set(panel.columns) if trees else set()
    if missing:
        raise ExpressionError(f"the panel has no {sorted(missing)}")
    names: dict = {}
    levels: dict[int, list] = {}

    def level(node) -> int:
        inner = max((level(p) for p in parts(node)), default=0)
        if isinstance(node, Call) and node.name not in SCALAR:
            inner += 1
            if node not in names:
                names[node] = f"_{node.name.lower()}_{len(names)}"
                levels.setdefault(inner, []).append(node)
        return inner

    def column(node) -> Column:
        if node in names:
            return F.col(names[node])
        value = constant(node)
        if value is not None:
            return F.lit(value)
        if isinstance(node, Field):
            return numeric(F.col(f"`{node.name}`").cast("double"))
        args = [column(p) for p in parts(node)]
        if isinstance(node, Sign):
            return -args[0] if node.symbol == "-" else args[0]
        if isinstance(node, Binary):
            a, b = args
            if node.symbol == "/":
                return numeric(F.try_divide(a, b))
            return numeric({"+": a + b, "-": a - b, "*": a * b}[node.symbol])
        return {"LOG": F.ln, "ABS": F.abs, "SIGN": F.signum}[node.name](args[0])

    for tree in trees.values():
        level(tree)
    out = panel
    for at in sorted(levels):
        for kind in (TRAILING, ACROSS):
            now = [n for n in levels[at] if n.name in kind]
            if not now:
                continue
            inputs = {}  # arguments as columns: a window may not hold a window
            for n in now:
                for p in n.args[: 1 if kind is TRAILING else None]:
                    inputs.setdefault(p, f"_in_{at}_{len(inputs)}_{'t' if kind is TRAILING else 'x'}")
            own = {n: names.pop(n) for n in now}
            out = out.withColumns({c: column(p) for p, c in inputs.items()})
            made = {}
            for n in now:
                args = [F.col(inputs[p]) for p in n.args if p in inputs]
                made[own[n]] = _trailing(n.name, args[0], window(n)) if kind is TRAILING else _across(n.name, args)
            out = out.withColumns(made).drop(*inputs.values())
            names |= own
    out = out.withColumns({f"_out_{n}": finite(column(t)) for n, t in trees.items()})
    return out.drop(*names.values(), *trees).withColumnsRenamed({f"_out_{n}": n for n in trees})


#: Texts that the loose check forbids.
FORBIDDEN = ("import ", "exec", "eval", "__", "os.", "open(")


def listed(expr: Column) -> Column:
    """The loose whitelist check of a column of expressions: struct (ok, reason)."""
    tokens = F.regexp_extract_all(expr, F.lit(r"(\$?[A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    unknown = F.filter(
        tokens,
        lambda t: F.when(t.startswith("$"), ~F.substring(t, 2, 4096).isin(*FIELDS)).otherwise((t == F.upper(t)) & (t != F.lower(t)) & ~t.isin(*LISTED, "E")),
    )
    bad = F.try_element_at(unknown, F.lit(1))
    hit = F.lit(False)
    for f in FORBIDDEN:
        hit |= expr.contains(f)
    reason = (
        F.when(expr.isNull() | (F.trim(expr) == ""), "empty expr")
        .when(hit, "forbidden token")
        .when(bad.startswith("$"), F.concat(F.lit("unknown var "), bad))
        .when(bad.isNotNull(), F.concat(F.lit("unknown func "), bad))
        .otherwise("ok")
    )
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))
