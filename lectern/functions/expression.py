"""Infix arithmetic on doubles (M1-M5), as an Arrow-batched function."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 3}
_TOKEN = re.compile(r"\s*(?:([0-9.]+)|([-+*/^()]))")


class ExpressionError(ValueError):
    pass


def tokens(text: str) -> list[float | str]:
    """Numbers and signs. A minus directly before a digit or point, where no operand stands before, belongs to the number."""
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError("Unsupported character.")
        sign = m[2]
        free = not out or (isinstance(out[-1], str) and out[-1] != ")")
        number = re.compile(r"[0-9.]+").match(text, m.end()) if sign == "-" and free else None
        literal = "-" + number[0] if number else m[1]
        if literal:
            try:
                out.append(float(literal))
            except ValueError:
                raise ExpressionError("Invalid numeric literal.") from None
        else:
            out.append(sign)
        at = number.end() if number else m.end()
    return out


def apply(op: str, a: float, b: float) -> float:
    if op == "/":
        return a / b if b else (math.nan if not a or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b))
    if op == "^":
        try:
            r = a**b
            return math.nan if isinstance(r, complex) else r
        except OverflowError:
            return -math.inf if a < 0 and b % 2 == 1 else math.inf
        except ZeroDivisionError:
            return math.inf
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def evaluate(text: str) -> float:
    """Two stacks, one of operands and one of signs; a sign is applied when one that binds no tighter follows."""
    values, signs = [], []

    def reduce() -> None:
        if len(values) < 2:
            raise ExpressionError("Insufficient operands.")
        b, a = values.pop(), values.pop()
        values.append(apply(signs.pop(), a, b))

    for t in tokens(text):
        if isinstance(t, float):
            values.append(t)
        elif t == "(":
            signs.append(t)
        elif t == ")":
            while signs and signs[-1] != "(":
                reduce()
            if not signs:
                raise ExpressionError("Mismatched parentheses.")
            signs.pop()
        else:
            while signs and signs[-1] != "(" and (_RANK[signs[-1]] > _RANK[t] or (_RANK[signs[-1]] == _RANK[t] and t != "^")):
                reduce()
            signs.append(t)
    while signs:
        if signs[-1] == "(":
            raise ExpressionError("Mismatched parentheses.")
        reduce()
    if len(values) != 1:
        raise ExpressionError("Invalid expression.")
    return values[0]


def number_text(x: float) -> str:
    """A double as scripts print it: the shortest digits, exponents from 1e21 and below 1e-6."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if not x:
        return "0"
    mantissa, _, power = repr(abs(x)).partition("e")
    figures = mantissa.replace(".", "")
    point = len(mantissa.split(".")[0]) + int(power or 0)
    lead = len(figures) - len(figures.lstrip("0"))
    figures, point = figures.lstrip("0").rstrip("0"), point - lead
    sign = "-" if x < 0 else ""
    if 0 < point <= 21:
        return sign + (figures.ljust(point, "0") if len(figures) <= point else f"{figures[:point]}.{figures[point:]}")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    return f"{sign}{figures[0]}{'.' + figures[1:] if len(figures) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


@F.pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def math_expression(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``struct(value, text, error)`` of each expression; null gives nulls."""
    for part in parts:
        rows = []
        for text in part:
            try:
                rows.append((None, None, None) if text is None else ((x := evaluate(text)), number_text(x), None))
            except ExpressionError as e:
                rows.append((None, None, str(e)))
        yield pd.DataFrame(rows, columns=["value", "text", "error"])
