"""Arithmetic given as text: numbers, + - * / **, signs and brackets, nothing else. Never a code evaluator."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST, MOST_POWER, MOST_BASE, MOST_RESULT = 200, 8, 1_000_000, 1e100
TOKEN = re.compile(r"\s*(?:(\d+(?:_?\d)*\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\*\*|[-+*/()]))")


def tokens(text: str) -> list:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError("neither number nor operator")
        out.append(float(m[1]) if m[1] else m[2])
        at = m.end()
    return out


def checked(x: float) -> float:
    if isinstance(x, complex) or not math.isfinite(x) or abs(x) > MOST_RESULT:
        raise ValueError("result is out of bounds")
    return x


def value(text: str) -> float:
    """The value of an expression; ValueError if it is none, or out of bounds."""
    if not isinstance(text, str) or not text.strip() or len(text) > LONGEST:
        raise ValueError("no expression, or too long")
    left = tokens(text)[::-1]
    ahead = lambda: left[-1] if left else None

    def atom() -> float:
        x = left.pop() if left else None
        if isinstance(x, float):
            return x
        if x != "(":
            raise ValueError("a number is missing")
        inner = total()
        if not left or left.pop() != ")":
            raise ValueError("a bracket is open")
        return inner

    def signed() -> float:
        if ahead() in ("+", "-"):
            return signed() if left.pop() == "+" else -signed()
        base = atom()
        if ahead() == "**":
            left.pop()
            power = signed()
            if abs(power) > MOST_POWER or abs(base) > MOST_BASE:
                raise ValueError("power is out of bounds")
            return checked(base**power)
        return base

    def product() -> float:
        out = signed()
        while ahead() in ("*", "/"):
            out = checked(out * signed() if left.pop() == "*" else out / signed())
        return out

    def total() -> float:
        out = product()
        while ahead() in ("+", "-"):
            out = checked(out + product() if left.pop() == "+" else out - product())
        return out

    found = total()
    if left:
        raise ValueError("something follows the expression")
    return found


def safe(text: str) -> float | None:
    try:
        return value(text)
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None


def evaluated(expressions: Column) -> Column:
    """Null where the text is no expression."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(safe).astype(float)

    return run(expressions)
