"""Small languages compiled to columns: the per-cell calculator, postfix formulas and polynomials.

The calculator has numbers, var_n, + - * /, unary minus, parentheses and the functions of CALLS. Its binary operators
group to the right at each level: a - b - c is a - (b - c). Any missing input makes the result missing.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|([()+\-*/,]))")

CALLS = {
    "pow": lambda a, b: F.pow(a, b),
    "abs": lambda a: F.abs(a),
    "sign": lambda a: F.signum(a),
    "min": lambda *v: F.least(*v) if len(v) > 1 else v[0],
    "max": lambda *v: F.greatest(*v) if len(v) > 1 else v[0],
    "lt": lambda a, b, x, y: F.when(a < b, x).otherwise(y),
    "gt": lambda a, b, x, y: F.when(a > b, x).otherwise(y),
    "lte": lambda a, b, x, y: F.when(a <= b, x).otherwise(y),
    "gte": lambda a, b, x, y: F.when(a >= b, x).otherwise(y),
    "eq": lambda a, b, x, y: F.when(a == b, x).otherwise(y),
    #: Uniform numbers from a fixed seed; they depend on the partitioning, not on the cell.
    "rand": lambda: F.rand(0),
}


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating-point division has it: infinite where b is 0, not a number where both are."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a == 0, F.lit(float("nan"))).when(b == 0, F.signum(a) * F.lit(float("inf")))


class Calculator:
    """Compiles one expression; used are the variables that occur in it."""

    def __init__(self, text: str, variables: dict[str, Column]) -> None:
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"can't read {text[at:]!r}")
            self.tokens.append(m.group(m.lastindex))
            at = m.end()
        self.at, self.variables, self.used = 0, variables, set()
        value = self._sum()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r}")
        if self.used:
            value = F.when(reduce(lambda a, b: a & b, (variables[v].isNotNull() for v in sorted(self.used))), value)
        self.column = value

    def _peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _take(self, wanted: str | None = None) -> str:
        token = self._peek()
        if token is None or wanted is not None and token != wanted:
            raise ValueError(f"expected {wanted or 'a value'}, found {token!r}")
        self.at += 1
        return token

    def _sum(self) -> Column:
        left = self._product()
        if self._peek() in ("+", "-"):
            return left + self._sum() if self._take() == "+" else left - self._sum()
        return left

    def _product(self) -> Column:
        left = self._value()
        if self._peek() in ("*", "/"):
            return left * self._product() if self._take() == "*" else quotient(left, self._product())
        return left

    def _value(self) -> Column:
        token = self._take()
        if token == "-":
            return -self._value()
        if token == "(":
            inner = self._sum()
            self._take(")")
            return inner
        if token in self.variables:
            self.used.add(token)
            return self.variables[token]
        if token in CALLS:
            self._take("(")
            if self._peek() == ")":
                self._take(")")
                return CALLS[token]()
            parts = [self._sum()]
            while self._peek() == ",":
                self._take(",")
                parts.append(self._sum())
            self._take(")")
            return CALLS[token](*parts)
        try:
            return F.lit(float(token))
        except ValueError:
            raise ValueError(f"unknown name {token!r}") from None


def calculate(text: str, variables: dict[str, Column]) -> Column:
    return Calculator(text, variables).column


def postfix(text: str, t: Column) -> Column:
    """A formula in postfix order over t: + - * / ^ sin cos tan abs."""
    stack: list[Column] = []
    two = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "^": F.pow}
    one = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "abs": F.abs}
    for token in text.split():
        if token in two:
            if len(stack) < 2:
                raise ValueError(f"too few values before {token}")
            b, a = stack.pop(), stack.pop()
            stack.append(two[token](a, b))
        elif token in one:
            if not stack:
                raise ValueError(f"no value before {token}")
            stack.append(one[token](stack.pop()))
        else:
            stack.append(t if token == "t" else F.lit(float(token)))
    if len(stack) != 1:
        raise ValueError("a formula must leave one value")
    return stack[0]


def polynomial(coefficients: list[float], t: Column) -> Column:
    """By Horner's rule, lowest power first; without coefficients 0."""
    return reduce(lambda acc, c: acc * t + F.lit(float(c)), reversed(coefficients), F.lit(0.0))
