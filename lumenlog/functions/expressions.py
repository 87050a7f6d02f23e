"""Expressions and comparisons of rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.ast import Call, Chain, Comparison, Const, Var
from ..plans.typing import kind_of_value
from .builtins import BUILTIN_COLUMNS, LEAST, absolute

SPARK_TYPES = {"number": "bigint", "float": "double", "string": "string"}


def _whole(op: str, a: Column, b: Column) -> Column:
    """64-bit arithmetic: overflow and division by zero give null, and the least number is null."""
    match op:
        case "+":
            out = F.try_add(a, b)
        case "-":
            out = F.try_subtract(a, b)
        case "*":
            out = F.try_multiply(a, b)
        case "/":
            out = F.when(b == -1, F.try_subtract(F.lit(0).cast("bigint"), a)).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))))
        case "%":
            out = F.when(b == -1, F.when(a != LEAST, F.lit(0).cast("bigint"))).otherwise(a % F.nullif(b, F.lit(0).cast("bigint")))
        case "&":
            out = a.bitwiseAND(b)
        case "|":
            out = a.bitwiseOR(b)
        case "^":
            out = a.bitwiseXOR(b)
    return F.nullif(out, F.lit(LEAST))


def _real(op: str, a: Column, b: Column) -> Column:
    """IEEE arithmetic; a negative zero is a zero."""
    match op:
        case "+":
            out = a + b
        case "-":
            out = a - b
        case "*":
            out = a * b
        case "/":
            by_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
            out = F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))
        case "%":
            out = F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(a % F.nullif(b, F.lit(0.0)))
        case _:
            return F.lit(None).cast("double")
    return out + F.lit(0.0)


def value(node, columns: dict[str, tuple[Column, str]]) -> tuple[Column, str]:
    """The node's column and kind; columns: those of the variables."""
    match node:
        case Var(name):
            return columns[name]
        case Const(v):
            kind = kind_of_value(v)
            return F.lit(v).cast(SPARK_TYPES[kind]), kind
        case Call("abs", (arg,)):
            x, kind = value(arg, columns)
            return absolute(x, kind), kind
        case Call(name, args):
            from ..lang.signatures import BUILTINS, NAMES

            return BUILTIN_COLUMNS[name](*(value(a, columns)[0] for a in args)), NAMES[BUILTINS[name][1]]
        case Chain(first, rest):
            out, kind = value(first, columns)
            for op, term in rest:
                right, _ = value(term, columns)
                out = (_real if kind == "float" else _whole)(op, out, right)
            return out, kind
    raise TypeError(node)


def condition(node: Comparison, columns: dict[str, tuple[Column, str]]) -> Column:
    """True where the comparison holds; never where an operand is null. NaN differs from everything."""
    (a, kind), (b, _) = value(node.left, columns), value(node.right, columns)
    plain = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.op]
    if kind != "float":
        return plain
    nan = F.isnan(a) | F.isnan(b)
    return a.isNotNull() & b.isNotNull() & (nan | plain if node.op == "!=" else ~nan & plain)
