"""Expression strings over column names, compiled to Columns through a whitelist of syntax.

Allowed are numbers, column names (in backticks if they are no identifiers), + - * / // % **, comparisons, & | ~ on them, and
floor, log, log1p, abs, sqrt. Anything else is refused. Results are doubles (comparisons 0 or 1); NULL stands for every
undefined value: zero denominators, logarithms and roots outside their domain, infinities.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Compiled:
    column: Column
    references: frozenset[str]
    text: str


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _python_mod(a: Column, b: Column) -> Column:
    return F.when(b != 0, a - b * F.floor(a / b))


_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: ratio,
    ast.FloorDiv: lambda a, b: F.floor(ratio(a, b)).cast("double"),
    ast.Mod: _python_mod,
    ast.Pow: lambda a, b: finite(F.pow(a, b)),
}
_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
FUNCTIONS = {
    "floor": lambda c: F.floor(c).cast("double"),
    "log": lambda c: F.when(c > 0, F.ln(c)),
    "log1p": lambda c: F.when(c > -1, F.log1p(c)),
    "abs": F.abs,
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
}


def compile_expression(text: str, df: DataFrame) -> Compiled:
    """The Column for an expression over the columns of df, and the columns that it reads."""
    quoted: dict[str, str] = {}

    def name_of(m: re.Match) -> str:
        alias = f"_q{len(quoted)}_"
        quoted[alias] = m[1]
        return alias

    try:
        tree = ast.parse(re.sub(r"`([^`]+)`", name_of, text).strip(), mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text}") from e
    seen: set[str] = set()
    truth = lambda c: c.cast("double")

    def walk(node: ast.expr) -> Column:
        match node:
            case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(id=name):
                name = quoted.get(name, name)
                if name not in df.columns:
                    raise ExpressionError(f"unknown column: {name}")
                seen.add(name)
                return F.col(f"`{name}`").cast("double")
            case ast.BinOp(left=a, op=ast.BitAnd(), right=b):
                return truth((walk(a) != 0) & (walk(b) != 0))
            case ast.BinOp(left=a, op=ast.BitOr(), right=b):
                return truth((walk(a) != 0) | (walk(b) != 0))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](walk(a), walk(b))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -walk(a)
            case ast.UnaryOp(op=ast.UAdd(), operand=a):
                return walk(a)
            case ast.UnaryOp(op=ast.Invert(), operand=a):
                return truth(walk(a) == 0)
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return truth(getattr(walk(a), _COMPARE[type(op)])(walk(b)))
            case ast.Call(func=ast.Name(id=f), args=[a], keywords=[]) if f in FUNCTIONS:
                return FUNCTIONS[f](walk(a))
        raise ExpressionError(f"not allowed: {ast.unparse(node)}")

    return Compiled(walk(tree.body), frozenset(seen), text)


def check_leakage(target: str, names: list[str], compiled: Compiled | None = None) -> None:
    """An error if the target is among the named columns or those that an expression reads."""
    if target in names or (compiled is not None and target in compiled.references):
        raise ValueError(f"the target column {target!r} must not be referenced")


def difference(a: str, b: str) -> Column:
    return F.col(a).cast("double") - F.col(b).cast("double")


def quotient(a: str, b: str) -> Column:
    return ratio(F.col(a).cast("double"), F.col(b).cast("double"))


def scaled_difference(a: str, b: str, scale: float = 86400.0) -> Column:
    return F.col(a).cast("double") / F.lit(scale) - F.col(b).cast("double")


def floored_difference(a: str, b: str, scale: float = 86400.0) -> Column:
    return F.floor(F.col(a).cast("double") / F.lit(scale)).cast("double") - F.col(b).cast("double")
