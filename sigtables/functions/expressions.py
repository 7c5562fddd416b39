"""Expressions of time as columns: arithmetic, functions, pi, e and t, read by Python's own parser and checked by name."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _number(c: Column) -> Column:
    return c.cast("double")


def _ratio(a: Column, b: Column) -> Column:
    """a / b; by zero it is infinite, or NaN for 0 / 0."""
    zero = F.when((a == 0) | F.isnan(a), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def _rest(a: Column, b: Column) -> Column:
    return F.when(b == 0, NAN).otherwise(a % F.when(b != 0, b))


def _log(f) -> object:
    return lambda x: F.when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(f(F.when(x > 0, x)))


def _whole(f) -> object:
    """f where x has a fraction to lose; numbers of 2**53 and more, infinities and NaN have none."""
    return lambda x: F.when(F.isnan(x) | (F.abs(x) >= float(1 << 53)), x).otherwise(_number(f(x)))


def _less(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def _more(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


#: Functions of one and of two arguments. min and max leave NaN out; round goes away from zero at a half.
ONE = {
    **{n: getattr(F, n) for n in "sin cos tan asin acos atan sinh cosh tanh exp sqrt abs".split()},
    "ln": _log(F.log), "log10": _log(F.log10), "log2": _log(F.log2),
    "floor": _whole(F.floor), "ceil": _whole(F.ceil), "round": _whole(F.round), "sign": F.signum,
}
TWO = {"pow": F.pow, "min": _less, "max": _more}
CONSTANTS = {"pi": math.pi, "e": math.e}
BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: _ratio, ast.Mod: _rest, ast.Pow: F.pow}


def expression(text: str, **variables: Column) -> Column:
    """The column that an expression such as `2 * sin(2 * pi * t) ^ 2` names; ^ is power, binds right, and % keeps the sign of its left side.

    Names are pi, e, the variables given and the functions of ONE and TWO; all else is a ValueError.
    """
    try:
        tree = ast.parse(text.strip().replace("^", "**"), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"{text!r}: {e.msg}") from None
    known = {k: _number(v) for k, v in variables.items()} | {k: F.lit(v) for k, v in CONSTANTS.items()}

    def column(node: ast.AST) -> Column:
        match node:
            case ast.Constant(value=int() | float() as v) if not isinstance(v, bool):
                return F.lit(float(v))
            case ast.Name(id=name) if name in known:
                return known[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -column(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return column(x)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
                return BINARY[type(op)](column(a), column(b))
            case ast.Call(func=ast.Name(id=name), args=[x], keywords=[]) if name in ONE:
                return ONE[name](column(x))
            case ast.Call(func=ast.Name(id=name), args=[x, y], keywords=[]) if name in TWO:
                return TWO[name](column(x), column(y))
        raise ValueError(f"{text!r}: {ast.unparse(node)!r} is not known")

    return column(tree)
