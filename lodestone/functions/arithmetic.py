"""A safe evaluator of arithmetic over named values, for scalar use and as a column function."""

from __future__ import annotations

import ast
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
CALLS = {"round": round, "sum": lambda *a: sum(a), "min": min, "max": max, "abs": abs}


class ArithmeticError_(ValueError):
    """An expression that is not plain arithmetic over known names."""


def evaluate(text: str, names: dict[str, float]) -> float:
    """Plus, minus, times, over, signs, round, sum, min, max and abs; anything else is refused."""

    def of(node) -> float:
        match node:
            case ast.Constant(value=bool()):
                raise ArithmeticError_("only numbers are allowed")
            case ast.Constant(value=int() | float()):
                return node.value
            case ast.Name() if node.id in names:
                return names[node.id]
            case ast.Name():
                raise ArithmeticError_(f"unknown name {node.id}")
            case ast.UnaryOp(op=ast.USub()):
                return -of(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return of(node.operand)
            case ast.BinOp() if type(node.op) in BINARY:
                return BINARY[type(node.op)](of(node.left), of(node.right))
            case ast.Call(func=ast.Name(id=name), keywords=[]) if name in CALLS and node.args:
                args = [of(a) for a in node.args]
                return CALLS[name](*([args[0], int(args[1])] if name == "round" and len(args) == 2 else args))
        raise ArithmeticError_(f"not allowed: {type(node).__name__}")

    try:
        return round(float(of(ast.parse(text.strip(), mode="eval").body)), 6)
    except ZeroDivisionError:
        raise ArithmeticError_("division by zero") from None
    except (SyntaxError, TypeError, OverflowError, RecursionError, MemoryError) as e:
        raise ArithmeticError_(f"not an expression: {e}") from None


@F.pandas_udf(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())]))
def _compute(text: pd.Series, names: pd.Series) -> pd.DataFrame:
    out = []
    for t, n in zip(text, names):
        try:
            out.append((evaluate(t or "", dict(n or {})), None))
        except ArithmeticError_ as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["value", "error"])


def compute(text: Column, names: Column) -> Column:
    """(value, error) of an expression over a map of names to numbers."""
    return _compute(text, names)
