"""The row-filter language: a Python expression over column names, compiled to a Column.

The expression is parsed by Python's own ``ast`` module and only an allow-list of
nodes is accepted, so operators keep Python's precedence (``&`` binds tighter than
``<``). Nothing is evaluated in Python. ``and``, ``or``, ``not`` and chained
comparisons are accepted as boolean conjunctions.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import missing


@dataclass(frozen=True)
class Typed:
    """A compiled part: its Column, its kind and whether it depends on a row."""

    column: Column
    kind: str  # bool, int, float or str
    row: bool


_COMPARE = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
# The functions that the language knows.
FUNCTIONS = ("abs", "log10", "log", "exp", "sqrt", "isfinite", "isnan", "sin", "cos", "tan", "deg2rad", "rad2deg", "minimum", "maximum", "where")


def _kind(dtype: str) -> str:
    if dtype == "boolean":
        return "bool"
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "float"
    return "str"


class _Compiler:
    def __init__(self, df: DataFrame):
        self.kinds = {name: _kind(dtype) for name, dtype in df.dtypes}

    def compile(self, node: ast.AST) -> Typed:
        method = getattr(self, f"_{type(node).__name__.lower()}", None)
        if method is None:
            raise ValueError(f"{type(node).__name__} is not allowed in a filter")
        return method(node)

    def _expression(self, node: ast.Expression) -> Typed:
        return self.compile(node.body)

    def _name(self, node: ast.Name) -> Typed:
        if node.id not in self.kinds:
            raise ValueError(f"unknown column {node.id!r}")
        kind = self.kinds[node.id]
        column = F.col(f"`{node.id}`")
        return Typed(column.cast("double") if kind == "float" else column, kind, True)

    def _constant(self, node: ast.Constant) -> Typed:
        kind = {bool: "bool", int: "int", float: "float", str: "str"}.get(type(node.value))
        if kind is None:
            raise ValueError(f"constant {node.value!r} is not allowed in a filter")
        return Typed(F.lit(node.value), kind, False)

    def _unaryop(self, node: ast.UnaryOp) -> Typed:
        x = self.compile(node.operand)
        if isinstance(node.op, ast.Not) or (isinstance(node.op, ast.Invert) and x.kind == "bool"):
            return Typed(~self._boolean(x), "bool", x.row)
        if isinstance(node.op, ast.Invert) and x.kind == "int":
            return Typed(F.bitwise_not(x.column), "int", x.row)
        if isinstance(node.op, (ast.USub, ast.UAdd)) and x.kind in ("int", "float"):
            return Typed(-x.column if isinstance(node.op, ast.USub) else x.column, x.kind, x.row)
        raise ValueError(f"{type(node.op).__name__} doesn't apply to {x.kind}")

    @staticmethod
    def _boolean(x: Typed) -> Column:
        if x.kind != "bool":
            raise ValueError("a boolean operand is needed")
        return x.column

    def _boolop(self, node: ast.BoolOp) -> Typed:
        parts = [self.compile(v) for v in node.values]
        out = self._boolean(parts[0])
        for p in parts[1:]:
            out = (out & self._boolean(p)) if isinstance(node.op, ast.And) else (out | self._boolean(p))
        return Typed(missing.strict(out, *[p.column for p in parts]), "bool", any(p.row for p in parts))

    def _binop(self, node: ast.BinOp) -> Typed:
        a, b = self.compile(node.left), self.compile(node.right)
        row, op = a.row or b.row, type(node.op)
        if op in (ast.BitAnd, ast.BitOr, ast.BitXor):
            if a.kind == b.kind == "bool":
                value = {ast.BitAnd: a.column & b.column, ast.BitOr: a.column | b.column, ast.BitXor: a.column != b.column}[op]
                return Typed(missing.strict(value, a.column, b.column), "bool", row)
            if a.kind == b.kind == "int":
                value = {ast.BitAnd: a.column.bitwiseAND(b.column), ast.BitOr: a.column.bitwiseOR(b.column), ast.BitXor: a.column.bitwiseXOR(b.column)}[op]
                return Typed(value, "int", row)
            raise ValueError(f"{op.__name__} needs two booleans or two integers")
        if not {a.kind, b.kind} <= {"int", "float"}:
            raise ValueError(f"{op.__name__} needs numbers")
        x, y = a.column, b.column
        kind = "int" if a.kind == b.kind == "int" else "float"
        if op in (ast.Add, ast.Sub, ast.Mult):
            return Typed({ast.Add: x + y, ast.Sub: x - y, ast.Mult: x * y}[op], kind, row)
        if op is ast.Div:
            return Typed(missing.divide(x, y), "float", row)
        if op is ast.FloorDiv:
            q = missing.divide(x, y)
            return Typed(F.when(missing.is_finite(q), F.floor(q).cast("double")).otherwise(q), "float", row)
        if op is ast.Mod:
            return Typed(missing.floor_mod(x.cast("double"), y.cast("double")), "float", row)
        if op is ast.Pow:
            return Typed(F.pow(x.cast("double"), y.cast("double")), "float", row)
        raise ValueError(f"{op.__name__} is not allowed in a filter")

    def _compare(self, node: ast.Compare) -> Typed:
        parts = [self.compile(x) for x in (node.left, *node.comparators)]
        found = []
        for op, a, b in zip(node.ops, parts[:-1], parts[1:], strict=True):
            if type(op) not in _COMPARE:
                raise ValueError(f"{type(op).__name__} is not allowed in a filter")
            if "str" in (a.kind, b.kind) and a.kind != b.kind:
                raise ValueError("text compares with text only")
            if {a.kind, b.kind} <= {"int", "float"} and "float" in (a.kind, b.kind):
                found.append(missing.ieee_compare(_COMPARE[type(op)], a.column, b.column))
            else:
                x, y = a.column, b.column
                found.append({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[_COMPARE[type(op)]])
        out = found[0]
        for f in found[1:]:
            out = out & f
        return Typed(missing.strict(out, *[p.column for p in parts]) if len(found) > 1 else out, "bool", any(p.row for p in parts))

    def _call(self, node: ast.Call) -> Typed:
        if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS or node.keywords:
            raise ValueError("only the filter functions may be called, by position")
        name, args = node.func.id, [self.compile(a) for a in node.args]
        if len(args) != {"minimum": 2, "maximum": 2, "where": 3}.get(name, 1):
            raise ValueError(f"{name} got {len(args)} arguments")
        row = any(a.row for a in args)
        if name == "where":
            test, yes, no = args
            kind = yes.kind if yes.kind == no.kind else "float"
            return Typed(F.when(self._boolean(test).isNull(), None).when(test.column, yes.column).otherwise(no.column), kind, row)
        if any(a.kind not in ("int", "float") for a in args):
            raise ValueError(f"{name} needs numbers")
        x = args[0].column.cast("double")
        if name in ("minimum", "maximum"):
            y = args[1].column.cast("double")
            pick = F.least(x, y) if name == "minimum" else F.greatest(x, y)
            return Typed(missing.strict(F.when(F.isnan(x) | F.isnan(y), missing.nan()).otherwise(pick), x, y), "float", row)
        never = F.lit(False)
        value = {
            "abs": lambda: F.abs(args[0].column),
            "log10": lambda: missing.guarded(x, x < 0, -missing.inf(), F.log10(x)),
            "log": lambda: missing.guarded(x, x < 0, -missing.inf(), F.ln(x)),
            "exp": lambda: F.exp(x),
            "sqrt": lambda: missing.guarded(x, x < 0, None, F.sqrt(x)),
            "isfinite": lambda: missing.strict(missing.is_finite(x), x),
            "isnan": lambda: missing.strict(F.isnan(x), x),
            "sin": lambda: missing.guarded(x, never, None, F.sin(x)),
            "cos": lambda: missing.guarded(x, never, None, F.cos(x)),
            "tan": lambda: missing.guarded(x, never, None, F.tan(x)),
            "deg2rad": lambda: F.radians(x),
            "rad2deg": lambda: F.degrees(x),
        }[name]()
        kind = "bool" if name in ("isfinite", "isnan") else args[0].kind if name == "abs" else "float"
        return Typed(value, kind, row)


def compile_filter(df: DataFrame, text: str) -> Column:
    """The boolean Column of a filter expression; ValueError for anything else."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, RecursionError) as error:
        raise ValueError(f"not an expression: {text!r}") from error
    found = _Compiler(df).compile(tree)
    if found.kind != "bool" or not found.row:
        raise ValueError("a filter must give one boolean per row")
    return found.column


def compile_value(df: DataFrame, text: str) -> Column:
    """The Column of an expression of any kind."""
    return _Compiler(df).compile(ast.parse(text.strip(), mode="eval")).column
