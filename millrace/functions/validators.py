"""Validators by name: answers are checked by column expressions, exact arithmetic by one small function."""

from __future__ import annotations

import ast
import json
import math
import operator
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from . import text as X

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}


@dataclass(frozen=True)
class Bounds:
    """What an expression may cost. Operands of an operator are numbers of ``digits`` characters at most, a fraction's bar included."""

    chars: int
    depth: int
    nodes: int
    digits: int
    exponent: int
    whole: int  # the largest argument of a function of whole numbers
    factorial: int
    calls: tuple[str, ...]
    results: bool = False  # whether results, too, have at most that many digits


# The bounds of answers that are scored, and those, tighter, of claims that a reviewer's counter-example refutes.
ANSWER = Bounds(chars=500, depth=20, nodes=500, digits=3000, exponent=100, whole=10_000, factorial=200, calls=("abs", "factorial", "gcd", "lcm", "comb"))
WITNESS = Bounds(chars=500, depth=500, nodes=120, digits=310, exponent=8, whole=10**12, factorial=0, calls=("abs", "gcd"), results=True)
_PLACES = {"abs": 1, "factorial": 1, "comb": 2}
#: Digits that a value may be spelled with; Python refuses more.
SPELLED_BITS = 14_000


def _call(name: str, args: list[Fraction], bounds: Bounds) -> Fraction:
    if name not in bounds.calls or len(args) != _PLACES.get(name, len(args)) or not args:
        raise ValueError("not a function")
    if name == "abs":
        return abs(args[0])
    if any(x.denominator != 1 or abs(x) > bounds.whole for x in args):
        raise ValueError("small whole numbers only")
    if name == "factorial" and args[0] > bounds.factorial:
        raise ValueError("too large")
    return Fraction(getattr(math, name)(*(int(x) for x in args)))


@lru_cache(64)
def _parsed(expression: str, nodes: int) -> ast.expr | None:
    """The tree of an expression, None for one of more than ``nodes`` nodes; rows often share theirs.

    Arithmetic has a root and two nodes a character at most (a name and an operator have two), so that short texts needn't be counted.
    """
    tree = ast.parse(expression, mode="eval")
    return tree.body if 2 * len(expression) < nodes or sum(1 for _ in ast.walk(tree)) <= nodes else None


def exact_value(expression: str | None, names: Mapping[str, int] | None = None, bounds: Bounds = ANSWER) -> Fraction | None:
    """The exact value of arithmetic on integers and decimals, with some functions of whole numbers; None for anything else.

    Length, depth, exponents and the size of operands are bounded, so that no answer can hold up a task.
    """
    expression = None if expression is None else expression.strip()
    if expression is None or len(expression) > bounds.chars:
        return None

    def operand(x: Fraction) -> Fraction:
        bits = x.numerator.bit_length() + x.denominator.bit_length()
        # a number of so many bits is spelled with bits * 0.302 + 4 characters at most, sign and bar included
        if bits > 3.33 * bounds.digits + 8 or (bits * 0.302 + 4 > bounds.digits and len(str(x)) > bounds.digits):
            raise ValueError("too large")
        return x

    def value(node: ast.AST, depth: int) -> Fraction:
        if depth > bounds.depth:
            raise ValueError("too deep")
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return Fraction(ast.get_source_segment(expression, node).replace("_", "") if type(node.value) is float else node.value)
        if isinstance(node, ast.Name) and names and node.id in names:
            return Fraction(names[node.id])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.UAdd | ast.USub):
            return value(node.operand, depth + 1) * (1 if isinstance(node.op, ast.UAdd) else -1)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            a, b = operand(value(node.left, depth + 1)), operand(value(node.right, depth + 1))
            if isinstance(node.op, ast.Pow) and (b.denominator != 1 or abs(b) > bounds.exponent):
                raise ValueError("not a small whole exponent")
            result = a ** int(b) if isinstance(node.op, ast.Pow) else Fraction(_OPS[type(node.op)](a, b))
            return operand(result) if bounds.results else result
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            return _call(node.func.id, [value(x, depth + 1) for x in node.args], bounds)
        raise ValueError("not arithmetic")

    try:
        tree = _parsed(expression, bounds.nodes)
        return None if tree is None else value(tree, 0)
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, MemoryError, TypeError, OverflowError):
        return None


def _spelled(x: Fraction | None) -> str | None:
    return None if x is None or max(x.numerator.bit_length(), x.denominator.bit_length()) > SPELLED_BITS else f"{x.numerator}/{x.denominator}"


@F.pandas_udf(StringType())
def exact_fraction(expressions: pd.Series) -> pd.Series:
    """The exact value of arithmetic as ``numerator/denominator``; null for anything else, and for more than about 4,200 digits."""
    return pd.Series([_spelled(exact_value(e)) for e in expressions], dtype=object)


@F.pandas_udf(StructType([StructField("correct", BooleanType()), StructField("message", StringType())]))
def scored(answers: pd.Series, golds: pd.Series) -> pd.DataFrame:
    """Answers against exact values; what can't be evaluated isn't correct, and the message says why."""
    rows = []
    for answer, gold in zip(answers, golds, strict=True):
        want, got = exact_value(gold), exact_value(answer)
        rows.append((want is not None and got == want, "no gold value" if want is None else "not evaluable" if got is None else None))
    return pd.DataFrame(rows, columns=["correct", "message"])


def identity_holds(left: Column, right: Column, names: list[str], tries: list[tuple[int, ...]]) -> Column:
    """Whether two expressions agree for every try of their names: the first that doesn't is a counter-example."""

    @F.pandas_udf(BooleanType())
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        def same(x: str, y: str) -> bool:
            values = [(exact_value(x, own), exact_value(y, own)) for own in (dict(zip(names, t, strict=True)) for t in tries)]
            return all(v is not None and v == w for v, w in values)

        return pd.Series([same(x, y) for x, y in zip(a, b, strict=True)])

    return check(left, right)


_REFUTED = StructType([StructField("refuted", BooleanType()), StructField("left", StringType()), StructField("right", StringType()), StructField("problem", StringType())])


@F.pandas_udf(_REFUTED)
def refuted(lefts: pd.Series, rights: pd.Series, assignments: pd.Series) -> pd.DataFrame:
    """Whether an assignment (a JSON object of whole numbers, eight at most) shows that two expressions aren't equal, with both values.

    ``problem`` says why nothing was shown: a bad assignment, an expression out of bounds, or values that are equal.
    """
    rows = []
    for left, right, text in zip(lefts, rights, assignments, strict=True):
        try:
            names = json.loads(text) if text is not None else None
        except ValueError:
            names = None
        if not isinstance(names, dict) or len(names) > 8 or any(type(v) is not int or abs(v) > WITNESS.whole for v in names.values()):
            rows.append((False, None, None, "bad assignment"))
            continue
        a, b = exact_value(left, names, WITNESS), exact_value(right, names, WITNESS)
        problem = "not evaluable" if a is None or b is None else "equal" if a == b else None
        rows.append((problem is None, _spelled(a), _spelled(b), problem))
    return pd.DataFrame(rows, columns=["refuted", "left", "right", "problem"])


def fraction_parts(text: Column) -> tuple[Column, Column]:
    """Numerator and denominator of ``a/b`` or ``a``; null otherwise or for b = 0."""
    num = F.regexp_extract(text, r"^\s*(-?[0-9]+)\s*(?:/\s*[0-9]+)?\s*$", 1).try_cast("decimal(38,0)")
    den = F.coalesce(F.regexp_extract(text, r"^\s*-?[0-9]+\s*/\s*([0-9]+)\s*$", 1).try_cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)"))
    return num, F.when(den != 0, den)


def same_fraction(a: Column, b: Column) -> Column:
    (an, ad), (bn, bd) = fraction_parts(a), fraction_parts(b)
    return F.coalesce(an * bd == bn * ad, F.lit(False))


def grounded(answer: Column, evidence: Column, context: Column) -> Column:
    return F.coalesce(F.contains(context, evidence) & F.contains(F.lower(evidence), F.lower(answer)), F.lit(False))


def same_json(answer: Column, gold: Column) -> Column:
    return F.coalesce(X.canonical_json(X.unwrap_json(answer)) == X.canonical_json(gold), F.lit(False))


#: Kind of constraint to a check of (answer, argument).
CONSTRAINTS: dict[str, Callable[[Column, Column], Column]] = {
    "min_words": lambda a, x: X.word_count(a) >= x.try_cast("int"),
    "max_words": lambda a, x: X.word_count(a) <= x.try_cast("int"),
    "word_once": lambda a, x: F.size(F.filter(F.split(F.lower(a), r"[^\p{L}\p{N}_]+"), lambda w: w == F.lower(x))) == 1,
    "word_banned": lambda a, x: ~F.array_contains(F.split(F.lower(a), r"[^\p{L}\p{N}_]+"), F.lower(x)),
    "paragraphs": lambda a, x: F.size(F.filter(F.split(a, r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 0)) == x.try_cast("int"),
    "lines_start": lambda a, x: F.forall(F.split(a, "\n"), lambda line: F.startswith(line, x)),
    "starts": lambda a, x: F.startswith(a, x),
    "ends": lambda a, x: F.endswith(F.rtrim(a), x),
}

VALIDATORS: dict[str, Callable[[Column, Column], Column]] = {
    "json": same_json,
    "fraction": same_fraction,
    "number": lambda a, g: F.coalesce(X.last_number(a) == g.try_cast("decimal(38,10)"), F.lit(False)),
    "integer": lambda a, g: F.coalesce(X.answer_integer(a) == g.try_cast("long"), F.lit(False)),
    "letter": lambda a, g: F.coalesce(X.answer_letter(a) == F.char(g.try_cast("int") + 65), F.lit(False)),
    "literal": lambda a, g: F.coalesce(X.norm(a) == X.norm(g), F.lit(False)),
}


def validate(kind: Column, answer: Column, gold: Column, complete: Column | None = None) -> Column:
    """Whether an answer passes its row's validator; unfinished, empty or unknown ones don't."""
    out = F.lit(False)
    for name, check in VALIDATORS.items():
        out = F.when(kind == name, check(answer, gold)).otherwise(out)
    short = F.coalesce(F.length(F.trim(answer)) == 0, F.lit(True))
    return F.when(short if complete is None else short | ~F.coalesce(complete, F.lit(False)), False).otherwise(out)


def constrained(kind: Column, answer: Column, argument: Column) -> Column:
    out = F.lit(False)
    for name, check in CONSTRAINTS.items():
        out = F.when(kind == name, F.coalesce(check(answer, argument), F.lit(False))).otherwise(out)
    return out
