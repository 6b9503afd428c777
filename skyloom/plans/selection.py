"""The row-selection language: lexer, recursive-descent parser, canonical text, and compilation to a Spark column.

    or   := and  (("||" | "or") and)*
    and  := cmp  (("&&" | "and") cmp)*
    cmp  := not  (("==" | "!=" | "<=" | ">=" | "<" | ">") not)*      left-associative chains
    not  := "~"? isf
    isf  := "isfinite"? term
    term := "(" or ")" | FLOAT | INT | NAME [("&" | "|") INT]
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.numeric import compare, seen

_LEXER = re.compile(
    r"""\s*(?:
    (?P<op>\|\||&&|==|!=|<=|>=|<|>|~|&|\||\(|\)|\b(?:and|or|isfinite)\b)
  | (?P<float>[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?\d+[eE][+-]?\d+)
  | (?P<int>[+-]?0[xX][0-9a-fA-F]+|[+-]?0[oO][0-7]+|[+-]?0[bB][01]+|[+-]?\d+)(?!\w)
  | (?P<name>\w+)
  | (?P<bad>\S))""",
    re.VERBOSE,
)
_COMPARE = ("==", "!=", "<=", ">=", "<", ">")


@dataclass(frozen=True)
class Number:
    value: int | float


@dataclass(frozen=True)
class Name:
    value: str


@dataclass(frozen=True)
class Unary:
    op: str
    right: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Always:
    """What a comparison with a column without any value becomes: true for each row."""


def tokenize(text: str) -> list[tuple[str, str]]:
    out = []
    for m in _LEXER.finditer(text.rstrip()):
        kind = m.lastgroup
        if kind == "bad":
            raise ValueError(f"unexpected character {m.group(kind)!r} at {m.start(kind)}")
        out.append((kind, m.group(kind)))
    return out


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokenize(text), 0

    def peek(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            return self.tokens[self.at][1]
        return None

    def take(self, *ops: str) -> str | None:
        if op := self.peek(*ops):
            self.at += 1
        return op

    def chain(self, below, *ops: str):
        node = below()
        while op := self.take(*ops):
            node = Binary({"or": "||", "and": "&&"}.get(op, op), node, below())
        return node

    def any(self):
        return self.chain(self.all, "||", "or")

    def all(self):
        return self.chain(self.comparison, "&&", "and")

    def comparison(self):
        return self.chain(self.negation, *_COMPARE)

    def negation(self):
        return Unary("~", self.isfinite()) if self.take("~") else self.isfinite()

    def isfinite(self):
        return Unary("isfinite", self.term()) if self.take("isfinite") else self.term()

    def term(self):
        if self.take("("):
            node = self.any()
            if not self.take(")"):
                raise ValueError(f"missing ) in {self.text!r}")
            return node
        if self.at >= len(self.tokens):
            raise ValueError(f"{self.text!r} ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "float":
            return Number(float(value))
        if kind == "int":
            return Number(int(value, 0) if re.match(r"[+-]?0[xXoObB]", value) else int(value))
        if kind != "name":
            raise ValueError(f"unexpected {value!r} in {self.text!r}")
        node = Name(value)
        if op := self.take("&", "|"):
            if self.at >= len(self.tokens) or self.tokens[self.at][0] != "int":
                raise ValueError(f"{op} needs an integer in {self.text!r}")
            node = Binary(op, node, self.term())
        return node


def parse(text: str):
    p = _Parser(text)
    node = p.any()
    if p.at < len(p.tokens):
        raise ValueError(f"unexpected {p.tokens[p.at][1]!r} in {text!r}")
    return node


def to_string(node, root: bool = True) -> str:
    """Canonical text: every operator but the outermost in parentheses, integers in decimal."""
    if isinstance(node, Unary):
        out = node.op + " " * node.op.isalpha() + to_string(node.right, False)
    elif isinstance(node, Binary):
        out = f"{to_string(node.left, False)} {node.op} {to_string(node.right, False)}"
    else:
        return str(node.value)
    return out if root else f"({out})"


def names(node) -> set[str]:
    if isinstance(node, Name):
        return {node.value}
    return set().union(*(names(x) for x in (getattr(node, "left", None), getattr(node, "right", None)) if x is not None))


def _truth(node, c: Column) -> Column:
    """The truth value of an operand: numbers by being non-zero (NaN counts as true)."""
    boolean = isinstance(node, (Unary, Always)) or isinstance(node, Binary) and node.op not in ("&", "|")
    return c if boolean else (c != 0)


def to_column(node, booleans: frozenset[str] = frozenset()) -> Column:
    """The node as a column; ``booleans`` are the columns of that type, which count as 0 and 1."""
    if isinstance(node, Always):
        return F.lit(True)
    if isinstance(node, Number):
        return F.lit(node.value)
    if isinstance(node, Name):
        return F.col(f"`{node.value}`").cast("int") if node.value in booleans else F.col(f"`{node.value}`")
    if isinstance(node, Unary):
        inner = to_column(node.right, booleans)
        return seen(inner) if node.op == "isfinite" else ~_truth(node.right, inner)
    a, b = to_column(node.left, booleans), to_column(node.right, booleans)
    if node.op == "&&":
        return _truth(node.left, a) & _truth(node.right, b)
    if node.op == "||":
        return _truth(node.left, a) | _truth(node.right, b)
    if node.op == "&":
        return a.cast("long").bitwiseAND(b.cast("long"))
    if node.op == "|":
        return a.cast("long").bitwiseOR(b.cast("long"))
    number = lambda n, c: c.cast("int") if isinstance(n, (Unary, Always)) or isinstance(n, Binary) and n.op not in ("&", "|") else c
    return compare(node.op, number(node.left, a), number(node.right, b))


def without_masked(node, masked: set[str]):
    """Rewrite for columns without a single finite value: comparisons and unary operators on them hold for every row."""
    if isinstance(node, Unary):
        right = without_masked(node.right, masked)
        return Always() if isinstance(right, Name) and right.value in masked or _only_bits(right, masked) else Unary(node.op, right)
    if isinstance(node, Binary) and node.op not in ("&", "|"):
        left, right = without_masked(node.left, masked), without_masked(node.right, masked)
        hit = [isinstance(x, Name) and x.value in masked or _only_bits(x, masked) for x in (left, right)]
        if any(hit):
            return Always()
        return Binary(node.op, left, right)
    return node


def _only_bits(node, masked: set[str]) -> bool:
    return isinstance(node, Binary) and node.op in ("&", "|") and isinstance(node.left, Name) and node.left.value in masked


def _compiled(df: DataFrame, expression: str, ignore_masked_columns: bool) -> tuple[str, Column]:
    if not expression.strip():
        return "", F.lit(True)
    node = parse(expression.strip())
    text = to_string(node)
    used = sorted(names(node))
    missing = [c for c in used if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing[0]!r}")
    if ignore_masked_columns and used:
        row = df.agg(*(F.max(seen(F.col(f"`{c}`"))).alias(f"c{i}") for i, c in enumerate(used))).first()
        node = without_masked(node, {c for i, c in enumerate(used) if not row[i]})
    return text, _truth(node, to_column(node, frozenset(c for c, kind in df.dtypes if kind == "boolean")))


def mask(df: DataFrame, expression: str, ignore_masked_columns: bool = False) -> tuple[str, Column]:
    """The canonical text and a boolean column, never null, for ``df``; an empty expression selects every row.

    With ``ignore_masked_columns`` one aggregate over the referenced columns finds those without any finite value.
    """
    text, column = _compiled(df, expression, ignore_masked_columns)
    return text, F.coalesce(column, F.lit(False))


def with_mask(df: DataFrame, expression: str, into: str = "mask", ignore_masked_columns: bool = False) -> DataFrame:
    return df.withColumn(into, mask(df, expression, ignore_masked_columns)[1])


def select(df: DataFrame, expression: str, ignore_masked_columns: bool = False) -> DataFrame:
    """The selected rows; plain comparisons reach the Parquet scan."""
    return df.filter(_compiled(df, expression, ignore_masked_columns)[1])
