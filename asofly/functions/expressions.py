"""User-defined factors: small expression trees over columns, compiled to Spark columns.

A tree is validated when it's built (positive lags, windows of two or more), has a canonical text in which the order of a
sum's or product's parts doesn't matter, and is evaluated level by level, so nested windows become successive columns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofly.functions import factors as fx
from asofly.operators.rolling import sliding_rank
from asofly.operators.timeblocks import in_blocks

COMMUTES = {"add", "multiply"}
WINDOWED = {"lag", "delta", "percent_change", "rolling_mean", "rolling_std", "zscore", "rolling_rank"}


@dataclass(frozen=True)
class Node:
    """An operation over other nodes: `op`, its parts, and one or two numbers."""

    op: str
    parts: tuple = ()
    params: tuple = ()

    def __post_init__(self):
        if self.op in ("lag", "delta", "percent_change") and self.params[0] < 1:
            raise ValueError(f"{self.op} must look back")
        if self.op in WINDOWED - {"lag", "delta", "percent_change"} and self.params[0] < 2:
            raise ValueError(f"{self.op} needs two rows at least")
        if self.op == "column" and self.params[0].startswith(("label", "forward")):
            raise ValueError("a factor may not read a label")

    @staticmethod
    def column(name: str) -> Node:
        return Node("column", (), (name,))

    def __add__(self, other: Node) -> Node:
        return Node("add", (self, other))

    def __sub__(self, other: Node) -> Node:
        return Node("subtract", (self, other))

    def __mul__(self, other: Node) -> Node:
        return Node("multiply", (self, other))

    def ratio(self, other: Node, eps: float = 1e-12) -> Node:
        return Node("safe_ratio", (self, other), (eps,))

    def clip(self, low: float, high: float) -> Node:
        return Node("clip", (self,), (low, high))

    def __getattr__(self, name: str):
        if name in WINDOWED:
            return lambda n: Node(name, (self,), (n,))
        raise AttributeError(name)

    @property
    def depth(self) -> int:
        return 1 + max((p.depth for p in self.parts), default=0)

    @property
    def lookback(self) -> int:
        own = self.params[0] if self.op in WINDOWED else 0
        return own + max((p.lookback for p in self.parts), default=0)

    def text(self) -> str:
        parts = [p.text() for p in self.parts]
        return f"{self.op}({','.join([*(sorted(parts) if self.op in COMMUTES else parts), *map(str, self.params)])})"

    def digest(self, *, unit: str = "dimensionless", parents: tuple[str, ...] = ()) -> str:
        """Hash of the canonical text, the unit of the result and the factors it comes from (in any order)."""
        return hashlib.sha256("|".join((self.text(), unit, *sorted(parents))).encode()).hexdigest()

    def columns(self) -> set[str]:
        """Names of the columns that the tree reads."""
        return {self.params[0]} if self.op == "column" else set().union(*(p.columns() for p in self.parts))


def safe_ratio(a: Column, b: Column, eps: float) -> Column:
    return F.when(F.abs(b) >= eps, a / b)


def _compile(node: Node, known: dict[str, str]) -> Column:
    x = [F.col(known[p.text()]) for p in node.parts]
    p = node.params
    match node.op:
        case "column":
            return F.col(p[0])
        case "add":
            return x[0] + x[1]
        case "subtract":
            return x[0] - x[1]
        case "multiply":
            return x[0] * x[1]
        case "safe_ratio":
            return safe_ratio(x[0], x[1], p[0])
        case "clip":
            return F.least(F.greatest(x[0], F.lit(p[0])), F.lit(p[1]))
        case "lag":
            return F.lag(x[0], p[0]).over(fx.W())
        case "delta":
            return x[0] - F.lag(x[0], p[0]).over(fx.W())
        case "percent_change":
            return fx.change(x[0], p[0])
        case "rolling_mean":
            return fx.full(F.avg, x[0], p[0])
        case "rolling_std":
            return fx.full(F.stddev_samp, x[0], p[0])
        case "zscore":
            return fx.zscore(known[node.parts[0].text()], p[0])
    raise ValueError(f"unknown operation {node.op}")


#: Columns that a factor may read.
ALLOWED = frozenset("open high low close volume quote_volume trades taker_buy_base taker_buy_quote funding_rate open_interest sum_open_interest sum_open_interest_value".split())


def evaluate(frame: DataFrame, trees: dict[str, Node], *, allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """The frame with a column for each tree; equal subtrees are computed once. A tree that reads another column is an error."""
    unknown = sorted(set().union(*(tree.columns() for tree in trees.values())) - allowed)
    if unknown:
        raise ValueError(f"UNKNOWN_COLUMNS: {unknown}")
    levels: dict[int, dict[str, Node]] = {}

    def collect(n: Node) -> None:
        levels.setdefault(n.depth, {})[n.text()] = n
        for p in n.parts:
            collect(p)

    for tree in trees.values():
        collect(tree)
    known: dict[str, str] = {}
    columns = list(frame.columns)

    def compute(f: DataFrame) -> DataFrame:
        for depth in sorted(levels):
            new = {}
            for text, node in levels[depth].items():
                if node.op == "column":
                    known[text] = node.params[0]
                    continue
                known[text] = name = f"_x{len(known)}"
                if node.op == "rolling_rank":
                    f = sliding_rank(f, known[node.parts[0].text()], node.params[0], name)
                else:
                    new[name] = _compile(node, known)
            if new:
                f = f.withColumns(new)
        return f

    reach = max((tree.lookback for tree in trees.values()), default=0)
    frame = in_blocks(frame, compute, before=reach) if reach else compute(frame)
    return frame.select(*columns, *(F.col(known[t.text()]).alias(n) for n, t in trees.items()))
