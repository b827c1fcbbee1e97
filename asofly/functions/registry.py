"""A registry of factors, and bounded enumeration of expression trees."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice, permutations, product

from pyspark.sql import Column, DataFrame

from asofly.functions.expressions import Node
from asofly.operators.timeblocks import in_blocks


#: Windowed operations of the grammar, in order.
GRAMMAR = ("lag", "delta", "percent_change", "rolling_mean", "rolling_std", "zscore", "rolling_rank")


class Registry:
    """Named factors: the columns they need, a builder of their column, and how many of an asset's rows it reaches back and
    ahead. Rows are never dropped or reordered."""

    def __init__(self):
        self.known: dict[str, tuple[list[str], Callable[[], Column], int, int]] = {}

    def add(self, name: str, needs: list[str], build: Callable[[], Column], *, before: int = 0, after: int = 0) -> None:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = (needs, build, before, after)

    def compute(self, frame: DataFrame, names: list[str]) -> DataFrame:
        missing = {c for n in names for c in self.known[n][0]} - set(frame.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        columns = {n: self.known[n][1]() for n in names}
        before, after = (max((self.known[n][i] for n in names), default=0) for i in (2, 3))
        return in_blocks(frame, lambda f: f.withColumns(columns), before=before, after=after)


def grow(columns: list[str], windows: list[int], *, depth: int, unary: tuple[str, ...] = GRAMMAR, binary: tuple[str, ...] = ("safe_ratio", "add", "subtract")) -> Iterator[Node]:
    """Trees of a small grammar, best first: the shallowest, of these those that look back least, then in order of text.

    A tree is a column, a windowed operation over another tree, or an operation over two of which one is as deep as allowed.
    A heap holds what is next; a tree that comes out is combined with those that came out before it, and trees of equal
    canonical text come out once. Only what is asked for is made.
    """
    heap: list[tuple[int, int, str, Node]] = []
    seen: set[str] = set()
    out: list[Node] = []

    def push(tree: Node) -> None:
        text = tree.text()
        if text not in seen and tree.depth <= depth:
            seen.add(text)
            heapq.heappush(heap, (tree.depth, tree.lookback, text, tree))

    for c in columns:
        push(Node.column(c))
    while heap:
        tree = heapq.heappop(heap)[-1]
        yield tree
        if tree.depth == depth:
            continue
        for op, n in product(unary, windows):
            push(Node(op, (tree,), (n,)))
        for other in out:
            for op in binary:
                for a, b in ((tree, other), (other, tree)):
                    push(a.ratio(b) if op == "safe_ratio" else Node(op, (a, b)))
        out.append(tree)


def enumerate_trees(columns: list[str], windows: list[int], *, depth: int = 3, most: int = 100) -> list[Node]:
    """The first `most` trees of the grammar, best first."""
    return list(islice(grow(columns, windows, depth=depth), most))


@dataclass(frozen=True)
class SearchSpace:
    """What candidates are made of. The defaults are fixed values."""

    windows: tuple[int, ...] = (6, 12, 24, 48, 168)
    unary: tuple[str, ...] = ("lag", "delta", "zscore", "rolling_rank")
    binary: tuple[str, ...] = ("add", "subtract", "multiply", "safe_ratio")
    columns: tuple[str, ...] = ("close", "volume", "high", "low")
    depth: int = 3
    most: int = 20
    seed: int = 7

    def __post_init__(self):
        if self.most <= 0 or self.depth <= 0:
            raise ValueError("most and depth must be positive")

    def digest(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()


@dataclass(frozen=True)
class Candidate:
    """A generated factor: its tree, its place in the search, how far it looks back, and the hash of the space it is from."""

    name: str
    tree: Node
    rank: int
    lookback: int
    space: str

    @property
    def factor_id(self) -> str:
        return f"candidate.{self.tree.digest()}"


def _templates(windows: tuple[int, ...]) -> Iterator[tuple[str, Node]]:
    """Factors with an economic reading come before the rest of the grammar."""
    close, volume = Node.column("close"), Node.column("volume")
    for n in windows:
        yield f"momentum_{n}", close.percent_change(n)
        yield f"volatility_{n}", close.rolling_std(n)
        yield f"volume_trend_{n}", volume.rolling_mean(n)
        yield f"zscore_close_{n}", close.zscore(n)
        yield f"rank_close_{n}", close.rolling_rank(n)


def _samples(space: SearchSpace) -> list[tuple[str, Node]]:
    """Single windowed columns, and operations over the means of two columns, in the order of a hash of the seed and the tree."""
    columns = [c for c in space.columns if c not in ("label", "target", "y")]
    found = [(f"{op}_{c}_{n}", Node(op, (Node.column(c),), (n,))) for c, n, op in product(columns, space.windows, space.unary)]
    for n, op, (a, b) in product(space.windows, space.binary, permutations(columns, 2)):
        x, y = Node.column(a).rolling_mean(n), Node.column(b).rolling_mean(n)
        found.append((f"{op}_{a}_{b}_{n}", x.ratio(y) if op == "safe_ratio" else Node(op, (x, y))))
    return sorted(found, key=lambda f: hashlib.sha256(f"{space.seed}:{f[1].text()}".encode()).digest())


def candidates(space: SearchSpace) -> list[Candidate]:
    """Templates, then samples of the grammar, each tree (by canonical text) once and none too deep, up to `most`, which
    is twenty at most. The same space gives the same candidates in the same order."""
    kept: dict[str, tuple[str, Node]] = {}
    for name, tree in chain(_templates(space.windows), _samples(space)):
        if tree.depth <= space.depth and len(kept) < min(space.most, 20):
            kept.setdefault(tree.text(), (name, tree))
    return [Candidate(name, tree, i, tree.lookback, space.digest()) for i, (name, tree) in enumerate(kept.values())]
