"""Trees: Newick text, bipartitions, ancestors and distances."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from helixframe.session import stored


@dataclass
class Node:
    name: str = ""
    length: float | None = None
    children: list["Node"] = field(default_factory=list)
    support: float | None = None

    def leaves(self) -> list[str]:
        return [n.name for n in walk(self) if not n.children]

    def newick(self) -> str:
        inner = f"({','.join(c.newick() for c in self.children)})" if self.children else ""
        label = self.name if self.support is None else f"{self.support:g}"
        return inner + label + ("" if self.length is None else f":{self.length:g}")


def parse_newick(text: str) -> Node:
    """Root of a Newick tree; numbers that name inner nodes are support values, brought to [0, 1] where any exceeds 1. Bracketed comments are skipped."""
    at = 0
    clean, depth = [], 0
    for c in text.strip().rstrip(";"):
        depth += c == "["
        if not depth:
            clean.append(c)
        depth -= c == "]"
    s = "".join(clean)

    def label() -> tuple[str, float | None]:
        nonlocal at
        start = at
        if at < len(s) and s[at] in "'\"":
            end = s.index(s[at], at + 1)
            name, at = s[at + 1 : end], end + 1
        else:
            while at < len(s) and s[at] not in ",():":
                at += 1
            name = s[start:at].strip()
        length = None
        if at < len(s) and s[at] == ":":
            start = at = at + 1
            while at < len(s) and s[at] not in ",()":
                at += 1
            length = float(s[start:at])
        return name, length

    # iterative, so that depth is not bounded by the interpreter
    root = Node()
    stack = [root]
    while at < len(s):
        if s[at] == "(":
            node = Node()
            stack[-1].children.append(node)
            stack.append(node)
            at += 1
        elif s[at] == ",":
            at += 1
        elif s[at] == ")":
            at += 1
            node = stack.pop()
            node.name, node.length = label()
            try:
                node.support, node.name = float(node.name), ""
            except ValueError:
                pass
        elif s[at].isspace():
            at += 1
        else:
            name, length = label()
            stack[-1].children.append(Node(name, length))
    top = root.children[0] if len(root.children) == 1 else root
    every = [n for n in walk(top) if n.support is not None]
    if every and max(n.support for n in every) > 1:
        scale = max(n.support for n in every)
        for n in every:
            n.support /= scale
    return top


def walk(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += reversed(n.children)
    return out


def bipartitions(root: Node, least_support: float = 0.0) -> set[frozenset]:
    """Splits of the leaves by inner edges, each as the side without the first leaf by name; weakly supported ones are left out."""
    every = frozenset(root.leaves())
    first = min(every)
    out = set()
    for n in walk(root):
        if n is root or not n.children or (n.support is not None and n.support < least_support):
            continue
        side = frozenset(n.leaves())
        side = every - side if first in side else side
        if 1 < len(side) < len(every) - 1:
            out.add(side)
    return out


def path_to_root(root: Node, name: str) -> list[Node]:
    stack = [(root, [root])]
    while stack:
        n, path = stack.pop()
        if n.name == name and not n.children:
            return path[::-1]
        stack += [(c, [*path, c]) for c in n.children]
    raise KeyError(name)


def lca(root: Node, a: str, b: str) -> Node:
    above = {id(n) for n in path_to_root(root, b)}
    return next(n for n in path_to_root(root, a) if id(n) in above)


def leaf_distance(root: Node, a: str, b: str) -> float:
    """Sum of branch lengths on the way between two leaves (missing ones count 0)."""
    top = lca(root, a, b)
    total = 0.0
    for name in (a, b):
        for n in path_to_root(root, name):
            if n is top:
                break
            total += n.length or 0.0
    return total


def ancestors(edges: DataFrame, child: str, parent: str, max_depth: int = 64) -> DataFrame:
    """(node, ancestor, steps) of a forest of (child, parent) rows by doubling: log2(depth) joins, each to a stored table. Rounds for ``max_depth`` come first; where chains are longer, more follow until all are whole. Raises on a cycle."""
    reach = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps"))

    def doubled(reach: DataFrame) -> DataFrame:
        step = reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_far"), F.col("steps").alias("_more"))
        further = reach.join(step, "ancestor").select("node", F.col("_far").alias("ancestor"), (F.col("steps") + F.col("_more")).alias("steps"))
        return stored(reach.unionByName(further).distinct(), "ancestors")  # a round uses what it has twice

    for _ in range(max(1, (max_depth - 1).bit_length())):
        reach = doubled(reach)
    # after k rounds all ancestors up to 2^k steps are there: the longest chain tells whether more are needed
    done = 1 << max(1, (max_depth - 1).bit_length())
    while True:
        if reach.where(F.col("node") == F.col("ancestor")).limit(1).count():
            raise ValueError("the edges hold a cycle")
        if (reach.agg(F.max("steps")).first()[0] or 0) < done:
            return reach
        reach, done = doubled(reach), done * 2


def newick_edges(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, child, parent, length, support, leaf) of every edge of Newick texts, one tree a row. Inner nodes without a name are numbered in the order of ``walk``, ``#0`` the root; a null text gives none."""

    def rows(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                if not isinstance(t, str) or not t.strip():
                    continue
                names, root = {}, parse_newick(t)
                for n in walk(root):
                    names[id(n)] = n.name or f"#{len(names)}"
                out += [(k, names[id(c)], names[id(n)], c.length, c.support, not c.children) for n in walk(root) for c in n.children]
            yield pd.DataFrame(out, columns=[key, "child", "parent", "length", "support", "leaf"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(rows, f"`{key}` {kind}, child string, parent string, length double, support double, leaf boolean")


def newick_splits(df: DataFrame, key: str, text: str, least_support: float = 0.0) -> DataFrame:
    """(key, side, support): the splits of each Newick text's leaves by its inner edges, as the sorted side without the first leaf by name, in the greatest support; weakly supported ones are left out."""

    def rows(batches):
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                if not isinstance(t, str) or not t.strip():
                    continue
                root = parse_newick(t)
                support: dict[frozenset, float] = {}
                every = frozenset(root.leaves())
                first = min(every)
                for n in walk(root):
                    if n.support is None or not n.children:  # a leaf makes no split
                        continue
                    side = frozenset(n.leaves())
                    side = every - side if first in side else side
                    support[side] = max(support.get(side, 0.0), n.support)
                out += [(k, sorted(s), support.get(s)) for s in bipartitions(root, least_support)]
            yield pd.DataFrame(out, columns=[key, "side", "support"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(rows, f"`{key}` {kind}, side array<string>, support double")
