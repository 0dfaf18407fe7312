"""Factor expressions: prefix stacks and text to trees, trees to columns of a flow. Equal subtrees are computed once."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cross_section import OPERATORS
from ..operators.time_series import FAMILIES
from . import flow
from .flow import Flow
from .stage import table_rows

#: User operators: name -> (arity, builder(flow, *names) -> name)
USER: dict[str, tuple] = {}
_COMMUTE = {"cs_add", "cs_mul", "cs_max", "cs_min", "cs_zscore_add", "cs_zscore_mul", "cs_zscore_min", "cs_zscore_max"}
_SAME = {"ts_last": "ts_delay", "ts_yoy": "ts_qoq", "ts_growth": "ts_pct", "ts_diff1q": "ts_delta", "ts_diff4q": "ts_delta"}


@dataclass(frozen=True)
class Node:
    op: str  # an operator's name, 'feature' or 'const'
    args: tuple = ()
    d: int | None = None
    value: object = None

    def __str__(self) -> str:
        if self.op in ("feature", "const"):
            return f"`{self.value}`" if self.op == "feature" else repr(self.value)
        return f"{self.op}{f'_{self.d}' if self.d is not None else ''}({', '.join(map(str, self.args))})"

    def depth(self) -> int:
        return 1 + max((a.depth() for a in self.args), default=-1)

    def length(self) -> int:
        return 1 + sum(a.length() for a in self.args)

    def nodes(self):
        yield self
        for a in self.args:
            yield from a.nodes()


def lookup(name: str) -> tuple[str, int | None, int]:
    """(operator, d, arity) of cs_<op>, ts_<family>_<d> for any whole d, or a user operator."""
    if name in USER:
        return name, None, USER[name][0]
    if name in OPERATORS:
        return name, None, OPERATORS[name][0]
    m = re.fullmatch(r"ts_(\w+?)_(\d+)", name)
    if m and m[1] in FAMILIES:
        return f"ts_{m[1]}", int(m[2]), FAMILIES[m[1]][0]
    raise KeyError(f"no operator {name}")


def from_stack(stack: list, features: list[str]) -> Node:
    """A prefix list of operator names, feature numbers (int) and constants (float)."""

    def read(i: int) -> tuple[Node, int]:
        x = stack[i]
        if isinstance(x, str):
            op, d, arity = lookup(x)
            args, i = [], i + 1
            for _ in range(arity):
                a, i = read(i)
                args.append(a)
            return Node(op, tuple(args), d), i
        return (Node("feature", value=features[x]) if isinstance(x, int) else Node("const", value=x)), i + 1

    tree, end = read(0)
    if end != len(stack):
        raise ValueError("the stack goes on after a whole expression")
    return tree


def to_stack(tree: Node, features: list[str]) -> list:
    if tree.op == "feature":
        return [features.index(tree.value)]
    if tree.op == "const":
        return [tree.value]
    return [tree.op + (f"_{tree.d}" if tree.d is not None else ""), *[x for a in tree.args for x in to_stack(a, features)]]


def parse(text: str) -> Node:
    """name(arg, arg); features bare or in backticks; numbers."""
    tokens = re.findall(r"`[^`]+`|[A-Za-z_]\w*|-?\d+\.?\d*(?:[eE][-+]?\d+)?|[(),]", text)

    def read(i: int) -> tuple[Node, int]:
        t = tokens[i]
        if i + 1 < len(tokens) and tokens[i + 1] == "(":
            op, d, arity = lookup(t)
            args, i = [], i + 2
            while tokens[i] != ")":
                a, i = read(i + (tokens[i] == ","))
                args.append(a)
            if len(args) != arity:
                raise ValueError(f"{t} takes {arity} arguments")
            return Node(op, tuple(args), d), i + 1
        if t[0] in "-0123456789":
            return Node("const", value=float(t)), i + 1
        return Node("feature", value=t.strip("`")), i + 1

    tree, end = read(0)
    if end != len(tokens):
        raise ValueError("text goes on after a whole expression")
    return tree


def canonical(t: Node) -> Node:
    """The same values under one name: aliases folded, arguments of commutative operators in order."""
    if not t.args:
        return t
    args = tuple(map(canonical, t.args))
    op = "cs_residual" if t.op == "cs_ortho" else _SAME.get(t.op, t.op)
    return Node(op, tuple(sorted(args, key=str)) if op in _COMMUTE else args, t.d)


def build(f: Flow, t: Node) -> str:
    """The column of a tree in a flow; each distinct canonical subtree has one."""
    t = canonical(t)
    if t not in f.memo:
        if t.op == "feature":
            f.memo[t] = t.value
        elif t.op == "const":
            f.memo[t] = f.ew(F.lit(float(t.value)))
        else:
            args = [build(f, a) for a in t.args]
            if t.op in USER:
                f.memo[t] = USER[t.op][1](f, *args)
            else:
                f.memo[t] = OPERATORS[t.op][1](f, *args) if t.op in OPERATORS else FAMILIES[t.op[3:]][1](f, *args, t.d)
    return f.memo[t]


def _flow(panel: DataFrame, trees: dict[str, Node], names: list[str]) -> tuple[Flow, dict[str, str]]:
    f = Flow(panel)
    return f, {n: build(f, trees[n]) for n in names}


def evaluate(panel: DataFrame, trees: dict[str, Node], width: int = 50, along: list[str] | None = None) -> list[DataFrame]:
    """The panel with the named expressions as columns, in batches of `width` so that no plan grows beyond what compiles well. With `along`, of the panel's own
    columns only its keys and those stay, as Flow.run has it; a user operator may read any, so all stay with one."""
    out, names = [], list(trees)
    for i in range(0, len(names), width):
        f, keep = _flow(panel, trees, names[i : i + width])
        out.append(f.run(keep, None if any(x.op in USER for n in keep for x in trees[n].nodes()) else along))
    return out


def batches(panel: DataFrame, trees: dict[str, Node], width: int = 50) -> list[list[str]]:
    """The names in batches of `width` at most, to be evaluated one after the other. Where written tables and exchanges of a batch of the panel's rows would hold more than
    HELD values, expressions that need neither go together, and of the others as many as hold that; what a batch takes of the disk does not grow with its width, then."""
    rows, names = table_rows(panel) or 0, list(trees)
    cut = lambda xs: [xs[i : i + width] for i in range(0, len(xs), width)]

    def held(some: list[str]) -> int:
        f, keep = _flow(panel, trees, some)
        return rows * f.held(keep)

    if not rows or all(held(some) <= flow.HELD for some in cut(names)):
        return cut(names)
    light: dict[tuple, list] = {}
    heavy: list[list[str]] = []
    for n in names:
        f, keep = _flow(panel, trees, [n])
        if not f.held(keep):
            light.setdefault(f.summed(), []).append(n)
        elif heavy and len(heavy[-1]) < width and held([*heavy[-1], n]) <= flow.HELD:
            heavy[-1].append(n)
        else:
            heavy.append([n])
    # sums by different keys want the panel written; without sums, an expression goes with any
    plain = light.pop((), [])
    first, *more = light.values() or [[]]
    return [some for group in (plain + first, *more) for some in cut(group)] + heavy


def register_operator(name: str, arity: int, build_, sample: DataFrame) -> None:
    """A user operator, taken after it gives finite or missing doubles on a small panel of ones, zeros and negatives."""
    f = Flow(sample.withColumns({f"u{i}": F.lit(float(v)) for i, v in enumerate((1, 0, -1))}))
    steps = {f"o{i}": build_(f, *[f"u{i}"] * arity) for i in range(3)}
    bad = f.run(steps).select([F.max(F.isnan(F.col(o)) | (F.abs(F.col(o)) == float("inf"))).alias(o) for o in steps]).first()
    if any(bad):
        raise ValueError(f"{name} is not closed on ones, zeros and negatives")
    USER[name] = (arity, build_)


#: Functions that can be applied to what a program gives, under their names.
TRANSFORMERS: dict[str, Callable[[Column], Column]] = {"sigmoid": lambda x: 1 / (1 + F.exp(-x))}


def register_transformer(name: str, f: Callable[[Column], Column], spark: SparkSession) -> None:
    """An output transformer: one column to one column of finite or missing doubles, tried on ones, zeros and negatives first."""
    got = spark.createDataFrame([(v,) for v in (1.0, 0.0, -1.0)], "x double").select(f(F.col("x")).cast("double").alias("y")).collect()
    if any(r.y is not None and not math.isfinite(r.y) for r in got):
        raise ValueError(f"{name} is not finite on ones, zeros and negatives")
    TRANSFORMERS[name] = f


def transformed(df: DataFrame, names: list[str], transformer: str | None) -> DataFrame:
    """df with the named columns as the transformer makes them; as they are without one."""
    if transformer is None:
        return df
    if transformer not in TRANSFORMERS:
        raise KeyError(f"no transformer {transformer}")
    return df.withColumns({n: TRANSFORMERS[transformer](F.col(n)) for n in names})
