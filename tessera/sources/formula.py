"""Feature formulas over statement fields: names, TTM(name), QTR(name), diff1q(...), diff4q(...) and a / b, as columns of a dense panel."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a formula can call.
CALLS = ("TTM", "QTR", "diff1q", "diff4q")


def parse_formula(text: str) -> tuple:
    """("field", name), ("call", function, part) or ("over", part, part) of

        formula: part [ "/" formula ]        part: function "(" formula ")" | "(" formula ")" | field
    """
    words = re.findall(r"[()/]|[^()/\s][^()/]*", text)

    def formula(i: int) -> tuple[tuple, int]:
        left, i = part(i)
        if words[i : i + 1] != ["/"]:
            return left, i
        right, i = formula(i + 1)
        return ("over", left, right), i

    def part(i: int) -> tuple[tuple, int]:
        word = words[i].strip() if i < len(words) else ""
        called = word in CALLS and words[i + 1 : i + 2] == ["("]
        if called or word == "(":
            inner, i = formula(i + 1 + called)
            if words[i : i + 1] != [")"]:
                raise ValueError(f"a parenthesis is missing in {text}")
            return (("call", word, inner) if called else inner), i + 1
        if word in ("", ")", "/"):
            raise ValueError(f"a field is missing in {text}")
        return ("field", word), i + 1

    tree, end = formula(0)
    if end != len(words):
        raise ValueError(f"{text} goes on after a whole formula")
    return tree


def with_formulas(df: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """df (entity, qidx, fields; dense) with a column for each formula. TTM is the sum of four quarters that are all there, QTR the quarter's own value, diff1q
    and diff4q the difference to one and four quarters before, a / b null where b is 0 or missing. A field that is not there is an error.

    Parts that formulas share are computed once; each step takes one window by entity, and all of them one exchange.
    """
    by = Window.partitionBy("entity").orderBy("qidx")
    year = by.rowsBetween(-3, 0)
    along = {
        "TTM": lambda x: F.when(F.count(x).over(year) == 4, F.sum(x).over(year)), "QTR": F.col,
        "diff1q": lambda x: F.col(x) - F.lag(x, 1).over(by), "diff4q": lambda x: F.col(x) - F.lag(x, 4).over(by),
    }
    steps: dict[tuple, tuple[str, int]] = {}
    layers: list[dict[str, Column]] = []

    def column(tree: tuple) -> tuple[str, int]:
        """The name of a formula's column and the layer from which it is there."""
        if tree in steps:
            return steps[tree]
        kind, *parts = tree
        if kind == "field":
            if parts[0] not in df.columns:
                raise KeyError(f"no field {parts[0]}")
            return parts[0], 0
        if kind == "call":
            x, at = column(parts[1])
            made = along[parts[0]](x)
        else:
            (a, i), (b, j) = map(column, parts)
            at, made = max(i, j), F.when(F.col(b) != 0, F.col(a) / F.col(b))
        while len(layers) <= at:
            layers.append({})
        steps[tree] = f"_f{len(steps)}", at + 1
        layers[at][steps[tree][0]] = made
        return steps[tree]

    names = {out: column(parse_formula(text))[0] for out, text in formulas.items()}
    done = df
    for layer in layers:
        done = done.withColumns(layer)
    return done.select(*df.columns, *[F.col(x).alias(out) for out, x in names.items()])
