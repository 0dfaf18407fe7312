"""Correlations with what regressors leave of a label, from products summed by date: rows are read once, whatever is asked of them later."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import cut
from .metrics import slopes

c = F.col

#: Bytes of states that a task holds at a time: those of one date, or those it has not handed on yet.
HELD = 64 << 20
#: What is left of a label counts as nothing below this share of the label's variance: products can't tell it from rounding.
NOTHING = 1e-10

#: number of rows, means, sums of products about the means
State = tuple[float, np.ndarray, np.ndarray]


def _merged(a: State, b: State) -> State:
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _over(states: list[tuple[np.ndarray, State]], at: list[int]) -> State | None:
    """The state, of columns `at`, of the rows that have all of them."""
    out = None
    for there, (n, mean, prod) in states:
        if there[at].all():
            own = n, mean[at], prod[np.ix_(at, at)]
            out = own if out is None else _merged(out, own)
    return out


def _ratio(cov: float, a: float, b: float, n: float) -> float:
    sd = np.sqrt(max(a, 0.0) * max(b, 0.0)) / n
    return cov / n / sd if sd > 1e-12 else np.nan


class Moments:
    """For each date and each set of columns that its rows have: number, means, products. Correlations of any of the columns, over the rows that
    have what is asked for, follow from these states, a date at a time."""

    def __init__(self, states: DataFrame, columns: list[str]):
        self.states, self.at = states, {n: i for i, n in enumerate(columns)}

    @classmethod
    def of(cls, df: DataFrame, columns: list[str]) -> Moments | None:
        """None where the states would be larger than the rows they stand for, or those of a date than HELD: columns with nulls in too many combinations.

        Rows without a period take no part. They are written narrow, dealt out in ranges of dates (a large date goes to several tasks) and
        turned into states there; the states of a date then meet in one task, in order.
        """
        columns = list(dict.fromkeys(columns))
        k = len(columns)
        d = cut(df.where(c("period").isNotNull()).select("period", *[c(n).cast("double").alias(f"_{i}") for i, n in enumerate(columns)]))
        there = F.concat(*[F.when(c(f"_{i}").isNull(), "0").otherwise("1") for i in range(k)])
        kinds = d.groupBy("period", there.alias("there")).agg(F.count(F.lit(1)).alias("n")).groupBy("period").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
        most, kinds, n = kinds.agg(F.coalesce(F.max("kinds"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        size = 8 * (k * k + k + 1)
        if most * size > HELD or kinds * k > n:
            return None
        days = d.schema["period"].dataType.simpleString()

        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict = {}
            for pdf in batches:
                code, day = pd.factorize(pdf.period)
                x = pdf[[f"_{i}" for i in range(k)]].to_numpy(float)
                for i, p in enumerate(day):
                    own = x[code == i]
                    kind, of = np.unique(~np.isnan(own), axis=0, return_inverse=True)
                    for j, has in enumerate(kind):
                        v = np.where(has, own[of.reshape(-1) == j], 0.0)
                        mean = v.mean(axis=0)
                        s, key = (float(len(v)), mean, (v - mean).T @ (v - mean)), (p, has.tobytes())
                        held[key] = _merged(held[key], s) if key in held else s
                    if len(held) * size > HELD:
                        yield _table(held)
                        held = {}
            if held:
                yield _table(held)

        def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key = state = None
            for p, has, s in _read(batches, k):
                if (p, has) == key:
                    state = _merged(state, s)
                    continue
                if key is not None:
                    yield _table({key: state})
                key, state = (p, has), s
            if key is not None:
                yield _table({key: state})

        schema = f"period {days}, has binary, state binary"
        parts = d.repartitionByRange("period", F.xxhash64(*d.columns)).mapInPandas(add_up, schema)
        return cls(cut(parts.repartition("period").sortWithinPartitions("period", "has").mapInPandas(put_together, schema)), columns)

    def ics(self, label: str, known: list[str], names: list[str]) -> DataFrame:
        """period and, for each of names, its correlation with what a linear fit on the known columns leaves of the label, by date. The fit is over
        the rows that have label and all known, two at least; the correlation over those of them that have the column too."""
        xs, y, of = [self.at[n] for n in known], self.at[label], [self.at[n] for n in names]

        def figures(states: list) -> list[float]:
            fit = _over(states, [*xs, y])
            if fit is None or (xs and fit[0] < 2):
                return [np.nan] * len(of)
            b = slopes(fit[1], fit[2] / fit[0])
            w, out = np.append(-b, 1.0), []
            for f in of:
                s = _over(states, [*xs, y, f])
                left = 0.0 if s is None else w @ s[2][:-1, :-1] @ w
                out.append(np.nan if s is None or left <= NOTHING * s[2][-2, -2] else _ratio(w @ s[2][:-1, -1], left, s[2][-1, -1], s[0]))
            return out

        return self._by_date(figures, names)

    def like(self, name: str, names: list[str]) -> DataFrame:
        """period and, for each of names, its correlation with the column `name` by date."""
        own, of = self.at[name], [self.at[n] for n in names]

        def figures(states: list) -> list[float]:
            pairs = [_over(states, [own, f]) for f in of]
            return [np.nan if s is None else _ratio(s[2][0, 1], s[2][0, 0], s[2][1, 1], s[0]) for s in pairs]

        return self._by_date(figures, names)

    def _by_date(self, figures: Callable[[list], list[float]], names: list[str]) -> DataFrame:
        k, days = len(self.at), self.states.schema["period"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def row():
                return pd.DataFrame([[day, *figures(held)]], columns=["period", *[f"_{i}" for i in range(len(names))]])

            day, held = None, []
            for p, has, s in _read(batches, k):
                if held and p != day:
                    yield row()
                    held = []
                day = p
                held.append((np.frombuffer(has, bool), s))
            if held:
                yield row()

        per = self.states.mapInPandas(run, f"period {days}, " + ", ".join(f"_{i} double" for i in range(len(names))))
        return per.select("period", *[F.when(~F.isnan(f"_{i}"), c(f"_{i}")).alias(n) for i, n in enumerate(names)])


def _table(held: dict) -> pd.DataFrame:
    rows = [(p, has, np.concatenate([[n], mean, prod.ravel()]).tobytes()) for (p, has), (n, mean, prod) in held.items()]
    return pd.DataFrame(rows, columns=["period", "has", "state"])


def _read(batches: Iterator[pd.DataFrame], k: int) -> Iterator[tuple]:
    for pdf in batches:
        for p, has, raw in zip(pdf.period, pdf["has"], pdf["state"]):
            v = np.frombuffer(raw)
            yield p, has, (v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k))
