"""Layers of a panel computation: elementwise, along time, sums over a date, across a date. Each layer is one select over as few exchanges as its windows allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import buckets, dropped, spread, table_rows, written

#: Ranges of values that a date's rows are ranked in.
PARTS = 16

#: Values that the written tables and the exchanges across dates of one batch hold at most; a single expression may need more.
HELD = 1 << 28

#: Values of a row that an exchange across dates takes along, about.
TAKEN = 5

#: What operators read of a panel besides their arguments.
KEYS = ("entity", "period", "qidx", "industry", "restricted")


class Flow:
    """Named columns to be computed over a dense panel (entity, qidx, period, industry, ...), and what each one needs.

    Steps are collected first. run() then computes, again and again, all elementwise steps that are ready, all ready
    time-series steps (one exchange by entity), all ready sums over a date, all ready cross-section steps (one exchange by period), so that work
    along time never waits behind work across dates it doesn't need.

    A figure of a whole date (a mean, a deviation, a slope) is a sum: it is aggregated where the rows are and comes back by broadcast, so the
    panel is not moved for it. A calendar bounds that table: a century of days has 36,525 rows, times the industries where
    sums are by industry. Sums and rows both come of the panel below them, so that is read twice; where it holds such sums itself, or where sums by several
    keys want it, it is written once first. What is read grows with the number of levels, then, and does not double with each.

    A table that was written has lost its exchange by entity; the next one deals it to as many tasks as it has rows for.

    Only ranks need the rows of a date in order. They are taken in `parts` ranges of values apart, so that a date is no one's task, for two more aggregations.
    """

    def __init__(self, df: DataFrame, parts: int = PARTS):
        self.df, self.steps, self.memo, self.parts = df, {}, {}, parts
        self.count = 0

    def step(self, kind: str | tuple, col: Column, deps: tuple[str, ...]) -> str:
        name = f"_s{self.count}"
        self.count += 1
        self.steps[name] = (kind, col, tuple(d for d in deps))
        return name

    def ew(self, col: Column, *deps: str) -> str:
        return self.step("EW", col, deps)

    def ts(self, col: Column, *deps: str) -> str:
        return self.step("TS", col, deps)

    def ag(self, col: Column, *deps: str, by: tuple[str, ...] = ("period",)) -> str:
        """An aggregate over the rows that share `by`, for each of those rows."""
        return self.step(("AG", by), col, deps)

    def cs(self, col: Column, *deps: str, by: tuple[str, ...] = ("period",)) -> str:
        """A window over the rows that share `by`."""
        return self.step(("CS", by), col, deps)

    def run(self, keep: dict[str, str] | None = None, along: list[str] | None = None) -> DataFrame:
        """The panel with the columns in keep (new name -> step), or all steps. With `along`, of the panel's own columns only its keys and those stay, where the steps
        need no others; a table that was written on the way goes as soon as the next one is there, for work inside passing()."""
        df, base, n = self.df, self.df, buckets(self.df)
        rows, by_entity = None, n > 0
        columns = [x for x in df.columns if along is None or x in KEYS or x in along]
        for kind, what in self._stages(columns, keep, apart=along is not None and (table_rows(base) or 0) * TAKEN * self._exchanges(keep) > HELD):
            if kind == "EW":
                df = df.withColumns(what)
            elif kind == "TS":
                if not by_entity:
                    rows, by_entity = table_rows(base) if rows is None else rows, True
                    df = df.repartition(n, "entity") if n else spread(rows or 0, df, "entity")
                df = df.withColumns(what)
            elif kind == "write":
                needed, later = what
                df, before = df.select(*[x for x in df.columns if x in needed]), base
                if n and later and not by_entity:
                    df, by_entity = df.repartition(n, "entity"), True
                base = df = written(df, n if by_entity else 0)
                rows, by_entity = None, buckets(base) > 0
                if along is not None and before is not self.df:
                    dropped(before)
            elif kind == "AG":
                below = df
                for keys, cols in what.items():
                    df = df.join(F.broadcast(below.groupBy(*keys).agg(*cols)), [*keys], "left")
            else:
                if rows is None:
                    rows = table_rows(base)
                keys, cols = what
                df, by_entity = spread(rows or 0, df, *keys).withColumns(cols), False
        if keep is None:
            return df
        return df.select(*[x for x in columns if x not in keep], *[F.col(s).alias(n) for n, s in keep.items()])

    def _stages(self, columns: list[str], keep: dict[str, str] | None, apart: bool = False):
        """What run() does, in order: ("EW" or "TS", columns), ("write", the columns that stay and whether windows along time follow), ("AG", columns by keys),
        ("CS", keys and columns). With `apart`, a table is written between two exchanges across a date."""
        left, done = dict(self.steps), set(self.df.columns)
        levels = 0  # of sums since the panel was written
        out = set(keep.values()) if keep is not None else set(self.steps)

        def stays(*more: dict):
            wait = [step for steps in (left, *more) for step in steps.values()]
            return {d for _, _, deps in wait for d in deps} | set(columns) | out, any(kind == "TS" for kind, _, _ in wait)

        while left:
            moved = True
            while moved:
                moved = False
                for kind in ("EW", "TS"):
                    while ready := self._ready(left, done, lambda k: k == kind):  # noqa: B023
                        moved = True
                        yield kind, {n: c for n, (_, c, _) in ready.items()}
            if sums := self._ready(left, done, lambda k: k[0] == "AG"):
                by: dict[tuple, list] = {}
                for n, (kind, col, _) in sums.items():
                    by.setdefault(kind[1], []).append(col.alias(n))
                if levels + len(by) > 1:
                    yield "write", stays(sums)
                    levels = 0
                levels += 1
                yield "AG", by
            elif ready := self._ready(left, done, lambda k: k[0] == "CS"):
                over: dict[tuple, dict] = {}
                for n, step in ready.items():
                    over.setdefault(step[0][1], {})[n] = step
                while over:
                    keys = next(iter(over))
                    yield "CS", (keys, {n: c for n, (_, c, _) in over.pop(keys).items()})
                    if apart and over:
                        yield "write", stays(*over.values())
                        levels = 0

    def _exchanges(self, keep: dict[str, str] | None) -> int:
        return sum(kind == "CS" for kind, _ in self._stages([], keep))

    def held(self, keep: dict[str, str]) -> int:
        """Values of a row that written tables and exchanges across a date hold in run(), those of the panel left out; 0 for a flow that needs neither."""
        own = set(self.df.columns)
        return sum(len(what[0] - own) if kind == "write" else TAKEN * (kind == "CS") for kind, what in self._stages([], keep))

    def summed(self) -> tuple:
        """The keys of the flow's sums."""
        return tuple(sorted({kind[1] for kind, _, _ in self.steps.values() if kind[0] == "AG"}))

    @staticmethod
    def _ready(left: dict, done: set, fits) -> dict:
        """Takes the steps of a kind whose columns are there out of what is left."""
        ready = {n: s for n, s in left.items() if fits(s[0]) and all(d in done for d in s[2])}
        for n in ready:
            del left[n]
        done |= set(ready)
        return ready


def along(k: int) -> Window:
    """The last k rows of the entity, this one included."""
    return Window.partitionBy("entity").orderBy("qidx").rowsBetween(-(k - 1), 0)


def entity_rows() -> Window:
    return Window.partitionBy("entity").orderBy("qidx")


def across(*more: str) -> Window:
    return Window.partitionBy("period", *more)
