"""Scores of a batch of expressions: all their values as one table, a row an expression and cell, summed by expression and date.

Ranks of all expressions are taken at once: rows are counted by expression, date and value, that table is range-partitioned by the three, and a value's rank is
the number of rows before its range and before it in its range. No date, and no expression, is one task's.

Metrics that give one number a factor, those that a user registers among them, take a pass over the panel a program.
"""

from __future__ import annotations

import inspect
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import flow
from ..plans.expression import Node, batches, canonical, evaluate
from ..plans.stage import dealt, passing, spread, table_rows, tasks, written
from ..sources.results import union_all
from . import fitness
from .fitness import neutral
from .ranking import with_ranks

c = F.col

#: Operators that map a date's values by a rising line, which no correlation across the date sees.
_LINES = {"cs_zscore", "cs_demean"}
#: Metrics that give a number a date, and whether they are of percentile ranks.
METRICS = {"pearson": False, "alert_pearson": False, "spearman": True, "alert_ic": True, "neutral_ic": True}
#: What a factor without a value scores by a metric that has a sign, and by one of a whole factor.
NOTHING, NO_FIGURE = -1.0, -100.0


@dataclass(frozen=True)
class Rule:
    """What a search asks of a factor. A date counts if at least `coverage` of its unrestricted entities have a value, no date if the mean over dates is lower; it
    needs `pairs` of value and label, and a factor a date for at least `share` of those with labels. Styles are taken out of the label by neutral metrics.

    The metric is one of METRICS, or any that fitness.METRICS has: such a one gives a number for the whole factor, masked by coverage where it masks, and asks for no
    pairs and dates but its own."""

    metric: str = "pearson"
    coverage: float = 0.9
    pairs: int = 100
    share: float = 2 / 3
    styles: tuple[str, ...] = ()


def bare(t: Node) -> tuple[Node, bool]:
    """The tree under the outermost operators that leave a date's correlations as they are, and whether a standardisation was among them."""
    standardised = False
    while t.op in _LINES:
        standardised |= t.op == "cs_zscore"
        t = t.args[0]
    return t, standardised


def _long(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """name, period, v, label of unrestricted cells that have a value."""
    if "restricted" in df.columns:
        df = df.where("not restricted")
    long = df.select("period", c(label).alias("label"), *[c(n).cast("double").alias(n) for n in names]).unpivot(["period", "label"], names, "name", "v")
    return long.where(c("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < 1e15))


def _open(panel: DataFrame, label: str) -> dict:
    """For each date its number of unrestricted cells and whether it has labels."""
    free = F.count(F.when(~c("restricted"), 1)) if "restricted" in panel.columns else F.count(F.lit(1))
    return {r.period: (r.n, r.labels > 0) for r in panel.groupBy("period").agg(free.alias("n"), F.count(label).alias("labels")).collect()}


def _covered(counts: dict, dates: dict, least: float) -> set:
    """The dates on which an expression with so many values a date counts."""
    if least <= 0:
        return set(counts)
    share = {p: counts.get(p, 0) / n for p, (n, _) in dates.items() if n}
    if not share or math.fsum(share.values()) / len(share) < least:
        return set()
    return {p for p, x in share.items() if x >= least}


def rank_ics(long: DataFrame, pairs: int, different: int = 0) -> DataFrame:
    """name, period, ic: the correlation of each expression's percentile ranks, among all of a date's values, with the label over the cells that have both. `different` is
    about how many values of a date and expression are different in all, where that is known: they are counted in as many tasks then."""
    values = written(spread(different, long, "name", "period", "v").groupBy("name", "period", "v").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("m"), F.sum("label").alias("s")))
    n = table_rows(values)
    order = ("name", "period", "v")
    many = tasks(n, long.sparkSession)
    ranged = written((values.repartitionByRange(many, *order) if many else values.repartitionByRange(*order)).withColumn("range", F.spark_partition_id()))
    of = Window.partitionBy("name", "period")
    heads = ranged.groupBy("name", "period", "range").agg(F.sum("n").alias("t"))  # ranges, and one more an expression and date
    heads = heads.select("name", "period", "range", F.sum("t").over(of).alias("whole"), (F.sum("t").over(of.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - c("t")).alias("before"))
    inside = Window.partitionBy("name", "period", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread(n, ranged.join(F.broadcast(heads), ["name", "period", "range"]), "name", "period", "range")
    r = (c("before") + F.sum("n").over(inside) - c("n") + (c("n") + 1) / 2) / c("whole") - 0.5
    sums = ranked.select("name", "period", "m", "s", r.alias("r")).groupBy("name", "period").agg(F.sum("m").alias("m"), F.sum(c("m") * c("r")).alias("r1"), F.sum(c("m") * c("r") * c("r")).alias("r2"), F.sum(c("r") * c("s")).alias("rs"))
    labels = long.where("label is not null").groupBy("name", "period").agg(F.avg("label").alias("mean"), F.stddev_pop("label").alias("dev"))
    both = sums.join(labels, ["name", "period"]).where(c("m") >= max(2, pairs))
    dev = F.sqrt(F.greatest(F.lit(0.0), c("r2") / c("m") - (c("r1") / c("m")) ** 2)) * c("dev")
    return both.select("name", "period", F.when(dev > 1e-12, (c("rs") / c("m") - c("r1") / c("m") * c("mean")) / dev).alias("ic")).where("ic is not null")


def ic_series(panel: DataFrame, trees: list[Node], label: str, width: int = 50, min_pairs: int = 30, rule: Rule | None = None) -> dict[str, dict]:
    """For each distinct canonical tree its IC of each date that counts. A number a tree and date reaches the driver.

    Correlations of values take one pass a batch, in which cells are counted too; a tree whose outermost operators only move and stretch a date's values is
    scored by what is under them. Those of ranks take two: the first counts cells, and only trees that pass are ranked in the second.
    """
    rule = rule or Rule(coverage=0.0, pairs=min_pairs, share=0.0)
    if rule.metric not in METRICS:
        return whole_figures(panel, trees, label, rule, width)
    with passing(panel.sparkSession):
        names = {f"_e{i}": t for i, t in enumerate(dict.fromkeys(map(canonical, trees)))}
        dates = _open(panel, label) if rule.coverage > 0 else {}
        ics, ranked = {str(t): {} for t in names.values()}, METRICS[rule.metric]
        if ranked:
            if rule.metric == "neutral_ic":
                panel, label = neutral(panel, label, list(rule.styles)), "_residual"
            panel = with_ranks(panel, {"_rank": label}).withColumn("_rank", c("_rank") / c("_rank_n")).drop("_rank_n")
            panel, label = dealt(written(panel)), "_rank"
        under = {n: (t, False) if ranked else bare(t) for n, t in names.items()}
        # a row a value: one small aggregation over all trees, where hundreds of aggregates side by side would make code too long to compile well
        x, y = F.when(c("label").isNotNull(), c("v")), F.when(c("v").isNotNull(), c("label"))
        sd = F.stddev_pop(x) * F.stddev_pop(y)
        ic = F.when((F.count(x) >= max(2, rule.pairs)) & (sd > 1e-12), F.covar_pop(x, y) / sd)
        # ranks of values are of a table of all a batch's values
        at_once = max(1, flow.HELD // (flow.TAKEN * (table_rows(panel) or 1)))
        for some in batches(panel, {n: t for n, (t, _) in under.items()}, width):
            with passing(panel.sparkSession):  # a batch's tables go with it
                (df,) = evaluate(panel, {n: under[n][0] for n in some}, width, [label])
                figures = [F.count(F.lit(1)).alias("cells")] + ([F.approx_count_distinct("v").alias("different")] if ranked else [ic.alias("ic"), F.stddev_samp("v").alias("spread")])
                rows = _long(df, some, label).groupBy("name", "period").agg(*figures).collect()
                counts: dict[str, dict] = {n: {} for n in some}
                for r in rows:
                    # a date on which values hardly vary has no standardised ones
                    if ranked or not under[r.name][1] or (r.spread or 0.0) >= 1e-10:
                        counts[r.name][r.period] = r.cells
                covered = {n: _covered(counts[n], dates, rule.coverage) for n in some}
                if ranked:
                    able = [n for n in some if covered[n]]
                    counted, rows = rows, []
                    for i in range(0, len(able), at_once):
                        with passing(panel.sparkSession):
                            part = able[i : i + at_once]
                            (df,) = evaluate(panel, {n: names[n] for n in part}, width, [label])
                            rows += rank_ics(_long(df, part, label), rule.pairs, sum(r.different for r in counted if r.name in part)).collect()
                for r in sorted(rows, key=lambda r: r.period):
                    if r.ic is not None and r.period in covered[r.name]:
                        ics[str(names[r.name])][r.period] = r.ic
    return ics


def whole_figures(panel: DataFrame, trees: list[Node], label: str, rule: Rule, width: int = 50) -> dict[str, dict]:
    """For each distinct canonical tree its figure by a metric of a whole factor, under no date (None), turned round where less is better; a row a tree reaches the
    driver, `width` of them a job. A metric that takes `by` is computed of one table of all their values, others in a pass over the panel a program."""
    if rule.metric not in fitness.METRICS:
        raise KeyError(f"no search goes by {rule.metric}")
    f, better = fitness.METRICS[rule.metric]
    takes = inspect.signature(f).parameters
    options = {k: v for k, v in (("styles", list(rule.styles)), ("least", rule.coverage)) if k in takes}
    names, out = list(dict.fromkeys(map(canonical, trees))), {}
    value = c("value").cast("double").alias("value")
    with passing(panel.sparkSession):
        panel = written(fitness.prepared(rule.metric, panel, label, list(rule.styles)) if "by" in takes else panel)  # every program reads it
        for i in range(0, len(names), width):
            some, got = names[i : i + width], {}
            with passing(panel.sparkSession):
                if "by" in takes:
                    (df,) = evaluate(panel, {f"_e{k}": t for k, t in enumerate(some)}, width)
                    keep = list(dict.fromkeys(["period", "restricted", label, *[n for n in ("_residual", "_residual_rank") if n in panel.columns]]))
                    cells = df.select(*keep, *[c(f"_e{k}").cast("double").alias(f"_e{k}") for k in range(len(some))])
                    long = cells.unpivot(keep, [f"_e{k}" for k in range(len(some))], "_name", "_factor")
                    got = {int(r._name[2:]): r.value for r in f(long, "_factor", label, by=("_name",), **options).select("_name", value).collect()}
                # a factor without any row in that table has what the metric gives for none
                if left := [k for k in range(len(some)) if k not in got]:
                    figures = union_all([f(evaluate(panel, {"_factor": some[k]})[0], "_factor", label, **options).select(F.lit(k).alias("k"), value) for k in left])
                    got |= {r.k: r.value for r in figures.collect()}
            for k, t in enumerate(some):
                v = got.get(k)
                out[str(t)] = {} if v is None or not math.isfinite(v) else {None: v if better or v == NO_FIGURE else -v}
    return out


def labelled(panel: DataFrame, label: str) -> int:
    """The number of dates that have labels."""
    return sum(has for _, has in _open(panel, label).values())


def fitness_of(ics: dict, rule: Rule | None = None, dates: int = 0) -> float:
    """One number of a factor's ICs: abs of their mean, the mean itself by an alert metric; -1 without enough of them. The figure itself by a metric that gives one; -100 without."""
    if rule and rule.metric not in METRICS:
        return ics.get(None, NO_FIGURE)
    if not ics or rule and len(ics) < math.ceil(rule.share * dates):
        return NOTHING
    mean = math.fsum(ics.values()) / len(ics)
    return mean if rule and rule.metric.startswith("alert_") else abs(mean)


def score(panel: DataFrame, trees: list[Node], label: str, width: int = 50, min_pairs: int = 30, rule: Rule | None = None) -> dict[str, float]:
    """The fitness of each distinct canonical tree."""
    dates = labelled(panel, label) if rule else 0
    return {n: fitness_of(ics, rule, dates) for n, ics in ic_series(panel, trees, label, width, min_pairs, rule).items()}
