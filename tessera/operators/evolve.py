"""Seeded genetic search: trees change on the driver, whole generations are scored by Spark in batches."""

from __future__ import annotations

import json
import math
import random
from dataclasses import asdict, dataclass, fields

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expression import Node, canonical, evaluate, lookup, parse
from ..plans.stage import dealt, passing, written
from ..sources.store import IcStore
from .batch import Rule, fitness_of, ic_series, labelled, score  # noqa: F401  (scores of a batch go by the search's name too)

CONSTANT_OPS = {"cs_add", "cs_sub", "cs_mul", "cs_div", "cs_max", "cs_min"}


@dataclass(frozen=True)
class Settings:
    population: int = 40
    generations: int = 3
    warm_start: int = 2
    tournament: int = 5
    depth: tuple[int, int] = (1, 3)
    most_depth: int = 5
    crossover: float = 0.4
    subtree: float = 0.01
    hoist: float = 0.295
    point: float = 0.295
    point_replace: float = 0.4
    seed: int = 7
    replacement: str = "generational"
    originality: float = 0.0
    #: what a node costs; "auto" takes the covariance of lengths and scores over the variance of lengths
    parsimony: float | str = 0.0
    #: the search ends when a candidate reaches it
    stop: float = math.inf
    #: the most that a score of 0 takes off; a score of 10 takes nothing
    penalty_weight: float = 0.0

    def __post_init__(self):
        """Values as JSON has them: a depth can be a list."""
        object.__setattr__(self, "depth", tuple(self.depth))
        if self.replacement not in ("generational", "parent", "elitist"):
            raise ValueError(f"no such replacement: {self.replacement}")
        if min(self.population, self.warm_start, self.tournament) < 1 or self.generations < 0:
            raise ValueError("population, warm start and tournament are whole numbers from 1")

    def to_json(self) -> str:
        """One object; an endless `stop` is null."""
        return json.dumps({k: None if v == math.inf else v for k, v in asdict(self).items()}, indent=2, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Settings from one object; what it lacks has its usual value, and a name that is no setting is an error."""
        given = json.loads(text)
        if strange := set(given) - {f.name for f in fields(cls)}:
            raise KeyError(f"no such setting: {', '.join(sorted(strange))}")
        return cls(**{k: math.inf if k == "stop" and v is None else v for k, v in given.items()})


def grow(rng: random.Random, ops: list[str], features: list[str], depth: int, full: bool) -> Node:
    """A random tree; constants only under operators that take them."""
    def leaf(parent: str | None) -> Node:
        if parent in CONSTANT_OPS and rng.random() < 1 / (len(features) + 1):
            return Node("const", value=round(rng.uniform(-1, 1), 3))
        return Node("feature", value=rng.choice(features))

    def make(d: int, parent: str | None) -> Node:
        if d == 0 or (not full and parent and rng.randrange(len(ops) + len(features)) < len(features)):
            return leaf(parent)
        op, k, arity = lookup(rng.choice(ops))
        return Node(op, tuple(make(d - 1, op) for _ in range(arity)), k)

    return make(depth, None)


def _paths(t: Node, at: tuple = ()) -> list[tuple]:
    return [at, *[p for i, a in enumerate(t.args) for p in _paths(a, (*at, i))]]


def _get(t: Node, path: tuple) -> Node:
    for i in path:
        t = t.args[i]
    return t


def _put(t: Node, path: tuple, new: Node) -> Node:
    if not path:
        return new
    args = list(t.args)
    args[path[0]] = _put(args[path[0]], path[1:], new)
    return Node(t.op, tuple(args), t.d, t.value)


def pick(rng: random.Random, t: Node) -> tuple:
    """A place in a tree: an operator nine times of ten."""
    paths = _paths(t)
    inner = [p for p in paths if _get(t, p).args]
    return rng.choice(inner if inner and rng.random() < 0.9 else paths)


def child(rng: random.Random, s: Settings, parent: Node, donor: Node, ops: list[str], features: list[str]) -> tuple[str, Node]:
    """A method and what it makes of the parents; a tree that grows too deep gives way to its parent."""
    r = rng.random()
    if r < s.crossover:
        how, new = "crossover", _put(parent, pick(rng, parent), _get(donor, pick(rng, donor)))
    elif (r := r - s.crossover) < s.subtree:
        how, new = "subtree", _put(parent, pick(rng, parent), grow(rng, ops, features, rng.randint(*s.depth), False))
    elif (r := r - s.subtree) < s.hoist:
        at = pick(rng, parent)
        sub = _get(parent, at)
        how, new = "hoist", _put(parent, at, _get(sub, pick(rng, sub)))
    elif r - s.hoist < s.point:
        how, new = "point", parent
        for p in _paths(parent):
            if rng.random() < s.point_replace:
                old = _get(new, p)
                if old.args:
                    # an operator of a first tree stays where mutations have none of as many arguments
                    if same := [o for o in ops if lookup(o)[2] == len(old.args)]:
                        op, k, _ = lookup(rng.choice(same))
                        new = _put(new, p, Node(op, old.args, k))
                elif old.op == "feature":
                    new = _put(new, p, Node("feature", value=rng.choice(features)))
    else:
        how, new = "reproduction", parent
    return how, (new if new.depth() <= s.most_depth and new.args else parent)


def explained(series: dict[str, dict], components: int = 5) -> dict[str, float]:
    """The share of each candidate's variation over the periods that the leading components of all candidates' ICs explain. A missing period counts
    as the candidate's mean; 0 for a candidate without variation. A matrix of candidates by periods, on the driver."""
    periods = sorted({p for s in series.values() for p in s})
    if not series or not periods:
        return dict.fromkeys(series, 0.0)
    m = np.array([[s.get(p, np.nan) for p in periods] for s in series.values()], float)
    mean = np.array([math.fsum(s.values()) / len(s) if s else 0.0 for s in series.values()])
    m = np.where(np.isnan(m), mean[:, None], m) - mean[:, None]
    axes = np.linalg.svd(m, full_matrices=False)[2][:components]
    whole, along = (m**2).sum(axis=1), ((m @ axes.T) ** 2).sum(axis=1)
    return dict(zip(series, np.where(whole > 1e-18, along / np.maximum(whole, 1e-18), 0.0).tolist()))


def original_first(series: dict[str, dict], weight: float, components: int = 5, value=fitness_of) -> dict[str, float]:
    """The rank of each candidate by fitness less weight times its rank by the share that others explain; ranks from 1, ties by their mean."""
    fit, share = {n: value(s) for n, s in series.items()}, explained(series, components)
    rank = lambda v: {n: sum(x < v[n] for x in v.values()) + (sum(x == v[n] for x in v.values()) + 1) / 2 for n in v}
    by_fit, by_share = rank(fit), rank(share)
    return {n: by_fit[n] - weight * by_share[n] for n in series}


def survivors(kept: list, born: list, value, mode: str, n: int) -> list:
    """The parents of the next generation. generational: the n best born; parent: each born takes the place of the one it comes from
    only if it is better; elitist: the n best of both. Entries are (tree, origin); of equals the later born, in `parent` the older."""
    best = lambda xs: [xs[i] for _, i in sorted(((value(x[0]), i) for i, x in enumerate(xs)), reverse=True)[:n]]
    if mode == "generational" or not kept:
        return best(born)
    if mode == "elitist":
        return best(kept + born)
    if mode == "parent":
        return [b if value(b[0]) > value(b[1]) else (b[1], b[1]) for b in born]
    raise ValueError(f"no such replacement: {mode}")


def parsimony_coefficient(lengths: list[int], scores: list[float], s: Settings) -> float:
    if s.parsimony != "auto":
        return float(s.parsimony)
    spread = float(np.var(lengths)) if len(lengths) > 1 else 0.0
    return float(np.cov(lengths, scores)[1, 0]) / spread if spread else 0.0


def evolve(panel: DataFrame, ops: list[str], features: list[str], label: str = "fwd_ret", s: Settings = Settings(), crossover_ops: list[str] | None = None, judged: dict[str, float] | None = None, rule: Rule = Rule(), store: IcStore | None = None) -> list[dict]:
    """Records of every candidate of every generation: generation, idx, formulation, ic, penalty, fitness, method, n_nodes. One seed gives one run, and a shorter
    run is the start of a longer one. With s.originality, tournaments go by rank less that weight times the rank of what others explain.

    ops make new trees and mutations; trees of the first generation come of crossover_ops alone where given. fitness is ic less the penalty of the
    candidate's score in `judged` (by formulation, 0 to 10; none without a score) and less s.parsimony a node. `ic` is the metric that `rule` names, of the factor masked as it
    says; -1 for one that fails it. What `store` holds of the same rule and label is read instead of computed, and what it lacks is added.
    """
    rng, records, series, judged = random.Random(s.seed), [], {}, judged or {}
    with passing(panel.sparkSession):
        panel = dealt(written(panel))  # every generation reads it, along time
        dates = labelled(panel, label)
        value = lambda ics: round(fitness_of(ics, rule, dates), 12)  # noqa: E731  (the order in which rows were added up decides no tie)
        key = lambda t: str(canonical(t))
        first = crossover_ops or ops
        pop = [("random", grow(rng, first, features, rng.randint(*s.depth), rng.random() < 0.5)) for _ in range(s.population * s.warm_start)]
        pop = [(m, t if t.args else Node("cs_rank", (t,)), None) for m, t in pop]
        kept: list = []
        for g in range(s.generations + 1):
            new = [t for _, t, _ in pop if key(t) not in series]
            if new:
                known = store.read(rule, label, {key(t) for t in new}) if store else {}
                made = ic_series(panel, left, label, rule=rule) if (left := [t for t in new if key(t) not in known]) else {}
                if store and made:
                    store.add(rule, label, made)
                series |= known | made
            raw = lambda t: value(series[key(t)])

            def penalty(t: Node) -> float:
                score = judged.get(str(t))
                return 0.0 if score is None or raw(t) < 0 else s.penalty_weight * (1 - min(10.0, max(0.0, score)) / 10)

            a_node = parsimony_coefficient([t.length() for _, t, _ in pop], [raw(t) - penalty(t) for _, t, _ in pop], s)
            fit = lambda t: raw(t) - penalty(t) - a_node * t.length()  # noqa: B023, E731
            records += [{"generation": g, "idx": i, "formulation": str(t), "ic": raw(t), "penalty": penalty(t), "fitness": fit(t), "method": m, "n_nodes": t.length()} for i, (m, t, _) in enumerate(pop)]
            if max(raw(t) - penalty(t) for _, t, _ in pop) >= s.stop:
                break
            kept = survivors(kept, [(t, o or t) for _, t, o in pop], fit, s.replacement, s.population)
            parents = [t for t, _ in kept]
            reward = {key(t): fit(t) for t in parents}
            if s.originality:
                reward = original_first({n: series[n] for n in reward}, s.originality, value=value)
            best = lambda: max((rng.choice(parents) for _ in range(s.tournament)), key=lambda t: reward[key(t)])
            pop = []
            for _ in range(s.population):
                parent, donor = best(), best()
                pop.append((*child(rng, s, parent, donor, ops, features), parent))
    return records


def hall_of_fame(records: DataFrame, k: int) -> DataFrame:
    """The k best different formulations of the last generation."""
    last = records.where(F.col("generation") == records.agg(F.max("generation")).first()[0])
    w = Window.partitionBy("formulation").orderBy("idx")
    return last.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc("ic"), F.desc("idx")).limit(k)


def flat_correlations(df: DataFrame, names: list[str]) -> dict[tuple[str, str], float]:
    """abs of the correlation of each two columns over all cells, each less its mean, missing cells as 0. One job; a number a pair reaches the driver."""
    means = df.agg(*[F.avg(n).alias(n) for n in names])  # one row
    flat = df.select(*names).crossJoin(F.broadcast(means.select(*[F.col(n).alias(f"{n}_m") for n in names])))
    flat = flat.select(*[F.coalesce(F.col(n) - F.col(f"{n}_m"), F.lit(0.0)).alias(n) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sd = lambda a, b: F.stddev_pop(a) * F.stddev_pop(b)
    got = flat.agg(*[F.abs(F.when(sd(a, b) > 1e-18, F.covar_pop(a, b) / sd(a, b))).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    return {p: float(v or 0.0) for p, v in zip(pairs, got)}


def best_programs(panel: DataFrame, records: DataFrame, k: int, n: int) -> list[str]:
    """Formulations of the hall of fame of k, less the worse of the most correlated two, again and again, until n are left."""
    names = [r.formulation for r in hall_of_fame(records, k).orderBy(F.desc("ic"), F.desc("idx")).collect()]
    cols = {f"h{i}": parse(t) for i, t in enumerate(names)}
    corr = flat_correlations(evaluate(panel, cols, max(50, len(cols)))[0], list(cols)) if len(names) > n else {}
    left = list(cols)
    while len(left) > n:
        pairs = [(corr[a, b], i, j) for i, a in enumerate(left) for j, b in enumerate(left) if i < j]
        _, _, worse = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        left.pop(worse)
    return [names[int(c[1:])] for c in left]


def execute(panel: DataFrame, formulations: list[str]) -> DataFrame:
    """The panel with the programs as columns p0, p1, ..."""
    return evaluate(panel, {f"p{i}": parse(t) for i, t in enumerate(formulations)}, max(50, len(formulations)))[0]
