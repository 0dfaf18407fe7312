"""The queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cross_section import OPERATORS
from ..operators.time_series import FAMILIES
from ..sources.panel import part_panel
from . import operator_sql, return_reports, run_reports, search_reports  # noqa: F401  (their queries are among REPORTS)
from .expression import Node, build
from .flow import Flow
from .reports import REPORTS, flagship_ic

#: Parameters for which a family gives values; 4 for all others.
PARAMETER = {"second_slope": 6, "sue0_score": 6, "sue1_score": 6, "cut_down_q1": 12, "cut_up_q1": 6, "first_slope": 4, "roll_resid": 4}

#: The second window that each family is queried at; 7 for all others.
SECOND = {"second_slope": 9, "sue0_score": 8, "sue1_score": 8, "cut_down_q1": 14, "cut_up_q1": 9}

#: Values that are sums and ratios of few-digit shares lie half-way between two sixth digits so often that they are nudged before rounding.
NUDGED = {"cs_double_scored": 1e-9, "ts_decay_linear_pctchg": 1e-9}


def _operator(op: str, arity: int, d: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    args = ("y",) if op in ("cs_abs", "cs_sign", "cs_signed_square") else ("x", "y", "z")[:arity]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = Flow(part_panel(spark, sf_dir))
        value = build(f, Node(op, tuple(Node("feature", value=a) for a in args), d))
        return f.run({"value": value}).select("entity", "qidx", (F.round(F.col("value") + NUDGED.get(op, 0.0), 6) + 0.0).alias("value"))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _operator(name, arity) for name, (arity, _) in OPERATORS.items()}
    out |= {f"ts_{name}_{d}": _operator(f"ts_{name}", arity, d) for name, (arity, _) in FAMILIES.items() for d in (PARAMETER.get(name, 4), SECOND.get(name, 7))}
    return out | {name: f for name, (f, _) in REPORTS.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: operator_sql.query(*operator_sql.CROSS[name], nudge=NUDGED.get(name, 0.0)) for name in OPERATORS}
    return out | {f"ts_{name}_{d}": operator_sql.along(name, d, NUDGED.get(f"ts_{name}", 0.0)) for name in FAMILIES for d in (PARAMETER.get(name, 4), SECOND.get(name, 7))} | {name: sql for name, (_, sql) in REPORTS.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_ic(spark, sf_dir)
