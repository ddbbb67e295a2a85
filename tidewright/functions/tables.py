"""Fits as table functions of Spark SQL, over rows that a query has summed or binned beforehand.

``register(spark)`` makes them callable::

    SELECT * FROM power_fit(TABLE(sums) PARTITION BY symbol ORDER BY theta, center => -6.9)
    SELECT * FROM two_regime_fit(TABLE(bins) PARTITION BY symbol ORDER BY q)
    SELECT * FROM form_fit(TABLE(bins) PARTITION BY symbol ORDER BY u, form => 'power')

Each takes a table by ``PARTITION BY`` the groups to fit, and gives one row a
group: the table's other columns (of which a group has one value), then the fit.
What meets in a task is a group's sums or bins, some hundred rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass
class Shape(AnalyzeResult):
    """The result's columns, and which of them are the group's own."""

    keys: list[str] = field(default_factory=list)


def _shape(table: AnalyzeArgument, needs: tuple[str, ...], gives: str) -> Shape:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name) PARTITION BY ...")
    fields = table.dataType.fields
    lacks = [n for n in needs if n not in {f.name for f in fields}]
    if lacks:
        raise ValueError(f"the table has no column {', '.join(lacks)}")
    own = [f for f in fields if f.name not in needs]
    # Table functions are analysed by a worker, which cannot parse types.
    kinds = {"double": DoubleType(), "bigint": LongType(), "boolean": BooleanType()}
    given = [StructField(name, kinds[kind]) for name, kind in (x.split() for x in gives.split(", "))]
    return Shape(StructType([*own, *given]), keys=[f.name for f in own])


class _Fit:
    """Collects a group's rows and gives one row at its end."""

    needs: tuple[str, ...] = ()

    def __init__(self, shape: Shape) -> None:
        self.keys, self.own, self.rows, self.options = shape.keys, None, [], ()

    def _take(self, row, *options) -> None:
        self.own = [row[k] for k in self.keys]
        self.options = options
        self.rows.append([row[n] for n in self.needs])

    def _columns(self) -> list[np.ndarray]:
        return list(np.array([[np.nan if v is None else float(v) for v in r] for r in self.rows]).T)


@udtf
class PowerFit(_Fit):
    """c and delta of y = c * scale * q ** delta from sums at the points of ``fits.nodes``; sizes are relative to ``exp(center)``."""

    needs = ("theta", "A", "B", "n")

    @staticmethod
    def analyze(sums: AnalyzeArgument, center: AnalyzeArgument, low: AnalyzeArgument | None = None, high: AnalyzeArgument | None = None) -> Shape:
        return _shape(sums, PowerFit.func.needs, "c double, delta double, rows bigint")

    def eval(self, sums, center, low=0.0, high=1.5):
        self._take(sums, float(center), float(low), float(high))

    def terminate(self):
        from tidewright.operators import fits

        if self.rows:
            center, *bounds = self.options
            theta, a, b, n = self._columns()
            order = np.argsort(theta)
            c, delta, _ = fits.polished(a[order][None, :], b[order][None, :], tuple(bounds), center)
            yield (*self.own, float(c[0]), float(delta[0]), int(n[0]))


@udtf
class TwoRegimeFit(_Fit):
    """Crossover of a linear and a square-root branch over bins of size q, mean y and weight w, with its interval."""

    needs = ("q", "y", "w")

    @staticmethod
    def analyze(bins: AnalyzeArgument, steps: AnalyzeArgument | None = None) -> Shape:
        return _shape(bins, TwoRegimeFit.func.needs, "a double, q_star double, wsse double, low double, high double, at_boundary boolean")

    def eval(self, bins, steps=200):
        self._take(bins, int(steps))

    def terminate(self):
        from tidewright.operators import fits

        if self.rows:
            f = fits.two_regime_arrays(*self._columns(), *self.options)
            yield (*self.own, f["a"], f["q_star"], f["wsse"], f["low"], f["high"], f["at_boundary"])


@udtf
class FormFit(_Fit):
    """Weighted least squares of a named form over bins of size u, mean y and weight w."""

    needs = ("u", "y", "w")

    @staticmethod
    def analyze(bins: AnalyzeArgument, form: AnalyzeArgument) -> Shape:
        from tidewright.operators import forms

        if form.value not in {f.name for f in forms.FORMS}:
            raise ValueError(f"unknown form: {form.value}")
        return _shape(bins, FormFit.func.needs, "level double, exponent double, wsse double, aic double")

    def eval(self, bins, form):
        self._take(bins, form)

    def terminate(self):
        from tidewright.operators import forms

        if self.rows:
            f = forms.fit(next(f for f in forms.FORMS if f.name == self.options[0]), *self._columns())
            yield (*self.own, float(f.theta[0]), None if np.isnan(f.exponent) else f.exponent, f.wsse, f.aic)


FUNCTIONS = {"power_fit": PowerFit, "two_regime_fit": TwoRegimeFit, "form_fit": FormFit}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
