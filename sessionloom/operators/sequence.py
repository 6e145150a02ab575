"""Ordered-session operators that stay parallel when one session is very large.

Everything in a trace is ordered inside its session, so most rules are windows keyed by session.
A plain window puts a whole session into one task.  Unless the planner's estimate of the whole table rules that out, ``order_sessions``
therefore counts rows per session first (a map-side-combined aggregate over the key column).  If no session is larger than
``rows_per_slice`` plain windows are used.  Otherwise only the large sessions are cut into slices
of the order column, windows run per (session, slice), and what crosses a slice border is carried
by a join with one summary row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.session import cut_lineage

ROWS_PER_SLICE_CONF = "sessionloom.rowsPerSlice"
ROWS_PER_SLICE_DEFAULT = 2_000_000
SLICE = "_slice"

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def rows_per_slice(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_SLICE_CONF, str(ROWS_PER_SLICE_DEFAULT)))


@dataclass(frozen=True)
class SessionOrder:
    """A DataFrame with its session key and total order; ``sliced`` tells how windows are run."""

    rows: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool = False

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(SLICE)

    def derive(self, rows: DataFrame, order: Sequence[str] | None = None) -> "SessionOrder":
        """Same session key over new rows; ``rows`` must still carry the slice column when sliced."""
        if self.sliced and SLICE not in rows.columns:
            raise ValueError("sliced rows lost their slice column")
        return SessionOrder(rows, self.key, tuple(order or self.order), self.sliced)

    def group_keys(self) -> list[str]:
        return [*self.key, SLICE] if self.sliced else list(self.key)

    def _window(self):
        return Window.partitionBy(*self.group_keys()).orderBy(*self.order)

    def _beside(self, summary: DataFrame):
        """Arguments of a left join with one row per slice; null keys meet."""
        named = summary.select(*[F.col(c).alias(f"_of_{c}") for c in self.group_keys()], *[c for c in summary.columns if c not in self.group_keys()])
        return named, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in self.group_keys()], "left"

    def _of(self) -> list[str]:
        return [f"_of_{c}" for c in self.group_keys()]

    def _slices(self):
        return Window.partitionBy(*self.key).orderBy(SLICE)

    def neighbours(
        self,
        prev: Mapping[str, str] | None = None,
        next: Mapping[str, str] | None = None,
    ) -> "SessionOrder":
        """Add columns of the previous / next row of the session: {new column: source column}."""
        prev, next = dict(prev or {}), dict(next or {})
        w = self._window()
        added = {name: F.lag(src).over(w) for name, src in prev.items()}
        added.update({name: F.lead(src).over(w) for name, src in next.items()})
        if not self.sliced:
            return self.derive(self.rows.withColumns(added))

        position = F.struct(*self.order)
        aggregates = [
            F.max_by(F.struct(*[F.col(c) for c in sorted(set(prev.values()))]), position).alias("_last") if prev else None,
            F.min_by(F.struct(*[F.col(c) for c in sorted(set(next.values()))]), position).alias("_first") if next else None,
        ]
        summary = self.rows.groupBy(*self.group_keys()).agg(*[a for a in aggregates if a is not None])
        carried = {}
        if prev:
            carried["_carry_prev"] = F.lag("_last").over(self._slices())
        if next:
            carried["_carry_next"] = F.lead("_first").over(self._slices())
        summary = summary.withColumns(carried).select(*self.group_keys(), *carried)
        out = (
            self.rows.withColumns(added)
            .withColumns({"_is_first": F.row_number().over(w) == 1, "_is_last": F.lead(F.lit(1)).over(w).isNull()})
            .join(*self._beside(summary))
        )
        out = out.withColumns(
            {name: F.when(F.col("_is_first"), F.col(f"_carry_prev.{src}")).otherwise(F.col(name)) for name, src in prev.items()}
            | {name: F.when(F.col("_is_last"), F.col(f"_carry_next.{src}")).otherwise(F.col(name)) for name, src in next.items()}
        )
        return self.derive(cut_lineage(out.drop("_is_first", "_is_last", *carried, *self._of())))

    def running(self, **columns: tuple[str, Column]) -> "SessionOrder":
        """Add inclusive running aggregates: name=('sum'|'max'|'min', expression)."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = {name: _COMBINE[how](expr).over(w) for name, (how, expr) in columns.items()}
        if not self.sliced:
            return self.derive(self.rows.withColumns(added))

        before = self._slices().rowsBetween(Window.unboundedPreceding, -1)
        summary = self.rows.groupBy(*self.group_keys()).agg(
            *[_COMBINE[how](expr).alias(f"_total_{name}") for name, (how, expr) in columns.items()]
        )
        carried = {f"_base_{name}": _COMBINE[how](F.col(f"_total_{name}")).over(before) for name, (how, _) in columns.items()}
        summary = summary.withColumns(carried).select(*self.group_keys(), *carried)
        out = self.rows.withColumns(added).join(*self._beside(summary))
        merged = {}
        for name, (how, _) in columns.items():
            base, inner = F.col(f"_base_{name}"), F.col(name)
            if how == "sum":
                merged[name] = F.when(base.isNull(), inner).when(inner.isNull(), base).otherwise(base + inner)
            elif how == "max":
                merged[name] = F.greatest(base, inner)
            else:
                merged[name] = F.least(base, inner)
        return self.derive(cut_lineage(out.withColumns(merged).drop(*carried, *self._of())))

    def totals(self, **columns: tuple[str, Column]) -> "SessionOrder":
        """Add whole-session aggregates to every row: name=('sum'|'max'|'min', expression).

        Sliced sessions are combined from one row per slice and joined on (session, slice), so that a
        large session's rows never meet in one task.
        """
        whole = Window.partitionBy(*self.key)
        if not self.sliced:
            return self.derive(self.rows.withColumns({n: _COMBINE[how](expr).over(whole) for n, (how, expr) in columns.items()}))
        parts = self.rows.groupBy(*self.group_keys()).agg(*[_COMBINE[how](expr).alias(n) for n, (how, expr) in columns.items()])
        summary = parts.withColumns({n: _COMBINE[how](n).over(whole) for n, (how, _) in columns.items()})
        return self.derive(cut_lineage(self.rows.join(*self._beside(summary)).drop(*self._of())))

    def index(self, name: str, start: int = 0) -> "SessionOrder":
        """Dense position of each row in its session."""
        counted = self.running(**{name: ("sum", F.lit(1).cast("bigint"))})
        return self.derive(counted.rows.withColumn(name, F.col(name) + F.lit(start - 1)))

    def where(self, condition: Column) -> "SessionOrder":
        return self.derive(self.rows.where(condition))

    def with_columns(self, columns: Mapping[str, Column]) -> "SessionOrder":
        return self.derive(self.rows.withColumns(dict(columns)))


def order_sessions(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    limit: int | None = None,
) -> SessionOrder:
    """Choose plain or sliced windows from the measured size of the largest session.

    The first order column must be numeric.  A large session is cut at quantiles of that column, so a
    burst or an outlier does not fill one slice; rows without a value are the first slice, as they
    come first in the windows.  Both ways give the same rows.
    """
    key = (key,) if isinstance(key, str) else tuple(key)
    order = (order,) if isinstance(order, str) else tuple(order)
    limit = limit or rows_per_slice(df)
    if _surely_small(df, limit):
        return SessionOrder(df, key, order)
    large = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    most = large.agg(F.max("_n")).first()[0]
    if most is None:
        return SessionOrder(df, key, order)
    slices = -(-most // limit)
    lead = F.col(order[0]).cast("double")
    places = F.percentile_approx(lead, [i / slices for i in range(1, slices)], F.lit(max(10_000, 20 * slices))) if slices > 1 else F.array()
    cuts = df.join(large, _same(df, large, key), "left_semi").groupBy(*key).agg(places.alias("_cuts"))
    cuts = cut_lineage(cuts.select(*[F.col(c).alias(f"_k_{c}") for c in key], "_cuts"))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    # Rows without a place come first, as in the windows; equal places share a slice.
    slice_no = F.coalesce(F.size(F.filter("_cuts", lambda c: c < lead)), F.lit(0)) + F.when(lead.isNull(), F.lit(-1)).otherwise(F.lit(0))
    slice_no = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(slice_no)
    rows = df.join(cuts, on, "left").withColumn(SLICE, slice_no.cast("bigint")).drop("_cuts", *[f"_k_{c}" for c in key])
    return SessionOrder(rows, key, order, sliced=True)


def _surely_small(df: DataFrame, limit: int) -> bool:
    """Whether the planner's estimate leaves no room for a session of more than ``limit`` rows, at eight bytes a row: then nothing is counted.

    An estimate that is off costs parallelism only, as plain and sliced windows give the same rows; without statistics it is huge, and rows are counted.
    """
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= 8 * limit


def _same(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    condition = F.lit(True)
    for c in key:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def islands(order: SessionOrder, start: Column, name: str) -> SessionOrder:
    """Number the maximal runs of rows; ``start`` is true on the first row of each run (1-based)."""
    return order.running(**{name: ("sum", start.cast("bigint"))})
