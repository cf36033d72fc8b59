"""Ordered computation inside groups.

The reference sorts each group and loops over it in Python.  Here rows are
range-partitioned over (group, order) and sorted once, so a hot group lies in
many partitions.  Each partition works on what it has, and what the next one
needs to know, its last row or the state of the group it breaks off in, is
handed over through a table of one row a partition.  A caller who knows that
no group is large may ask for a window partitioned by the group key instead
(``skew_safe=False``).  In both, an ordinary grouped aggregate (partial on the
map side) follows.  :func:`ordered_aggregate` runs a user's own state (init,
update, merge) over the same partitions; :func:`grouped_apply`
(``applyInPandas``) keeps a whole group in one task and so is for small groups.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from ..functions.arith import rain_rate
from ..session import cut_lineage

_MID, _PREV, _HAS, _OPEN = "_ff_mid", "_ff_prev", "_ff_has", "_ff_open"


def _sorted_once(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Range-partitioned and sorted over (group, order), each row with partition id << 33 | place in ``_ff_mid``."""
    from .rank import _partitions
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    return df.repartitionByRange(_partitions(df, None), *keys).sortWithinPartitions(*keys) \
        .withColumn(_MID, F.monotonically_increasing_id())


def _same(a: pa.Array, b: pa.Array) -> pa.Array:
    """Equality as Spark groups: nulls are equal, NaNs are equal."""
    out = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(a.type):
        out = pc.or_(out, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return out


def _with_previous(df: DataFrame, group: list[str], order: list[str], column: str) -> DataFrame:
    """``df`` with the group's previous value of ``column`` (``_ff_prev``), whether there is a previous row
    (``_ff_has``) and the sorted place (``_ff_mid``); one exchange of the rows.

    A partition finds all but the previous row of its first row, which is the
    last row of the partition before it.
    """
    placed = _sorted_once(df, group, order)
    at = [placed.columns.index(c) for c in [*group, column]]

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            before = []
            for i in at:
                have = batch.column(i)
                head = last.column(i) if last is not None else pa.nulls(1, have.type)
                before.append(pa.concat_arrays([head, have.slice(0, n - 1)]))
            has = pa.array([True] * n)
            for i, b in zip(at[:-1], before):
                has = pc.and_(has, _same(batch.column(i), b))
            opens = pa.array([last is None] + [False] * (n - 1))
            has = pc.and_(has, pc.invert(opens))
            prev = pc.if_else(has, before[-1], pa.scalar(None, before[-1].type))
            yield pa.RecordBatch.from_arrays([*batch.columns, prev, has, opens], [*batch.schema.names, _PREV, _HAS, _OPEN])
            last = batch.slice(n - 1, 1)

    schema = StructType([*placed.schema.fields, StructField(_PREV, placed.schema[column].dataType, True),
                         StructField(_HAS, BooleanType(), True), StructField(_OPEN, BooleanType(), True)])
    done = cut_lineage(placed.mapInArrow(shifted, schema))
    pid = F.shiftright(_MID, 33)
    key = F.struct(*[F.col(g) for g in group])
    ends = done.groupBy(pid.alias("_ff_pid")).agg(
        F.max_by(F.struct(key.alias("k"), F.col(column).alias("v")), F.col(_MID)).alias("_ff_end"))
    rows = ends.orderBy("_ff_pid").collect()  # one row a partition
    handed = done.sparkSession.createDataFrame(
        [(after["_ff_pid"], here["_ff_end"]) for here, after in zip(rows, rows[1:])], ends.schema)
    both = done.join(F.broadcast(handed), F.col(_OPEN) & (pid == F.col("_ff_pid")), "left")
    taken = F.coalesce(F.col("_ff_end.k").eqNullSafe(key) & F.col("_ff_end").isNotNull(), F.lit(False))
    return both.withColumn(_PREV, F.when(taken, F.col("_ff_end.v")).otherwise(F.col(_PREV))) \
        .withColumn(_HAS, F.col(_HAS) | taken).drop("_ff_pid", "_ff_end", _OPEN)


def lag_diff(df: DataFrame, group: list[str], order: list[str], column: str,
             name: str = "delta", default: float = 0, skew_safe: bool = True) -> DataFrame:
    """``x - lag(x, 1, default)`` inside each group in order.

    ``skew_safe=True`` (default): one range sort over (group, order), the last
    row of every partition handed to the next one, so a hot group is spread
    over many tasks.  ``skew_safe=False``: a window partitioned by the group,
    for groups that are known to fit in a task.
    """
    if not skew_safe:
        w = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.col(column) - F.lag(column, 1, default).over(w))
    j = _with_previous(df, group, order, column)
    return j.withColumn(name, F.col(column) - F.when(F.col(_HAS), F.col(_PREV)).otherwise(F.lit(default))) \
        .drop(_MID, _PREV, _HAS)


def weighted_duration(df: DataFrame, group: list[str], order: list[str], minute: str,
                      rate, horizon: float = 60.0, name: str = "estimate",
                      skew_safe: bool = True) -> DataFrame:
    """Duration-weighted sum of a per-reading rate.

    Each reading is valid from the previous reading's minute to its own
    minute; the last reading of a group is stretched to ``horizon``.  The
    reference builds ``valid = minute - previous`` and then adds
    ``horizon - sum(valid)`` to the last one, which telescopes to
    ``horizon - previous`` for the last row.  Readings whose rate is not
    finite contribute nothing; a group with none gives 0.

    ``rate`` is a Column computed per reading (e.g. :func:`rain_rate`).
    Output: one row per group with ``name``.

    ``skew_safe=False`` uses a window partitioned by the group, so that a group
    holding a third of all rows is one task.  ``skew_safe=True`` (default) never
    puts a group in one task: the previous minute comes from one range sort with
    the partitions' last rows handed on, and the final sum is a partial
    (map-side) aggregate, which also finds each group's last reading.
    """
    r = rate if not isinstance(rate, str) else F.col(rate)
    finite = r.isNotNull() & ~F.isnan(r) & (F.abs(r) != F.lit(float("inf")))
    if not skew_safe:
        w = Window.partitionBy(*group).orderBy(*order)
        readings = df.select(*group, F.when(finite, r).alias("_ff_rate"),
                             F.col(minute).alias("_ff_min"),
                             F.lag(F.col(minute), 1, 0).over(w).alias("_ff_prev"),
                             F.lead(F.lit(1), 1).over(w).isNull().alias("_ff_last"))
        valid = F.when(F.col("_ff_last"), F.lit(horizon) - F.col("_ff_prev")) \
                 .otherwise(F.col("_ff_min") - F.col("_ff_prev"))
        contrib = F.col("_ff_rate") * valid.cast("double") / F.lit(horizon)
        return readings.groupBy(*group).agg(F.coalesce(F.sum(contrib), F.lit(0.0)).alias(name))

    base = df.select(*group, *[c for c in order if c not in group], F.when(finite, r).alias("_ff_rate"),
                     F.col(minute).alias("_ff_min"))
    placed = _with_previous(base, group, order, "_ff_min")
    since = F.col("_ff_min") - F.when(F.col(_HAS), F.col(_PREV)).otherwise(F.lit(0))
    own = F.col("_ff_rate") * since.cast("double") / F.lit(horizon)
    # the last reading is good for what is left up to the horizon, too
    rest = F.col("_ff_rate") * (F.lit(horizon) - F.col("_ff_min")).cast("double") / F.lit(horizon)
    return placed.groupBy(*group).agg(
        (F.coalesce(F.sum(own), F.lit(0.0))
         + F.coalesce(F.max_by(F.struct(rest.alias("r")), F.col(_MID))["r"], F.lit(0.0))).alias(name))


def rain_estimate(df: DataFrame, group: list[str], order: list[str], minute: str,
                  dbz: str, name: str = "estimate", skew_safe: bool = True) -> DataFrame:
    """Marshall-Palmer rainfall per group: :func:`weighted_duration` of
    :func:`~fitframe.functions.arith.rain_rate` (I2, I3, F16)."""
    return weighted_duration(df, group, order, minute, rain_rate(dbz), name=name, skew_safe=skew_safe)


def ordered_aggregate(df: DataFrame, group: list[str], order: list[str], init: Callable[[], object],
                      update: Callable[[object, pd.DataFrame], object], merge: Callable[[object, object], object],
                      finish: Callable[[object], object], result: str = "value double") -> DataFrame:
    """A user's aggregate over the sorted rows of each group (U3), groups of any size.

    ``update(state, chunk)`` takes rows of one group that follow one another;
    ``merge(left, right)`` joins the states of two stretches, the left one
    first.  A group is cut where sorted partitions end, each stretch keeps one
    state, and the states of a group (at most one a partition) are merged in
    order.  States travel pickled.  Output: ``group`` and the ``result`` column.
    """
    placed = _sorted_once(df, group, order)
    kinds = placed.select(*group).schema

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (row of group columns, first place, state)

        def out(part):
            keys, first, state = part
            return pa.RecordBatch.from_arrays([*keys, pa.array([first]), pa.array([pickle.dumps(state)])],
                                              [*group, "_ff_at", "_ff_state"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(batch.schema.names.index(g)) for g in group]
            same = pa.array([True] * (n - 1))
            for c in cols:
                same = pc.and_(same, _same(c.slice(1), c.slice(0, n - 1)))
            starts = [0, *(i + 1 for i, v in enumerate(same.to_pylist()) if not v), n]
            frame = batch.to_pandas().drop(columns=[_MID])
            places = batch.column(batch.schema.names.index(_MID))
            for a, b in zip(starts, starts[1:]):
                keys = [c.slice(a, 1) for c in cols]
                if held is not None and not all(_same(x, y)[0].as_py() for x, y in zip(held[0], keys)):
                    yield out(held)
                    held = None
                if held is None:
                    held = (keys, places[a].as_py(), init())
                held = (*held[:2], update(held[2], frame.iloc[a:b]))
        if held is not None:
            yield out(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for parts in batch.column(len(group)).to_pylist():
                state = None
                for i, part in enumerate(sorted(parts, key=lambda v: v["_ff_at"])):
                    mine = pickle.loads(part["_ff_state"])
                    state = mine if i == 0 else merge(state, mine)
                values.append(finish(state))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(group))), pa.array(values)], names)

    parts = cut_lineage(placed.mapInArrow(stretches, StructType(
        [*kinds.fields, StructField("_ff_at", LongType()), StructField("_ff_state", BinaryType())])))
    grouped = parts.groupBy(*group).agg(F.collect_list(F.struct("_ff_at", "_ff_state")).alias("_ff_parts"))
    value = StructType.fromDDL(result)
    names = [*group, value.fields[0].name]
    return grouped.mapInArrow(merged, StructType([*kinds.fields, *value.fields]))


def grouped_apply(df: DataFrame, group: list[str], fn, schema: str) -> DataFrame:
    """General sorted-group function via ``applyInPandas`` (I2 fallback, U3).

    Only for logic no window/aggregate can express; ``fn`` receives one
    group as a pandas DataFrame.
    """
    return df.groupBy(*group).applyInPandas(fn, schema)
