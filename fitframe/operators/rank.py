"""Global position over a total order without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one
task.  Instead:

1. range-partition on the order keys and sort inside each partition,
2. tag each row with its partition id and its position in that partition
   (``monotonically_increasing_id`` = ``pid << 33 | row``) and cut lineage
   with a reliable checkpoint, so every later pass sees the same rows in
   the same partitions even if an executor is lost,
3. count (or sum) per partition -- one row per partition, a proven-small
   table -- and turn it into prefix offsets,
4. broadcast the offsets (size bounded by the partition count) and add
   them to the local position.

The order must be total (pass a unique tie-break column) for the result to
be reproducible; with ties the ranks are still a permutation of 1..n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .relate import leaf_bytes

_PID = "_ff_pid"
_MID = "_ff_mid"
_OFF = "_ff_off"


def _as_order(spec) -> list[Column]:
    out = []
    for s in spec:
        if isinstance(s, str):
            out.append(F.col(s).asc_nulls_first())
        else:
            out.append(s)
    return out


# Range partitions are sized from the leaf scans (bytes as stored, i.e.
# compressed for Parquet): about this much input per partition.
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Explicit count, else max(shuffle partitions, bytes of the leaf scans / target)."""
    if num_partitions:
        return num_partitions
    base = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(base, -(-(leaf_bytes(df) or 0) // TARGET_PARTITION_BYTES))


def sorted_tagged(df: DataFrame, order_by, num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned, locally sorted, tagged and checkpointed copy of ``df``."""
    order = _as_order(order_by)
    n = _partitions(df, num_partitions)
    tagged = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn(_PID, F.spark_partition_id())
                .withColumn(_MID, F.monotonically_increasing_id()))
    return cut_lineage(tagged)


def _offsets(tagged: DataFrame, measure: Column, name: str) -> DataFrame:
    """Prefix offsets per partition id as a small DataFrame (one row per partition)."""
    agg = tagged.groupBy(_PID).agg(measure.alias("_v"))
    is_double = dict(agg.dtypes)["_v"] in ("double", "float")
    conv = float if is_double else int
    per_part = agg.orderBy(_PID).collect()  # <= number of partitions rows
    rows, acc = [], conv(0)
    for r in per_part:
        rows.append((int(r[_PID]), acc))
        acc = acc + conv(r["_v"] or 0)
    spark = tagged.sparkSession
    return spark.createDataFrame(rows, f"{_PID} int, {name} {'double' if is_double else 'long'}")


def global_rank(df: DataFrame, order_by, name: str = "rank",
                num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the global order (``row_number`` semantics)."""
    tagged = sorted_tagged(df, order_by, num_partitions)
    offs = _offsets(tagged, F.count(F.lit(1)), _OFF)
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)
    return (tagged.join(F.broadcast(offs), _PID)
                  .withColumn(name, (F.col(_OFF) + local + 1).cast("long"))
                  .drop(_PID, _MID, _OFF))


def dense_codes(values: DataFrame, column: str, name: str = "code",
                num_partitions: int | None = None, start: int = 0) -> DataFrame:
    """Dense codes ``start..start+K-1`` for the sorted distinct non-null values of ``column``."""
    distinct = values.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = global_rank(distinct, [F.col(column).asc()], "_ff_r", num_partitions)
    return ranked.select(column, (F.col("_ff_r") - 1 + start).cast("int").alias(name))


def cumulative(df: DataFrame, order_by, value: str, name: str = "cumulative",
               num_partitions: int | None = None) -> DataFrame:
    """Running sum of ``value`` over the global order (I8), two-pass offset form.

    Per-partition totals give the offsets (one row per partition, broadcast).
    Inside a partition a window per partition id sums in the JVM, so integers
    stay exact and other columns are not touched.  NULL values count as 0, as
    in SQL ``SUM OVER``.
    """
    tagged = sorted_tagged(df, order_by, num_partitions)
    is_int = dict(tagged.dtypes)[value] in ("int", "bigint", "smallint", "tinyint")
    amount = F.col(value).cast("long" if is_int else "double")
    offs = _offsets(tagged, F.sum(amount), _OFF)
    w = Window.partitionBy(_PID).orderBy(_MID).rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum(F.coalesce(amount, F.lit(0).cast("long" if is_int else "double"))).over(w)
    return (tagged.repartitionByRange(max(1, offs.count()), F.col(_PID))
            .withColumn("_ff_local", local)
            .join(F.broadcast(offs), _PID)
            .withColumn(name, F.col(_OFF) + F.col("_ff_local"))
            .drop(_PID, _MID, _OFF, "_ff_local"))
