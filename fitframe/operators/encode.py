"""Fitted encoders and scalers (E1-E5) as ``pyspark.ml`` estimators.

Each fit is a fixed, small number of Spark jobs no matter how many columns:

* :class:`LabelEncoder` unpivots all input columns into ``(name, value)``
  pairs and de-duplicates them (map-side partial distinct, then one
  shuffle).  When at most ``collect_max`` distinct values come back (one
  bounded ``limit`` job) they are numbered on the driver; otherwise they are
  numbered with :func:`~fitframe.operators.rank.global_rank` and no label
  list reaches the driver, so a column with 10^8 distinct values (device
  ids, IPs) fits as a distributed job.  The mapping
  stays a DataFrame and is joined at transform time; it is broadcast only
  when its bytes (known exactly from the fit) are under ``broadcast_bytes``,
  otherwise the join shuffles.
* :class:`ZScore` computes mean and population std of every column in one
  aggregate (trap T7: population std, zero std treated as 1).

``fit_on`` (traps T9, T10) is handled by :func:`fit_frame`: ``'union'`` fits
on train UNION ALL test (the reference's behaviour), ``'train'`` on train
only; ``'each'`` is done by fitting twice.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from .rank import global_rank
from .relate import DEFAULT_BROADCAST_BYTES

DEFAULT_COLLECT_MAX = 100_000
#: Bytes counted for an entry of a mapping beside those of its text.
ENTRY_BYTES = 32


# Values are carried in the field of their kind, so large integers stay exact
# (a double holds integers exactly only up to 2^53).
_FIELD = {"int": "lval", "float": "dval", "str": "sval"}
_CAST = {"int": "long", "float": "double", "str": "string"}


def value_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """'int' for integral columns, 'float' for other numeric ones, 'str' otherwise."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return {c: "int" if isinstance(types[c], IntegralType)
            else "float" if isinstance(types[c], NumericType) else "str" for c in columns}


def value_struct(c: str, kind: str, with_presence: bool = True) -> Column:
    """``(name, [present], lval, dval, sval)`` with the value in its kind's field."""
    fields = [F.lit(c).alias("name")]
    if with_presence:
        fields.append(F.col(c).isNotNull().alias("present"))
    for k, f in _FIELD.items():
        fields.append((F.col(c).cast(_CAST[k]) if k == kind else F.lit(None).cast(_CAST[k])).alias(f))
    return F.struct(*fields)


def fit_frame(train: DataFrame, test: DataFrame | None, fit_on: str, columns: list[str]) -> DataFrame:
    """The rows a fitted operator learns from (T10: ``union`` is the reference's default)."""
    if fit_on == "train" or test is None:
        return train.select(*columns)
    if fit_on == "union":
        return train.select(*columns).unionByName(test.select(*columns))
    raise ValueError(f"fit_on must be 'union' or 'train', got {fit_on!r}")


class LabelEncoder(Estimator):
    """Sorted distinct values -> 0..K-1, per column.

    Numeric columns sort numerically (a dense rank), text columns
    lexicographically.  Trap T14: when the fitted rows contain NULL, NULL is
    its own class with code 0 and the other values start at 1.

    ``handle_unseen``: a value that the fit has not seen gets NULL (``'null'``)
    or fails the job that meets it (``'error'``).
    """

    def __init__(self, inputCols: list[str], outputCols: list[str] | None = None,
                 broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, collect_max: int = DEFAULT_COLLECT_MAX,
                 handle_unseen: str = "null"):
        super().__init__()
        self.inputCols = list(inputCols)
        self.outputCols = list(outputCols) if outputCols else list(inputCols)
        if handle_unseen not in ("null", "error"):
            raise ValueError(f"handle_unseen must be 'null' or 'error', got {handle_unseen!r}")
        self.broadcast_bytes, self.collect_max, self.handle_unseen = broadcast_bytes, collect_max, handle_unseen

    def _from_values(self, dataset: DataFrame, kinds: dict, rows) -> "LabelEncoderModel":
        """Number a bounded list of distinct values in the same order the
        distributed path uses: NULL first, then ascending (NaN last)."""
        def key(r):
            d = r["dval"]
            dk = (0, 0.0) if d is None else ((2, 0.0) if math.isnan(d) else (1, d))
            return (r["name"], r["present"], (r["lval"] is not None, r["lval"] or 0), dk,
                    (r["sval"] is not None, r["sval"] or ""))
        out, pos, size = [], {}, {}
        for r in sorted(rows, key=key):
            code = pos.get(r["name"], 0)
            pos[r["name"]] = code + 1
            out.append((r["name"], r["present"], r["lval"], r["dval"], r["sval"], code))
            size[r["name"]] = size.get(r["name"], 0) + ENTRY_BYTES + len((r["sval"] or "").encode())
        mapping = dataset.sparkSession.createDataFrame(
            out, "name string, present boolean, lval long, dval double, sval string, code int")
        return LabelEncoderModel(self.inputCols, self.outputCols, kinds, mapping, pos, size,
                                 self.broadcast_bytes, self.handle_unseen)

    def _fit(self, dataset: DataFrame) -> "LabelEncoderModel":
        kinds = value_kinds(dataset, self.inputCols)
        pairs = [value_struct(c, kinds[c]) for c in self.inputCols]
        values = (dataset.select(F.explode(F.array(*pairs)).alias("kv"))
                  .select("kv.*").distinct())
        # Small dictionaries (the usual case): one job returns at most
        # collect_max + 1 distinct values; when under the bound they are
        # numbered on the driver and the mapping is a proven-small table.
        if self.collect_max > 0:
            head = values.limit(self.collect_max + 1).collect()
            if len(head) <= self.collect_max:
                return self._from_values(dataset, kinds, head)
        ranked = global_rank(values, [F.col("name").asc(), F.col("present").asc(),
                                      F.col("lval").asc_nulls_first(),
                                      F.col("dval").asc_nulls_first(),
                                      F.col("sval").asc_nulls_first()], "_r")
        # first rank and size per column: one row per input column
        starts = ranked.groupBy("name").agg(
            F.min("_r").alias("_start"), F.count(F.lit(1)).alias("_n"),
            F.sum(ENTRY_BYTES + F.coalesce(F.octet_length("sval"), F.lit(0))).alias("_bytes")).collect()
        sizes = {r["name"]: int(r["_n"]) for r in starts}
        size = {r["name"]: int(r["_bytes"]) for r in starts}
        start_df = dataset.sparkSession.createDataFrame(
            [(r["name"], int(r["_start"])) for r in starts], "name string, _start long")
        mapping = (ranked.join(F.broadcast(start_df), "name")
                   .select("name", "present", "lval", "dval", "sval",
                           (F.col("_r") - F.col("_start")).cast("int").alias("code")))
        return LabelEncoderModel(self.inputCols, self.outputCols, kinds, mapping, sizes, size,
                                 self.broadcast_bytes, self.handle_unseen)


class LabelEncoderModel(Model):
    """Fitted codes: the mapping table is joined, once for each column, and
    broadcast where its bytes are under ``broadcast_bytes``."""

    def __init__(self, inputCols, outputCols, kinds: dict, mapping: DataFrame, sizes: dict, size_bytes: dict,
                 broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, handle_unseen: str = "null"):
        super().__init__()
        self.inputCols, self.outputCols = inputCols, outputCols
        self.kinds, self.mapping, self.sizes, self.size_bytes = kinds, mapping, sizes, size_bytes
        self.broadcast_bytes, self.handle_unseen = broadcast_bytes, handle_unseen

    def labels(self, column: str) -> DataFrame:
        """The fitted (value, code) table of one column, as a DataFrame."""
        key = _FIELD[self.kinds[column]]
        return (self.mapping.where(F.col("name") == column)
                .select(F.col(key).alias("value"), "code"))

    def small(self, column: str) -> bool:
        """Whether the column's mapping may be broadcast."""
        return self.size_bytes.get(column, 0) <= self.broadcast_bytes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset
        for i, (c, o) in enumerate(zip(self.inputCols, self.outputCols)):
            k, v = f"_ff_k{i}", f"_ff_v{i}"
            m = self.labels(c).select(F.col("value").alias(k), F.col("code").alias(v))
            if self.small(c):
                m = F.broadcast(m)
            probe = F.col(c).cast(_CAST[self.kinds[c]])
            code = F.col(v)
            if self.handle_unseen == "error":
                code = F.coalesce(code, F.raise_error(
                    F.concat(F.lit(f"{c}: unseen value "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))).cast("int"))
            out = (out.join(m, probe.eqNullSafe(F.col(k)), "left")
                   .withColumn(o, code).drop(k, v))
        return out


def first_seen_codes(train: DataFrame, test: DataFrame, column: str, order_key: str,
                     name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """R ``factor(x, levels = unique(c(train$x, test$x)))``.

    Levels in order of first appearance, train rows before test rows, rows in
    ``order_key`` order inside each; codes are 1-based; NULL stays NULL (R
    drops NA from the levels).  Returns both tables with ``name`` added.
    """
    name = name or column
    seen = (train.select(column, F.lit(0).alias("_s"), F.col(order_key).alias("_o"))
            .unionByName(test.select(column, F.lit(1).alias("_s"), F.col(order_key).alias("_o")))
            .where(F.col(column).isNotNull())
            .groupBy(column).agg(F.min(F.struct("_s", "_o")).alias("_first")))
    levels = global_rank(seen, [F.col("_first").asc()], "_code")
    levels = levels.select(F.col(column).alias("_ff_lv"), F.col("_code").cast("int").alias("_ff_code"))
    # the level table is read from the checkpoint: measuring it is cheap, and its
    # bytes let the join be planned as a broadcast before any shuffle
    size = levels.agg(F.sum(ENTRY_BYTES + F.octet_length(F.col("_ff_lv").cast("string")))).first()[0] or 0
    if size <= DEFAULT_BROADCAST_BYTES:
        levels = F.broadcast(levels)

    def apply(df: DataFrame) -> DataFrame:
        return (df.join(levels, df[column] == F.col("_ff_lv"), "left")
                .withColumn(name, F.col("_ff_code")).drop("_ff_lv", "_ff_code"))

    return apply(train), apply(test)


def ordinal_map(c, mapping: dict, otherwise: str = "cast") -> Column:
    """Fixed dictionary lookup (E4).  Unmapped values keep their own value as
    a number (``astype(float)`` after the partial replacement), or NULL when
    they are not numeric text."""
    col = F.col(c) if isinstance(c, str) else c
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    fallback = col.try_cast("double") if otherwise == "cast" else F.lit(None)
    return (expr.otherwise(fallback) if expr is not None else fallback).cast("double")


class ZScore(Estimator):
    """``(x - mean) / std`` with population std, std 0 treated as 1."""

    def __init__(self, inputCols: list[str], outputCols: list[str] | None = None):
        super().__init__()
        self.inputCols = list(inputCols)
        self.outputCols = list(outputCols) if outputCols else list(inputCols)

    def _fit(self, dataset: DataFrame) -> "ZScoreModel":
        aggs = []
        for c in self.inputCols:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
        row = dataset.agg(*aggs).first()  # one row: 2 numbers per column
        stats = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in self.inputCols}
        return ZScoreModel(self.inputCols, self.outputCols, stats)


class ZScoreModel(Model):
    def __init__(self, inputCols, outputCols, stats: dict):
        super().__init__()
        self.inputCols, self.outputCols, self.stats = inputCols, outputCols, stats

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = {}
        for c, o in zip(self.inputCols, self.outputCols):
            m, s = self.stats[c]
            m = 0.0 if m is None else float(m)
            s = 1.0 if (s is None or s == 0) else float(s)
            cols[o] = (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
        return dataset.withColumns(cols)
