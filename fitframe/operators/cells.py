"""Regression trees fitted on counted cells instead of rows.

MLlib's trees see a row only through the bins of its features, at most
``maxBins`` a feature, and a split is chosen by three sums over each bin: of
weights, of labels and of squared labels.  Rows that share all their bins form
a cell.  A fit on one row a cell, with the number of its rows as weight and
their mean label, has the same sums of weights and labels; of the squared
labels only what is the same on every side of a split is missing, so all gains
agree, up to the order of additions.  A boosted fit under squared error is the
same for the same reason: the rows of a cell have one prediction, so the mean
of their residuals is the residual of their mean.

The rows are passed over three times (count, sample for the candidate splits,
counting of the cells), however many trees are fitted.  Nothing is assumed of
the values: the bins come from a sample as large as MLlib's own, and where
there could be more than a cell for :data:`LEAST_ROWS` rows, or a parameter
makes single rows matter, nothing is gained or it would be another fit, and
the callers fit on the rows.

Fitted trees are read the same way (:func:`per_cell`): their own thresholds cut
the features into cells, the trees predict each cell once, and a row looks up
the prediction of its cell.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark import SparkContext
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows a cell must stand for, on average and at least, for a fit on cells.
LEAST_ROWS = 4
#: Features and bins a feature up to which the sample is read on the driver: at most 16 x 256^2 values.
MOST_FEATURES, MOST_BINS = 16, 256

#: Bytes that a table of predictions by cell may have to be broadcast.
MOST_BYTES = 64 * 1024 * 1024

HIGHEST = math.nextafter(math.inf, 0)

CELL, ROWS = "_ff_cell", "_ff_rows"


def countable(est) -> bool:
    """Whether ``est`` sees its rows only through sums over bins, so that cells give the same trees."""
    if type(est) not in (DecisionTreeRegressor, GBTRegressor):
        return False
    for name in ("weightCol", "validationIndicatorCol", "varianceCol"):
        if est.hasParam(name) and est.isDefined(name) and est.getOrDefault(name):
            return False
    if est.getMinInstancesPerNode() != 1 or est.getMaxBins() > MOST_BINS:
        return False
    return isinstance(est, DecisionTreeRegressor) or (est.getLossType() == "squared" and est.getSubsamplingRate() == 1.0)


def candidate_splits(values: list[float], max_bins: int) -> list[float]:
    """MLlib's candidate thresholds of a continuous feature, from a sample of its values."""
    seen = sorted(Counter(values).items())
    if len(seen) <= max_bins:
        found = [(a + b) / 2 for (a, _), (b, _) in zip(seen, seen[1:])]
    else:
        found, stride = [], len(values) / max_bins
        target, before = stride, seen[0][1]
        for (a, _), (b, n) in zip(seen, seen[1:]):
            if abs(before - target) < abs(before + n - target):
                found.append((a + b) / 2)
                target += stride
            before += n
    return sorted({t for t in found if abs(t) < HIGHEST})


@dataclass
class Bins:
    """The candidate thresholds of each feature; a tree on bins has the number of a value's bin, from 1, for the value."""

    splits: list[list[float]]

    @property
    def cells(self) -> int:
        """How many cells there can be."""
        return math.prod(len(s) + 1 for s in self.splits)

    def _digits(self) -> list[tuple[int, int, int]]:
        """(bins, place value, base) of each feature in a cell's code; minus infinity and NaN have digits of their own."""
        out, place = [], 1
        for s in self.splits:
            out.append((len(s) + 1, place, len(s) + 3))
            place *= len(s) + 3
        return out

    def coded(self, df: DataFrame, features: str, keep: list[str]) -> DataFrame:
        """``keep`` and the code of each row's cell."""
        lowest = math.nextafter(-math.inf, 0)
        edges = {i: [-math.inf, lowest, *_past(s), math.inf] for i, s in enumerate(self.splits)}
        return _coded(df, features, keep, edges, [(place, base - 1) for _, place, base in self._digits()])

    def vector(self, own: Bins | None = None) -> Column:
        """The bin numbers of a cell as a vector; ``own`` has coarser bins, to be numbered instead.

        NaN for NaN or infinity, so that MLlib refuses it, as it does for the row.
        """
        numbers = []
        for s, wanted, (_, place, base) in zip(self.splits, (own or self).splits, self._digits(), strict=True):
            each = [-math.inf, *[1.0 + bisect_left(wanted, t) for t in [*s, math.inf]], math.nan]
            numbers.append(F.get(F.lit(each), F.pmod(F.expr(f"{CELL} div {place}L"), F.lit(base)).cast("int")))
        return array_to_vector(F.array(*numbers))

    def on_values(self, est, model):
        """A model that was fitted on bin numbers, as the same model of the features' values."""
        gateway, fitted = SparkContext._active_spark_context._gateway, model._java_obj
        ml = gateway.jvm.org.apache.spark.ml
        if isinstance(est, GBTRegressor):
            trees = [self._tree(ml, t) for t in fitted.trees()]
            array = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
            weights = gateway.new_array(gateway.jvm.double, len(trees))
            for i, (t, w) in enumerate(zip(trees, fitted.treeWeights())):
                array[i], weights[i] = t, w
            java = ml.regression.GBTRegressionModel(fitted.uid(), array, weights, fitted.numFeatures())
        else:
            java = self._tree(ml, fitted)
        return est._copyValues(est._create_model(java))

    def _tree(self, ml, tree):
        def node(n):
            told = n.impurityStats()
            getattr(told, "rawCount_$eq")(round(told.count()))  # rows, not cells
            if n.subtreeDepth() == 0:
                return n
            left, right, at = node(n.leftChild()), node(n.rightChild()), n.split()
            f = at.featureIndex()
            threshold = self.splits[f][math.floor(at.threshold()) - 1]
            return ml.tree.InternalNode(n.prediction(), n.impurity(), n.gain(), left, right,
                                        ml.tree.ContinuousSplit(f, threshold), told)
        return ml.regression.DecisionTreeRegressionModel(tree.uid(), node(tree.rootNode()), tree.numFeatures())


def _past(splits: list[float]) -> list[float]:
    """Edges of buckets for bins that hold their upper threshold: a bucket does not hold its upper edge."""
    return [math.nextafter(t, math.inf) for t in splits]


def _coded(df: DataFrame, features: str, keep: list[str], edges: dict[int, list[float]], places: list[tuple[int, int]]) -> DataFrame:
    """``keep`` and one code of the buckets that the features are in.

    ``edges`` are by the feature's number, ``places`` the place value and last
    digit of each.  Infinity and NaN are in a bucket past the last, or in the last digit.
    """
    keep = [F.col(f"`{c}`") for c in keep]
    plain = F.unwrap_udt(F.col(features))
    values = F.when(plain["type"] == 1, plain["values"]).otherwise(vector_to_array(F.col(features)))  # 1: dense
    out = df.select(*keep, values.alias("_ff_x"))
    names, x = [f"_ff_b{i}" for i in edges], [F.get("_ff_x", F.lit(i)) for i in edges]
    nan, top = F.lit(float("nan")), F.lit(float("inf"))
    out = out.select(*keep, *[F.when(v < top, v).otherwise(nan).alias(n) for v, n in zip(x, names)])
    numbered = [f"{n}n" for n in names]
    if names:
        out = Bucketizer(splitsArray=list(edges.values()), inputCols=names, outputCols=numbered,
                         handleInvalid="keep").transform(out)
    digits = [F.least(F.col(n).cast("long"), F.lit(last)) * F.lit(place) for n, (place, last) in zip(numbered, places)]
    return out.select(*keep, reduce(add, digits, F.lit(0).cast("long")).alias(CELL))


def _thresholds(trees: list) -> dict[int, list[float]] | None:
    """The thresholds of each feature that the trees split on, or None if a split is one of categories."""
    found = {}
    for tree in trees:
        text = tree.toDebugString
        if " in {" in text:
            return None
        for f, t in re.findall(r"If \(feature (\d+) <= ([^)]+)\)", text):
            found.setdefault(int(f), set()).add(float(t))
    return {f: sorted(found[f]) for f in sorted(found)}


def per_cell(df: DataFrame, features: str, trees: list, predict, outputs: int, keep: list[str]) -> DataFrame | None:
    """``keep`` and what ``predict`` makes of the features, looked up by the cells that the trees' thresholds cut.

    ``predict`` takes a table with ``features``, and adds ``outputs`` numbers
    that depend on what ``trees`` predict only; it is applied to one vector a
    cell.  None if there are too many cells, or a split is one of categories.
    """
    splits = _thresholds(trees) if trees else None
    if splits is None or any(abs(t) >= HIGHEST for s in splits.values() for t in s):
        return None
    cells = math.prod(len(s) + 1 for s in splits.values())
    if cells * (outputs + 8) * 8 > MOST_BYTES:
        return None
    places, place = {}, 1
    for f, s in splits.items():
        places[f] = (place, len(s))
        place *= len(s) + 1
    # the highest value of each bin stands for it: its upper threshold, or infinity
    values = [F.get(F.lit([*splits[f], math.inf]), F.pmod(F.expr(f"{CELL} div {places[f][0]}L"), F.lit(places[f][1] + 1)).cast("int"))
              if f in splits else F.lit(0.0) for f in range(trees[0].numFeatures)]
    table = df.sparkSession.range(cells).withColumnRenamed("id", CELL)
    table = predict(table.withColumn(features, array_to_vector(F.array(*values)))).drop(features)
    edges = {f: [-math.inf, *_past(s), math.inf] for f, s in splits.items()}
    return _coded(df, features, keep, edges, list(places.values())).join(F.broadcast(table), CELL).drop(CELL)


def _few_features(df: DataFrame, features: str) -> bool:
    told = df.schema[features].metadata.get("ml_attr", {})
    if not 0 < told.get("num_attrs", 1) <= MOST_FEATURES or {"nominal", "binary"} & set(told.get("attrs", {})):
        return False
    first = df.select(features).first()
    return first is not None and first[0] is not None and 0 < first[0].size <= MOST_FEATURES


def _sample(df: DataFrame, features: str, max_bins: int, rows: int, by: list[str] = ()) -> list[tuple]:
    """``by`` and the features of rows: as many as MLlib takes of ``rows``, that is ``max_bins`` squared, 10,000 at least."""
    wanted, some = max(max_bins * max_bins, 10_000), df.select(*by, features)
    some = some if wanted >= rows else some.sample(wanted / rows, 0)
    return [(*r[:-1], r[-1].toArray().tolist()) for r in some.collect()]


def _bins(sample: list[list[float]], max_bins: int) -> Bins:
    columns = zip(*sample)
    return Bins([candidate_splits([x for x in column if math.isfinite(x)], max_bins) for column in columns])


def _few_cells(df: DataFrame, bins: Bins, features: str, by: list[str], groups: int, rows: int) -> bool:
    """Whether the cells of each of ``groups`` values of ``by`` are far fewer than the rows."""
    if bins.cells >= 1 << 40:
        return False
    if bins.cells * groups * LEAST_ROWS <= rows:
        return True
    codes = bins.coded(df, features, by)  # not all cells need occur
    return codes.agg(F.approx_count_distinct(F.struct(*by, CELL))).first()[0] * LEAST_ROWS <= rows


def find_bins(df: DataFrame, features: str, max_bins: int, by: list[str] = (), groups: int = 1) -> Bins | None:
    """The bins of ``df``'s features, or None where the cells of each of ``groups`` values of ``by`` are too many for its rows."""
    if not _few_features(df, features):
        return None
    rows = df.count()
    sample = [x for x, in _sample(df, features, max_bins, rows)]
    if not sample:
        return None
    bins = _bins(sample, min(max_bins, rows))
    return bins if _few_cells(df, bins, features, list(by), groups, rows) else None


def find_fold_bins(df: DataFrame, features: str, max_bins: int, fold: str, sizes: list[int]) -> tuple[Bins, list[Bins]] | None:
    """The bins of the rows outside each fold, those of all rows as the last, and bins that are finer than all of them.

    ``sizes`` are the folds' numbers of rows.  None where the cells of the finer bins are too many.
    """
    rows = sum(sizes)
    if rows <= max(sizes) or not _few_features(df, features):
        return None
    sample = _sample(df, features, max_bins, rows - max(sizes), [fold])
    outside = [[x for f, x in sample if f != i] for i in range(len(sizes))] + [[x for _, x in sample]]
    if not all(outside):
        return None
    own = [_bins(some, min(max_bins, rows - n)) for some, n in zip(outside, [*sizes, 0])]
    finer = Bins([sorted(set().union(*s)) for s in zip(*[b.splits for b in own])])
    return (finer, own) if _few_cells(df, finer, features, [fold], len(sizes), rows) else None


def even(cells: DataFrame) -> DataFrame:
    """A table of cells written once, over all task slots."""
    return cut_lineage(cells.repartition(cells.sparkSession.sparkContext.defaultParallelism))


def count_cells(df: DataFrame, bins: Bins, features: str, label: str, by: list[str] = ()) -> DataFrame:
    """A row for each cell and value of ``by``: its code, number of rows and mean ``label``.

    The mean is null if a label is, so that a fit refuses it as it would the row.
    """
    y = F.col("_ff_y")
    rows = bins.coded(df.withColumn("_ff_y", F.col(label).cast("double")), features, [*by, "_ff_y"])
    return even(rows.groupBy(*by, CELL).agg(F.count(F.lit(1)).cast("double").alias(ROWS),
                                            F.when(F.count(y) == F.count(F.lit(1)), F.avg(y)).alias(label)))


def most_bins(est, count: int) -> int:
    """``maxBins`` for a fit on ``count`` cells, so that all bins stay candidates.

    Past the root of the number of cells, MLlib reads them all for its splits.
    """
    return max(est.getMaxBins(), math.isqrt(max(0, count)) + 1) + 2


def fit_cells(est, cells: DataFrame, bins: Bins, count: int, own: Bins | None = None):
    """``est`` fitted on ``count`` cells of ``bins``, or of the coarser bins ``own``, as a model of the features' values."""
    vectors = cells.withColumn(est.getFeaturesCol(), bins.vector(own))
    model = est.copy({est.weightCol: ROWS, est.maxBins: most_bins(est, count)}).fit(vectors)
    return (own or bins).on_values(est, model)


def fit_counted(est, df: DataFrame):
    """``est.fit(df)``: on counted cells where that gives the same model and they are far fewer than the rows."""
    if not countable(est):
        return est.fit(df)
    bins = find_bins(df, est.getFeaturesCol(), est.getMaxBins())
    if bins is None:
        return est.fit(df)
    cells = count_cells(df, bins, est.getFeaturesCol(), est.getLabelCol())
    return fit_cells(est, cells, bins, cells.count())
