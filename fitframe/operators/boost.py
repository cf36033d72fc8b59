"""Boosted trees grown round by round over a column of margins.

MLlib's booster fits every round it is told to, and knows two classes at most.
Here the state of the boosting is a table: the rows of both sides with an array
of margins, one a class.  A round fits one ``DecisionTreeRegressor`` a class on
the gradient of a joint objective, sets its leaves by one Newton step (two sums
a leaf, from one grouped aggregate), adds them to the margins, and reads the
metric on both sides.  When the metric has not improved for ``patience`` rounds
nothing more is fitted.  The lineage is cut every few rounds; a stopped model
can be grown on from its margins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .cells import CELL, ROWS, Bins, countable, even, find_bins, most_bins, per_cell

EPS = 1e-15


#: Classes up to which the softmax is written out, so that it is compiled and no term is worked out twice.
WRITTEN_OUT = 16


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(margins: Column, classes: int = 0) -> Column:
    """Class probabilities of an array of margins, safe for large ones; ``classes`` is its length, if known."""
    if 1 < classes <= WRITTEN_OUT:
        each = [F.get(margins, F.lit(c)) for c in range(classes)]
        each = [F.exp(x - F.greatest(*each)) for x in each]
        return F.array(*[x / reduce(add, each, F.lit(0.0)) for x in each])
    each = _let(F.array_max(margins), lambda most: F.transform(margins, lambda x: F.exp(x - most)))
    return _let(each, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v),
                                     lambda total: F.transform(e, lambda x: x / total)))


def class_loss(label: Column, probs: Column, rows: Column | None = None) -> Column:
    """Mean multiclass log-loss as an aggregate (M2); ``rows`` is how many rows a row stands for, if not one."""
    loss = F.log(F.greatest(F.lit(EPS), F.get(probs, label.cast("int"))))
    return -F.avg(loss) if rows is None else -F.try_divide(F.sum(rows * loss), F.sum(rows))


def squared_error(label: Column, prediction: Column) -> Column:
    """Mean squared error as an aggregate."""
    return F.avg((label - prediction) * (label - prediction))


@dataclass
class Boosted:
    """A grown model: for every round one (tree, leaf values) a class.

    ``classes`` is 0 for the squared objective, which has one margin.  Leaf
    values are by MLlib's leaf number and hold the learning rate already.
    """

    classes: int
    base: list[float]
    features: str
    rounds: list[list[tuple]] = field(default_factory=list)

    def cut(self, rounds: int) -> Boosted:
        """The model of the first ``rounds`` rounds."""
        return Boosted(self.classes, self.base, self.features, self.rounds[:rounds])

    def margins(self, df: DataFrame, name: str = "margins", cut_every: int = 4) -> DataFrame:
        """``df`` and an array column with the margin of each class after all rounds."""
        trees = [t for done in self.rounds for t, _ in done]
        out = per_cell(df, self.features, trees, lambda cells: self._row_margins(cells, name, cut_every),
                       len(self.base), df.columns)
        return self._row_margins(df, name, cut_every) if out is None else out

    def _row_margins(self, df: DataFrame, name: str, cut_every: int) -> DataFrame:
        out = df.withColumn(name, F.array(*map(F.lit, self.base)))
        for i, trees in enumerate(self.rounds):
            out = _added(out, trees, self.features, name)
            if i % cut_every == cut_every - 1 and i + 1 < len(self.rounds):
                out = cut_lineage(out)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, and for classes a ``probability`` vector."""
        out = self.margins(df, "_ff_margins")
        if not self.classes:
            return out.withColumn("prediction", F.get("_ff_margins", F.lit(0))).drop("_ff_margins")
        best = F.array_position(F.col("_ff_margins"), F.array_max("_ff_margins")) - 1  # ties: the smallest class
        return (out.withColumn("prediction", best.cast("double"))
                .withColumn("probability", array_to_vector(softmax(F.col("_ff_margins"), self.classes))).drop("_ff_margins"))


def _leaves(df: DataFrame, trees: list, features: str) -> DataFrame:
    """``df`` with the array ``_ff_leaves``: the row's leaf number in each tree."""
    names = [f"_ff_leaf{c}" for c in range(len(trees))]
    out = df
    for tree, name in zip(trees, names, strict=True):
        out = tree.setFeaturesCol(features).setPredictionCol("").setLeafCol(name).transform(out)
    return out.withColumn("_ff_leaves", F.array(*[F.col(n).cast("int") for n in names])).drop(*names)


def _added(df: DataFrame, trees: list[tuple], features: str, margins: str) -> DataFrame:
    """``df`` with the leaf values of one round added to its margins."""
    out = _leaves(df, [t for t, _ in trees], features)
    values = [F.get(F.array(*map(F.lit, v)), F.get("_ff_leaves", F.lit(c))) for c, (_, v) in enumerate(trees)]
    new = F.array(*[F.get(margins, F.lit(c)) + v for c, v in enumerate(values)])
    return out.withColumn(margins, new).drop("_ff_leaves")


def _counted(rows: DataFrame, bins: Bins) -> tuple[DataFrame, int]:
    """A row for each side, label and cell: bin numbers for the features, and how many rows; and the number of cells."""
    cells = bins.coded(rows, "_x", ["_y", "_side"]).groupBy("_y", "_side", CELL).agg(F.count(F.lit(1)).alias(ROWS))
    cells = even(cells.select("_y", bins.vector().alias("_x"), "_side", F.col(ROWS).cast("double").alias(ROWS)))
    return cells, cells.count()


def grow(train: DataFrame, valid: DataFrame, classes: int = 0, rounds: int = 100, patience: int | None = None,
         eta: float = 0.1, max_depth: int = 5, l2: float = 1.0, metric=None, label: str = "label",
         features: str = "features", start: Boosted | None = None, cut_every: int = 4, **tree):
    """Boosting under one joint objective that stops by itself.

    ``classes`` = 0 fits squared error, otherwise the softmax of that many
    classes (labels 0, 1, ...), with one tree a class and round.  ``metric``
    takes the label and the prediction (the array of probabilities for classes)
    and returns an aggregate; smaller is better.  ``patience`` rounds without a
    new best on ``valid`` end the fit; None grows all ``rounds``.  ``start`` is
    a model to grow on from.  ``tree`` goes to ``DecisionTreeRegressor``.

    Where there are far fewer cells of rows with equal bins than rows (:mod:`cells`),
    classes with the built-in metric are fitted on one row for each side, label and
    cell, with the number of its rows: such rows have the same margins in all rounds.

    Returns ``(model cut at the best round, curve)``, the curve a table (round,
    train_loss, valid_loss, is_best) of the rounds that were fitted.  Rows with
    a null label are left out; without training rows this is a ValueError.
    """
    own_metric, metric = metric is None, metric or (class_loss if classes else squared_error)
    y, g = F.col("_y"), F.col("_m")
    sides = [df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("_y"), F.col(features).alias("_x"), F.lit(side).alias("_side"))
        for side, df in enumerate((train, valid))]
    rows = sides[0].unionByName(sides[1])
    if start is None:
        mean = sides[0].agg(F.avg("_y")).first()[0]
        if mean is None:
            raise ValueError("no training rows")
        start = Boosted(classes, [0.0] * classes if classes else [float(mean)], features)
    model = Boosted(classes, start.base, features, list(start.rounds))
    est = DecisionTreeRegressor(featuresCol="_x", labelCol="label", maxDepth=max_depth, **tree)
    bins, n = None, F.lit(1.0)
    if classes and own_metric and not model.rounds and countable(est):
        bins = find_bins(sides[0], "_x", est.getMaxBins(), ["_y"], classes)
    if bins:
        rows, count = _counted(rows, bins)
        est, n = est.copy({est.weightCol: ROWS, est.maxBins: most_bins(est, count)}), F.col(ROWS)

        def metric(label, probs):
            return class_loss(label, probs, n)
    fitted_on = Boosted(classes, start.base, "_x", model.rounds)  # the same rounds over the state's column
    state = cut_lineage(fitted_on.margins(rows, "_m", cut_every))
    if classes:
        probs = softmax(g, classes)
        # gradient and (doubled) curvature of the softmax loss
        first = F.transform(probs, lambda p, c: F.when(c == y.cast("int"), 1.0).otherwise(0.0) - p)
        second = F.transform(probs, lambda p: F.greatest(2 * p * (1 - p), F.lit(EPS)))
    else:
        probs = F.get(g, F.lit(0))
        first, second = F.array(y - probs), F.array(F.lit(1.0))
    curve, best, best_at = [], float("inf"), len(model.rounds)
    for i in range(rounds):
        left = state.where("_side = 0").withColumn("_g", first)
        trees = []
        for c in range(max(1, classes)):
            one = left.select("_x", F.get("_g", F.lit(c)).alias("label"), *([ROWS] if bins else []))
            trees.append(est.fit(one))
        # the sums of every leaf of every tree: a few rows a tree, added up before the shuffle
        at = _leaves(left, trees, "_x").select(F.posexplode(F.arrays_zip(
            F.col("_ff_leaves").alias("leaf"), F.col("_g").alias("g"), second.alias("h"))).alias("c", "v"), n.alias("_n"))
        sums = {(r.c, r.leaf): (r.g, r.h) for r in at.groupBy("c", "v.leaf").agg(
            F.sum(F.col("v.g") * F.col("_n")).alias("g"), F.sum(F.col("v.h") * F.col("_n")).alias("h")).collect()}

        def value(c: int, leaf: int) -> float:
            total, bend = sums.get((c, leaf), (0.0, 0.0))
            return eta * total / (bend + l2) if bend + l2 else 0.0

        done = [(t, [value(c, leaf) for leaf in range((t.numNodes + 1) // 2)]) for c, t in enumerate(trees)]
        model.rounds.append(done)
        state = _added(state, done, "_x", "_m")
        if i % cut_every == cut_every - 1 and i + 1 < rounds:
            state = cut_lineage(state)
        loss = {r["_side"]: r["v"] for r in state.groupBy("_side").agg(metric(y, probs).alias("v")).collect()}
        curve.append((len(model.rounds), loss.get(0), loss.get(1)))
        if loss.get(1) is not None and loss[1] < best:
            best, best_at = loss[1], len(model.rounds)
        elif patience is not None and len(model.rounds) - best_at >= patience:
            break
    if best == float("inf"):
        best_at = len(model.rounds)  # no loss to go by: nothing is cut
    if bins:  # the trees of bin numbers as trees of values
        model.rounds = [[(bins.on_values(est, t), v) for t, v in done] for done in model.rounds]
    table = train.sparkSession.createDataFrame([(n, t, v, n == best_at) for n, t, v in curve],
                                               "round int, train_loss double, valid_loss double, is_best boolean")
    return model.cut(best_at), table


# ---------------------------------------------------------------- K20


def tree_nodes(model, path: str) -> DataFrame:
    """(tree, node, feature, threshold, gain, rows): the nodes of a fitted tree, forest or booster.

    ``feature`` is its number, null for a leaf.  The model is saved under
    ``path``, a new folder that all executors see, and its nodes are read back
    as a table; nothing is parsed on the driver.
    """
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    return data.select("tree", F.col("id").alias("node"), F.when(inner, F.col("split.featureIndex")).alias("feature"),
                       F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
                       F.when(inner, F.col("gain")).alias("gain"), F.col("rawCount").alias("rows"))


def split_importances(nodes: DataFrame, feature_names: list[str]) -> DataFrame:
    """(feature, splits, gain, cover) from a node table, a row for every feature.

    ``splits`` counts the nodes that split on the feature, ``gain`` and
    ``cover`` are the mean gain and number of rows of those nodes (null for a
    feature that no node uses).
    """
    names = nodes.sparkSession.createDataFrame(list(enumerate(feature_names)), "at int, feature string")
    used = nodes.where("feature IS NOT NULL").groupBy(F.col("feature").alias("at")).agg(
        F.count("*").alias("splits"), F.avg("gain").alias("gain"), F.avg("rows").alias("cover"))
    return names.join(used, "at", "left").select("feature", F.coalesce("splits", F.lit(0)).alias("splits"), "gain", "cover")
