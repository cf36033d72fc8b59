"""Sinks (B1-B7).  All writes are distributed (one file per partition);
nothing is funnelled through the driver or a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import class_probabilities


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite",
              compression: str | None = None) -> None:
    """CSV with a header row and no index column (B1)."""
    w = df.write.mode(mode).option("header", header)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def write_submission(df: DataFrame, path: str, id_col: str, pred_col: str,
                     id_name: str | None = None, pred_name: str | None = None) -> None:
    """Header + (id, prediction) rows (B2); the id is carried, not regenerated."""
    write_csv(df.select(F.col(id_col).alias(id_name or id_col),
                        F.col(pred_col).alias(pred_name or pred_col)), path)


def wide_submission(df: DataFrame, id_col: str, probability: str,
                    class_names: list[str]) -> DataFrame:
    """id + one probability column per class in fixed class order."""
    return df.select(F.col(id_col), *class_probabilities(probability, class_names))


def write_wide_submission(df: DataFrame, path: str, id_col: str, probability: str,
                          class_names: list[str]) -> None:
    write_csv(wide_submission(df, id_col, probability, class_names), path)


def run_tagged_path(base: str, **params) -> str:
    """Output path carrying the run's parameters in its name."""
    tag = "_".join(f"{k}{v}" for k, v in params.items())
    return f"{base.rstrip('/')}/{tag}" if tag else base


def feature_map(spark: SparkSession, features: list[str], kind: str = "q") -> DataFrame:
    """``index, name, type`` rows of the feature list (B5); the list is a
    schema-sized driver object, not data."""
    return spark.createDataFrame([(i, f, kind) for i, f in enumerate(features)],
                                 "index int, name string, type string")


def write_feature_map(spark: SparkSession, features: list[str], path: str) -> None:
    """Tab-separated ``i \\t name \\t q`` file."""
    (feature_map(spark, features).write.mode("overwrite")
     .option("sep", "\t").option("header", False).csv(path))


def write_importances(importances: DataFrame, path: str) -> None:
    """Feature importance table sorted ascending by score."""
    write_csv(importances.orderBy(F.col("importance").asc(), F.col("feature").asc()), path)


def fill_template(template: DataFrame, preds: DataFrame, id_col: str, target: str,
                  pred_col: str) -> DataFrame:
    """Take ids (and order of columns) from a sample submission and replace
    its target by the predictions, joined on id (B7) -- a positional
    assignment would depend on row order, which a distributed table lacks."""
    j = template.drop(target).join(preds.select(id_col, F.col(pred_col).alias(target)),
                                   id_col, "left")
    return j.select(*template.columns)
