"""Scans (A1-A8): typed CSV and Parquet readers, the train/test loader and
the reload-or-build intermediate."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.split import random_split


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             dtype: dict[str, str] | None = None, header: bool = True,
             infer: bool = True, repartition: int | None = None,
             lenient: bool = False) -> DataFrame:
    """CSV with a header (A1).

    ``schema`` gives every type up front (no inference pass -- preferred at
    scale); text that does not fit it raises, unless ``lenient``, where it
    becomes NULL.  Otherwise types are inferred and ``dtype`` overrides single
    columns by a cast (A3).  The cast is strict (bad text raises, like the
    reference's typed read) unless ``lenient``, where it becomes NULL (C9).
    Gzip input is detected by extension (A4); a gzip file is one split, so
    pass ``repartition`` to spread the rows after it.
    """
    mode = "FAILFAST" if schema is not None and not lenient else "PERMISSIVE"
    reader = spark.read.option("header", header).option("mode", mode)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    df = reader.csv(path)
    if dtype:
        df = df.withColumns({c: (F.col(c).try_cast(t) if lenient else F.col(c).cast(t))
                             for c, t in dtype.items()})
    if repartition:
        df = df.repartition(repartition)
    return df


def scan_files(spark: SparkSession, *paths: str, **kw) -> tuple[DataFrame, ...]:
    """Several files with the same options, returned as a tuple (A2, A5)."""
    return tuple(scan_csv(spark, p, **kw) for p in paths)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan: typed, column-pruned and filter-pushed by Catalyst."""
    return spark.read.parquet(path)


def load_pair(spark: SparkSession, full: str | None = None, train: str | None = None,
              test: str | None = None, random: bool = True, flag: str = "is_train",
              fraction: float = 0.75, seed: int = 0, key_cols: list[str] | None = None,
              **kw) -> tuple[DataFrame, DataFrame]:
    """One full file split at random, or a fixed train/test pair."""
    if random:
        _, tr, te = random_split(scan_csv(spark, full, **kw), fraction, seed, flag, key_cols)
        return tr, te
    return scan_csv(spark, train, **kw), scan_csv(spark, test, **kw)


def reload_or_build(spark: SparkSession, path: str, build, rebuild: bool = False) -> DataFrame:
    """Re-enter at a materialised intermediate.

    When ``path`` holds a Parquet table and ``rebuild`` is false it is read;
    otherwise ``build()`` runs, its result is written there and read back,
    so later stages start from the stored table instead of the raw input.
    """
    marker = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    if rebuild or not fs.exists(marker):  # only a completed write counts
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_argument(position: int = 1, default: str | None = None) -> str:
    """Input path from the command line."""
    if len(sys.argv) > position:
        return sys.argv[position]
    if default is None:
        raise SystemExit(f"usage: {os.path.basename(sys.argv[0])} <path>")
    return default
