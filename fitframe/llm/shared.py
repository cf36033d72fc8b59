"""Helpers of the training-data operators: shared tables, columns, zstd blocks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The white space that separates words in every contract of this folder.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage in a place every executor sees, and gives every later
    pass the same rows whatever task is run again.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def renamed(df: DataFrame, taken: list[str]) -> dict[str, str]:
    """For every name in ``taken``, a helper column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    out = {}
    for name in taken:
        new = f"__{name}"
        while new.lower() in have:
            new = "_" + new
        out[name] = new
    return out


def text_or_empty(col: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def packed(values: np.ndarray) -> bytes:
    """An integer array as zstd bytes, its byte planes stored one after another."""
    import zstandard

    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    """The array that ``packed`` took."""
    import zstandard

    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)
