"""Row-local derivations and fitted-model scoring on a stream.

The reference has no streaming operator.  Everything row-local in this
package (null rules, date/text derivations, crosses, calibration) and any
fitted ``Model.transform`` whose state is literals or a broadcast table is
a stateless projection, so it applies unchanged to a ``readStream``
DataFrame.  This module only wires source and sink; the fitted state comes
from a batch fit on the historical table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType | str,
                fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``path`` (directory or glob) with a fixed schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def score_stream(stream: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply batch-defined steps (``df -> df``: derivations, ``model.transform``) to a stream."""
    out = stream
    for step in steps:
        out = step(out)
    return out


def write_stream(scored: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 once: bool = True):
    """Append the scored rows to a table; the checkpoint makes restarts exactly-once."""
    w = (scored.writeStream.format(fmt).option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if once else w
    return w.start()
