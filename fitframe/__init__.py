"""fitframe: tabular feature preparation and model scoring on Spark DataFrames.

Subpackages
-----------
``fitframe.sources``    typed CSV/Parquet scans, train/test loading, reload-or-build,
                        submission and feature-map sinks
``fitframe.functions``  row-local column expressions (null rules, division rule,
                        date/text derivations, pairwise crosses, target transforms)
``fitframe.operators``  DataFrame operators and ``pyspark.ml`` estimators:
                        ``clean``, ``impute``, ``encode``, ``split``, ``rank``,
                        ``relate``, ``ordered``, ``metrics``, ``post``, ``schema``,
                        ``models``
``fitframe.plans``      the query catalogue on the driver tables, each query
                        registered with its DuckDB SQL twin
``fitframe.streaming``  row-local operators and fitted models on a file stream
``fitframe.session``    checkpoint folder rule, lineage cuts, cluster sizing
"""

__version__ = "0.1.0"
