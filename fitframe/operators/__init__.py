"""Table operators: DataFrame -> DataFrame, fitted ones as pyspark.ml estimators."""
