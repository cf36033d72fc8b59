"""Row and column filters driven by statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reuse_if_shuffled


def drop_outliers(df: DataFrame, columns: list[str], k: float = 3.0,
                  faithful: bool = True) -> DataFrame:
    """Sequential k-sigma filter (P3, traps T4, T8).

    For each column in turn, mean and *sample* std are computed over the rows
    still left.  ``faithful`` reproduces both passes the reference runs per
    column: ``|x-m| <= k*s`` (drops NULL, and everything when s is NULL),
    then, with statistics recomputed, ``NOT(|x-m| > k*s)`` (keeps rows whose
    comparison is unknown).  Each pass is one aggregate job; the statistics
    come back as two literals, so the filters stay inside codegen.  If the
    input's plan shuffles, it is materialised once before the passes.
    """
    out = reuse_if_shuffled(df)
    for c in columns:
        x = F.col(c).cast("double")
        m, s = out.agg(F.avg(x), F.stddev_samp(x)).first()
        out = out.where(F.abs(x - F.lit(m)) <= F.lit(k) * F.lit(s).cast("double"))
        if faithful:
            m, s = out.agg(F.avg(x), F.stddev_samp(x)).first()
            out = out.where(~F.coalesce(F.abs(x - F.lit(m)) > F.lit(k) * F.lit(s).cast("double"),
                                        F.lit(False)))
    return out


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: rows, non-null count, distinct non-null count.

    One unpivot + two-level aggregate for all columns: ``(name, value)``
    pairs are de-duplicated with a map-side partial aggregate, so neither a
    wide ``countDistinct`` expand nor a per-column job is needed.  Returns a
    small DataFrame ``(name, n_rows, n_present, n_distinct)``.
    """
    cols = columns or df.columns
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in cols]
    long = df.select(F.explode(F.array(*pairs)).alias("kv")).select("kv.*")
    per_value = long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    prof = per_value.groupBy("name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_present"),
        F.count("v").alias("n_distinct"))
    return prof.select("name", F.col("n_rows").cast("long"), F.col("n_present").cast("long"),
                       F.col("n_distinct").cast("long"))


def noisy_verdict(prof: DataFrame, min_share: float = 0.5, max_distinct_share: float = 0.4) -> DataFrame:
    """Add the reference's verdict: 'empty' (no value), 'sparse' (< half
    present), 'high_cardinality' (distinct > 0.4 * rows), else 'keep'."""
    return prof.withColumn(
        "verdict",
        F.when(F.col("n_distinct") < 1, F.lit("empty"))
        .when(F.col("n_present") < F.lit(min_share) * F.col("n_rows"), F.lit("sparse"))
        .when(F.col("n_distinct") > F.lit(max_distinct_share) * F.col("n_rows"), F.lit("high_cardinality"))
        .otherwise(F.lit("keep")))


def noisy_columns(df: DataFrame, columns: list[str] | None = None, approx_first: bool = True,
                  min_share: float = 0.5, max_distinct_share: float = 0.4, rsd: float = 0.02) -> set:
    """Names of the columns the P6 rule rejects, exactly.

    ``approx_first``: one aggregate gives row count, non-null counts and
    HyperLogLog distinct estimates for every column.  Only columns whose
    estimate lies within the error band (5 * rsd) of a distinct threshold are
    re-counted exactly with :func:`profile_columns`, so the verdict equals
    the exact one while wide tables avoid the full unpivot.
    """
    cols = columns or df.columns
    if not approx_first:
        v = noisy_verdict(profile_columns(df, cols), min_share, max_distinct_share)
        return {r["name"] for r in v.where(F.col("verdict") != "keep").select("name").collect()}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count(F.col(c)).alias(f"p{i}"),
                 F.approx_count_distinct(F.col(c), rsd).alias(f"d{i}")]
    row = df.agg(*aggs).first()  # one row: two numbers per column
    n = row["_n"]
    bad, unsure = set(), []
    band = 5 * rsd
    for i, c in enumerate(cols):
        present, est = row[f"p{i}"], row[f"d{i}"]
        if present == 0:
            bad.add(c)                                  # no value at all (exact: count is exact)
        elif present < min_share * n:
            bad.add(c)                                  # exact: counts are exact
        elif abs(est - max_distinct_share * n) <= band * max(est, 1):
            unsure.append(c)                            # near the distinct threshold: count exactly
        elif est > max_distinct_share * n:
            bad.add(c)
    if unsure:
        bad |= noisy_columns(df, unsure, approx_first=False, min_share=min_share,
                             max_distinct_share=max_distinct_share)
    return bad


def drop_noisy(df: DataFrame, columns: list[str] | None = None, keep: list[str] = (),
               approx_first: bool = True) -> DataFrame:
    """Drop the columns the P6 rule rejects; ``keep`` are never dropped."""
    bad = noisy_columns(df, columns, approx_first)  # <= number of columns
    return df.select(*[c for c in df.columns if c not in bad or c in keep])


def null_counts(df: DataFrame, columns: list[str] | None = None) -> dict:
    """Nulls per column, one aggregate."""
    cols = columns or df.columns
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def drop_null_columns(train: DataFrame, test: DataFrame | None = None,
                      mode: str = "intersection"):
    """Drop every column that has a null (P7, trap T11).

    ``independent``: each table loses its own null columns (schemas may
    diverge, as in the reference).  ``intersection``: a column survives only
    if it is null-free in both.
    """
    tr = null_counts(train)
    if test is None:
        return train.select(*[c for c in train.columns if tr[c] == 0])
    te = null_counts(test)
    if mode == "independent":
        return (train.select(*[c for c in train.columns if tr[c] == 0]),
                test.select(*[c for c in test.columns if te[c] == 0]))
    if mode != "intersection":
        raise ValueError(mode)
    keep = [c for c in train.columns if tr[c] == 0 and te.get(c, 0) == 0]
    return (train.select(*keep), test.select(*[c for c in test.columns if c in set(keep) or c not in tr]))


def complement(df: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``chosen`` (P8, R ``tra[-h, ]``)."""
    return df.join(chosen.select(*key), key, "left_anti")
