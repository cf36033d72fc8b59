"""Splits and samples.

Compared results must not depend on partitioning, so the splits used by
the queries are hash based (``xxhash64`` of a key and a seed): the same row
lands on the same side on any cluster layout and after any retry.
``rand(seed)`` splits are kept for the reference's random split; they are
materialised with a reliable checkpoint so both sides are cut from one draw
even if an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rank import global_rank
from .select import key_of, literal_key, nth_smallest


_DRAW_RANGE = 1 << 62


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_hash(key_cols: list[str], seed: int) -> Column:
    """A uniform draw in [0, 1) from a hash of the key columns and a seed."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key_cols])
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def random_split(df: DataFrame, fraction: float = 0.75, seed: int = 0,
                 flag: str = "is_train", key_cols: list[str] | None = None):
    """Uniform draw <= fraction is train; the flag is kept as a column.

    With ``key_cols`` the draw is a hash of the key (reproducible anywhere);
    without, ``rand(seed)`` is drawn once and checkpointed.
    Returns ``(flagged, train, test)``.
    """
    if key_cols:
        flagged = df.withColumn(flag, unit_hash(key_cols, seed) <= fraction)
    else:
        flagged = cut_lineage(df.withColumn(flag, F.rand(seed) <= fraction))
    return flagged, flagged.where(F.col(flag)), flagged.where(~F.col(flag))


def expr_split(df: DataFrame, condition: Column, flag: str = "is_train"):
    """Split by a deterministic expression: ``pmod(id, 10) >= 5`` (S2) or
    ``pmod(Sales*15 + Customers*3, 17) <= 13`` (S3).  Returns (flagged, train, test)."""
    flagged = df.withColumn(flag, condition)
    return flagged, flagged.where(F.col(flag)), flagged.where(~F.col(flag))


def modulo_condition(key: str, modulus: int = 10, threshold: int = 5) -> Column:
    """``id % modulus >= threshold`` with Python's modulo."""
    return F.pmod(F.col(key), F.lit(modulus)) >= threshold


def holdout(df: DataFrame, key_cols: list[str], fraction: float, seed: int = 1337,
            flag: str = "is_holdout") -> DataFrame:
    """Fractional holdout by a stable hash draw (S4): 1 % or 5 % of rows, or any other share."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key_cols]), F.lit(_DRAW_RANGE))
    return df.withColumn(flag, draw < F.lit(round(min(1.0, max(0.0, fraction)) * _DRAW_RANGE)))


def fold_column(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 1337,
                name: str = "fold") -> DataFrame:
    """Shuffled k-fold assignment as a column (S6); usable as ``CrossValidator(foldCol=...)``."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), *[F.col(k_) for k_ in key_cols]),
                                      F.lit(k)).cast("int"))


def fixed_sample_split(df: DataFrame, n: int, key_cols: list[str], seed: int = 0,
                       flag: str = "is_sample") -> DataFrame:
    """Exactly ``n`` rows as validation, the rest for training.

    The sample is the ``n`` rows with the smallest (hash draw, row number).
    Row numbers are given once, in a checkpointed copy, so rows that share a
    key (or have a NULL one) are told apart.  Only rows with a draw under a
    bound sized for about 1.2 n expected rows are ranked; when fewer than
    ``n`` come back the bound is doubled.  The n smallest are always among
    them, so the result equals a full sort.  The last of them is a threshold
    that flags the rows in place: no join.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in key_cols]), F.lit(_DRAW_RANGE))
    drawn = cut_lineage(df.withColumn("_ff_draw", draw).withColumn("_ff_row", F.monotonically_increasing_id()))
    total = drawn.count()
    if n <= 0 or n >= total:
        return drawn.withColumn(flag, F.lit(n > 0)).drop("_ff_draw", "_ff_row")
    frac = min(1.0, 1.2 * n / total + 16.0 / total)
    while True:
        bound = int(_DRAW_RANGE * frac) if frac < 1.0 else _DRAW_RANGE
        cand = drawn.where(F.col("_ff_draw") < F.lit(bound)).select("_ff_draw", "_ff_row")
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 2)
    last = global_rank(cand, [F.col("_ff_draw").asc(), F.col("_ff_row").asc()], "_ff_pos") \
        .where(F.col("_ff_pos") == n).first()
    inside = (F.col("_ff_draw") < last["_ff_draw"]) | \
        ((F.col("_ff_draw") == last["_ff_draw"]) & (F.col("_ff_row") <= last["_ff_row"]))
    return drawn.withColumn(flag, inside).drop("_ff_draw", "_ff_row")


def sample_rows(df: DataFrame, n: int, key_cols: list[str], seed: int = 0) -> DataFrame:
    """A reproducible ``n``-row development sample (S9): the sampling feature itself."""
    flagged = fixed_sample_split(df, n, key_cols, seed, "_ff_in")
    return flagged.where(F.col("_ff_in")).drop("_ff_in")


def date_split(df: DataFrame, date_col: str, cutoff: str, flag: str = "is_train") -> DataFrame:
    """Rows on or before the cut-off date are train (S7).  The cut-off is cast
    to the column's own type, so a zone-less timestamp is compared without
    any session time-zone shift."""
    return df.withColumn(flag, F.col(date_col) <= F.lit(cutoff).cast(dict(df.dtypes)[date_col]))


def tail_split(df: DataFrame, order_by: list, n_valid: int, flag: str = "is_train") -> DataFrame:
    """Positional head/tail split on an explicit order (S8): the last
    ``n_valid`` rows are validation.

    With column names (ascending, nulls first) the last training row's key is
    selected exactly and rows are flagged in place: no sort, no shuffle of
    rows.  Rows that tie across the border, and orders given as expressions,
    need a place each and go by the distributed global rank.
    """
    total = df.count()
    n_train = total - n_valid
    if n_train <= 0 or n_valid <= 0:
        return df.withColumn(flag, F.lit(n_train > 0))
    if all(isinstance(c, str) for c in order_by):
        last, at_most = nth_smallest(df, order_by, n_train)
        if at_most == n_train:
            kinds = [df.schema[c].dataType for c in order_by]
            return df.withColumn(flag, key_of(order_by) <= literal_key(last, kinds))
    ranked = global_rank(df, order_by, "_ff_pos")
    return ranked.withColumn(flag, F.col("_ff_pos") <= n_train).drop("_ff_pos")
