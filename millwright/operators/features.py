"""Model features: one-hot type, leakage-safe feature matrix, vector assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright import schema as S


def one_hot_type(df: DataFrame, type_col: str = S.TYPE) -> DataFrame:
    """Three 0/1 DOUBLE columns for types H, L, M (fixed order, nothing to fit)."""
    t = F.col(type_col)
    return df.select(
        "*",
        *[F.when(t == v, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"type_{v.lower()}") for v in ("H", "L", "M")],
    )


def feature_matrix(df: DataFrame) -> DataFrame:
    """Id, the eight features with NULL -> 0, and ``label`` (NULL -> 0).

    Failure-mode columns are never selected (they are the label's parts).
    Ids are required, as in the reference.
    """
    missing = [c for c in (S.UDI,) if c not in df.columns]
    if missing:
        raise ValueError(f"readings need the id column(s) {missing}")
    oh = one_hot_type(df)
    return oh.select(
        S.UDI,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in S.NUMERIC_FEATURES],
        *S.ONE_HOT,
        F.coalesce(F.col(S.LABEL).cast("int"), F.lit(0)).alias("label"),
    )
