"""Query registry: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB oracle SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.operators.state import FittedState, exists, load_state, save_state
from millwright.session import ensure_checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is its DuckDB SQL (omit for rows-only checks)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every DOUBLE column (for engine-independent comparison of sums and means)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(out)


def state_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where the session's store has the state ``name`` of a data folder."""
    return f"{ensure_checkpoint_dir(spark)}/state-{name}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"


def fitted(spark: SparkSession, sf_dir: str, name: str, fit: Callable[[], FittedState]) -> FittedState:
    """The state ``name`` of a data folder from the session's store; fitted and saved where it is not there yet."""
    path = state_path(spark, sf_dir, name)
    if not exists(spark, f"{path}/manifest"):
        save_state(spark, fit(), path)
    return load_state(spark, path)
