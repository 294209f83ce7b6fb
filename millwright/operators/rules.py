"""Derived columns and failure-mode rules (row-wise, no shuffle)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright import schema as S
from millwright.functions import expressions as X

# Calibration parts: the excess each violated rule contributes to the risk model.
PARTS = ["twf", "hdf_temp", "hdf_rpm", "pwf_low", "pwf_high", "osf"]
ANY_TYPE = ""  # type key of the parts that do not depend on the machine type


def with_inputs(df: DataFrame) -> DataFrame:
    """``df`` with all columns that the rules read. Where one is absent no rule can be judged:
    the result has no row, and calibration and modes over it are empty."""
    absent = [c for c in [*S.SENSORS, S.TYPE] if c not in df.columns]
    if not absent:
        return df
    kinds = {c: "string" if c == S.TYPE else "double" for c in absent}
    return df.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).where(F.lit(False))


def derived_features(df: DataFrame) -> DataFrame:
    """Add temperature difference, power (W), overstrain (min·Nm) and the type's OSF limit."""
    return df.select(
        "*",
        X.temp_diff().alias("temp_diff"),
        X.power().alias("power_w"),
        X.overstrain().alias("overstrain"),
        X.osf_limit().alias("osf_limit"),
    )


def rule_twf(df: DataFrame) -> DataFrame:
    """Readings with tool wear above 200 min, and the excess over the threshold."""
    return df.where(X.twf_rule()).select(
        "*", (F.col(S.WEAR) - F.lit(S.TWF_WEAR)).alias("wear_excess")
    )


def rule_hdf(df: DataFrame) -> DataFrame:
    """Heat dissipation: temperature difference below 8.6 K and speed below 1380 rpm."""
    return df.where(X.hdf_rule()).select(
        "*",
        X.temp_diff().alias("temp_diff"),
        (F.lit(S.HDF_TEMP_DIFF) - X.temp_diff()).alias("temp_margin"),
        (F.lit(S.HDF_RPM) - F.col(S.RPM)).alias("rpm_margin"),
    )


def rule_pwf(df: DataFrame) -> DataFrame:
    """Power outside 3500..9000 W; the low branch is tested first."""
    p = X.power()
    return df.where(X.pwf_rule()).select(
        "*",
        p.alias("power_w"),
        F.when(p < S.PWF_POWER_MIN, "low").otherwise("high").alias("branch"),
        F.when(p < S.PWF_POWER_MIN, F.lit(S.PWF_POWER_MIN) - p).otherwise(p - F.lit(S.PWF_POWER_MAX)).alias("power_excess"),
    )


def rule_osf(df: DataFrame) -> DataFrame:
    """Overstrain above the limit of the machine type (unknown type: never)."""
    return df.where(X.osf_rule()).select(
        "*",
        X.overstrain().alias("overstrain"),
        X.osf_limit().alias("osf_limit"),
        (X.overstrain() - X.osf_limit()).alias("overstrain_excess"),
    )


def _part(name: str, cond: Column, excess: Column, type_col: Column | None = None) -> Column:
    t = type_col if type_col is not None else F.lit(ANY_TYPE)
    return F.when(cond & excess.isNotNull(), F.struct(F.lit(name).alias("part"), t.alias("type"), excess.alias("value")))


def violation_parts(df: DataFrame) -> Column:
    """Array of (part, type, excess) for every rule part the reading violates (one pass)."""
    td, p, o = X.temp_diff(), X.power(), X.overstrain()
    hdf = X.hdf_rule()
    return X.compact_array(
        _part("twf", X.twf_rule(), F.col(S.WEAR) - F.lit(S.TWF_WEAR)),
        _part("hdf_temp", hdf, F.lit(S.HDF_TEMP_DIFF) - td),
        _part("hdf_rpm", hdf, F.lit(S.HDF_RPM) - F.col(S.RPM)),
        _part("pwf_low", p < F.lit(S.PWF_POWER_MIN), F.lit(S.PWF_POWER_MIN) - p),
        _part("pwf_high", p > F.lit(S.PWF_POWER_MAX), p - F.lit(S.PWF_POWER_MAX)),
        _part("osf", o > X.osf_limit(), o - X.osf_limit(), F.col(S.TYPE)),
    )


def risk_calibration(df: DataFrame) -> DataFrame:
    """Excess values of the violating readings, one row per (reading, part).

    ``part`` is one of :data:`PARTS`; ``type`` is the machine type for ``osf``
    and '' otherwise. Readings with a missing sensor contribute nothing to the
    part that needs it, and a table without one of the columns has no calibration.
    """
    return with_inputs(df).select(F.inline(violation_parts(df)))


def shown_numbers(mode: str) -> Column:
    """The numbers in a mode's trigger text, from the reading's columns."""
    numbers = {"TWF": [F.col(S.WEAR)], "HDF": [X.temp_diff(), F.col(S.RPM)], "PWF": [X.power()], "OSF": [X.overstrain()]}
    return F.array(*[n.cast("double") for n in numbers[mode]])


def trigger_text(mode: Column, shown: Column, type_: Column) -> Column:
    """Human-readable trigger of a violated mode, from its :func:`shown_numbers` and the machine type;
    numbers round as in :func:`X.fixed`."""
    text = None
    for name, words in S.TRIGGERS.items():
        numbers = iter(range(2))
        parts = []
        for w in re.split(r"(\{\w+\})", words):
            if w == "{type}":
                parts.append(type_)
            elif w == "{limit}":
                parts.append(X.osf_limit(type_).cast("int").cast("string"))
            elif w.startswith("{"):
                parts.append(X.fixed(F.get(shown, F.lit(next(numbers))), 1 if w in S.ONE_DECIMAL else 0))
            elif w:
                parts.append(F.lit(w))
        here = F.concat(*parts)
        text = F.when(mode == name, here) if text is None else text.when(mode == name, here)
    return text
