"""Column expressions shared by the operators (all JVM-side, no UDF)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright import schema as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def temp_diff(air: str | Column = S.AIR, process: str | Column = S.PROCESS) -> Column:
    """Process minus air temperature, in kelvin."""
    return col(process) - col(air)


def power(torque: str | Column = S.TORQUE, rpm: str | Column = S.RPM) -> Column:
    """Mechanical power in watts; evaluated as ``torque * rpm * pi / 30``, in that order."""
    return col(torque) * col(rpm) * F.lit(math.pi) / F.lit(30.0)


def overstrain(wear: str | Column = S.WEAR, torque: str | Column = S.TORQUE) -> Column:
    return col(wear) * col(torque)


def osf_limit(type_col: str | Column = S.TYPE) -> Column:
    """Overstrain limit of the machine type; NULL for an unknown type (no OSF rule then)."""
    t = col(type_col)
    expr = None
    for k, v in S.OSF_LIMITS.items():
        expr = (F.when(t == k, F.lit(v)) if expr is None else expr.when(t == k, F.lit(v)))
    return expr


def twf_rule(wear: str | Column = S.WEAR) -> Column:
    return col(wear) > F.lit(S.TWF_WEAR)


def hdf_rule(air=S.AIR, process=S.PROCESS, rpm=S.RPM) -> Column:
    return (temp_diff(air, process) < F.lit(S.HDF_TEMP_DIFF)) & (col(rpm) < F.lit(S.HDF_RPM))


def pwf_low_rule(torque=S.TORQUE, rpm=S.RPM) -> Column:
    return power(torque, rpm) < F.lit(S.PWF_POWER_MIN)


def pwf_high_rule(torque=S.TORQUE, rpm=S.RPM) -> Column:
    return power(torque, rpm) > F.lit(S.PWF_POWER_MAX)


def pwf_rule(torque=S.TORQUE, rpm=S.RPM) -> Column:
    return pwf_low_rule(torque, rpm) | pwf_high_rule(torque, rpm)


def osf_rule(wear=S.WEAR, torque=S.TORQUE, type_col=S.TYPE) -> Column:
    return overstrain(wear, torque) > osf_limit(type_col)


def flag(cond: Column) -> Column:
    """Boolean to int 0/1; NULL input (missing sensor) counts as 0, like a pandas mask."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def normalize_type(raw: str | Column) -> Column:
    """Machine type token -> 'L'/'M'/'H', or '' when unknown (NULL input gives '').

    Strips all surrounding whitespace (not only spaces), upper-cases and removes
    '-' and '_' before the lookup.
    """
    cleaned = F.translate(
        F.upper(F.regexp_replace(col(raw).cast("string"), r"(?U)^\s+|\s+$", "")), "-_", ""
    )
    expr = None
    for token, t in S.TYPE_TOKENS.items():
        expr = F.when(cleaned == token, F.lit(t)) if expr is None else expr.when(cleaned == token, F.lit(t))
    return F.coalesce(expr.otherwise(F.lit("")), F.lit(""))


#: Text that counts as a number: decimal digits, or an infinity; no type suffix, no hex.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def to_double(c: str | Column) -> Column:
    """Numeric coercion: text or number to DOUBLE, unparsable and NaN to NULL.

    The cast alone would take ``45d``, ``45f`` and ``0x1p3``, which are no numbers here.
    """
    text = col(c).cast("string")
    d = F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


#: Up to here ``value * 10`` and ``value * 100`` keep their whole part and a rest of at least 10 bits.
FIXED_LIMIT = 2.0**36


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fixed(value: Column, decimals: int) -> Column:
    """Text of a double with ``decimals`` (at most 2) places: its exact binary value, ties to the even digit.

    ``format_string`` rounds the shortest decimal text half up, which differs on ties (0.25) and on
    values whose text only looks like a tie (0.15 is below it). Here ``value * 10**decimals`` is
    ``product + error`` exactly (the factors split in halves of 26 bits), and what lies over the
    product's whole part is compared with one half, error included. Values beyond ``FIXED_LIMIT``
    take ``format_string``.
    """
    ten = float(10**decimals)

    def halves(a):
        return let(a * F.lit(134217729.0), lambda t: F.named_struct(F.lit("a"), a, F.lit("high"), t - (t - a)))

    def exact(s):
        return let(s["a"] * F.lit(ten), lambda p: F.named_struct(
            F.lit("product"), p, F.lit("error"), (s["high"] * F.lit(ten) - p) + (s["a"] - s["high"]) * F.lit(ten)))

    def rounded(x):
        return let(F.floor(x["product"]), lambda w: let(
            (x["product"] - w - F.lit(0.5)) + x["error"],
            lambda over: w + F.when((over > 0) | ((over == 0) & (w % 2 == 1)), 1).otherwise(0)))

    def text(n):
        if not decimals:
            return n.cast("string")
        digits = F.when(n < int(ten), F.lpad(n.cast("string"), decimals + 1, "0")).otherwise(n.cast("string"))
        return let(digits, lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - decimals), F.lit("."),
                                              F.substring(d, F.length(d) - (decimals - 1), F.lit(decimals))))

    def signed(v):
        plain = let(let(let(let(F.abs(v), halves), exact), rounded), text)
        plain = F.when(v < 0, F.concat(F.lit("-"), plain)).otherwise(plain)
        return F.when(F.abs(v) < F.lit(FIXED_LIMIT), plain).when(v.isNotNull(), F.format_string(f"%.{decimals}f", v))

    return let(value, signed)


def compact_array(*items: Column) -> Column:
    """Array of the non-NULL items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def round4(c: str | Column) -> Column:
    return F.round(col(c), 4)


def literal_table(spark, rows: list[tuple], names: list[str]):
    """A small constant table built JVM-side (``inline`` of literal structs), no Python worker."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
