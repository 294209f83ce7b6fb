"""A strict reader of JSON objects as column expressions: one parse per text.

The text is parsed inside an array whose second element is an object with a mark, a hash of the
text. If anything follows the text's own value, or the value does not end, the array does not have
exactly these two elements and the text is no JSON. An object becomes a map of raw values, in
which a repeated key is there as often as in the text: its last value counts, and a key that is
present with ``null`` differs from an absent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS, _VALUES, _PLAIN = "__json_keys", "__json_values", "__json_plain"


def read_objects(df: DataFrame, text: Column, value: str = "string") -> DataFrame:
    """``df`` with the entries of ``text``, for :func:`has_key`, :func:`raw_value`, :func:`is_object`,
    :func:`is_json`; :func:`without_entries` takes them away again.

    Values are read as ``string``, or as ``variant``, which keeps their JSON type (an object nested in
    a value must not repeat a key then).

    Each stage is a projection of its own, so that every parse is evaluated once a row. Only a text
    that is no object is parsed a second time, to tell other JSON values from no JSON.
    """
    mark = F.lower(F.hex(F.xxhash64("__json_text")))
    s = df.select("*", text.alias("__json_text"))
    s = s.select("*", mark.alias("__json_mark"))
    s = s.select("*", F.concat(F.lit("["), "__json_text", F.lit(',{"end":"'), "__json_mark", F.lit('"}]')).alias("__json_in"))
    s = s.select("*", F.from_json("__json_in", f"array<map<string,{value}>>").alias("__json_doc"))
    doc = F.col("__json_doc")
    end = F.get(doc, F.lit(1))["end"]
    end = F.try_variant_get(end, "$", "string") if value == "variant" else end
    whole = (F.size(doc) == 2) & (end == F.col("__json_mark"))
    s = s.select("*", F.when(whole, F.get(doc, F.lit(0))).alias("__json_map"))
    other = F.from_json("__json_in", "array<string>")
    tail = F.concat(F.lit('{"end":"'), "__json_mark", F.lit('"}'))
    plain = (F.size(other) == 2) & (F.get(other, F.lit(1)) == tail)
    return s.select(
        *df.columns, F.reverse(F.map_keys("__json_map")).alias(_KEYS), F.reverse(F.map_values("__json_map")).alias(_VALUES),
        F.when(F.col("__json_map").isNull(), F.coalesce(plain, F.lit(False))).otherwise(F.lit(True)).alias(_PLAIN))


def without_entries(df: DataFrame) -> DataFrame:
    return df.drop(_KEYS, _VALUES, _PLAIN)


def is_json() -> Column:
    return F.col(_PLAIN)


def is_object() -> Column:
    return F.col(_KEYS).isNotNull()


def object_size() -> Column:
    """Entries of the object, repeated keys counted each; null for no object."""
    return F.when(is_object(), F.size(_KEYS))


def entry_names() -> Column:
    """The distinct keys; null for no object."""
    return F.array_distinct(_KEYS)


def last_value(name: Column) -> Column:
    """The last value of the key ``name``, for names that are columns."""
    return F.get(F.col(_VALUES), (F.array_position(F.col(_KEYS), name) - 1).cast("int"))


def has_key(key: str) -> Column:
    return F.coalesce(F.array_position(_KEYS, key) > 0, F.lit(False))


def raw_value(key: str) -> Column:
    """The last value of ``key``: text of a string, JSON text of any other value, null for ``null`` or no such key."""
    return F.get(F.col(_VALUES), (F.array_position(_KEYS, key) - 1).cast("int"))
