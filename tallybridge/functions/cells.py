"""Cell semantics: what "missing", "equal" and "the same row" mean.

Everything here builds native Column expressions, so the comparison stays inside
Spark's code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
FLOATS = (T.DoubleType, T.FloatType)
INTEGRALS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
CALENDAR = (T.DateType, T.TimestampType, T.TimestampNTZType)
FIXED_WIDTH = INTEGRALS + FLOATS + CALENDAR + (T.BooleanType, T.DecimalType)


def quoted(name: str) -> Column:
    """A column by its literal name, whatever dots, spaces or back-ticks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def internal_names(df: DataFrame) -> list[str]:
    return [f"c{i}" for i in range(len(df.columns))]


def positional(df: DataFrame) -> DataFrame:
    """Rename columns to c0, c1, … so that later references can never be ambiguous.

    Names that differ only in case, or contain dots, survive: the real names are
    put back by position on output.
    """
    return df.toDF(*internal_names(df))


def without_nan(col: Column, dtype: T.DataType) -> Column:
    """One notion of missing: NaN becomes NULL in floating point columns."""
    if isinstance(dtype, FLOATS):
        return F.when(~F.isnan(col), col)
    return col


def missing_to_null(df: DataFrame) -> DataFrame:
    """Apply :func:`without_nan` to every column of a positionally named frame."""
    if not any(isinstance(f.dataType, FLOATS) for f in df.schema):
        return df
    return df.select(*[without_nan(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])


# Nested timestamps keep their microseconds and their offset.
NESTED_TEXT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# Zones in which every local time is one instant.
ZONES_WITHOUT_CHANGES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def as_text(col: Column, dtype: T.DataType) -> Column:
    """Text of a cell; nested values as JSON, maps by their keys. NULL stays NULL.

    Different values have different texts: of two instants that share a local time, when
    clocks are put back, the one the text would not be read as carries its offset.
    """
    if isinstance(dtype, NESTED):
        return F.to_json(in_key_order(col, dtype), NESTED_TEXT)
    if isinstance(dtype, T.BinaryType):
        return F.hex(col)
    text = col.cast("string")
    if isinstance(dtype, T.TimestampType):
        session = SparkSession.getActiveSession()
        zone = session.conf.get("spark.sql.session.timeZone") if session else ""
        if zone not in ZONES_WITHOUT_CHANGES:
            with_offset = F.concat(text, F.date_format(col, "xxx"))
            text = F.when(text.try_cast("timestamp").eqNullSafe(col), text).otherwise(with_offset)
    return text


def in_key_order(col: Column, dtype: T.DataType) -> Column:
    """A nested value with the entries of all its maps in key order."""
    if "map<" not in dtype.simpleString():
        return col
    if isinstance(dtype, T.MapType):
        keys = F.array_sort(F.map_keys(col))
        values = F.transform(keys, lambda k: in_key_order(F.element_at(col, k), dtype.valueType))
        return F.map_from_arrays(keys, values)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: in_key_order(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [in_key_order(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col


def canonical(col: Column, dtype: T.DataType) -> Column:
    """Text of a cell for keyless comparison: missing and the empty string are one value."""
    return F.coalesce(as_text(without_nan(col, dtype), dtype), F.lit(""))


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type two cells are compared in, or None when they can never be equal.

    Numbers compare with numbers and dates with timestamps; text and numbers are
    different values however they read.
    """
    if a == b:
        return a
    if isinstance(a, NESTED) or isinstance(b, NESTED):
        return _wider_nested(a, b)
    # True equals 1 and False equals 0.
    integral = INTEGRALS + (T.BooleanType,)
    numeric = integral + FLOATS + (T.DecimalType,)
    if isinstance(a, numeric) and isinstance(b, numeric):
        if isinstance(a, integral) and isinstance(b, integral):
            return T.LongType()
        if isinstance(a, FLOATS) or isinstance(b, FLOATS):
            return T.DoubleType()
        return _decimal_over(a, b)
    if isinstance(a, CALENDAR) and isinstance(b, CALENDAR):
        if isinstance(a, T.TimestampType) or isinstance(b, T.TimestampType):
            return T.TimestampType()
        return T.TimestampNTZType()
    if isinstance(a, (T.StringType, T.CharType, T.VarcharType)) and isinstance(
        b, (T.StringType, T.CharType, T.VarcharType)
    ):
        return T.StringType()
    return None


def _wider_nested(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds the values of two nested types of one shape: what may be missing on either side may be
    missing, and what they are made of is widened as cells are. Fields are the same by name and place."""
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        element = wider_type(a.elementType, b.elementType)
        return None if element is None else T.ArrayType(element, a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        key, value = wider_type(a.keyType, b.keyType), wider_type(a.valueType, b.valueType)
        if key is not None and value is not None:
            return T.MapType(key, value, a.valueContainsNull or b.valueContainsNull)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.names == b.names:
        types = [wider_type(x.dataType, y.dataType) for x, y in zip(a, b)]
        if all(t is not None for t in types):
            return T.StructType(
                [T.StructField(x.name, t, x.nullable or y.nullable) for x, y, t in zip(a, b, types)]
            )
    return None


def _decimal_over(a: T.DataType, b: T.DataType) -> T.DecimalType | None:
    def digits(t):
        return (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0)

    (ai, ascale), (bi, bscale) = digits(a), digits(b)
    scale = max(ascale, bscale)
    if max(ai, bi) + scale > 38:
        return None
    return T.DecimalType(max(ai, bi) + scale, scale)


def _is_wide_pair(a: T.DataType, b: T.DataType) -> bool:
    """Two exact numbers that no common decimal type holds."""
    exact = INTEGRALS + (T.DecimalType,)
    return isinstance(a, exact) and isinstance(b, exact) and wider_type(a, b) is None


def _plain_number(col: Column) -> Column:
    """An exact number as text without trailing zeros of its fraction."""
    text = col.cast("string")
    text = F.when(text.contains("."), F.regexp_replace(text, "\\.?0+$", "")).otherwise(text)
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def _without_equality(dtype: T.DataType) -> bool:
    """Maps and variants have no equality in Spark; their texts, in key order, do."""
    return isinstance(dtype, T.VariantType) or "map<" in dtype.simpleString()


def _comparable(col: Column, dtype: T.DataType) -> Column:
    return as_text(col, dtype) if _without_equality(dtype) else col


def comparable_pair(
    old: Column, old_type: T.DataType, new: Column, new_type: T.DataType, *, align_types: bool = False
) -> tuple[Column, Column]:
    """Two cells as values of one type that are equal where the cells are, and missing where they are."""
    common = wider_type(old_type, new_type)
    if common is not None:
        old = old if old_type == common else old.cast(common)
        new = new if new_type == common else new.cast(common)
        return _comparable(old, common), _comparable(new, common)
    if _is_wide_pair(old_type, new_type):
        return _plain_number(old), _plain_number(new)
    old, new = as_text(old, old_type), as_text(new, new_type)
    if align_types:
        return old, new
    return F.concat(F.lit("o:"), old), F.concat(F.lit("n:"), new)  # never equal


def hashable_pair(
    old: Column, old_type: T.DataType, new: Column, new_type: T.DataType, *, align_types: bool = False
) -> tuple[Column, Column]:
    """:func:`comparable_pair` with values whose hashes are equal where the cells are, and differ where they do."""
    pair = comparable_pair(old, old_type, new, new_type, align_types=align_types)
    common = wider_type(old_type, new_type)
    if common is None or _without_equality(common):
        return pair
    return hashable(pair[0], common), hashable(pair[1], common)


def differs(
    old: Column,
    old_type: T.DataType,
    new: Column,
    new_type: T.DataType,
    *,
    nulls: str = "safe",
    align_types: bool = False,
) -> Column:
    """True when a cell changed. Never NULL.

    ``nulls="safe"``: two missing cells are equal. ``nulls="unequal"``: they are a
    change, as NaN is unequal to itself in pandas.
    """
    old, new = comparable_pair(old, old_type, new, new_type, align_types=align_types)
    changed = ~old.eqNullSafe(new)
    if nulls == "unequal":
        changed = changed | (old.isNull() & new.isNull())
    return changed


def hashable(col: Column, dtype: T.DataType) -> Column:
    """A value whose hash tells nested cells apart.

    Spark's hashes pass over missing elements and over the borders of nested lists. Here a list leads with its
    length, every element and field with whether it is there; so different values are different sequences
    of plain values, which is what is hashed. Maps and variants come as texts (see :func:`comparable_pair`).
    """
    if isinstance(dtype, T.ArrayType):
        there = F.transform(
            col, lambda x: F.struct(x.isNotNull().alias("there"), hashable(x, dtype.elementType).alias("value"))
        )
        return F.struct(F.size(col).alias("length"), there.alias("elements"))
    if isinstance(dtype, T.StructType):
        parts = []
        for i, f in enumerate(dtype.fields):
            field = col[f.name]
            parts += [field.isNotNull().alias(f"there{i}"), hashable(field, f.dataType).alias(f"value{i}")]
        return F.struct(*parts) if parts else F.lit(0)
    return col


def digest(texts: Sequence[Column]) -> Column:
    """32-byte SHA-256 of a list of texts, each prefixed by its length.

    The prefix makes the encoding injective ("a","bc" differs from "ab","c"; NULL
    differs from ""), so equal digests mean equal lists.
    """
    parts = [
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def similarity(old: Column, new: Column) -> Column:
    """Share of positions at which two equally long cell arrays agree."""
    agree = F.filter(F.zip_with(old, new, lambda o, n: o == n), lambda same: same)
    return F.size(agree) / F.size(new)
