"""JSON documents: an array of records or values, or one object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Read one JSON document.

    An array of objects gives a row per object, one of arrays a column per place ("0", "1", …), one
    of other values a column "0". An object whose fields are all arrays gives a column per
    field, short ones padded with NULL; any other object gives one row. Scalars, several
    documents in one file, and broken documents are errors.
    """
    # A document cannot be split, so its text is one cell.
    text = spark.read.text(path, wholetext=True).where(F.trim("value") != "")
    first = F.regexp_extract("value", r"^\s*(.)", 1).alias("first")
    second = F.regexp_extract("value", r"^\s*\[\s*(.)", 1).alias("second")
    head = text.select(first, second, _is_one_document(F.col("value")).alias("one")).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    if head["first"] not in ("[", "{"):
        raise ValueError(f"{path} holds neither an array nor an object")
    if not head["one"]:
        raise ValueError(f"{path} does not hold exactly one JSON document")
    if head["first"] == "[" and head["second"] not in ("{", "]"):
        return _array_of_values(text, path)
    df = spark.read.option("multiLine", True).json(path)
    if CORRUPT in df.columns:
        raise ValueError(f"{path} is not a JSON array of objects or an object")
    if head["first"] == "{" and df.columns and _all_arrays(df):
        names = df.columns
        columns = df.toDF(*[f"c{i}" for i in range(len(names))])
        return columns.select(F.inline_outer(F.arrays_zip(*columns.columns))).toDF(*names)
    return df


def _is_one_document(text: Column) -> Column:
    """Whether a text is one array or object and nothing after it, which Spark's own readers let pass.

    Without escapes and strings, brackets must close the outermost one once, at the very end.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))
    opens = {"[": 1, "{": 1, "]": -1, "}": -1}

    def step(state: Column, bracket: Column) -> Column:
        depth = state["depth"]
        for sign, change in opens.items():
            depth = depth + F.when(bracket == sign, change).otherwise(0)
        closes = bracket.isin("]", "}") & (depth == 0)
        return F.struct(depth.alias("depth"), (state["closed"] + closes.cast("int")).alias("closed"))

    end = F.aggregate(brackets, start, step)
    return (end["closed"] == 1) & (end["depth"] == 0) & F.trim(bare).rlike(r"[\]}]\s*\z")


def _array_of_values(text: DataFrame, path: str) -> DataFrame:
    """An array of scalars, or of arrays: columns by place, types from all values."""
    values = text.select(F.from_json("value", "array<variant>").alias("a")).select(
        F.posexplode("a").alias("row", "v")
    )
    kinds = values.agg(
        F.count_if(F.schema_of_variant("v").startswith("ARRAY")).alias("arrays"),
        F.count_if(F.schema_of_variant("v").startswith("OBJECT")).alias("objects"),
        F.count(F.lit(1)).alias("all"),
        F.max(F.size(F.try_variant_get("v", "$", "array<variant>"))).alias("width"),
    ).first()
    if kinds["objects"] or kinds["arrays"] not in (0, kinds["all"]):
        raise ValueError(f"{path} is an array of values of different kinds")
    places = ["$"] if not kinds["arrays"] else [f"$[{i}]" for i in range(kinds["width"] or 0)]
    cells = [F.try_variant_get("v", place, "variant") for place in places]
    if not cells:
        raise ValueError(f"no columns in {path}")
    types = values.agg(*[F.schema_of_variant_agg(c).alias(f"t{i}") for i, c in enumerate(cells)]).first()
    return values.select(
        *[F.try_variant_get("v", place, _column_type(types[i])).alias(str(i)) for i, place in enumerate(places)]
    )


def _column_type(found: str) -> str:
    """The type of a column of variants: numbers with a fraction are double, mixtures text."""
    if found.startswith("DECIMAL"):
        return "double"
    return "string" if found in ("VARIANT", "VOID") or found.startswith("OBJECT") else found


def _all_arrays(df: DataFrame) -> bool:
    return all(isinstance(f.dataType, T.ArrayType) for f in df.schema)
