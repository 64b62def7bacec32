"""Equality of result sets, by three different rules, and what a result looks like."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DecimalType, FractionalType, IntegralType, MapType, StringType, StructType

C = F.col
#: The signature of a result without rows.
EMPTY = "0:0:0"
_CELL = "struct<kind:string,whole:decimal(38,0),real:double,text:string>"


def _cell(c: Column, kind: DataType, normalise: bool) -> Column:
    """A value as a comparable cell: struct(kind, whole, real, text), null for null.

    Whole numbers and truth values compare exactly, as numbers of 38 digits; a real number that is whole, as far as a double tells, is the same
    number; other reals compare unrounded. Text never equals a number. normalise rounds reals to six places and puts the case and
    the surrounding blanks of texts aside.
    """
    none = {"kind": F.lit(None).cast("string"), "whole": F.lit(None).cast("decimal(38,0)"), "real": F.lit(None).cast("double"), "text": F.lit(None).cast("string")}

    def made(**parts: Column) -> Column:
        return F.struct(*[(parts.get(k, v)).alias(k) for k, v in none.items()])

    if isinstance(kind, (IntegralType, BooleanType)):
        number = c.cast("int") if isinstance(kind, BooleanType) else c
        cell = made(kind=F.lit("n"), whole=number.cast("decimal(38,0)"))
    elif isinstance(kind, (FractionalType, DecimalType)):
        exact = isinstance(kind, DecimalType)
        value = F.round(c, 6) if normalise else c
        # beyond 2 ** 53 a double is always whole; up to 10 ** 37 it fits the whole part, above that and for NaN and infinities it stays a double
        whole = (value == F.floor(value)) if exact else ((value == F.floor(value)) & (F.abs(value) < 1e37))
        cell = F.when(whole, made(kind=F.lit("n"), whole=value.cast("decimal(38,0)"))).otherwise(made(kind=F.lit("n"), real=value.cast("double")))
    elif isinstance(kind, BinaryType):
        cell = made(kind=F.lit("t" if normalise else "b"), text=F.lower(F.trim(c.cast("string"))) if normalise else F.hex(c))
    elif isinstance(kind, StringType):
        cell = made(kind=F.lit("t"), text=F.lower(F.trim(c)) if normalise else c)
    elif isinstance(kind, (ArrayType, MapType, StructType)):
        cell = made(kind=F.lit("j"), text=F.to_json(c))
    else:  # dates and times are text where the values come from
        cell = made(kind=F.lit("t"), text=c.cast("string"))
    return F.when(c.isNotNull(), cell).cast(_CELL)


def _cells(df: DataFrame, normalise: bool) -> DataFrame:
    """df by position: columns c0, c1, ... of comparable cells."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[_cell(C(f"_{i}"), f.dataType, normalise).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])


def differences(a: DataFrame, b: DataFrame, multiset: bool = False, normalise: bool = False) -> DataFrame:
    """(equal, only_a, only_b): one row. Both results go through one aggregation on their cells: a single shuffle where two set differences would take four.

    By default sets of rows: order, duplicates and column names don't count, column order does, values compare exactly. multiset counts
    duplicates; normalise rounds reals to six places and puts case and surrounding blanks aside. Results of different width are equal only if both are empty.
    """
    spark = a.sparkSession
    if len(a.columns) != len(b.columns):
        n, m = a.limit(1).count(), b.limit(1).count()
        return spark.createDataFrame([(n == 0 and m == 0, n, m)], "equal boolean, only_a long, only_b long")
    x = _cells(a, normalise).withColumns({"in_a": F.lit(1), "in_b": F.lit(0)})
    y = _cells(b, normalise).withColumns({"in_a": F.lit(0), "in_b": F.lit(1)})
    keys = [f"c{i}" for i in range(len(a.columns))]
    each = x.unionByName(y).groupBy(*keys).agg(F.sum("in_a").alias("na"), F.sum("in_b").alias("nb"))
    if multiset:
        over_a, over_b = F.greatest(F.lit(0), C("na") - C("nb")), F.greatest(F.lit(0), C("nb") - C("na"))
    else:
        over_a, over_b = ((C("na") > 0) & (C("nb") == 0)).cast("int"), ((C("nb") > 0) & (C("na") == 0)).cast("int")
    total = each.agg(F.coalesce(F.sum(over_a), F.lit(0)).alias("only_a"), F.coalesce(F.sum(over_b), F.lit(0)).alias("only_b"))
    return total.select(((C("only_a") == 0) & (C("only_b") == 0)).alias("equal"), C("only_a").cast("long").alias("only_a"), C("only_b").cast("long").alias("only_b"))


def same_set(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b).first()["equal"]


def same_normalised(a: DataFrame, b: DataFrame) -> bool:
    return differences(a, b, multiset=True, normalise=True).first()["equal"]


def signature(rows: list[tuple], columns: list[str]) -> str:
    """Of rows that were fetched: column names and rows in their order, as text; what an exact vote groups by."""
    return json.dumps([columns, [[str(v) if v is not None else None for v in r] for r in rows]], ensure_ascii=False)


def set_signature(df: DataFrame) -> DataFrame:
    """(signature, n_rows, n_distinct): one row that tells a result apart by its set of rows, whatever their order, duplicates and column names.

    Each different row is hashed on its cells, and the hashes are added up twice over, so that no task gathers the rows.
    """
    width = len(df.columns)
    rows = _cells(df, False).select(F.xxhash64(F.lit(width), *[f"c{i}" for i in range(width)]).alias("h"), F.xxhash64(F.lit(-1), *[F.to_json(C(f"c{i}")) for i in range(width)]).alias("g"))
    each = rows.groupBy("h", "g").agg(F.count("*").alias("n"))
    wide = each.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(C("h").cast("decimal(38,0)")).alias("s"), F.sum(C("g").cast("decimal(38,0)")).alias("t"))
    none = F.lit(EMPTY)
    return wide.select(F.when(C("n_distinct") == 0, none).otherwise(F.concat_ws(":", C("n_distinct").cast("string"), C("s").cast("string"), C("t").cast("string"))).alias("signature"), F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), C("n_distinct").cast("long").alias("n_distinct"))


def shape(df: DataFrame, shown: int = 5) -> dict:
    """columns, row_count, distinct_count and the first rows of a result."""
    counts = set_signature(df).first()
    return {"columns": df.columns, "row_count": counts["n_rows"], "distinct_count": counts["n_distinct"], "sample": [[None if v is None else str(v) for v in r] for r in df.limit(shown).collect()]}


def shape_signature(result: dict) -> str:
    """A result's shape as text, or ERROR: and its message where there is none."""
    return f"ERROR:{result['error']}" if result.get("error") else json.dumps([result["columns"], result["row_count"], result["distinct_count"], result["sample"]], ensure_ascii=False)


def any_value(df: DataFrame) -> bool:
    """Whether any cell is neither null nor blank text."""
    tests = [(C(f"`{f.name}`").isNotNull() & (F.trim(C(f"`{f.name}`").cast("string")) != "") if isinstance(f.dataType, StringType) else C(f"`{f.name}`").isNotNull()) for f in df.schema.fields]
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    return not df.where(test).limit(1).isEmpty()
