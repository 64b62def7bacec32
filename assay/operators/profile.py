"""Column profiles of a table from one pass: values are counted by (column, value), and everything else is read off these counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

C = F.col
#: Shapes of dates.
DATE_SHAPES = r"^(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})$"


def looks_like_date(x: Column) -> Column:
    return F.trim(x).rlike(DATE_SHAPES)


def numeric(x: Column) -> Column:
    """The finite number a text stands for, else null."""
    d = F.trim(x).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def declared_kind(type_name: Column) -> Column:
    """NUMERIC or DATE by a declared type's name, null if the name tells nothing."""
    t = F.upper(type_name)
    return F.when(t.rlike("INT|REAL|FLOAT|DOUBLE|NUMERIC|DECIMAL|NUMBER"), "NUMERIC").when(t.rlike("DATE|TIME"), "DATE")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, value, n): how often each value occurs, as whole text; nulls counted too. One shuffle of partial counts, whatever the number of columns."""
    names = columns or df.columns
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), C(f"`{c}`").cast("string").alias("value")) for c in names])).alias("x"))
    return long.groupBy("x.column_name", "x.value").agg(F.count("*").alias("n"))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: counts, distinct values, numeric shape, length shape, least and greatest value, kind. An empty table gives no rows."""
    counts = value_counts(df, columns)
    typed = {f.name: f.dataType for f in df.schema.fields}
    declared = F.create_map(*[x for c in (columns or df.columns) for x in (F.lit(c), F.lit(typed[c].simpleString()))])
    v, n, d = C("value"), C("n"), numeric(C("value"))
    seen = F.when(v.isNotNull(), n)
    size = F.length("value")
    out = counts.groupBy("column_name").agg(
        F.sum("n").alias("row_count"), F.coalesce(F.sum(seen), F.lit(0)).alias("non_null"), F.count("value").alias("distinct_count"),
        F.min(d).alias("num_min"), F.max(d).alias("num_max"), (F.sum(d * n) / F.sum(F.when(d.isNotNull(), n))).alias("num_mean"), F.percentile(d, F.lit(0.5), n).alias("num_median"),
        F.min(size).alias("len_min"), F.max(size).alias("len_max"), (F.sum(size * n) / F.sum(seen)).alias("len_mean"), F.min("value").alias("text_min"), F.max("value").alias("text_max"),
        F.bool_and(F.when(v.isNotNull(), looks_like_date(v))).alias("dates"), F.bool_and(F.when(v.isNotNull(), d.isNotNull())).alias("numbers"),
    )
    kind = F.coalesce(declared_kind(declared[C("column_name")]), F.when(C("dates"), "DATE").when(C("numbers"), "NUMERIC"), F.lit("TEXT"))
    return out.select(
        "column_name", "row_count", "non_null", (C("row_count") - C("non_null")).alias("null_count"), "distinct_count", kind.alias("kind"), "num_min", "num_max", "num_mean", "num_median", "len_min", "len_max", "len_mean", "text_min", "text_max"
    )


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column_name, value, n, place): each column's k most frequent values, ties by value; nulls don't count."""
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    return value_counts(df, columns).where("value is not null").withColumn("place", place).where(C("place") <= k)


def first_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The first n values of a column that aren't null, as the table has them; a limit, so no more is read than needed."""
    return df.select(C(f"`{column}`").alias("value")).where("value is not null").limit(n)


def character_classes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shares of a column's values that hold capitals, small letters, digits, blanks, punctuation, are all digits, look like dates or like JSON."""
    v, n = C("value"), C("n")
    tests = {
        "has_upper": v.rlike(r"\p{Lu}"), "has_lower": v.rlike(r"\p{Ll}"), "has_digit": v.rlike(r"\d"), "has_space": v.rlike(r"\s"), "has_punct": v.rlike(r"[^\w\s]"), "all_digits": v.rlike(r"^\d+$"),
        "looks_date_like": looks_like_date(v), "looks_json_like": v.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$"),
    }
    counted = value_counts(df, columns).where("value is not null")
    return counted.groupBy("column_name").agg(*[(F.sum(F.when(t, n).otherwise(0)) / F.sum(n)).alias(k) for k, t in tests.items()])


def prefixes(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column_name, length, prefix, n): the k most frequent beginnings of 2, 3 and 4 characters."""
    counted = value_counts(df, columns).where("value is not null")
    long = counted.select("column_name", "n", "value", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))).alias("length")).where(F.length("value") >= C("length"))
    each = long.groupBy("column_name", "length", F.expr("substring(value, 1, length)").alias("prefix")).agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("column_name", "length").orderBy(F.desc("n"), "prefix"))
    return each.withColumn("place", place).where(C("place") <= k).drop("place")


def rendered(value: Column) -> Column:
    """A value in a schema text: numbers to four places, text cut to 50 characters."""
    return F.when(F.length(value) <= 50, value).otherwise(F.concat(F.substring(value, 1, 47), F.lit("...")))


def schema_text(df: DataFrame, table: str, comments: dict[str, str] | None = None, examples: int = 3, columns: list[str] | None = None) -> str:
    """A table's schema as text for a prompt: a heading with its size, then a line a column with kind, comment, statistics and most frequent values."""
    rows = {r["column_name"]: r for r in column_profile(df, columns).collect()}  # a row a column
    tops: dict[str, list[str]] = {}
    for r in top_values(df, columns, examples).select("column_name", rendered(C("value")).alias("v"), "place").orderBy("column_name", "place").collect():
        tops.setdefault(r["column_name"], []).append(r["v"])
    names = columns or df.columns
    size = next(iter(rows.values()))["row_count"] if rows else 0
    show = lambda x: "NULL" if x is None else str(round(x, 4)) if isinstance(x, float) else str(x)
    lines = []
    for f in df.schema.fields:
        if f.name not in names:
            continue
        r = rows.get(f.name)
        parts = [(comments or {}).get(f.name, "").strip(), "Nullable" if f.nullable else "Not Null"]
        if r is not None:
            stats = [f"Nulls: {r['null_count']}", f"Non-null: {r['non_null']}", f"Distinct: {r['distinct_count']}"]
            if isinstance(f.dataType, NumericType) and r["num_min"] is not None:
                stats += [f"Min: {show(r['num_min'])}", f"Avg: {show(r['num_mean'])}", f"Max: {show(r['num_max'])}"]
            elif r["kind"] == "DATE" and r["text_min"] is not None:
                stats += [f"Min: {r['text_min']}", f"Max: {r['text_max']}"]
            parts += ["Stats: " + "; ".join(stats), f"Top values: [{', '.join(tops.get(f.name, []))}]" if tops.get(f.name) else ""]
        lines.append(f"({f.name}:{f.dataType.simpleString().upper()}, " + ", ".join(p for p in parts if p) + ")")
    return f"# Table: {table} | Rows: {size}, Columns: {len(df.columns)}\n[\n" + ",\n".join(lines) + "\n]"
