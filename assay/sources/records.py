"""Records in and out: JSON, JSONL, CSV and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

C = F.col


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSONL (.jsonl) line by line, else one JSON array or object; blank lines are skipped. With a schema nothing is inferred, so the files are read once."""
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    if path.rstrip("/").endswith((".jsonl", ".jsonl.gz")):
        return reader.json(path)
    return reader.option("multiLine", True).json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of JSONL lines that are no JSON; line counts from 1 within its file.

    The line number needs a file's own order: a file is read whole only here, where an error has to be named.
    """
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "text")).where(F.trim("text") != "")
    return lines.where(F.expr("try_parse_json(text)").isNull()).select("file", (C("pos") + 1).alias("line"), "text")


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One object a line, UTF-8, non-ASCII kept; refuses a folder that exists unless overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_json(df: DataFrame, path: str, overwrite: bool = False, most: int = 100_000) -> None:
    """A summary as one JSON array with an indent of 2, non-ASCII kept; for aggregates only, so more than most rows are refused."""
    rows = [json.loads(r) for r in (x[0] for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect())]
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write_jsonl takes any number")
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(target, overwrite)
    try:
        out.write(bytearray(json.dumps(rows, ensure_ascii=False, indent=2).encode("utf-8")))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A summary with header; a column accuracy has two decimals."""
    if "accuracy" in df.columns:
        df = df.withColumn("accuracy", F.format_string("%.2f", C("accuracy")))
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 500) -> str:
    """A table of at most most rows, for reports over aggregates; a further row says how many are not shown."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: ("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"| and {df.count() - most} more |" + " |" * (len(df.columns) - 1))
    return "\n".join(lines)


def column_comments(meanings: DataFrame) -> DataFrame:
    """(map_key, db_id, table_name, column_name, comment) of a map db|table|column: comment marks, quotes and blanks around meanings are dropped, missing parts are empty."""
    part = lambda i: F.split_part("map_key", F.lit("|"), F.lit(i))
    comment = F.trim(F.regexp_replace(F.coalesce("meaning", F.lit("")), r"""^[\s#'"]+|[\s'"]+$""", ""))
    return meanings.select("map_key", *[F.coalesce(part(i), F.lit("")).alias(n) for i, n in ((1, "db_id"), (2, "table_name"), (3, "column_name"))], comment.alias("comment"))


def merged_shards(shards: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows of all shards, one a key; raises if a key of expected is missing, naming five of them."""
    missing = expected.select(key).join(shards.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no shard has {key} {', '.join(str(r[0]) for r in missing)}")
    return shards.dropDuplicates([key])


def inspect(df: DataFrame, n: int = 3, width: int = 120) -> list[dict[str, str]]:
    """Previews of the first n records' fields."""
    return [{k: str(v)[:width] for k, v in row.asDict().items()} for row in df.limit(n).collect()]


def selected(df: DataFrame, order: str, size: int, start: int = 0, seed: int | None = None) -> DataFrame:
    """size rows: those from start on in order, or, with a seed, the least by a seeded hash. Raises if there are fewer; -1 means all from start on."""
    if seed is not None:
        out = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), C(order).cast("string"))), order).limit(size)
    else:
        out = df.orderBy(order).offset(start)
        out = out if size < 0 else out.limit(size)
    if size >= 0 and (n := out.count()) < size:
        raise ValueError(f"{n} rows where {size} were asked for")
    return out


def default_paths(base: str, split: str, exists) -> dict[str, str]:
    """Where a split's records, meanings and databases are: in the layout of one folder a split if that is there, else beside each other. exists tells whether a path is."""
    new = {"records": f"{base}/{split}/{split}.json", "meanings": f"{base}/{split}/column_meaning.json", "databases": f"{base}/{split}/databases"}
    return new if exists(new["records"]) else {"records": f"{base}/{split}.json", "meanings": f"{base}/{split}_column_meaning.json", "databases": f"{base}/{split}_databases"}
