"""Sources and sinks of record files. Positional sources carry row_id, the 0-based line number, dense across a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomtext.functions import text as t

CORRUPT = "_corrupt_record"


def dense_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """name: 0, 1, ... in scan order: positions within a partition shifted by the counts of those before; no row moves."""
    placed = df.withColumn("_m", F.monotonically_increasing_id())
    part = F.shiftright("_m", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_c")).alias("_o"))
    # one row for each partition of the scan
    return placed.join(F.broadcast(before), part == F.col("_p"), "left").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_o")


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """S1."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Strict fails on a bad line; otherwise bad lines are kept apart in _corrupt_record. Blank lines are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(schema.fields)
    parsed = F.from_json("value", full.add(CORRUPT, T.StringType()), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).filter(t.trim(F.col("value")) != "").select(parsed.alias("r")).select("r.*")


def good_and_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that parsed, bad lines) of a permissive read."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One array of records in a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """The records as one array in one file, by `order` (unique), a record a line. One task writes the file, row after row; it holds no more than a sorted range of them."""
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("z")).first()
    if ends["a"] is None:
        df.sparkSession.createDataFrame([("[\n]",)], "value string").coalesce(1).write.text(path)
        return
    line = F.concat(F.when(F.col(order) == F.lit(ends["a"]), "[\n").otherwise(""), F.to_json(F.struct(*df.columns)), F.when(F.col(order) == F.lit(ends["z"]), "\n]").otherwise(","))
    df.orderBy(order).select(line.alias("value")).coalesce(1).write.text(path)


def write_jsonl(df: DataFrame, path: str, order: list[Column | str] | None = None) -> None:
    """One object a line, UTF-8, in order across the part files."""
    (df.orderBy(*order) if order else df).write.json(path)


def index_order(index: str = "index") -> list[Column]:
    """Whole numbers by value, then the others by text."""
    number = F.expr(f"try_cast({index} as bigint)")
    return [number.asc_nulls_last(), F.col(index).asc()]


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """Tab-separated, a byte-order mark is skipped, lines that don't fit are dropped."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("escape", "\\").option("mode", "DROPMALFORMED").csv(path)


def write_tsv(df: DataFrame, path: str, bom: bool = False, mode: str = "error") -> None:
    """With a header; bom prefixes the first name with U+FEFF."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode(mode).option("sep", "\t").option("header", True).option("escape", "\\").csv(path)


def split_indexed(lines: DataFrame, value: str = "value") -> DataFrame:
    """`idx:payload` lines, split at the first colon; lines without one are dropped."""
    parts = F.split(value, ":", 2)
    return lines.filter(F.contains(F.col(value), F.lit(":"))).select(*[c for c in lines.columns if c != value], t.trim(parts[0]).alias("index"), t.trim(parts[1]).alias("code"))


def read_indexed_lines(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    rows = dense_row_id(spark.read.text(path))
    rows = split_indexed(rows)
    return rows if cap is None else rows.filter(F.col("row_id") < cap)


def indexed_line(row_id: str, payload: str) -> Column:
    """`i:payload`, i from 1, on one line."""
    return F.concat((F.col(row_id) + 1).cast("string"), F.lit(":"), t.trim(F.regexp_replace(F.coalesce(payload, F.lit("")), r"[\r\n]", " ")))


def write_indexed_lines(df: DataFrame, path: str, row_id: str, payload: str) -> None:
    df.orderBy(row_id).select(indexed_line(row_id, payload).alias("value")).write.text(path)


def read_jsonl_indexed(spark: SparkSession, path: str, code: str = "code") -> DataFrame:
    """JSON lines with index, the line number from 1 as text, and the code trimmed."""
    rows = dense_row_id(spark.read.text(path))
    return rows.select("row_id", (F.col("row_id") + 1).cast("string").alias("index"), t.trim(F.get_json_object("value", f"$.{code}")).alias("code"))


def prediction_text(value: Column) -> Column:
    """A prediction line without its index and the word Summary, trimmed; blank lines are ''."""
    payload = F.when(F.contains(value, F.lit("\t")), F.split(value, "\t", 2)[1]).otherwise(value)
    return t.trim(F.replace(payload, F.lit("Summary"), F.lit("")))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return dense_row_id(spark.read.text(path)).select("row_id", prediction_text(F.col("value")).alias("text"))


def read_floats(spark: SparkSession, path: str) -> DataFrame:
    """One number a line; blank lines are skipped, others must be numbers."""
    return spark.read.text(path).filter(t.trim(F.col("value")) != "").select(t.trim(F.col("value")).cast("double").alias("value"))


def write_predictions(df: DataFrame, path: str, debug_path: str | None = None) -> None:
    """`idx<TAB>summary` lines, and all columns as JSON lines, from which the lines are then made, so that what made df runs once."""
    line = F.concat(F.col("idx").cast("string"), F.lit("\t"), F.regexp_replace(F.coalesce("summary", F.lit("")), r"\r?\n", " "))
    if debug_path:
        df.orderBy("idx").write.json(debug_path)
        df = df.sparkSession.read.schema(df.schema).json(debug_path)
    df.orderBy("idx").select(line.alias("value")).write.text(path)


def read_template(spark: SparkSession, root: str, pattern: str, schema: str | T.StructType, langs: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """One scan over root/pattern, a glob whose first two parts are lang and model, which become columns; files that don't exist are no rows.

    langs and models take the place of the first two parts, so that only their folders are listed and only their files opened.
    """
    parts = pattern.split("/")
    for at, names in enumerate((langs, models)):
        if names is not None:
            parts[at] = "{" + ",".join(names) + "}"
    if langs == [] or models == []:
        rows = spark.createDataFrame([], schema)
        return rows.withColumn("lang", F.lit(None).cast("string")).withColumn("model", F.lit(None).cast("string"))
    df = spark.read.schema(schema).option("ignoreMissingFiles", True).json(f"{root}/{'/'.join(parts)}")
    found, depth = F.split(F.input_file_name(), "/"), len(parts)
    return df.withColumn("lang", F.element_at(found, -depth)).withColumn("model", F.element_at(found, 1 - depth))
