"""Files in and out: delimited text with a declared schema, JSON documents, Markdown, YAML settings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value in delimited files.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "<NA>")

CREDIT_SCHEMA = T.StructType([
    T.StructField("duration", T.DoubleType()), T.StructField("credit_amount", T.DoubleType()), T.StructField("age", T.DoubleType()),
    T.StructField("installment_rate", T.DoubleType()), T.StructField("sex", T.StringType()), T.StructField("target", T.IntegerType()),
])


#: Quotes are doubled inside quotes, line breaks may stand there, and no white space is dropped.
QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, separator: str = ",", multi_line: bool = True) -> DataFrame:
    """A delimited file with a declared schema. Cells are read as text, all spellings of a missing value are nulls, and a cell that does not fit its type is an error when it is read.

    Quoted cells may hold separators, doubled quotes and line breaks. A file that may hold line breaks can't be split between tasks, so its size bounds
    the parallelism: many files are read side by side; a huge file that is known to have none is read in parts with `multi_line=False`."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    text = spark.read.schema(raw).options(**QUOTING).option("header", header).option("sep", separator).option("multiLine", multi_line).csv(path)
    known = lambda c: F.when(~F.trim(F.col(f"`{c}`")).isin(*MISSING), F.col(f"`{c}`"))
    return text.select(*((known(f.name) if isinstance(f.dataType, T.StringType) else F.trim(known(f.name)).cast(f.dataType)).alias(f.name) for f in schema.fields))


def read_whitespace(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A headerless file with fields separated by runs of white space, as text columns; missing trailing fields are null."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns coerced to doubles; what is no number is null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop))


def first_available(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that can be read. Reading is lazy, so each is made to give a row before it is trusted."""
    errors = []
    for source in sources:
        try:
            df = source()
            df.limit(1).collect()
            return df
        except Exception as error:  # noqa: BLE001
            errors.append(f"{type(error).__name__}: {str(error)[:200]}")
    raise RuntimeError("no source can be read: " + "; ".join(errors))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**QUOTING).option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object per row, appended; null fields are written out, so that slots to be filled later are there."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def json_text(record: Column, indented: bool = False) -> Column:
    """A record as JSON with all its null fields, in one line or indented."""
    return F.to_json(record, {"ignoreNullFields": "false", "pretty": str(indented).lower()})


def write_each(df: DataFrame, key: str, text: str, path: str) -> None:
    """A folder per key with its texts (indented documents, reports), appended; for a few records that people open, not for a corpus."""
    df.select(key, F.col(text).alias("value")).write.mode("append").partitionBy(key).text(path)


def write_markdown(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def record_key(*columns: str) -> Column:
    """A repeatable short id of a record."""
    return F.lpad(F.lower(F.hex(F.xxhash64(*columns))), 16, "0")


def short_id(length: int = 8) -> Column:
    """The start of a new random id: another one at every evaluation, so write it down before it is used twice."""
    return F.substring(F.uuid(), 1, length)


def read_settings(spark: SparkSession, *paths: str) -> tuple[dict, str]:
    """YAML files of any file system merged in order, and a version: the start of the SHA-256 of their bytes. Small by nature and read on the driver."""
    import yaml

    merged: dict = {}
    blob = b""
    for path in paths:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        blob += data
        merged.update(yaml.safe_load(data) or {})
    return merged, hashlib.sha256(blob).hexdigest()[:10]


def bands_from(settings: dict) -> tuple:
    """Bounds of metrics from settings, checked: each needs category, direction, strong_at and weak_below."""
    out = []
    for key, one in settings.items():
        missing = {"category", "direction", "strong_at", "weak_below"} - set(one)
        if missing:
            raise ValueError(f"{key} lacks {sorted(missing)}")
        direction = str(one["direction"]).removesuffix("_better")
        if direction not in ("higher", "lower"):
            raise ValueError(f"unknown direction {one['direction']!r} of {key!r}")
        out.append((key, one["category"], direction, float(one["strong_at"]), float(one["weak_below"])))
    return tuple(out)


def preview(df: DataFrame, order: list[str], rows: int = 6) -> tuple[list, int, int]:
    """The first rows by an order, and the numbers of rows and columns."""
    return df.orderBy(*order).limit(rows).collect(), df.count(), len(df.columns)
