"""Landed report files: catalogue, scans, ledgers, sinks. Remote systems land files; this module reads and writes them through Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, modified, size) of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))


def published_reports(files: DataFrame) -> DataFrame:
    """(path, name, modified, size) of reports in a catalogue that tasks published: a report is a folder of part files, all of them together."""
    parts = files.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]+$", 1))
    whole = parts.groupBy(F.col("folder").alias("path")).agg(F.max("modified").alias("modified"), F.sum("size").alias("size"))
    return whole.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))


def file_named(files: DataFrame, name: str, required: bool = True) -> DataFrame:
    """The one file of this name; raises if it is required and not there, or there are several."""
    found = files.where(F.col("name") == name)
    n = found.limit(2).count()
    if n > 1 or (required and not n):
        raise ValueError(f"{n or 'no'} files named {name!r}")
    return found


def report_path(files: DataFrame, prefix: str) -> str:
    """Path of the only file whose name begins with the prefix."""
    rows = files.where(F.col("name").startswith(prefix)).select("path").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} files begin with {prefix!r}")
    return rows[0]["path"]


def newest_path(files: DataFrame, prefix: str) -> str:
    """Path of the last modified file whose name begins with the prefix; ties by name."""
    row = files.where(F.col("name").startswith(prefix)).agg(F.max_by("path", F.struct("modified", "name")).alias("path")).first()
    if row["path"] is None:
        raise ValueError(f"no file begins with {prefix!r}")
    return row["path"]


def csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, legacy_encoding: bool = False) -> DataFrame:
    """A CSV report with a header; all columns text unless a schema is given. NaN becomes null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "ISO-8859-1" if legacy_encoding else "UTF-8")
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}) if any(t in ("double", "float") for _, t in df.dtypes) else df


def json_array(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def workbook(sheets: dict[str, DataFrame]) -> DataFrame:
    """The sheets of a workbook (landed one by one) as one table with sheet_name."""
    out = None
    for name, df in sheets.items():
        tagged = df.withColumn("sheet_name", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sheet")
    return out


def sheet_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows of one sheet (blanks and case aside), without its name; raises if there is none."""
    rows = df.where(F.lower(F.trim("sheet_name")) == name.strip().lower()).drop("sheet_name")
    if rows.isEmpty():
        raise ValueError(f"no sheet {name!r}")
    return rows


def ledger(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """A resumable ledger: text columns; a header other than the fields raises."""
    header = spark.read.text(path).first()
    if header is None or header["value"].lstrip("﻿") != ",".join(fields):
        raise ValueError("the ledger's header differs")
    return csv(spark, path, ", ".join(f"`{f}` string" for f in fields))


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of files."""
    rows.write.mode("append").parquet(path)


def published(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces what is at the path. One file is for consumers of small reports only: coalesce before."""
    writer = rows.write.mode("overwrite")
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.option("header", True).csv(p)}[kind](path)


def database(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A JDBC scan, split by a numeric key (lowest, highest, parts) where one is given; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", "500").options(**options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(bounds[2]))
    return reader.load()


def stored(df: DataFrame, as_of: Column, ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows as the store keeps them: created and updated stamps, ids as text, 'None' as null, dates as stamps."""
    stamp = F.date_format(as_of, "yyyyMMddHHmmss")
    out = {}
    for name, kind in df.dtypes:
        if name in ids or name.endswith("_id"):
            out[name] = F.col(name).cast("string")
        elif kind == "string":
            out[name] = F.nullif(F.col(name), F.lit("None"))
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            out[name] = F.date_format(name, "yyyyMMddHHmmss")
    return df.withColumns(out).withColumns({"created": stamp, "updated": stamp})


def validated(df: DataFrame, schema: StructType) -> list[str]:
    """Raises where columns are missing or unknown; returns what differs in type only."""
    have, want = {f.name: f for f in df.schema.fields}, {f.name: f for f in schema.fields}
    if have.keys() != want.keys():
        raise ValueError(f"missing {sorted(want.keys() - have.keys())}, unknown {sorted(have.keys() - want.keys())}")
    return [f"{n}: {have[n].dataType.simpleString()} for {f.dataType.simpleString()}" for n, f in want.items() if have[n].dataType != f.dataType]
