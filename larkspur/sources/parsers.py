"""Parsers of landed text: control-record reports, statements, sanctions lists, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.fixed_values import CONTROL_RECORDS, OFAC_COLUMNS, STATEMENT_SECTION, UK_HEADER
from larkspur.operators import joins
from larkspur.shared import kept


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of text files; a file is one report and is numbered in one task."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = F.posexplode(F.split(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n"), "\n"))
    return whole.select("file", lines.alias("line", "value"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, line, value) of text files of any size, read by splits: part is where a split begins, line grows within it. Kept, so that lines keep their numbers. A quoted cell must not hold a line break."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "^\ufeff", "").alias("value")
    )
    return kept(lines, "lines")


def cells(line: Column) -> Column:
    """The cells of a CSV line, quotes removed, doubled quotes single."""
    parts = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^",]*)\s*,'), F.lit(1))
    return F.transform(parts, lambda c: F.replace(F.regexp_replace(c, '^\\s*"|"$', ""), F.lit('""'), F.lit('"')))


def control_record_report(lines: DataFrame) -> DataFrame:
    """(file, line, row map) of a report with control records: rows with a control cell and repeated headers are dropped; the first that remains is the header."""
    parsed = lines.where(F.trim("value") != "").withColumn("cells", cells(F.col("value")))
    kept = parsed.where(~F.arrays_overlap(F.transform("cells", lambda c: F.trim(c)), F.array(*[F.lit(c) for c in CONTROL_RECORDS])))
    headers = kept.groupBy("file").agg(F.min_by("cells", "line").alias("header"))
    body = kept.join(headers, "file").where(F.col("cells") != F.col("header"))  # a row per file: the planner sees how many
    width = F.least(F.size("header"), F.size("cells"))
    return body.select("file", "line", F.map_from_arrays(F.slice("header", F.lit(1), width), F.slice("cells", F.lit(1), width)).alias("row"))


def columns_of(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns out of row maps."""
    return rows.select(*[F.try_element_at("row", F.lit(n)).alias(n) for n in names])


def statement_rows(lines: DataFrame, account: str | None, month_end: Column) -> DataFrame:
    """(Date, Description, Amount, Account) of an account's section of a statement (account null: of every section). An amount that is no number raises; blank ones are skipped."""
    parsed = lines.withColumn("cells", cells(F.col("value")))
    own = F.when((F.col("cells")[0] == "Account Information") & (F.try_element_at("cells", F.lit(2)) == "Data") & (F.try_element_at("cells", F.lit(3)) == "Account"), F.trim(F.split_part(F.try_element_at("cells", F.lit(4)), F.lit(" "), F.lit(1))))
    # Of a line only what it says of the account or of the section goes through the sort, and no other line does.
    entry = F.when((F.col("cells")[0] == STATEMENT_SECTION) & (F.try_element_at("cells", F.lit(2)) == "Data"), F.struct(F.try_element_at("cells", F.lit(3)).alias("description"), F.try_element_at("cells", F.lit(4)).alias("amount")))
    place = [c for c in ("file", "part", "line") if c in lines.columns]
    said = parsed.select(*place, own.alias("own"), entry.alias("entry")).where("own is not null or entry is not null")
    if "part" in lines.columns:
        current = joins.carried_in_parts(said, ["file"], "part", [F.col("line")], F.col("own"), "account", lines.count())
    else:
        current = joins.carried(said, ["file"], [F.col("line")], F.col("own"), "account")
    data = current.where((F.col("account").isNotNull() if account is None else F.col("account") == account) & F.col("entry").isNotNull())
    text = F.trim(F.replace(F.col("entry.amount"), F.lit(","), F.lit("")))
    amount = text.try_cast("double")
    checked = F.when(amount.isNull(), F.raise_error(F.concat(F.lit("no amount: "), text)).cast("double")).otherwise(amount)
    return data.where(F.coalesce(text, F.lit("")) != "").select(month_end.alias("Date"), F.col("entry.description").alias("Description"), checked.alias("Amount"), F.col("account").alias("Account"))


def statement_files(files: DataFrame) -> DataFrame:
    """(path, account, month) of files named <account>_YYYYMM.csv, in any case."""
    pattern = r"(?i)^(.+)_(\d{4})(\d{2})\.csv$"
    named = files.where(F.col("name").rlike(pattern))
    return named.select("path", F.regexp_extract("name", pattern, 1).alias("account"), F.concat_ws("-", F.regexp_extract("name", pattern, 2), F.regexp_extract("name", pattern, 3)).alias("month"))


def statement_faults(statements: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, fault): several statements of a month, or none at all."""
    several = statements.groupBy("account", "month").count().where("count > 1").select("account", F.concat(F.lit("several statements of "), "month").alias("fault"))
    return several.unionByName(accounts.select("account").join(statements, "account", "left_anti").select("account", F.lit("no statement").alias("fault")))


def ofac_entries(parts: list[DataFrame]) -> DataFrame:
    """The united list under its twelve names; an individual's `Last, First` becomes ` First Last`."""
    out = parts[0].toDF(*OFAC_COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.toDF(*OFAC_COLUMNS))
    last, first = F.split_part("name", F.lit(","), F.lit(1)), F.split_part("name", F.lit(","), F.lit(2))
    swapped = F.lower(F.trim("type")).eqNullSafe("individual") & F.col("name").contains(",")
    return out.withColumn("name", F.when(swapped, F.concat(first, F.lit(" "), last)).otherwise(F.col("name")))


def uk_entries(lines: DataFrame) -> DataFrame:
    """(file, line, row map) of the list below its header line, which may follow other lines."""
    heads = lines.where(F.col("value").startswith(UK_HEADER)).groupBy("file").agg(F.min(F.struct("line", "value")).alias("h"))
    body = lines.join(heads, "file").where((F.col("line") > F.col("h.line")) & (F.trim("value") != ""))
    header, own = cells(F.col("h.value")), cells(F.col("value"))
    width = F.least(F.size(header), F.size(own))
    return body.select("file", "line", F.map_from_arrays(F.slice(header, F.lit(1), width), F.slice(own, F.lit(1), width)).alias("row"))


def un_entries(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, name, aliases, source) of individuals and entities of the list's XML."""
    names = "FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, NAME_ORIGINAL_SCRIPT string"
    parts = []
    for kind, tag in (("individual", "INDIVIDUAL"), ("entity", "ENTITY")):
        schema = f"DATAID string, {names}, {tag}_ALIAS array<struct<ALIAS_NAME:string>>"
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        spelled = F.filter(F.array("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME"), lambda n: F.coalesce(F.trim(n), F.lit("")) != "")
        name = F.concat_ws(" ", F.transform(spelled, lambda n: F.trim(n)))
        if kind == "individual":
            name = F.when(name != "", name).otherwise(F.coalesce(F.trim("NAME_ORIGINAL_SCRIPT"), F.lit("")))
        aliases = F.filter(F.transform(F.col(f"{tag}_ALIAS"), lambda a: F.trim(a["ALIAS_NAME"])), lambda a: F.coalesce(a, F.lit("")) != "")
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col("DATAID").alias("id"), name.alias("name"), F.array_join(F.coalesce(aliases, F.array().cast("array<string>")), "|").alias("aliases"), F.lit("UN").alias("source")))
    return parts[0].unionByName(parts[1])


def resolved_ids(tickers: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """(ticker, conid): of a search's results of one section type, the exact symbol first, then the first; each id once, with its first ticker."""
    joined = tickers.join(found.where(F.array_contains("sections", kind)), "ticker")
    order = F.struct((F.upper("symbol") != F.upper("ticker")).alias("inexact"), "place", "conid")
    best = joined.groupBy("ticker").agg(F.min_by("conid", order).alias("conid"), F.min("n").alias("n"))
    return best.groupBy("conid").agg(F.min_by("ticker", F.struct("n", "ticker")).alias("ticker")).select("ticker", "conid")


def plain_conid(c: Column) -> Column:
    return F.substring_index(c, "@", 1)


def watch_list_ids(instruments: DataFrame) -> DataFrame:
    """(conid, place) of a watch list's bonds (assetClass, conid, place): each id once, at the first place it is seen."""
    return instruments.where((F.col("assetClass") == "BOND") & F.col("conid").isNotNull()).groupBy(F.col("conid").cast("string").alias("conid")).agg(F.min("place").alias("place"))
