"""Document records: recognition roll-ups, batches to do, translation memory and units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from larkspur.fixed_values import GLOSSARY_CHARS, GLOSSARY_ENTRIES, PLACEHOLDER, PROTECTED_PATTERNS, TERMINAL_FAILURES
from larkspur.functions import ocr, text
from larkspur.functions.numbers import bound
from larkspur.operators import intervals, selection


def decoded(df: DataFrame, data: str = "data", kind: str = "mime_type") -> DataFrame:
    """Adds `content` (binary; null for bad base64) and, for plain text, `plain` (UTF-8, else Latin-1)."""
    content = F.try_to_binary(F.regexp_replace(F.col(data), r"^data:[^,]*,|\s", ""), F.lit("base64"))
    plain = F.when(F.col(kind).startswith("text/"), F.coalesce(F.try_validate_utf8(F.col("content")), F.decode("content", "ISO-8859-1")))
    return df.withColumn("content", content).withColumn("plain", plain)


def document_quality(pages: DataFrame) -> DataFrame:
    """Per document_id of pages (page_number, text, regions array<struct<text,confidence>>, image_quality, defects): text, counts, confidence, assessment and status after the provider's view (the least image quality counts)."""
    confidence = F.flatten(F.collect_list(F.coalesce("regions", F.array().cast("array<struct<text:string,confidence:double>>"))))
    rolled = pages.groupBy("document_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("page_count"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_pages"), confidence.alias("regions"),
        F.min("image_quality").alias("image_quality"), F.flatten(F.collect_list(F.coalesce("defects", F.array().cast("array<struct<type:string,confidence:double>>")))).alias("defects"),
    )
    low = F.size(F.filter("regions", lambda r: r["confidence"] < 0.5))
    judged = rolled.withColumn("confidence", F.round(ocr.weighted_confidence(F.col("regions")), ocr.CONFIDENCE_PLACES)).withColumn("quality", ocr.assessed(F.col("text"), F.col("confidence"), F.col("page_count"), F.size("regions"), F.col("empty_pages"), low))
    return judged.withColumn("status", ocr.downgraded(F.col("quality.status"), F.col("image_quality"), F.col("defects")))


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """Per document of page chunks (pages, image_quality): page-weighted mean image quality."""
    weight = F.when(F.col("image_quality").isNotNull(), F.col("pages"))
    return chunks.groupBy("document_id").agg(F.sum("pages").alias("pages"), F.try_divide(F.sum(F.col("image_quality") * weight), F.sum(weight)).alias("image_quality"))


def finished(ledger: DataFrame, key: str = "document_id") -> DataFrame:
    """Keys of a ledger that are done: completed, or failed in a way that will not change."""
    terminal = (F.col("status") == "failed") & selection.starts_with_any(F.coalesce("error", F.lit("")), TERMINAL_FAILURES)
    return ledger.where((F.col("status") == "completed") | terminal).select(key).distinct()


def next_batch(links: DataFrame, processed: DataFrame, ledger: DataFrame, n: int = 100) -> DataFrame:
    """The newest links whose document is neither processed nor finished; a top-n report."""
    done = processed.where("status = 'completed'").select("document_id").unionByName(finished(ledger)).distinct()
    return links.join(done, "document_id", "left_anti").orderBy(F.desc("created"), F.desc("id")).limit(n)


def translation_batch(processing: DataFrame, ledger: DataFrame, n: int = 10) -> DataFrame:
    """The newest completed text of each document that is not translated yet, oldest first; a top-n report."""
    newest = selection.latest(processing.where("status = 'completed' and process_type = 'text_extraction'"), ["document_id"], [F.coalesce("updated", "created", F.lit("")).desc(), F.desc("id")])
    done = ledger.where((F.col("status") == "completed") & text.translation_error(F.col("translated_text")).isNull()).select("document_id").distinct()
    return newest.join(done, "document_id", "left_anti").where(text.document_text(F.col("output_text")) != "").orderBy("created", "document_id").limit(n)


def glossary_entries(pairs: DataFrame) -> DataFrame:
    """(entry, total, key) of pairs (document_id, source, translated) with as many lines: each source line with its most frequent translation, and how often it comes."""
    clean = pairs.select("document_id", text.document_text(F.col("source")).alias("s"), text.document_text(F.col("translated")).alias("t")).where("s <> '' and t <> ''")
    lines = clean.withColumn("a", F.split("s", "\n")).withColumn("b", F.split("t", "\n")).where(F.size("a") == F.size("b"))
    each = lines.select("document_id", F.posexplode(F.arrays_zip("a", "b")).alias("n", "p")).select("document_id", "n", F.trim("p.a").alias("line"), F.trim("p.b").alias("target"))
    usable = each.where(text.glossary_pair(F.col("line"), F.col("target"))).withColumn("key", F.lower("line"))
    counted = usable.groupBy("key", "target").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("document_id", "n", "line")).alias("first"))
    best = counted.groupBy("key").agg(F.sum("n").alias("total"), F.max_by("target", F.struct(F.col("n"), -F.col("first.n"), F.col("target"))).alias("target"), F.min("first").alias("first"))
    return best.select(F.concat_ws(" = ", "first.line", "target").alias("entry"), "total", "key")


def translation_memory(pairs: DataFrame) -> DataFrame:
    """One row: glossary and its number of lines: the entries of most frequent lines first, within the budget; one that does not fit is skipped."""
    # Of entries of one length those that are kept come first, so no more of a length than may be kept at all are needed.
    entries = glossary_entries(pairs).withColumn("_length", F.length("entry"))
    ranked = selection.top(entries, ["_length"], [F.desc("total"), F.col("key")], GLOSSARY_ENTRIES)
    order = F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("r"), "key", "entry")))
    kept = ranked.agg(text.within_budget(F.transform(order, lambda e: e["entry"]), GLOSSARY_CHARS, GLOSSARY_ENTRIES).alias("kept"))
    return kept.select(F.array_join("kept", "\n").alias("glossary"), F.size("kept").alias("entries"))


def translation_units(docs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(document_id, unit, text, translate): adjacent lines to translate are one unit; lines that pass through, and exact glossary hits (key, target), are units of their own."""
    lines = docs.select("document_id", F.posexplode(F.split(text.document_text(F.col("text")), "\n")).alias("n", "line"))
    known = lines.withColumn("key", F.lower(F.trim("line"))).join(glossary.select("key", "target"), "key", "left")
    marked = known.withColumn("own", F.col("target").isNotNull() | text.passes_through(F.col("line")))
    order = Window.partitionBy("document_id").orderBy("n")
    starts = F.col("own") | F.coalesce(F.lag("own").over(order), F.lit(True))
    numbered = marked.withColumn("unit", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.coalesce("target", "line").alias("t")))), lambda x: x["t"]), "\n")
    return numbered.groupBy("document_id", "unit").agg(joined.alias("text"), (~F.bool_or("own")).alias("translate"))


_PATTERNS = [re.compile(p) for p in PROTECTED_PATTERNS]


def protected_text(source: str) -> tuple[str, list[str]]:
    """The text with values replaced by numbered placeholders, and the values."""
    values: list[str] = []

    def hide(m: re.Match) -> str:
        values.append(m[0])
        return PLACEHOLDER.format(len(values))

    for pattern in _PATTERNS:
        source = pattern.sub(hide, source)
    return source, values


def protected(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds `protected` and `values`: numbers run through each text, which no built-in replacement can do. Other columns pass as they are."""

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [protected_text(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("row"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=["row", "protected", "values"])

    rows = docs.select(F.struct("*").alias("row"), F.col(column).alias("text"))
    schema = StructType([rows.schema["row"]]).add("protected", "string").add("values", ArrayType(StringType()))
    return rows.mapInArrow(hide, schema).select("row.*", "protected", "values")


def restored(df: DataFrame, translated: str = "translated") -> DataFrame:
    """Adds `restored` and `fault`: placeholders replaced by their values; each has to occur once."""
    numbered = PLACEHOLDER.replace("{:04d}", "%04d")
    names = F.transform(F.col("values"), lambda v, i: F.format_string(numbered, i + 1))
    # Parts of the text between placeholders: as many of each name as there are, found in one pass.
    found = F.regexp_extract_all(F.col(translated), F.lit(PLACEHOLDER.replace("{:04d}", r"\d{4,}")), F.lit(0))
    each_once = lambda f: F.array_sort(f) == F.array_sort(names)
    lost = bound(found, lambda f: F.when(each_once(f), F.array().cast("array<string>")).otherwise(F.filter(names, lambda n: F.size(F.filter(f, lambda x: x == n)) != 1)))
    # later placeholders first: a value may itself hold an earlier one
    filled = F.aggregate(F.reverse(F.arrays_zip(names.alias("n"), F.col("values").alias("v"))), F.col(translated), lambda s, p: F.replace(s, p["n"], p["v"]))
    told = bound(lost, lambda l: F.when(F.size(l) > 0, F.concat(F.lit("The model omitted or duplicated protected values: "), F.array_join(F.slice(l, 1, 5), ", "))))
    return df.withColumn("fault", told).withColumn("restored", F.when(F.col("fault").isNull(), filled))


def paragraph_confidences(words: DataFrame, paragraphs: DataFrame, page: list[str]) -> DataFrame:
    """(page, paragraph_id, words, confidence): of each paragraph (polygon) the words (polygon, confidence) whose centre lies within its bounds, and their mean confidence; none without words.

    Words and paragraphs meet in the cells of a grid, so a page with many of both is neither one task nor a product.
    """
    x, y = ocr.centre(F.col("polygon"))
    box = ocr.bounds(F.col("polygon"))
    points = words.select(*page, "confidence", x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    boxes = paragraphs.select(*page, "paragraph_id", *[box[side].cast("double").alias(f"_{side}") for side in ("left", "top", "right", "bottom")])
    met = intervals.inside(points, "_x", "_y", boxes, ("_left", "_top", "_right", "_bottom"), page)
    found = met.groupBy(*page, "paragraph_id").agg(F.count(F.lit(1)).alias("words"), F.avg(F.col("confidence").cast("double")).alias("confidence"))
    return paragraphs.select(*page, "paragraph_id").join(found, [*page, "paragraph_id"], "left").withColumn("words", F.coalesce("words", F.lit(0)))
