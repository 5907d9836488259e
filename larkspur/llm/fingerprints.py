"""Document fingerprints by winnowing, with DataFrame functions alone.

The GRAM-byte strings of a text are hashed at every byte; of each WINDOW consecutive hashes the least is selected, the
rightmost of equals, and kept with its position. A passage of GRAM + WINDOW - 1 bytes that two texts share gives them a
selected hash in common. A hash and its place are one long (hash above, distance from a far end below), so the least long
is the least hash with the rightmost place, and minima over windows come from minima over half as long windows.

Documents are compared with the next one, descending doc_id. They are dealt to bins of consecutive ids with one shuffle
of their texts; the first document of each bin also goes to the bin above, as a guest, so that the last one there finds
its next. Bins have bounds at quantiles of the ids that there are, so gaps between ids leave none of them large. There
are at most MOST_BINS bounds, small enough for the driver; a bin is sorted with spill, never held whole.

Edge cases: a null text is empty; an empty text has the fingerprint '', like another empty text and unlike any other;
texts below GRAM bytes are one string, with fewer strings than WINDOW one window; after the last document comes the
first, which for a single document is itself; repeated rows follow one another; documents with a null doc_id have no next one and are
dealt by their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 16, 16  # WINDOW: a power of four
DOCUMENTS_A_BIN, MOST_BINS = 2500, 100_000


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def selected(raw: Column) -> Column:
    """Selected hashes with places of a binary value, in order of place: hash * 2**32 + 2**32 - 1 - place."""

    def places(raw: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - (GRAM - 1), F.lit(1))), lambda i: F.shiftleft(F.xxhash64(F.substring(raw, i, F.lit(GRAM))).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.lit(0x100000000) - i))
        return let(hashes, lambda h: F.slice(minima(h, 1), F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(1))))

    def minima(h: Column, reach: int) -> Column:
        if reach == WINDOW:
            return h
        return let(F.transform(h, lambda x, i: F.least(x, *[F.get(h, i + reach * k) for k in (1, 2, 3)])), lambda m: minima(m, reach * 4))

    return F.when(F.octet_length(raw) > 0, F.array_distinct(let(raw, places))).otherwise(F.array().cast("array<bigint>"))


def selected_after(chosen: Column, kept: Column, edited: Column) -> Column:
    """Selected of an edited text whose first `kept` bytes are those of a text with `chosen`: windows inside them are not computed again."""
    whole = F.greatest(kept - (GRAM + WINDOW - 2), F.lit(0))  # windows that lie inside the kept bytes
    start = F.greatest(whole - (WINDOW - 1), F.lit(0))  # the first window that reaches a place behind them
    tail = F.transform(selected(F.substring(edited, start + 1, F.octet_length(edited))), lambda v: v - start)
    return F.array_distinct(F.concat(F.filter(chosen, lambda v: F.lit(0xFFFFFFFF) - v.bitwiseAND(F.lit(0xFFFFFFFF)) < whole), tail))


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda v: F.shiftright(v, 32).cast("int")))


def written_out(chosen: Column) -> Column:
    """hash.place in hexadecimal, in order of place."""
    return F.array_join(F.transform(chosen, lambda v: F.concat(F.hex(F.shiftright(v, 32)), F.lit("."), F.hex(F.lit(0xFFFFFFFF) - v.bitwiseAND(F.lit(0xFFFFFFFF))))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; of two empty ones, 1."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.coalesce(F.try_divide(n.cast("double"), F.size(a) + F.size(b) - n), F.lit(1.0)))


def in_bins(plain: DataFrame, bins: int) -> DataFrame:
    """Adds `bin`: 0 and above for ids between two quantiles (equal as doubles: one bin), below 0 for null ids, by a hash of the text."""
    alone = -1 - F.pmod(F.xxhash64("text"), F.lit(bins))
    cuts = []
    if bins > 1:
        quantiles = F.percentile_approx(F.col("doc_id").cast("double"), [i / bins for i in range(1, bins)], 20 * bins)
        cuts = sorted(set(plain.agg(quantiles).first()[0]))
    if not cuts:
        return plain.withColumn("bin", F.when(F.col("doc_id").isNull(), alone).otherwise(0).cast("int"))
    place = plain.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))
    binned = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="cut").transform(place)
    return binned.withColumn("bin", F.when(F.col("doc_id").isNull(), alone).otherwise(F.col("cut")).cast("int")).drop("place", "cut")


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, chosen and, of the next document, next_text and next_hashes (null without one)."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bins = max(1, min(MOST_BINS, -(-plain.agg(F.count("doc_id")).first()[0] // DOCUMENTS_A_BIN)))
    placed = in_bins(plain, bins)
    tops = sorted((r["bin"], r["top"]) for r in placed.where("doc_id is not null").groupBy("bin").agg(F.max("doc_id").alias("top")).collect())
    guests = [(high[0], low[1]) for low, high in zip(tops[:-1], tops[1:], strict=True)] + ([(tops[0][0], tops[-1][1])] if tops else [])
    guest_rows = plain.join(F.broadcast(spark.createDataFrame(guests, "bin int, guest long")), F.col("doc_id") == F.col("guest"))
    rows = placed.withColumn("late", F.lit(0)).unionByName(guest_rows.select("doc_id", "text", "bin", F.lit(1).alias("late"))).repartition("bin")
    chosen = rows.withColumn("chosen", selected(F.col("text").cast("binary")))
    order = Window.partitionBy("bin").orderBy("late", F.desc_nulls_last("doc_id"), "text")
    known = F.col("doc_id").isNotNull()
    return chosen.withColumn("next_text", F.when(known, F.lead("text").over(order))).withColumn("next_chosen", F.when(known, F.lead("chosen").over(order))).where("late = 0").drop("late", "bin")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars and positions (hash, place) of its fingerprint."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), selected(F.col("text").cast("binary")).alias("chosen")).select("doc_id", "n_chars", F.transform("chosen", lambda v: F.struct(F.shiftright(v, 32).alias("hash"), (F.lit(0xFFFFFFFF) - v.bitwiseAND(F.lit(0xFFFFFFFF))).alias("place"))).alias("positions"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: the fingerprint, that of the edited text (last third replaced by the start of the next document), and likenesses."""
    rows = beside_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third)
    own = hashes(F.col("chosen"))

    def of(kept: Column) -> Column:
        edited = F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third)).cast("binary")
        return let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), let(selected_after(F.col("chosen"), F.octet_length(kept), e), lambda c: F.struct(written_out(c).alias("print"), likeness(own, hashes(c)).alias("near"))).alias("own")))

    of_edited = let(kept, of)
    rows = rows.withColumn("edited", of_edited)
    return rows.select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), written_out(F.col("chosen")).alias("fingerprint"), F.col("edited.own.print").alias("edited_fingerprint"),
        F.col("edited.own.near").alias("near_edited"), F.when(F.col("next_text").isNotNull(), likeness(own, hashes(F.col("next_chosen")))).otherwise(0.0).alias("near_next"),
    )
