"""Quality of recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.fixed_values import (
    CONFIDENCE_IF_UNKNOWN, HIGH_SCORE, LOW_DEFECT, LOW_PROVIDER_QUALITY, LOW_REGION_CONFIDENCE, PAGES_A_CHUNK, RETRY_CONFIDENCE, REVIEW_DEFECT, REVIEW_DEFECTS, REVIEW_PROVIDER_QUALITY, REVIEW_SCORE, SEVERE_DEFECTS,
)
from larkspur.functions import numbers
from larkspur.functions.numbers import clamp

#: Places of scores, and of documents' confidences: fewer than a double has, so that a sum's order moves no value over a limit or a half.
SCORE_PLACES, CONFIDENCE_PLACES = 11, 12


def assessed(text: Column, confidence: Column, pages: Column, regions: Column, empty_pages: Column, low_regions: Column) -> Column:
    """struct(score 0 to 100, status, characters, printable_ratio, suspicious_ratio, reasons) of a text; its characters are counted once."""

    def counted(t: Column) -> Column:
        length_without = lambda pattern: F.length(F.regexp_replace(t["visible"], pattern, ""))
        return F.struct(t["characters"].alias("characters"), F.length(t["visible"]).alias("n"), length_without(r"\p{C}|\p{Z}").alias("printable"), length_without("\\p{C}|�").alias("clean"))

    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    told = numbers.bound(plain, lambda p: F.struct(F.length(p).alias("characters"), F.regexp_replace(p, r"(?U)\s", "").alias("visible")))
    return numbers.bound(numbers.bound(told, counted), lambda c: judged(c, confidence, pages, regions, empty_pages, low_regions))


def judged(counts: Column, confidence: Column, pages: Column, regions: Column, empty_pages: Column, low_regions: Column) -> Column:
    """assessed, from the counts of a text's characters: characters, n (visible), printable and clean ones of them."""
    n, none = counts["n"], counts["characters"] == 0
    odd, suspicious = n - counts["printable"], n - counts["clean"]
    pages, regions = F.greatest(F.lit(1), pages), F.greatest(F.lit(0), regions)
    empty, low = F.least(pages, F.greatest(F.lit(0), empty_pages)), F.least(regions, F.greatest(F.lit(0), low_regions))
    printable, suspect = 1 - odd / F.greatest(F.lit(1), n), suspicious / F.greatest(F.lit(1), n)
    bounded = F.when(confidence.isNotNull(), clamp(confidence, 0.0, 1.0))
    points = F.coalesce(bounded, F.lit(CONFIDENCE_IF_UNKNOWN)) * 65 + printable * 20 + F.least(F.lit(10.0), n / 4) + (1 - suspect) * 5
    points = points - empty / pages * 25 - F.coalesce(F.try_divide(low, regions), F.lit(0.0)) * 15
    score = F.when(none, F.lit(0.0)).otherwise(F.round(clamp(points, 0.0, 100.0), SCORE_PLACES))
    reason = lambda test, name: F.when(test, F.lit(name))
    told = F.when(bounded.isNull(), F.lit("confidence_unavailable")).when(bounded < LOW_REGION_CONFIDENCE, F.lit("very_low_average_confidence")).when(bounded < RETRY_CONFIDENCE, F.lit("low_average_confidence"))
    reasons = F.array_compact(F.array(told, reason(empty > 0, "empty_pages"), reason(low > 0, "low_confidence_regions"), reason(printable < 0.98, "non_printable_characters"), reason(suspect > 0, "suspicious_characters"), reason(n < 4, "very_short_text")))
    return F.struct(
        score.alias("score"),
        F.when(score >= HIGH_SCORE, "high").when(score >= REVIEW_SCORE, "review").otherwise("low").alias("status"),
        counts["characters"].alias("characters"),
        F.when(none, F.lit(0.0)).otherwise(printable).alias("printable_ratio"),
        F.when(none, F.lit(0.0)).otherwise(suspect).alias("suspicious_ratio"),
        F.when(none, F.array(F.lit("no_text"))).otherwise(reasons).alias("reasons"),
    )


def rank_score(assessment: Column) -> Column:
    """Score of an attempt among others: quality and up to 50 for length."""
    return assessment["score"] + F.least(F.lit(50.0), assessment["characters"] / 10)


def downgraded(status: Column, provider_quality: Column, defects: Column) -> Column:
    """Status after the provider's image quality and its defects (array of struct(type, confidence))."""
    severe = F.size(F.array_distinct(F.transform(F.filter(defects, lambda d: d["type"].isin(*SEVERE_DEFECTS) & (d["confidence"] >= LOW_DEFECT)), lambda d: d["type"])))
    review = F.exists(defects, lambda d: d["type"].isin(*SEVERE_DEFECTS, *REVIEW_DEFECTS) & (d["confidence"] >= REVIEW_DEFECT))
    low = (provider_quality < LOW_PROVIDER_QUALITY) | (severe >= 2)
    worse = (provider_quality < REVIEW_PROVIDER_QUALITY) | review
    return F.when(F.coalesce(low, F.lit(False)), F.lit("low")).when(F.coalesce(worse, F.lit(False)) & (status == "high"), F.lit("review")).otherwise(status)


def bounds(polygon: Column) -> Column:
    """struct(left, top, right, bottom) of an array of points."""
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(F.array_min(x).alias("left"), F.array_min(y).alias("top"), F.array_max(x).alias("right"), F.array_max(y).alias("bottom"))


def inside(words: Column, box: Column) -> Column:
    """The words (struct with polygon) whose centre lies in a box."""

    def centred(w: Column) -> Column:
        b = bounds(w["polygon"])
        x, y = (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2
        return x.between(box["left"], box["right"]) & y.between(box["top"], box["bottom"])

    return F.filter(words, centred)


def centre(polygon: Column) -> tuple[Column, Column]:
    b = bounds(polygon)
    return (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2


def weighted_confidence(parts: Column) -> Column:
    """Mean confidence of parts (struct(text, confidence)) weighted by text length, 1 at least; parts without one are left out."""
    known = F.filter(parts, lambda p: p["confidence"].isNotNull())
    weight = lambda p: F.greatest(F.lit(1), F.length(F.coalesce(p["text"], F.lit("")))).cast("double")
    total = F.aggregate(known, F.lit(0.0), lambda s, p: s + weight(p))
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, p: s + weight(p) * p["confidence"].cast("double")), total)


def page_chunks(pages: Column, size: int = PAGES_A_CHUNK) -> Column:
    """Arrays of page numbers, `size` together; none for no pages."""
    starts = F.when(pages > 0, F.sequence(F.lit(1), F.greatest(pages, F.lit(1)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.sequence(s, F.least(s + (size - 1), pages)))
