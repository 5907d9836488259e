"""Rating functions: parsing, levels, equivalents and portfolio buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.fixed_values import MOODYS_SCALE, SP_SCALE, SP_TEXT_ORDER, TREASURY_PATTERNS
from larkspur.functions.numbers import any_of, bound


def literal_map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def clean_rating(c: Column) -> Column:
    """Only the characters that ratings are made of."""
    return F.regexp_replace(c, r"[^AaBbC123/+\-]", "")


def agency_ratings(text: Column) -> Column:
    """struct(moodys, sp) of `rating (agency)` or `a/b (AGENCY/AGENCY)`; both null without a parenthesis."""
    rating = F.trim(F.split_part(text, F.lit("("), F.lit(1)))
    inside = F.split_part(text, F.lit("("), F.lit(2))
    agency = F.substring(inside, F.lit(1), F.greatest(F.length(inside) - 1, F.lit(0)))
    names, values = F.split(agency, "/"), F.split(rating, "/")
    paired = (F.size(names) == 2) & (F.size(values) == 2)

    def of(word: str, first: bool) -> Column:
        inner = F.when(names[0].contains(word), F.trim(values[0])).when(names[1].contains(word), F.trim(values[1]))
        single = F.when(agency.contains(word) & (F.lit(first) | ~agency.contains("MOODY")), rating)
        return F.when(text.contains("("), F.when(paired, inner).otherwise(single))

    return F.struct(of("MOODY", True).alias("moodys"), of("SP", False).alias("sp"))


def rating_level(c: Column, strict: bool = True) -> Column:
    """1 (best) to 22. strict: names as the scales write them; else in any case."""
    pairs = {name: level for scale in (MOODYS_SCALE, SP_SCALE) for level, name in enumerate(scale, 1)}
    if strict:
        return F.try_element_at(literal_map(pairs.items()), c)
    return F.try_element_at(literal_map({k.upper(): v for k, v in pairs.items()}.items()), F.upper(c))


def worse_level(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def sp_equivalent(level: Column) -> Column:
    return F.try_element_at(literal_map(enumerate(SP_SCALE, 1)), level.cast("int"))


def token(c: Column) -> Column:
    """Upper case without blanks; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c.cast("string"))), " ", ""), F.lit(""))


def sp_like_token(text: Column) -> Column:
    """The first name, in a fixed order, that the text contains anywhere; null if none."""
    upper, out = F.upper(text), F.lit(None).cast("string")
    for name in reversed(SP_TEXT_ORDER):
        out = F.when(upper.contains(name), F.lit(name)).otherwise(out)
    return out


def moodys_to_sp(c: Column) -> Column:
    return F.try_element_at(literal_map((m.upper(), s) for m, s in zip(MOODYS_SCALE[:-1], SP_SCALE[:-1], strict=True)), token(c))


def is_treasury(*fields: Column) -> Column:
    joined = F.upper(F.concat_ws(" ", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))
    return bound(joined, lambda text: any_of([text.rlike(p) for p in TREASURY_PATTERNS]))


def resolved_rating(treasury: Column, equivalent: Column, sp: Column, text: Column, moodys: Column) -> Column:
    """UST, S&P equivalent, S&P rating, rating in a text, Moody's equivalent: the first there is; else ''."""
    return F.coalesce(F.when(treasury, F.lit("UST")), token(equivalent), token(sp), sp_like_token(text), moodys_to_sp(moodys), F.lit(""))


def rating_bucket(rating: Column) -> Column:
    """Portfolio bucket of a rating; '' if it has none."""
    plain = F.regexp_replace(F.upper(F.trim(rating)), r"[+\-]", "")
    return bound(
        plain,
        lambda r: F.when(r == "UST", "treasuries").when(r == "ETF", "etfs").when(r == "STOCK", "stocks").when(r.isin("AAA", "AA", "A"), "bonds_aaa_a").when(r == "BBB", "bonds_bbb").when(r == "BB", "bonds_bb").otherwise(""),
    )


def issuer(text: Column) -> Column:
    """The first word."""
    return F.regexp_extract(text, r"^\s*(\S+)", 1)
