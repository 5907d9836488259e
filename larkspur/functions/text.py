"""Text functions: name normalisation, document text, masks, translation checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.fixed_values import CHUNK_CHARS, GLOSSARY_LINE, LEAK_MARKERS, PAGE_COUNTER, PROTECTED_PATTERNS
from larkspur.functions.numbers import bound


class Fold:
    """A replacement of characters beyond ASCII by ASCII letters, one or several, as a rule over all code points says."""

    def __init__(self, rule: Callable[[str], str]):
        single, several = {}, {}
        for code in range(0x80, LAST_LETTER):
            plain = rule(chr(code))
            if plain:
                (single if len(plain) == 1 else several)[chr(code)] = plain
        self.marked, self.plain = "".join(single), "".join(single.values())
        self.several = "\x02".join(f"{k}\x01{v}" for k, v in several.items())
        self.wide = "".join(several)

    def __call__(self, c: Column) -> Column:
        """c with letters replaced; other characters beyond ASCII stay. Texts of ASCII alone stay as they are; those with a letter that becomes several are taken apart, others are translated whole."""
        table = F.str_to_map(F.lit(self.several), F.lit("\x02"), F.lit("\x01"))
        letter = lambda x: F.when(x < "\x80", x).otherwise(F.coalesce(F.try_element_at(table, x), x))  # noqa: E731  (the table is searched from its begin)
        apart = F.array_join(F.transform(F.split(c, ""), letter), "")
        wide = F.translate(c, self.wide, "") != c  # a look-up a character, where a class of a pattern is searched from its begin
        folded = F.translate(F.when(wide, apart).otherwise(c), self.marked, self.plain)
        return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


#: Beyond this code point no character decomposes to ASCII or folds to it.
LAST_LETTER = 0x20000


@cache
def ascii_fold() -> Fold:
    """Compatibility decomposition, of which ASCII stays."""
    return Fold(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@cache
def identity_fold() -> Fold:
    """Compatibility decomposition without combining marks, then full case folding, of which letters a to z and digits stay."""

    def rule(x: str) -> str:
        bare = "".join(p for p in unicodedata.normalize("NFKD", x) if not unicodedata.combining(p))
        return "".join(p for p in bare.casefold() if p.isascii() and p.isalnum())

    return Fold(rule)


def without_marks(c: Column) -> Column:
    """Letters as the ASCII letters that they decompose to; other characters beyond ASCII go."""
    return F.regexp_replace(ascii_fold()(c), r"[^\x00-\x7F]", "")


def normalized_name(c: Column) -> Column:
    """Lower-case letters and digits, single blanks; '' for null."""
    kept = F.regexp_replace(F.lower(without_marks(F.coalesce(c, F.lit("")))), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def normalized_country(c: Column) -> Column:
    return F.upper(normalized_name(c))


def identity_key(c: Column) -> Column:
    """Letters a to z and digits alone, after folding of case and marks; '' for null."""
    return F.regexp_replace(F.lower(F.regexp_replace(identity_fold()(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", "")), "[^a-z0-9]", "")


def document_text(c: Column) -> Column:
    """Line ends as \\n, no blanks at line ends, none around the text; '' for null."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n"), r"(?m)[ \t\f\x0B]+$", "")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def preview(c: Column, most: int = 300) -> Column:
    return F.substring(F.regexp_replace(document_text(c), "\n", " "), 1, most)


def page_count(c: Column) -> Column:
    """Form feeds and one."""
    return F.length(c) - F.length(F.replace(c, F.lit("\f"), F.lit(""))) + 1


def masked(c: Column, pattern: str = r"\d[\d.,'/:+-]*", mask: str = "#") -> Column:
    return F.regexp_replace(c, pattern, mask)


def translation_error(c: Column) -> Column:
    """What is wrong with a translation: the first of four checks that fails; null if none."""
    text = F.coalesce(c, F.lit(""))
    out = F.when(document_text(text) == "", F.lit("Translation output is empty."))
    out = out.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), F.lit("Translation output contains terminal control characters."))
    out = out.when(text.rlike(r"PRESERVETOKEN|ENDTOKEN|__PRESERVE_|ZZX9\d{4,}8XZZ"), F.lit("Translation output contains an unresolved protected-value token."))
    for marker in LEAK_MARKERS:
        out = out.when(text.contains(marker), F.lit(f"Translation output copied context marker: {marker}"))
    return out


def passes_through(line: Column) -> Column:
    """A line that is not translated: no letter, or one protected value or page counter as a whole."""
    stripped = F.trim(line)
    whole = F.lit(False)
    for pattern in (*PROTECTED_PATTERNS[:-1], PAGE_COUNTER):
        flags = pattern[: pattern.index(")") + 1] if pattern.startswith(("(?m)", "(?i)", "(?im)")) else ""
        whole = whole | stripped.rlike(f"{flags}^(?:{pattern[len(flags):]})$")
    return (stripped == "") | ~stripped.rlike("[A-Za-zÀ-ÿ]") | whole


def glossary_pair(source: Column, target: Column) -> Column:
    """Whether a line and its translation may enter a glossary."""
    fits = lambda c: (c != "") & (F.length(c) <= GLOSSARY_LINE) & ~c.contains("=")
    return fits(source) & fits(target) & (F.lower(source) != F.lower(target)) & ~source.rlike(r"\d") & source.rlike("[A-Za-zÀ-ÿ]")


def packed_lines(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Chunks of whole lines of at most `most` characters (a longer line is a chunk of its own), greedily.

    The fold carries only the length of the open chunk and the numbers of the lines that begin one, since all that a fold
    carries is copied at each step.
    """
    start = F.struct(F.lit(0).alias("line"), F.lit(-1).alias("chars"), F.lit("").alias("firsts"))

    def add(state: Column, line: Column) -> Column:
        joined = state["chars"] + 1 + F.length(line)
        fits = (state["chars"] >= 0) & (joined <= most)
        firsts = F.when(fits, state["firsts"]).otherwise(F.concat(state["firsts"], state["line"].cast("string"), F.lit(" ")))
        return F.struct((state["line"] + 1).alias("line"), F.when(fits, joined).otherwise(F.length(line)).alias("chars"), firsts.alias("firsts"))

    def chunks(lines: Column) -> Column:
        firsts = F.transform(F.filter(F.split(F.aggregate(lines, start, add, lambda s: s["firsts"]), " "), lambda x: x != ""), lambda x: x.cast("int"))
        after = lambda f, i: F.coalesce(F.get(f, i + 1), F.size(lines))
        return bound(firsts, lambda f: F.transform(f, lambda first, i: F.trim(F.array_join(F.slice(lines, first + 1, after(f, i) - first), "\n"))))

    return F.filter(bound(F.split(text, "\n"), chunks), lambda c: c != "")


def within_budget(entries: Column, most_chars: int, most: int) -> Column:
    """Entries taken in order while they fit a budget of characters (one more for each); one that does not fit is skipped."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))

    def add(state: Column, entry: Column) -> Column:
        fits = (state["used"] + F.length(entry) <= most_chars) & (F.size(state["kept"]) < most)
        return F.struct(F.when(fits, F.array_append(state["kept"], entry)).otherwise(state["kept"]).alias("kept"), F.when(fits, state["used"] + F.length(entry) + 1).otherwise(state["used"]).alias("used"))

    return F.aggregate(entries, start, add, lambda s: s["kept"])


def language_codes(c: Column, names: dict[str, str], default: str = "es", last: str = "en") -> Column:
    """Language codes of a list like `Spanish; English`, mapped, distinct, in order; default if none, `last` always at the end."""
    parts = F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[,;+]"), lambda x: F.trim(x)), lambda x: x != "")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    codes = F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, x), x)))
    return F.array_distinct(F.concat(F.when(F.size(codes) == 0, F.array(F.lit(default))).otherwise(codes), F.array(F.lit(last))))
