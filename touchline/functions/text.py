"""Column expressions for names, whitespace and markup text."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from functools import lru_cache
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def _char_ranges(test: Callable[[str], bool], stop: int) -> str:
    """Body of a regex character class holding every character that passes ``test``."""
    ranges: list[list[int]] = []
    for code in range(stop):
        if test(chr(code)):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)


# Whitespace as Unicode defines it for text splitting; nothing lies above U+3000.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE_CLASS = _char_ranges(str.isspace, 0x3001)

# Punctuation deleted from names, and words that carry no identity.
NAME_PUNCTUATION = "'-.,:;()/"
STOP_WORDS = ("Real",)


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Decimal digits plus superscripts and the like, which also count as digits."""
    return _char_ranges(str.isdigit, sys.maxunicode + 1)


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_long(text: Column) -> Column:
    """The same for long texts, in which a trim looks up each character."""
    return F.regexp_extract(text, f"(?s)^[{SPACE_CLASS}]*+(.*[^{SPACE_CLASS}])", 1)


def collapse_space(text: Column) -> Column:
    return strip_space(F.regexp_replace(text, f"[{SPACE_CLASS}]+", " "))


def normalized(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens without punctuation, stop words and pure numbers.

    The stop-word test is case-sensitive and runs before lower-casing.
    """
    # One character to split at: Spark compiles any longer pattern of a split anew for each row.
    spaced = F.translate(text, WHITESPACE + NAME_PUNCTUATION, " " * len(WHITESPACE))
    tokens = F.split(spaced, " ")
    # The look-ahead rejects tokens that start with an ASCII letter without walking the class.
    number = f"^(?![\\x00-\\x2f\\x3a-\\x7f])[{digit_class()}]+$"

    def keep(token: Column) -> Column:
        kept = (token != "") & ~token.rlike(number)
        return kept & ~token.isin(*stop_words) if stop_words else kept

    return F.lower(F.array_join(F.filter(tokens, keep), " "))


def letters(text: str) -> str:
    """The characters of ``text`` as a set of 64 bits, in SQL; several characters share a bit.

    One edit changes at most two bits, and a text made of characters of another has no other bits.
    """
    return f"aggregate(split({text}, ''), 0L, (bits, c) -> bits | shiftleft(1L, ascii(c) % 64))"


def first_truthy(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def after_first(text: Column, mark: str) -> Column:
    """Text behind the first ``mark``; null where there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


_ENTITY = "&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def unescape_entities(text: Column) -> Column:
    """Decode numeric and named character references.

    Numbers that name no character (0, surrogates, above U+10FFFF) give U+FFFD.
    """
    named = F.create_map(
        *[F.lit(v) for name, code in sorted(name2codepoint.items()) for v in (name, chr(code))],
        F.lit("apos"), F.lit("'"),
    )

    def decode(ref: Column) -> Column:
        is_hex = F.lower(F.substring(ref, 1, 2)) == "#x"
        digits = F.ltrim(
            F.when(is_hex, F.substring(ref, F.lit(3), F.length(ref)))
            .otherwise(F.substring(ref, F.lit(2), F.length(ref))),
            F.lit("0"),
        )
        # Seven digits hold every character in either base; longer numbers name none.
        code = F.when(F.length(digits).between(1, 7), F.conv(
            F.concat(F.lit("0"), digits), 16, 10)).cast("bigint")
        code = F.when(is_hex, code).otherwise(
            F.when(F.length(digits).between(1, 7), digits.cast("bigint")))
        real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        hexadecimal = F.when(real, F.lpad(F.hex(code), 8, "0")).otherwise(F.lit("0000FFFD"))
        char = F.decode(F.unhex(hexadecimal), "UTF-32")
        return F.coalesce(
            F.when(F.startswith(ref, F.lit("#")), char).otherwise(F.try_element_at(named, ref)),
            F.concat(F.lit("&"), ref, F.lit(";")),
        )

    plain = F.split(text, _ENTITY)
    refs = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1))
    pieces = F.zip_with(
        plain, refs, lambda p, r: F.when(r.isNull(), p).otherwise(F.concat(p, decode(r)))
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def strip_tags(markup: Column) -> Column:
    """Text content of a markup fragment."""
    return unescape_entities(F.regexp_replace(markup, "(?s)<!--.*?-->|<[^>]*>", ""))
