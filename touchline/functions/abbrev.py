"""Abbreviation rule between normalised names, as SQL expressions over named columns.

A short form is read left to right. It starts on the first character of the long form,
and every further character must be found later in the current word, at the space that
ends the word, or at the start of the next word. Whole trailing words may be left over;
a word between two hits may not.
"""

from __future__ import annotations

KEY_LENGTH = 3

_Q = r"\\Q$1\\E"


def abbrev_pattern(short: str) -> str:
    """Regex that finds ``short`` as an abbreviation at the start of a longer text.

    Possessive gaps stop at the next hit inside a word, so the only choice left to the
    regex engine is when to move on to the next word.
    """
    onward = f"(?:[^ {_Q}]*+{_Q}|[^ ]*+ {_Q})"
    return rf"""if({short} = '', '', concat(
        r'^\Q', substring({short}, 1, 1), r'\E',
        regexp_replace(substring({short}, 2), '(?s)(.)', r'{onward}')))"""


def abbreviates(short: str, long: str) -> str:
    """The same rule as a walk over the set of reachable positions.

    Takes polynomial time on any input; used where names are too long for the regex.
    """
    reached = walk("array(1)", f"substring({short}, 2)", long)
    return f"""({short} = '' or (
        {long} <> '' and substring({short}, 1, 1) = substring({long}, 1, 1)
        and size({reached}) > 0))"""


def walk(start: str, chars: str, long: str) -> str:
    """Positions of ``long`` at which reading on with ``chars`` can end, from those of ``start``."""
    hit, space = f"position(c, {long}, p + 1)", f"position(' ', {long}, p + 1)"
    hops = f"""array(
        if({hit} > 0 and ({space} = 0 or {hit} <= {space}), {hit}, 0),
        if({space} > 0 and substring({long}, {space} + 1, 1) = c, {space} + 1, 0))"""
    return f"""aggregate(
        filter(split({chars}, ''), c -> c <> ''),
        {start},
        (at, c) -> filter(
            array_distinct(flatten(transform(at, p -> {hops}))), p -> p > 0))"""


def abbrev_heads(long: str) -> str:
    """Every abbreviation of ``long`` with one to ``KEY_LENGTH`` characters, as an array.

    Inside a word the earliest hit of a character reaches whatever a later hit does, so
    one step per distinct character is enough.
    """
    word = "substring_index(s.rest, ' ', 1)"
    beyond = f"length({word}) + 2"
    step = f"""concat(
        transform(
            array_distinct(filter(split({word}, ''), c -> c <> '')),
            c -> named_struct('head', concat(s.head, c),
                              'rest', substring(s.rest, position(c, s.rest) + 1))),
        filter(
            array(
                named_struct('head', concat(s.head, ' '), 'rest', substring(s.rest, {beyond})),
                named_struct('head', concat(s.head, substring(s.rest, {beyond}, 1)),
                             'rest', substring(s.rest, {beyond} + 1))),
            z -> contains(s.rest, ' ')))"""
    levels = [
        f"""array(named_struct('head', substring({long}, 1, 1), 'rest', substring({long}, 2)))"""
    ]
    for _ in range(KEY_LENGTH - 1):
        levels.append(f"flatten(transform({levels[-1]}, s -> {step}))")
    heads = ", ".join(f"transform({level}, s -> s.head)" for level in levels)
    return f"filter(array_distinct(concat({heads})), h -> h <> '')"
