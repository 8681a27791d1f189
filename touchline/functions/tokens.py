"""Token overlap between normalised names, as SQL expressions over named columns."""

from __future__ import annotations


def token_count(text: str) -> str:
    return f"if({text} = '', 0, length({text}) - length(replace({text}, ' ', '')) + 1)"


def token_set(text: str) -> str:
    """The tokens as a set of 64 bits. Texts that agree have a bit in common.

    A text with an empty token has all bits, as that token occurs between any two others.
    """
    bits = "(bits, t) -> bits | shiftleft(1L, int(pmod(xxhash64(t), 64)))"
    return f"if(contains(concat(' ', {text}, ' '), '  '), -1L, aggregate(split({text}, ' '), 0L, {bits}))"


def occurrences(token: str, text: str) -> str:
    """How many tokens of ``text`` equal ``token``; 0 for a null token."""
    padded = f"concat(' ', replace({text}, ' ', '  '), ' ')"
    removed = f"length({padded}) - length(replace({padded}, concat(' ', {token}, ' '), ''))"
    return f"coalesce(int(({removed}) div (length({token}) + 2)), 0)"


def token_columns(side: str, text: str) -> list[str]:
    """Token count and first two tokens, precomputed once per row before a join."""
    return [
        f"{token_count(text)} as {side}_n",
        f"substring_index({text}, ' ', 1) as {side}_t1",
        f"if(contains({text}, ' '), split_part({text}, ' ', 2), null) as {side}_t2",
    ]


def tokens_agree(threshold: float, long_repeats: bool) -> str:
    """Equal token pairs over the product of the token counts reach ``threshold``.

    Reads the columns x, y and those of ``token_columns``. If both sides have more than
    two tokens the rule can hold only where both repeat one, if the threshold is 0.5 or more;
    ``long_repeats`` says whether the dictionary has such names.
    """

    def same(a: str, b: str) -> str:
        return f"coalesce(int({a} = {b}), 0)"

    pairs = " + ".join(same(a, b) for a in ("x_t1", "x_t2") for b in ("y_t1", "y_t2"))
    rest = "0"
    if long_repeats or threshold < 0.5:
        rest = f"aggregate(split(x, ' '), 0, (total, t) -> total + {occurrences('t', 'y')})"
    equal = f"""case
        when x_n <= 2 and y_n <= 2 then {pairs}
        when y_n <= 2 then {occurrences('y_t1', 'x')} + {occurrences('y_t2', 'x')}
        when x_n <= 2 then {occurrences('x_t1', 'y')} + {occurrences('x_t2', 'y')}
        else {rest} end"""
    if threshold < 0.5:
        # As a quotient, since a product with 0.3 may be off by rounding.
        return f"(x_n > 0 and y_n > 0 and {equal} / nullif(bigint(x_n) * y_n, 0) >= {threshold}D)"
    return f"(x_n > 0 and y_n > 0 and {threshold}D * x_n * y_n <= {equal})"


def dominant_tokens(text: str) -> str:
    """The tokens, at most two, that make up half of ``text`` or more.

    In the sorted tokens such a token covers one of the middle places.
    """
    return f"""filter(
        flatten(transform(array(array_sort(split({text}, ' '))), o -> array_distinct(array(
            element_at(o, int((size(o) + 1) div 2)), element_at(o, int(size(o) div 2 + 1)))))),
        t -> {text} <> '' and {occurrences('t', text)} * 2 >= {token_count(text)})"""


def dominant_pairs(text: str) -> str:
    """Each dominant token together with each other token of ``text``."""
    return f"""flatten(transform({dominant_tokens(text)}, t -> transform(
        filter(array_distinct(split({text}, ' ')), u -> u <> t), u -> concat(t, ' ', u))))"""


# Below a threshold of 0.5. The overlap is the sum over the tokens of their shares in both
# texts, so it is at most the largest share of a shared token, on either side.

_HALF = 1 << 31


def frequent_tokens(text: str, threshold: float) -> str:
    """The tokens, at most 1 / ``threshold``, whose share of ``text`` reaches the threshold.

    Each text has one among the tokens that it shares with a text it agrees with.
    """
    return f"""filter(array_distinct(split({text}, ' ')),
        t -> {text} <> '' and {_is_frequent('t', text, threshold)})"""


def frequent_pairs(text: str, threshold: float) -> str:
    """Array of (key, weight) of the pairs of tokens, at least one of them frequent.

    The key has the smaller token first; the weight has the count of it above the lower 31 bits,
    which hold the count of the other. Two texts that agree and share two tokens share such a pair.
    """
    other = f"u <> t and (t < u or not {_is_frequent('u', text, threshold)})"
    weight = f"bigint({occurrences('p.a', text)}) * {_HALF}L + {occurrences('p.b', text)}"
    return f"""transform(
        flatten(transform({frequent_tokens(text, threshold)}, t -> transform(
            filter(array_distinct(split({text}, ' ')), u -> {other}),
            u -> named_struct('a', least(t, u), 'b', greatest(t, u))))),
        p -> named_struct('key', concat(p.a, ' ', p.b), 'weight', {weight}))"""


def proven(threshold: float) -> str:
    """Whether the one or two tokens of a key, with their counts, make up the overlap alone."""
    pair = f"""(x_weight div {_HALF}L) * (y_weight div {_HALF}L)
        + (x_weight % {_HALF}L) * (y_weight % {_HALF}L)"""
    return f"""(kind in ('share', 'pair') and if(kind = 'share', x_weight * y_weight, {pair})
        / nullif(bigint(x_total) * y_total, 0) >= {threshold}D)"""


def _is_frequent(token: str, text: str, threshold: float) -> str:
    return f"{occurrences(token, text)} / nullif({token_count(text)}, 0) >= {threshold}D"
