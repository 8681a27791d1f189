"""Keys that turn "within k edits" into an equality, as SQL expressions.

Up to two edits have keys that prove a hit by themselves; more go by segments alone.
"""

from __future__ import annotations

MAX_EDITS = 2


def edit_spots(text: str, k: int = MAX_EDITS) -> str:
    """Array of the places (i, j) of up to ``k`` touched characters; 0 stands for none."""
    positions = f"sequence(0, length({text}))"
    if k == 0:
        return "array(named_struct('i', 0, 'j', 0))"
    if k == 1:
        return f"transform({positions}, j -> named_struct('i', 0, 'j', j))"
    return f"""flatten(transform({positions}, i -> transform(
        filter({positions}, j -> j > i or i = 0), j -> named_struct('i', i, 'j', j))))"""


def untouched(text: str) -> str:
    """``text`` without the characters at the columns i < j."""
    return f"""concat(substring({text}, 1, i - 1), substring({text}, i + 1, j - i - 1),
                      substring({text}, j + 1))"""


def edit_keys() -> str:
    """Array of (key, masked, deleted) for the columns i, j and rest of one spot.

    A key is the text without the touched characters, led by the positions of the masked
    ones. Two texts are within ``k`` edits exactly when they share a key and the masked
    count plus both deletion counts is at most ``k``: a mask at the same place on both
    sides is a substitution, a deletion on one side is an insertion on the other.
    """

    def key(masks: str, masked: int, deleted: int) -> str:
        return f"""named_struct('key', concat({masks}, ':', rest),
                                'masked', {masked}, 'deleted', {deleted})"""

    return f"""case
        when j = 0 then array({key("''", 0, 0)})
        when i = 0 then array({key("''", 0, 1)}, {key("j", 1, 0)})
        else array({key("''", 0, 2)}, {key("j - 1", 1, 1)},
                   {key("i", 1, 1)}, {key("i, ',', j", 2, 0)}) end"""


def _which(k: int, part: int | None) -> str:
    return f"sequence(0, {k})" if part is None else f"array({part})"


def part_index_keys(text: str, k: int, part: int | None = None) -> str:
    """Keys of the ``k`` + 1 near-equal segments of a dictionary text, one of which survives; or of one."""
    start, width = _part(k + 1)
    segment = f"substring({text}, int({start} + 1), int({width}))"
    return f"""flatten(transform(array(length({text})), n -> transform(
        {_which(k, part)}, part -> {_segment_key(segment)})))"""


def part_probe_keys(text: str, k: int, part: int | None = None) -> str:
    """Keys under which texts within ``k`` edits of ``text`` may be indexed; or those of one segment.

    Of the segments that survive, one lies so that at most as many edits are left of it as
    there are segments left of it, and likewise right of it; so a segment is looked up only
    as far from its place as that allows.
    """
    start, width = _part(k + 1)
    gap = f"(length({text}) - n)"
    low = f"greatest(-part, {gap} - ({k} - part), -({start}))"
    high = f"least(part, {gap} + ({k} - part))"
    shifts = f"if({low} <= {high}, sequence(int({low}), int({high})), cast(array() as array<int>))"
    segment = f"substring({text}, int({start} + shift + 1), int({width}))"
    return f"""array_distinct(flatten(flatten(transform(
        filter(sequence(length({text}) - {k}, length({text}) + {k}), n -> n >= 0),
        n -> transform({_which(k, part)}, part -> transform(
            {shifts}, shift -> {_segment_key(segment)}))))))"""


def _part(parts: int) -> tuple[str, str]:
    """Start from 0 and width of a segment of a text with ``n`` characters."""
    start = f"(n div {parts}) * part"
    return start, f"if(part < {parts - 1}, n div {parts}, n - (n div {parts}) * part)"


# Start and width of one of three near-equal segments of a text with ``n`` characters.
_PARTS = MAX_EDITS + 1
_START = f"(n div {_PARTS}) * part + 1"
_WIDTH = f"if(part < {_PARTS - 1}, n div {_PARTS}, n - (n div {_PARTS}) * part)"


def _segment_key(segment: str) -> str:
    # Hashed to keep rows small; every hit is verified afterwards.
    return f"concat_ws(',', n, part, xxhash64({segment}))"


def segment_index_keys(text: str, part: int | None = None) -> str:
    """Keys of the segments of a dictionary text, one of which survives two edits; or of one."""
    segment = f"substring({text}, int({_START}), int({_WIDTH}))"
    return f"""flatten(transform(array(length({text})), n -> transform(
        {_which(_PARTS - 1, part)}, part -> {_segment_key(segment)})))"""
