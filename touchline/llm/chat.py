"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template. A mark, and the control strings, which are the mark and a letter.
# In texts and roles each mark becomes the escape, so they cannot hold a control string:
#   ⟦h role ⟦b text ⟦n next text of the same role ⟦e
MARK = "⟦"
ESCAPE, HEAD, BODY, NEXT, END = (MARK + c for c in ("q", "h", "b", "n", "e\n"))


#: Pieces whose offsets are added up in one go.
BLOCK = 128

_SPANS = """flatten(zip_with(blocks, starts, (b, start) -> aggregate(
    b,
    named_struct('at', start, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
    (a, p) -> named_struct(
        'at', a.at + octet_length(p.s),
        'spans', if(p.learn, array_append(a.spans, named_struct(
            'start', a.at, 'length', cast(octet_length(p.s) as bigint))), a.spans)),
    a -> a.spans)))"""


def _escaped(sql: str) -> str:
    return f"replace({sql}, '{MARK}', '{ESCAPE}')"


def _unescaped(sql: str) -> str:
    return f"replace({sql}, '{ESCAPE}', '{MARK}')"


def format_chats(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn",
    role_col: str = "role", text_col: str = "text", learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, ``formatted`` and ``loss_spans``.

    Turns are collected as structs and sorted by (turn, role, text), nulls first; equal rows
    stay, each a turn of its own. Adjacent turns of one role are merged under one head, their
    texts parted by ``NEXT``. Null texts and roles count as empty. Rows of null conversation
    id form one conversation of null id. ``loss_spans`` are (start, length) in UTF-8 bytes of
    ``formatted``, from 0: the escaped text of each turn of role ``learn``, without heads and
    separators. Other columns are left out; an empty table gives an empty result. The turns
    of one conversation meet in one task, as its one output row must; copies of it do not.
    """
    collected = turns.select(
        F.col(conv_col).alias("id"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    ).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # Places where the role changes, one more at the end; between two of them lies a run.
    cut = collected.select(
        "id", "ts",
        F.expr("""concat(
            filter(sequence(0, size(ts) - 1), i -> i = 0 or ts[i].role != ts[i - 1].role),
            array(size(ts)))""").alias("cuts"),
    )
    runs = cut.select(
        "id",
        F.expr(f"""transform(slice(cuts, 1, size(cuts) - 1), (s, k) -> named_struct(
            'role', ts[s].role,
            'texts', transform(slice(ts, s + 1, cuts[k + 1] - s), t -> {_escaped("t.text")})
        ))""").alias("runs"),
    )
    # Strings of the output in order, and whether the loss covers them.
    pieces = runs.select(
        "id",
        F.expr(f"""flatten(transform(runs, r -> concat(
            array(named_struct('s', concat('{HEAD}', {_escaped("r.role")}, '{BODY}'), 'learn', false)),
            flatten(transform(r.texts, (t, i) -> array(
                named_struct('s', if(i = 0, '', '{NEXT}'), 'learn', false),
                named_struct('s', t, 'learn', r.role = :learn)))),
            array(named_struct('s', '{END}', 'learn', false))
        )))""".replace(":learn", "'" + learn.replace("\\", "\\\\").replace("'", "\\'") + "'")).alias("pieces"),
    )
    # Running offsets go by blocks, so that no step copies more than a block's spans.
    blocks = pieces.select(
        "id", "pieces",
        F.expr(f"""transform(sequence(0, (size(pieces) - 1) div {BLOCK}), b -> slice(pieces, b * {BLOCK} + 1, {BLOCK}))""")
        .alias("blocks"),
    )
    placed = blocks.select(
        "*",
        F.expr("""aggregate(
            transform(blocks, b -> aggregate(b, 0L, (n, p) -> n + octet_length(p.s))),
            named_struct('at', 0L, 'starts', cast(array() as array<bigint>)),
            (a, n) -> named_struct('at', a.at + n, 'starts', array_append(a.starts, a.at)),
            a -> a.starts)""").alias("starts"),
    )
    return placed.select(
        F.col("id").alias(conv_col),
        F.expr("array_join(pieces.s, '')").alias("formatted"),
        F.expr(_SPANS).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """What ``format_chats`` wrote, read back: id, ``turns`` (role, text), ``loss_texts``, ``formatted_chars``.

    Turns come from the control strings alone, loss texts from the spans alone; both are
    unescaped. Null ids pass through; an empty table gives an empty result.
    """
    blocks = formatted.select(
        F.col(conv_col),
        F.expr(f"filter(split(formatted, '\\\\Q{END}\\\\E'), b -> b != '')").alias("blocks"),
        # The array of one element has the text encoded once, not once a span.
        F.expr(f"""flatten(transform(array(encode(formatted, 'UTF-8')), bytes -> transform(loss_spans, s -> {_unescaped(
            "decode(substring(bytes, cast(s.start + 1 as int), cast(s.length as int)), 'UTF-8')"
        )})))""").alias("loss_texts"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return blocks.select(
        conv_col,
        F.expr(f"""flatten(transform(blocks, b -> transform(
            split(substring_index(b, '{BODY}', -1), '{NEXT}'),
            t -> named_struct(
                'role', {_unescaped(f"substring(substring_index(b, '{BODY}', 1), {len(HEAD) + 1})")},
                'text', {_unescaped("t")}))))""").alias("turns"),
        "loss_texts", "formatted_chars",
    )


def digests(formatted: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation the counts and SHA-256 digests of what ``read_chats`` finds."""
    return read_chats(formatted, conv_col=conv_col).select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.expr(
            "sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256)"
        ).alias("turns_sha256"),
        F.length(F.array_join("loss_texts", "")).cast("bigint").alias("loss_chars"),
        F.sha2(F.array_join("loss_texts", ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )
