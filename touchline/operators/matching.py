"""Resolution of free-text names to the entities of a league's dictionary.

The rule is an ordered cascade: the first strategy with any hit decides, and within it
the first entity in dictionary order, then its first alias. So each strategy needs only
the first hit of a text, never all of them, and a hit is one number: rank of the
strategy, entity position and alias position packed into a BIGINT whose minimum wins.

Texts are made distinct first. Each league then takes one of two exact ways, chosen by
its dictionary size:

* Up to ``direct_limit`` aliases: every text of the league is compared with each of
  them. The bound is checked, so the work per text is constant. Sets of letters, words and own
  keys, 64 bits each, rule most pairs out in the join. The rest feed a ``min`` and are never written out.
* More: texts and aliases meet on keys in one inverted index. Keys whose agreement alone
  proves a hit keep only their first alias, so a key shared by many names still joins to
  one row.

  =============  =====================================  ==========================
  strategy       key                                    check after the join
  =============  =====================================  ==========================
  exact          the text                               none
  edit           text with up to two characters gone    sum of the costs
  edit, longer   hash of a third of the text            edit distance
  edit, k > 2    hash of one of k + 1 parts             edit distance
  own            keys of the strategy                   condition of the strategy
  abbrev         first characters of an abbreviation,   abbreviation rule
                 more where many names share them
  token          token that makes up half of a name     counts
  token, second  that token and one more                token rule
  token < 0.5    frequent token, or it and one more     counts
  the same       tokens but for the two most common     token rule
  =============  =====================================  ==========================
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from touchline.functions import abbrev, edits, tokens
from touchline.functions.text import letters, normalized
from touchline.operators.abbrev_keys import KEY_NAMES, adapted
from touchline.operators.token_keys import PROVEN, rarest
from touchline.session import shuffled, spread, staged, staging

EXACT, EDIT, ABBREV, ABBREV_REVERSE, TOKEN = "exact", "edit", "abbrev", "abbrev_reverse", "token"
OWN = "own"


class Strategy(NamedTuple):
    """One step of the cascade; ``limit`` is the edit count or the token threshold.

    A strategy of the kind ``OWN`` is given by SQL: ``keys`` is an array of keys of a text,
    which it names ``{t}``, and ``holds`` a condition on ``x``, the text, and ``y``, the alias.
    It hits where the two have a key in common and the condition is true.
    """

    name: str
    kind: str
    limit: float | None = None
    keys: str | None = None
    holds: str = "true"


DEFAULT_STRATEGIES = (
    Strategy("exact", EXACT),
    Strategy("edit", EDIT, 2),
    Strategy("abbrev0", ABBREV),
    Strategy("abbrev1", ABBREV_REVERSE),
    Strategy("token", TOKEN, 0.5),
)

DIRECT_LIMIT = 256  # aliases of one league compared one by one
BROADCAST_ROWS = 200_000  # dictionary or index rows sent to every executor
BROADCAST_BYTES = 32 << 20  # names and entities of a dictionary from which rows are sent
ROUND_TEXTS = 200_000  # texts whose keys for all strategies meet a large dictionary at once
LEAGUE_TEXTS = 50_000  # texts of one league that meet its dictionary in one task

# Up to here a name has at most about 500 two-edit keys, each of which proves a hit. Longer
# names have 3 segment keys (75 to look up), whose meetings are verified; on names of 20 to
# 30 characters that is less than half the time.
_LONGEST_KEYED = 14
# Up to here the abbreviation regex has few ways to move between words.
_REGEX_LENGTH, _REGEX_WORDS = 40, 6

# Alias lengths below the key length, looked up whole.
_SHORT_LENGTHS = range(abbrev.KEY_LENGTH)

_ALIAS_BITS, _RANK_BITS = 20, 52


def resolve_entities(
    texts: DataFrame,
    aliases: DataFrame,
    strategies: Sequence[Strategy] = DEFAULT_STRATEGIES,
    strict: bool = False,
    within: list[str] | None = None,
    **options,
) -> DataFrame:
    """(league, text, entity, strategy) for each distinct text; null where nothing hits.

    With ``strict`` a text or alias that normalises to nothing matches nothing. By
    default an empty text abbreviates, and so matches, the first entity of its league.
    The distinct texts are staged, as they are matched and then joined with their hits, and so
    are these, so that the files of the matching are gone by then.
    """
    distinct = texts.select("league", "text").distinct()
    names = staged(distinct.withColumn("x", normalized(F.col("text"))), "names", within)
    best = staged(match_normalized(
        names.select("league", "x").distinct(), aliases, strategies, strict, within=within, **options
    ), "hits", within)
    return names.join(shuffled(best), ["league", "x"], "left").select("league", "text", "entity", "strategy")


def exact_join(texts: DataFrame, aliases: DataFrame, **options) -> DataFrame:
    """First entity with an alias equal to the text after normalisation."""
    return resolve_entities(texts, aliases, [Strategy("exact", EXACT)], **options)


def edit_join(texts: DataFrame, aliases: DataFrame, k: int = 2, **options) -> DataFrame:
    """First entity with an alias within ``k`` edits; the first, not the nearest."""
    return resolve_entities(texts, aliases, [Strategy("edit", EDIT, k)], **options)


def abbrev_join(
    texts: DataFrame, aliases: DataFrame, reverse: bool = False, **options
) -> DataFrame:
    """First entity with an alias that the text abbreviates, or that abbreviates the text."""
    step = Strategy("abbrev1", ABBREV_REVERSE) if reverse else Strategy("abbrev0", ABBREV)
    return resolve_entities(texts, aliases, [step], **options)


def token_join(
    texts: DataFrame, aliases: DataFrame, threshold: float = 0.5, **options
) -> DataFrame:
    """First entity with an alias whose tokens agree with those of the text."""
    return resolve_entities(texts, aliases, [Strategy("token", TOKEN, threshold)], **options)


def match_normalized(
    names: DataFrame,
    aliases: DataFrame,
    strategies: Sequence[Strategy] = DEFAULT_STRATEGIES,
    strict: bool = False,
    direct_limit: int = DIRECT_LIMIT,
    broadcast_rows: int = BROADCAST_ROWS,
    key_names: int = KEY_NAMES,
    within: list[str] | None = None,
) -> DataFrame:
    """(league, x, entity, strategy) for the distinct (league, x) that resolve.

    An abbreviation key that more than ``key_names`` names of a league share is replaced by
    longer ones. What is staged, the dictionary at least, is added to ``within``.
    """
    for step in strategies:
        if step.kind == EDIT and (step.limit < 0 or step.limit != int(step.limit)):
            raise ValueError("edit strategies take a whole number from 0 as limit")
        if step.kind == OWN and not (step.keys and step.name.isidentifier()):
            raise ValueError("own strategies take keys and a name that is an identifier")
        if step.kind == TOKEN and not 0 < step.limit <= 1:
            raise ValueError("token strategies take a threshold above 0, up to 1")

    coded = aliases.filter(F.col("alias_norm").isNotNull()).select(
        "league",
        F.col("alias_norm").alias("y"),
        F.expr(f"""(bigint(entity_pos) << {_ALIAS_BITS}) + if(alias_pos < {1 << _ALIAS_BITS}, alias_pos,
            raise_error(concat('too many aliases: ', entity)))""").alias("place"),
        "entity",
    )
    if strict:
        coded, names = coded.filter("y != ''"), names.filter("x != ''")
    first = coded.groupBy("league", "y").agg(F.min(F.struct("place", "entity")).alias("p"))
    entities = staged(first.select("league", "y", "p.place", "p.entity"), "dictionary", within)
    profile = _profile(entities, direct_limit)
    dictionary = entities.drop("entity")
    if profile.bytes > BROADCAST_BYTES:
        broadcast_rows = -1

    found = []
    if profile.direct_rows:
        small = dictionary
        if profile.index_rows:
            small = _of_size(dictionary, f"size <= {direct_limit}")
        found.append(_match_direct(names, small, strategies, profile, broadcast_rows, within))
    if profile.index_rows:
        large = dictionary
        if profile.direct_rows:
            large = _of_size(dictionary, f"size > {direct_limit}")
        found.append(_match_indexed(names, large, strategies, profile, broadcast_rows, key_names, within))
    if not found:
        return names.select(
            "league", "x", F.lit(None).cast("string").alias("entity"),
            F.lit(None).cast("string").alias("strategy"),
        ).filter(F.lit(False))

    hits = reduce(DataFrame.unionByName, found).filter(F.col("hit").isNotNull())
    entities = entities.drop("y")
    entities = F.broadcast(entities) if profile.entities <= broadcast_rows else shuffled(entities)
    strategy_names = F.array(*[F.lit(s.name) for s in strategies])
    return (
        hits.select(
            "league",
            "x",
            F.get(strategy_names, F.expr(f"int(hit >> {_RANK_BITS})")).alias("strategy"),
            F.expr(f"hit & {(1 << _RANK_BITS) - 1}L").alias("place"),
        )
        .join(entities, ["league", "place"])
        .select("league", "x", "entity", "strategy")
    )


def _of_size(dictionary: DataFrame, condition: str) -> DataFrame:
    sizes = dictionary.groupBy("league").agg(F.count("*").alias("size"))
    return dictionary.join(shuffled(sizes.filter(condition)), "league", "left_semi")


def _profile(dictionary: DataFrame, direct_limit: int) -> Row:
    """One row of facts about the dictionary, read before the plan is chosen."""
    words = tokens.token_count("y")
    keyed = f"bigint(least(length(y), {_LONGEST_KEYED}))"
    per_league = dictionary.groupBy("league").agg(
        F.expr("count(*) as n"),
        F.expr("sum(octet_length(y) + octet_length(entity)) as bytes"),
        F.expr(f"sum(2 * {keyed} * {keyed} + 8 * {keyed} + 16) as keys"),
        F.expr("max(length(y)) as longest"),
        F.expr(f"max({words}) as wordiest"),
        F.expr(f"max(int({words} > greatest(2, size(array_distinct(split(y, ' ')))))) as repeats"),
        *[F.expr(f"max(int(length(y) = {n})) as length_{n}") for n in _SHORT_LENGTHS],
    )
    return per_league.agg(
        F.expr("coalesce(sum(n), 0) as entities"),
        F.expr("coalesce(sum(bytes), 0) as bytes"),
        F.expr("coalesce(max(n), 0) as largest"),
        F.expr(f"coalesce(sum(n) filter (where n <= {direct_limit}), 0) as direct_rows"),
        F.expr(f"coalesce(sum(keys) filter (where n > {direct_limit}), 0) as index_rows"),
        *[
            F.expr(f"coalesce(max({fact}), 0) as {fact}")
            for fact in ("longest", "wordiest", "repeats")
        ],
        *[F.expr(f"max(length_{n}) as length_{n}") for n in _SHORT_LENGTHS],
    ).first()


def _abbreviation_test(short: str, long: str) -> str:
    """The rule as a regex on the columns x_pattern or y_pattern, or as a walk.

    The regex is faster, but its ways multiply with the words of the long side, so each row
    takes the walk where that side is long or has many words, be it from the dictionary or
    a page. A short form longer than the bound has no pattern.
    """
    words = f"length({long}) - length(replace({long}, ' ', '')) < {_REGEX_WORDS}"
    return f"""if(length({long}) <= {_REGEX_LENGTH} and length({short}) <= {_REGEX_LENGTH} and {words},
        rlike({long}, {short}_pattern), {abbrev.abbreviates(short, long)})"""


def _first_hit(conditions: Sequence[tuple[int, str]]) -> str:
    """Smallest packed hit of a group; a pair without a hit gives null, which min ignores.

    Filtering such pairs would make Spark evaluate the cascade twice, in the join and
    after it.
    """
    cases = " ".join(
        f"when {condition} then {rank << _RANK_BITS}L" for rank, condition in conditions
    )
    return f"min(case {cases} end + place) as hit"


# --- leagues with few aliases ---------------------------------------------------------


def _match_direct(
    names: DataFrame,
    dictionary: DataFrame,
    strategies: Sequence[Strategy],
    profile: Row,
    broadcast_rows: int,
    within: list[str] | None,
) -> DataFrame:
    right, on = _comparable(dictionary, "y", strategies), ["league"]
    if profile.direct_rows <= broadcast_rows:
        left, right = spread(_comparable(names, "x", strategies), "x", "league"), F.broadcast(right)
    else:
        on = ["league", "salt"]
        left, right = _salted(staged(names, "sides", within), right)
        left = _comparable(left, "x", strategies)
    hit = _first_hit([(rank, _holds(step, profile)) for rank, step in enumerate(strategies)])
    # Most pairs go before the cascade and the hash table of the minimum see them.
    near = " or ".join(f"({_may_hold(step)})" for step in strategies)
    return left.join(right, on).filter(near).groupBy(*on, "x").agg(F.expr(hit)).drop("salt")


def _salted(names: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: a league of many texts is cut into parts, any other is one part.

    Leagues that are cut have over ``LEAGUE_TEXTS`` texts each, so they are few.
    """
    parts = names.groupBy("league").agg(F.expr(f"int(ceil(count(*) / {LEAGUE_TEXTS}))").alias("parts"))
    cut = F.broadcast(parts.filter("parts > 1"))
    left = names.join(cut, "league", "left").selectExpr(
        "league", "x", "int(pmod(xxhash64(x), coalesce(parts, 1))) as salt"
    )
    right = dictionary.join(cut, "league", "left").selectExpr(
        "*", "explode(sequence(0, coalesce(parts, 1) - 1)) as salt"
    )
    return left, shuffled(right.drop("parts"))


def _comparable(df: DataFrame, side: str, strategies: Sequence[Strategy]) -> DataFrame:
    own = {_own(step): step.keys.format(t=side) for step in strategies if step.kind == OWN}
    return df.selectExpr(
        "*",
        *tokens.token_columns(side, side),
        f"length({side}) as {side}_length",
        f"substring({side}, 1, 1) as {side}_first",
        f"{letters(side)} as {side}_letters",
        f"{tokens.token_set(side)} as {side}_words",
        f"if(length({side}) <= {_REGEX_LENGTH}, {abbrev.abbrev_pattern(side)}, null)"
        f" as {side}_pattern",
        *[f"{keys} as {side}_{name}" for name, keys in own.items()],
    ).selectExpr("*", *[f"{_key_set(f'{side}_{name}')} as {side}_{name}_set" for name in own])


def _own(step: Strategy) -> str:
    """Name of the columns with the keys of a strategy of the caller; its own name may occur twice."""
    return f"own_{zlib.crc32(step.keys.encode())}"


def _key_set(keys: str) -> str:
    """The keys as a set of 64 bits; arrays with a key in common have a bit in common."""
    bits = "(bits, k) -> bits | shiftleft(1L, int(pmod(xxhash64(k), 64)))"
    return f"aggregate({keys}, 0L, {bits})"


def _may_hold(step: Strategy) -> str:
    """A cheap condition that holds wherever ``_holds`` does."""
    if step.kind == EXACT:
        return "x_letters = y_letters"
    if step.kind == EDIT:
        k = int(step.limit)
        return f"abs(x_length - y_length) <= {k} and bit_count(x_letters ^ y_letters) <= {2 * k}"
    if step.kind == TOKEN:
        return "x_words & y_words <> 0"
    if step.kind == OWN:
        return f"x_{_own(step)}_set & y_{_own(step)}_set <> 0"
    short, long = ("x", "y") if step.kind == ABBREV else ("y", "x")
    return f"""{short}_length = 0 or (x_first = y_first and {short}_length <= {long}_length
        and {short}_letters & ~{long}_letters = 0)"""


def _holds(step: Strategy, profile: Row) -> str:
    if step.kind == EXACT:
        return "x = y"
    near = _may_hold(step)
    if step.kind == EDIT:
        return f"({near} and levenshtein(x, y, {int(step.limit)}) >= 0)"
    if step.kind == TOKEN:
        return f"({near} and {tokens.tokens_agree(step.limit, bool(profile.repeats))})"
    if step.kind == OWN:
        return f"({near} and arrays_overlap(x_{_own(step)}, y_{_own(step)}) and ({step.holds}))"
    short, long = ("x", "y") if step.kind == ABBREV else ("y", "x")
    return f"(({near}) and ({short}_length = 0 or {_abbreviation_test(short, long)}))"


# --- leagues with many aliases --------------------------------------------------------


def _entry(
    kind: str, base: str, weight: str = "0", total: str = "0", value: str = "null",
    spot: str = "0, 0",
) -> str:
    i, j = spot.split(", ")
    return f"""named_struct('kind', '{kind}', 'base', {base}, 'weight', bigint({weight}),
                            'total', int({total}), 'value', string({value}), 'i', {i}, 'j', {j})"""


def _entries_when(condition: str, entries: str) -> str:
    none = "struct<kind:string,base:string,weight:bigint,total:int,value:string,i:int,j:int>"
    return f"if({condition}, {entries}, cast(array() as array<{none}>))"


def _keyed(df: DataFrame, text: str, entries: str, *keep: str) -> DataFrame:
    """One row (kind, key, weight, total, value) per entry of a text.

    The weight of an entry whose pairs are verified character by character is the set of letters
    of its text, which rules most pairs out first; it is made once per text.

    The many edit keys are spelled out from their spots in generated code, which the
    lambdas that make the entries are not.
    """
    spelled = f"""case when kind = 'edit' then {edits.edit_keys()}
        else array(named_struct('key', base, 'masked', total, 'deleted', weight)) end"""
    return (
        df.selectExpr("*", f"{letters(text)} as {text}_letters")
        .selectExpr(*keep, f"inline({entries})")
        .selectExpr("*", f"if(kind = 'edit', {edits.untouched(text)}, null) as rest")
        .selectExpr(*keep, "kind", "value", f"inline({spelled}) as (key, total, weight)")
    )


def _token_entries(text: str, value: str, threshold: float) -> str:
    if threshold < 0.5:
        return _low_token_entries(text, value, threshold)
    count = tokens.token_count(text)
    single = _entry("token", "t", tokens.occurrences("t", text), count)
    double = _entry("tokens", "p", value=value)
    pairs = f"transform({tokens.dominant_pairs(text)}, p -> {double})"
    return f"""concat(transform({tokens.dominant_tokens(text)}, t -> {single}),
                      {_entries_when(f"{count} > 1", pairs)})"""


def _low_token_entries(text: str, value: str, threshold: float) -> str:
    count = tokens.token_count(text)
    frequent = tokens.frequent_tokens(text, threshold)
    single = _entry("share", "t", tokens.occurrences("t", text), count)
    double = _entry("pair", "p.key", "p.weight", count)
    rare = _entry("rare", "t", value=value)
    words = f"array_distinct(split({text}, ' '))"
    return f"""concat(
        transform({frequent}, t -> {single}),
        transform({tokens.frequent_pairs(text, threshold)}, p -> {double}),
        {_entries_when(
            f"{count} > {PROVEN} and size({words}) > {PROVEN} and size({frequent}) > 0",
            f"transform({words}, t -> {rare})",
        )})"""


def _edit_entries(text: str, k: int, segments: str, value: str, segment: int | None) -> str:
    """Both ways overlap by ``MAX_EDITS`` lengths, so that no pair falls between them.

    The keys of short texts go with the first segment.
    """
    near = _entry("edit", "string(null)", spot="e.i, e.j")
    part = _entry("segment", "s", f"{text}_letters", value=value)
    keyed = f"transform({edits.edit_spots(text, k)}, e -> {near})"
    split = f"transform({segments}, s -> {part})"
    if segment:
        return _entries_when(f"length({text}) > {_LONGEST_KEYED - edits.MAX_EDITS}", split)
    return f"""concat(
        {_entries_when(f"length({text}) <= {_LONGEST_KEYED}", keyed)},
        {_entries_when(f"length({text}) > {_LONGEST_KEYED - edits.MAX_EDITS}", split)})"""


def _own_entries(step: Strategy, text: str, value: str) -> str:
    entry = _entry(f"own {step.name}", "string(k)", value=value)
    return f"transform({step.keys.format(t=text)}, k -> {entry})"


def _part_entries(text: str, keys: str, value: str) -> str:
    return f"transform({keys}, s -> {_entry('segment', 's', f'{text}_letters', value=value)})"


def _index_entries(step: Strategy, part: int | None) -> str:
    if step.kind == EXACT:
        return f"array({_entry('exact', 'y')})"
    if step.kind == OWN:
        return _own_entries(step, "y", "y")
    if step.kind == EDIT and step.limit > edits.MAX_EDITS:
        return _part_entries("y", edits.part_index_keys("y", int(step.limit), part), "y")
    if step.kind == EDIT:
        return _edit_entries("y", int(step.limit), edits.segment_index_keys("y", part), "y", part)
    if step.kind == TOKEN:
        return _token_entries("y", "y", step.limit)
    if step.kind == ABBREV:
        heads = abbrev.abbrev_heads("y")
        full = f"filter({heads}, h -> length(h) = {abbrev.KEY_LENGTH})"
        verified = f"transform({full}, h -> {_entry('head', 'h', 'y_letters', value='y')})"
        return f"""concat(
            array({_entry("short", "''")}),
            transform({heads}, h -> {_entry("short", "h")}),
            {_entries_when(f"length(y) > {abbrev.KEY_LENGTH}", verified)})"""
    is_long = f"length(y) > {abbrev.KEY_LENGTH}"
    return f"""array({_entry(
        "reverse",
        f"if({is_long}, substring(y, 1, {abbrev.KEY_LENGTH}), y)",
        f"if({is_long}, y_letters, 0)",
        value=f"if({is_long}, y, null)",
    )})"""


def _probe_entries(step: Strategy, profile: Row, part: int | None) -> str:
    if step.kind == EXACT:
        return f"array({_entry('exact', 'x')})"
    if step.kind == OWN:
        return _own_entries(step, "x", "null")
    if step.kind == EDIT and step.limit > edits.MAX_EDITS:
        k = int(step.limit)
        parts = _part_entries("x", edits.part_probe_keys("x", k, part), "null")
        return _entries_when(f"length(x) <= {profile.longest + k}", parts)
    if step.kind == EDIT:
        return _entries_when(
            f"length(x) <= {profile.longest + edits.MAX_EDITS}",
            _edit_entries("x", int(step.limit), edits.part_probe_keys("x", edits.MAX_EDITS, part), "null", part),
        )
    if step.kind == TOKEN:
        return _token_entries("x", "null", step.limit)
    if step.kind == ABBREV:
        head = _entry("head", f"substring(x, 1, {abbrev.KEY_LENGTH})", "x_letters")
        longer = _entries_when(f"length(x) <= {profile.longest}", f"array({head})")
        return f"if(length(x) <= {abbrev.KEY_LENGTH}, array({_entry('short', 'x')}), {longer})"
    # Emit only key lengths that the dictionary has; one-letter keys would be hot.
    present = [n for n in _SHORT_LENGTHS if profile[f"length_{n}"]]
    wanted = ", ".join(map(str, [*present, abbrev.KEY_LENGTH]))
    heads = f"filter({abbrev.abbrev_heads('x')}, h -> length(h) in ({wanted}))"
    entries = f"transform({heads}, h -> {_entry('reverse', 'h', 'x_letters')})"
    if 0 in present:
        entries = f"""concat(array({_entry("reverse", "''")}), {entries})"""
    return entries


def _confirmed(step: Strategy, profile: Row) -> str:
    """Whether a pair that met on a key of ``step`` is a hit."""
    if step.kind == EXACT:
        return "kind = 'exact'"
    if step.kind == OWN:
        return f"(kind = 'own {step.name}' and ({step.holds}))"
    if step.kind == EDIT:
        k = int(step.limit)
        return f"""((kind = 'edit' and x_weight + y_weight + x_total <= {k})
                    or (kind = 'segment' and bit_count(x_weight ^ y_weight) <= {2 * k}
                        and levenshtein(x, y, {k}) >= 0))"""
    if step.kind == TOKEN and step.limit < 0.5:
        return f"""({tokens.proven(step.limit)}
                    or (kind = 'rare' and {tokens.tokens_agree(step.limit, True)}))"""
    if step.kind == TOKEN:
        return f"""((kind = 'token'
                     and x_weight * y_weight >= {step.limit}D * x_total * y_total)
                    or (kind = 'tokens'
                        and {tokens.tokens_agree(step.limit, bool(profile.repeats))}))"""
    if step.kind == ABBREV:
        return f"""(kind = 'short' or (kind = 'head' and x_weight & ~y_weight = 0
            and {_abbreviation_test('x', 'y')}))"""
    return f"""(kind = 'reverse' and (y is null or (y_weight & ~x_weight = 0
        and {_abbreviation_test('y', 'x')})))"""


def _pattern_for(kind: str, text: str) -> str:
    needed = f"kind = '{kind}' and length({text}) <= {_REGEX_LENGTH}"
    return f"if({needed}, {abbrev.abbrev_pattern(text)}, null) as {text}_pattern"


def _match_indexed(
    names: DataFrame,
    dictionary: DataFrame,
    strategies: Sequence[Strategy],
    profile: Row,
    broadcast_rows: int,
    key_names: int,
    within: list[str] | None,
) -> DataFrame:
    """At once where the index is sent to the texts, or the texts are few; else in rounds.

    The keys of many texts for all strategies would fill the disks together. A round takes one
    strategy, or one segment of the texts for its edits, and leaves its hits; what a strategy
    hits needs no later one.
    """
    ranked = list(enumerate(strategies))
    if profile.index_rows <= broadcast_rows:
        return _meet(names, dictionary, ranked, None, profile, broadcast_rows, key_names, within)
    rest, found = staged(names, "sides", within), []
    if rest.count() <= ROUND_TEXTS:
        return _meet(rest, dictionary, ranked, None, profile, broadcast_rows, key_names, within)
    with staging(names.sparkSession) as rests:
        for rank, step in ranked:
            hits = []
            for part in _rounds(step):
                with staging(names.sparkSession) as passing:
                    met = _meet(rest, dictionary, [(rank, step)], part, profile, broadcast_rows, key_names, passing)
                    hits.append(staged(met.filter("hit is not null"), "round", within))
            found += hits
            if rank + 1 < len(strategies):
                hit = reduce(DataFrame.unionByName, hits).select("league", "x")
                rest = staged(rest.join(shuffled(hit), ["league", "x"], "left_anti"), "rest", rests)
    return reduce(DataFrame.unionByName, found).groupBy("league", "x").agg(F.min("hit").alias("hit"))


def _rounds(step: Strategy) -> list[int | None]:
    if step.kind != EDIT:
        return [None]
    return list(range(max(int(step.limit), edits.MAX_EDITS) + 1))


def _meet(
    names: DataFrame,
    dictionary: DataFrame,
    ranked: Sequence[tuple[int, Strategy]],
    part: int | None,
    profile: Row,
    broadcast_rows: int,
    key_names: int,
    within: list[str] | None,
) -> DataFrame:
    """The first hit of each text by these strategies, or by one segment of the texts."""
    strategies = [step for _, step in ranked]
    entries = ", ".join(_index_entries(step, part) for step in strategies)
    index = (
        # Not exchanged before the minimum, so a key of very many names is one row a task.
        _keyed(
            spread(dictionary, "y", "league"), "y", f"concat({entries})", "league", "y", "place"
        )
        .groupBy("league", "kind", "key", "weight", "total", "value")
        .agg(F.min("place").alias("place"))
    )
    probes = f"concat({', '.join(_probe_entries(step, profile, part) for step in strategies)})"
    if strategies[0].kind == EXACT and len(strategies) > 1:
        # Early exit: a text with an exact hit needs no other key.
        known = dictionary.selectExpr("league", "y as x", "true as known")
        known = F.broadcast(known) if profile.entities <= broadcast_rows else shuffled(known)
        names = names.join(known, ["league", "x"], "left")
        probes = f"if(known, {_probe_entries(strategies[0], profile, part)}, {probes})"
    probed = (
        _keyed(spread(names, "x", "league"), "x", probes, "league", "x")
        .select("league", "x", "kind", "key", "weight", "total")
    )
    ranks = any(s.kind == TOKEN and s.limit < 0.5 for s in strategies)
    if ranks:
        index, probed = rarest(index, probed, within)
    # A league with fewer names than that has no key with more.
    adapts = profile.largest > key_names and {s.kind for s in strategies} & {ABBREV, ABBREV_REVERSE}
    if adapts:
        index, probed = adapted(index, probed, key_names, within)
    index = index.selectExpr(
        "league", "kind", "key", "place",
        "weight as y_weight", "total as y_total", "value as y",
    ).selectExpr("*", _pattern_for("reverse", "y"), *tokens.token_columns("y", "y"))
    # The bound is on the usual keys; staged ones have a size that Spark sees.
    if profile.index_rows <= broadcast_rows and not adapts and not ranks:
        index = F.broadcast(index)
    else:
        index = shuffled(index)
    probed = probed.selectExpr(
        "league", "x", "kind", "key", "weight as x_weight", "total as x_total"
    ).selectExpr(
        "*",
        _pattern_for("head", "x"),
        *tokens.token_columns("x", "if(kind in ('tokens', 'rare'), x, null)"),
    )
    hit = _first_hit([(rank, _confirmed(step, profile)) for rank, step in ranked])
    return probed.join(index, ["league", "kind", "key"]).groupBy("league", "x").agg(F.expr(hit))
