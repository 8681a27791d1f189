import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tests import brute
from touchline.functions.text import letters, normalized
from touchline.operators import matching
from touchline.operators.abbrev_keys import adapted
from touchline.operators.token_keys import rarest

# Dictionaries of two leagues.
ENG1 = [
    (name, [])
    for name in (
        "Arsenal", "Aston Villa", "Bournemouth", "Brentford", "Brighton", "Burnley", "Chelsea",
        "Crystal Palace", "Everton", "Fulham", "Leeds", "Liverpool", "Man City", "Man United",
        "Newcastle",
    )
] + [
    ("Nott'm Forest", ["Notts Forest"]),
    ("Sunderland", []),
    ("Tottenham", []),
    ("West Ham", []),
    ("Wolves", ["Wolverhampton Wanderers"]),
]
ENG2 = [
    (name, [])
    for name in (
        "Birmingham", "Blackburn", "Bristol City", "Charlton", "Coventry", "Derby", "Hull",
        "Ipswich", "Leicester", "Middlesbrough", "Millwall", "Norwich", "Preston", "QPR", "Oxford",
        "Sheffield Weds", "Southampton", "Stoke", "Swansea", "Watford", "West Brom", "Portsmouth",
        "Sheffield United", "Wrexham",
    )
]


def alias_frame(spark, leagues):
    rows = [
        (league, i, j, name, alias)
        for league, entities in leagues.items()
        for i, (name, others) in enumerate(entities)
        for j, alias in enumerate([name, *others])
    ]
    return spark.createDataFrame(
        rows, "league string, entity_pos int, alias_pos int, entity string, alias string"
    ).withColumn("alias_norm", normalized(F.col("alias")))


def resolved(spark, leagues, texts, **options):
    frame = spark.createDataFrame(texts, "league string, text string")
    out = matching.resolve_entities(frame, alias_frame(spark, leagues), **options)
    return {(r.league, r.text): (r.entity, r.strategy) for r in out.collect()}


WAYS = {
    "direct": {},
    "salted": {"broadcast_rows": 0},
    "indexed": {"direct_limit": 0},
    "indexed_shuffled": {"direct_limit": 0, "broadcast_rows": 0},
    "mixed": {"direct_limit": 22},
}


@pytest.mark.parametrize("way", ["direct", "mixed"])
def test_golden_cases(spark, way):
    cases = {
        ("ENG1", "Manchester City"): ("Man City", "abbrev1"),
        ("ENG1", "Brighton & Hove Albion"): ("Brighton", "abbrev1"),
        ("ENG1", "Nottingham Forest"): ("Nott'm Forest", "abbrev1"),
        ("ENG1", "Wolverhampton Wanderers"): ("Wolves", "exact"),
        ("ENG1", "AFC Bournemouth"): ("Bournemouth", "token"),
        ("ENG1", "Man Utd"): ("Man United", "abbrev0"),
        ("ENG1", "Villa"): ("Aston Villa", "token"),
        ("ENG1", "Spurs"): (None, None),
        ("ENG1", "REAL"): (None, None),
        ("ENG1", "Real"): ("Arsenal", "abbrev0"),
        ("ENG1", "2025"): ("Arsenal", "abbrev0"),
        ("ENG1", ""): ("Arsenal", "abbrev0"),
        ("ENG1", "Man"): ("Man City", "abbrev0"),
        ("ENG1", "A"): ("Arsenal", "abbrev0"),
        ("ENG2", "Sheffield Wednesday"): ("Sheffield Weds", "abbrev1"),
        ("ENG2", "Sheff Utd"): ("Sheffield United", "abbrev0"),
        ("ENG2", "Queens Park Rangers"): ("QPR", "abbrev1"),
        ("ENG2", "Hall"): ("Hull", "edit"),
        ("ENG2", "QPRX"): ("QPR", "edit"),
        ("ENG2", "City"): ("Bristol City", "token"),
        ("ENG2", "Bristol Rovers"): (None, None),
        ("NONE", "Arsenal"): (None, None),
    }
    got = resolved(spark, {"ENG1": ENG1, "ENG2": ENG2}, list(cases), **WAYS[way])
    assert got == cases


def random_name(rng, alphabet, words):
    return " ".join(
        "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))
        for _ in range(rng.randint(0, words))
    )


def spoiled(rng, name, alphabet):
    for _ in range(rng.randint(0, 3)):
        at = rng.randint(0, len(name))
        name = name[:at] + rng.choice(["", rng.choice(alphabet)]) + name[at + rng.randint(0, 1):]
    return name


@pytest.mark.parametrize(
    "way, rules",
    [(way, tuple(brute.RULES)) for way in WAYS]
    + [("indexed", (rule,)) for rule in brute.RULES],
)
def test_equals_brute_force(spark, way, rules):
    rng = random.Random(f"{way}{rules}")
    leagues, texts = {}, set()
    for i, alphabet in enumerate(["ab", "abc.", "abcdefgh'é", "a*[\\E+?^"]):
        names = [random_name(rng, alphabet, 4) for _ in range(15 + 5 * i)]
        leagues[f"L{i}"] = [
            (name or f"n{k}", [random_name(rng, alphabet, 3)] if rng.random() < 0.3 else [])
            for k, name in enumerate(names)
        ]
        for _ in range(60):
            texts.add((f"L{i}", spoiled(rng, rng.choice(names), alphabet)))
            texts.add((f"L{i}", random_name(rng, alphabet, 4)))
    steps = [s for s in matching.DEFAULT_STRATEGIES if s.name in rules]
    got = resolved(spark, leagues, sorted(texts), strategies=steps, **WAYS[way])
    assert got == {(lg, t): brute.resolve(t, leagues[lg], rules) for lg, t in texts}


@pytest.mark.parametrize("way", ["salted", "indexed_shuffled"])
def test_long_names(spark, way):
    rng = random.Random(way)
    names = [
        " ".join("".join(rng.choice("abcd") for _ in range(6)) for _ in range(words))
        for words in (5, 5, 6, 6, 7, 8, 9, 12, 30)
        for _ in range(3)
    ]
    leagues = {"L": [(name, []) for name in names]}
    texts = {("L", spoiled(rng, n, "abcd")) for n in names for _ in range(6)}
    texts |= {("L", n + " extra words") for n in names} | {("L", n[: len(n) // 2]) for n in names}
    got = resolved(spark, leagues, sorted(texts), **WAYS[way])
    assert got == {(lg, t): brute.resolve(t, leagues[lg]) for lg, t in texts}


def test_strict_leaves_empty_texts_alone(spark):
    got = resolved(spark, {"ENG1": ENG1}, [("ENG1", "2025"), ("ENG1", "Leeds")], strict=True)
    assert got == {("ENG1", "2025"): (None, None), ("ENG1", "Leeds"): ("Leeds", "exact")}


def test_bad_limits(spark):
    aliases = alias_frame(spark, {"ENG1": ENG1})
    frame = spark.createDataFrame([("ENG1", "x")], "league string, text string")
    for limit in (-1, 1.5):
        with pytest.raises(ValueError):
            matching.edit_join(frame, aliases, k=limit)
    for own in (matching.Strategy("a b", matching.OWN, keys="array({t})"), matching.Strategy("a", matching.OWN)):
        with pytest.raises(ValueError):
            matching.resolve_entities(frame, aliases, [own])
    for limit in (0, -0.5, 1.5):
        with pytest.raises(ValueError):
            matching.token_join(frame, aliases, threshold=limit)


def test_long_texts_take_the_walk(spark):
    """A junk text of many words must not let the regex try every way through it."""
    aliases = alias_frame(spark, {"L": [("a" * 38 + "b", []), ("Other", [])]})
    texts = spark.createDataFrame([("L", " ".join(["aaaa"] * 60))], "league string, text string")
    matching.abbrev_join(texts, aliases, reverse=True).count()
    start = time.time()
    for limit in (256, 0):
        got = matching.abbrev_join(texts, aliases, reverse=True, direct_limit=limit).collect()
        assert [r.entity for r in got] == [None]
    assert time.time() - start < 20


def test_too_many_aliases_are_refused(spark):
    aliases = alias_frame(spark, {"L": [("One", [])]}).withColumn("alias_pos", F.lit(1 << 20))
    texts = spark.createDataFrame([("L", "one")], "league string, text string")
    with pytest.raises(Exception, match="too many aliases"):
        matching.exact_join(texts, aliases).collect()


@pytest.mark.parametrize("bound", [1, 4, 25])
@pytest.mark.parametrize("reverse", [False, True])
def test_crowded_abbreviation_keys_are_opened(spark, monkeypatch, bound, reverse):
    rng = random.Random(bound)
    words = ["ab", "abc", "abcab", "ba", "cab", "aab", "b", "a", "é漢"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(220)]
    names += ["abc" * 3 + str(i) + "x" for i in range(40)] + ["abcabc"] * 3 + ["ab"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(150)]
    texts += ["abc", "abca", "abcabcabc", "ab ab", "a", "", "abx", "abc" * 3 + "7x", "zz", "aaaa", "abcabcabc12"]
    leagues = {"L": [(n, []) for n in names], "M": [(n, []) for n in names[:9]]}
    seen = []

    def recorded(index, probes, most, within=None):
        out = adapted(index, probes, most, within)
        seen.append(out[0])
        return out

    monkeypatch.setattr(matching, "adapted", recorded)
    rows = [(league, t) for league in leagues for t in texts]
    step = matching.Strategy("step", matching.ABBREV_REVERSE if reverse else matching.ABBREV)
    got = resolved(spark, leagues, rows, strategies=[step], direct_limit=0, key_names=bound)
    rule = "abbrev1" if reverse else "abbrev0"
    want = {(league, t): brute.resolve(t, leagues[league], [rule])[0] for league, t in rows}
    assert {k: v[0] for k, v in got.items()} == want
    keys = seen[0].filter("kind in ('head', 'reverse') and value is not null").groupBy("league", "kind", "key")
    assert keys.count().agg(F.max("count")).first()[0] <= bound


@pytest.mark.parametrize("k", [3, 4, 6])
@pytest.mark.parametrize("way", ["direct", "indexed", "indexed_shuffled"])
def test_any_number_of_edits(spark, k, way):
    rng = random.Random(k)
    names = [random_name(rng, "abc", 5) or "c" for _ in range(40)] + ["ab", "a", "b" * 30]
    texts = {("L", t) for t in ["", "c", "bb", "cccccc", "b" * 27, "b" * 40]}
    for name in names:
        for edits in (1, 2, k, k + 1):
            text = name
            for _ in range(edits):
                at = rng.randint(0, len(text))
                text = text[:at] + rng.choice(["", "x", "ab"[rng.randint(0, 1)]]) + text[at + rng.randint(0, 1):]
            texts.add(("L", text))
    leagues = {"L": [(name, []) for name in names]}
    got = resolved(spark, leagues, sorted(texts), strategies=[matching.Strategy("edit", matching.EDIT, k)], **WAYS[way])
    for (_, text), (entity, _) in got.items():
        near = [n for n in names if brute.distance(brute.norm(text), brute.norm(n)) <= k]
        assert entity == (near[0] if near else None), text


@pytest.mark.parametrize(
    "threshold, way",
    [(0.3, "direct"), (0.3, "indexed"), (0.1, "indexed_shuffled"), (1 / 3, "indexed"), (0.45, "indexed")],
)
def test_low_token_thresholds(spark, monkeypatch, threshold, way):
    rng = random.Random(f"{threshold}{way}")
    words = ["fc", "united", "é漢", "a", "b", "c", *(f"w{chr(97 + i)}" for i in range(20))]
    names = [" ".join(rng.choices(words, [9, 6, 3] + [1] * 23, k=rng.randint(1, 12))) for _ in range(250)]
    texts = {" ".join(rng.choices([*words, "unknown"], [9, 6, 3] + [1] * 24, k=rng.randint(1, 12))) for _ in range(200)}
    texts |= {" ".join(rng.sample(n.split(), len(n.split()))) for n in names[:60]} | {"", "fc", "fc united", "united fc fc"}
    leagues = {"L": [(n, []) for n in names], "M": [(n, []) for n in names[:7]]}
    rows = sorted((league, t) for league in leagues for t in texts)
    asked = []

    def recorded(index, probes, within=None):
        out = rarest(index, probes, within)
        asked.append(out[0])
        return out

    monkeypatch.setattr(matching, "rarest", recorded)
    step = matching.Strategy("token", matching.TOKEN, threshold)
    got = resolved(spark, leagues, rows, strategies=[step], **WAYS[way])
    for (league, text), (entity, _) in got.items():
        x = brute.norm(text)
        near = [n for n, _ in leagues[league] if brute.overlap(x, brute.norm(n), threshold)]
        assert entity == (near[0] if near else None), (league, text)
    if way == "indexed":
        assert asked[0].filter("kind = 'rare' and key = 'fc' and league = 'L'").isEmpty()


def test_own_strategy_is_the_same_in_every_way(spark):
    rng = random.Random(4)
    names = [random_name(rng, "abc", 3) or "c" for _ in range(60)]
    texts = sorted({("L", spoiled(rng, rng.choice(names), "abc")) for _ in range(150)} | {("L", "")})
    own = matching.Strategy(
        "shares_word", matching.OWN, keys="split({t}, ' ')", holds="abs(length(x) - length(y)) <= 1"
    )
    steps = [matching.DEFAULT_STRATEGIES[0], own, matching.DEFAULT_STRATEGIES[2]]
    found = [resolved(spark, {"L": [(n, []) for n in names]}, texts, strategies=steps, **WAYS[way]) for way in WAYS]
    assert all(f == found[0] for f in found)

    def rule(x, y):
        return bool(set(x.split(" ")) & set(y.split(" "))) and abs(len(x) - len(y)) <= 1

    for (_, text), hit in found[0].items():
        x = brute.norm(text)
        want = (None, None)
        for name, test in (("exact", lambda x, y: x == y), ("shares_word", rule), ("abbrev0", brute.abbreviates)):
            first = next((n for n in names if test(x, brute.norm(n))), None)
            if first is not None:
                want = (first, name)
                break
        assert hit == want, text


@pytest.mark.parametrize("direct_limit, joins", [(256, 2), (0, 3)])
def test_tables_over_the_bound_are_not_broadcast(spark, direct_limit, joins):
    """Spark guesses these few rows small enough; only the counted bound may decide."""
    aliases = alias_frame(spark, {"ENG1": ENG1})
    names = spark.createDataFrame([("ENG1", "arsenal"), ("ENG1", "wolvs")], "league string, x string")
    best = matching.match_normalized(names, aliases, direct_limit=direct_limit, broadcast_rows=0)
    plan = best._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == joins
    assert {(r.x, r.entity) for r in best.collect()} == {("arsenal", "Arsenal"), ("wolvs", "Wolves")}


def test_leagues_of_many_texts_are_cut(spark, monkeypatch):
    monkeypatch.setattr(matching, "LEAGUE_TEXTS", 3)
    leagues = {"ENG1": ENG1, "ENG2": ENG2[:2]}
    texts = [("ENG1", name) for name, _ in ENG1] + [("ENG1", ""), ("ENG2", "Brmingham"), ("ENG3", "x")]
    assert resolved(spark, leagues, texts, broadcast_rows=-1) == resolved(spark, leagues, texts)


def test_letters_rule_pairs_out_before_the_rules(spark):
    rows = spark.createDataFrame([("axb", "axb"), ("axb", "pq axb"), ("cdef", "ijklm")], "x string, y string")
    for step, kind, held in (
        (matching.Strategy("a", matching.ABBREV), "head", [True, True, False]),
        (matching.Strategy("r", matching.ABBREV_REVERSE), "reverse", [True, False, False]),
    ):
        # Patterns that find anything: only the letters can tell.
        pairs = rows.selectExpr(
            "x", "y", f"'{kind}' as kind", "'' as x_pattern", "'' as y_pattern",
            f"{letters('x')} as x_weight", f"{letters('y')} as y_weight",
        )
        confirmed = matching._confirmed(step, Row(longest=9, repeats=0))
        assert [r.held for r in pairs.selectExpr(f"{confirmed} as held").collect()] == held


def test_opened_keys_keep_texts_whose_letters_share_a_bit(spark):
    # "a" and U+00E1 share a bit of the sets, as do many others.
    names = [f"abc{c}{d} {e}" for c in "a\u00e1xyz" for d in "pq\u0171" for e in ("rest", "r\u00e9st")]
    texts = [n[:k] for n in names for k in (3, 4, 5)] + [n.replace("st", "") for n in names] + names
    leagues, asked = {"L": [(n, []) for n in names]}, [("L", t) for t in texts]
    for kind in (matching.ABBREV, matching.ABBREV_REVERSE):
        steps = {"strategies": [matching.Strategy("a", kind)]}
        opened = resolved(spark, leagues, asked, direct_limit=0, key_names=2, **steps)
        assert opened == resolved(spark, leagues, asked, **steps)


@pytest.mark.parametrize("steps, rounds", [
    (matching.DEFAULT_STRATEGIES, 7),
    ([matching.Strategy("edit", matching.EDIT, 3), matching.Strategy("token", matching.TOKEN, 0.3)], 5),
    ([matching.Strategy("edit", matching.EDIT, 1), matching.Strategy("own", matching.OWN, keys="split({t}, ' ')")], 4),
])
def test_many_texts_meet_a_large_dictionary_in_rounds(spark, monkeypatch, steps, rounds):
    """With the hits they have at once; no round takes what an earlier strategy hit."""
    rng = random.Random(11)
    names = [random_name(rng, "abcde", 4) or "c" for _ in range(50)] + ["abcdefghijk lmnop qrstuv", "ab" * 25]
    texts = sorted({("L", spoiled(rng, rng.choice(names), "abc")) for _ in range(150)} | {("L", ""), ("M", "a")})
    ask = lambda: resolved(spark, {"L": [(n, []) for n in names]}, texts, strategies=steps, direct_limit=0, broadcast_rows=0)
    at_once, purposes, stage = ask(), [], matching.staged

    def watched(df, purpose, within=None):
        purposes.append(purpose)
        return stage(df, purpose, within)

    monkeypatch.setattr(matching, "ROUND_TEXTS", 0)
    monkeypatch.setattr(matching, "staged", watched)
    assert ask() == at_once
    assert purposes.count("round") == rounds and purposes.count("rest") == len(steps) - 1


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_far_pairs_go_in_the_join_of_small_leagues(spark, broadcast_rows):
    """Before the cascade and the minimum, whose cost would be that of all pairs."""
    own = [
        matching.Strategy("same", matching.OWN, keys="array(substring_index({t}, ' ', -1))", holds="length(x) > 3"),
        matching.Strategy("same", matching.OWN, keys="split({t}, ' ')", holds="length(y) > 30"),
    ]
    steps = [*matching.DEFAULT_STRATEGIES, *own]
    aliases = alias_frame(spark, {"ENG1": ENG1})
    names = spark.createDataFrame([("ENG1", "arsenal"), ("ENG1", None)], "league string, x string")
    best = matching.match_normalized(names, aliases, steps, broadcast_rows=broadcast_rows)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    (pairs,) = [line for line in plan.splitlines() if "Join" in line and "_letters" in line]
    assert "bit_count" in pairs and "_words" in pairs and pairs.count("_set") == 4 and "levenshtein" not in pairs
    assert [tuple(r) for r in best.collect()] == [("ENG1", "arsenal", "Arsenal", "exact")]
    texts = [("ENG1", t) for t in ("Old Villa", "Villa", "Man", "zz", "", "City of West Ham")]
    found = resolved(spark, {"ENG1": ENG1}, texts, strategies=own, broadcast_rows=broadcast_rows)
    assert found == {
        ("ENG1", "Old Villa"): ("Aston Villa", "same"), ("ENG1", "Villa"): ("Aston Villa", "same"),
        ("ENG1", "Man"): (None, None), ("ENG1", "zz"): (None, None), ("ENG1", ""): (None, None),
        ("ENG1", "City of West Ham"): ("West Ham", "same"),
    }
