import hashlib
import random

from touchline.llm.fixity import audit, merkle_levels, with_offsets

SCHEMA = "archive string, offset long, length int, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tree_of_one_archive(spark):
    rows = [("x", 0, 5, "a"), ("x", 5, 20, "b"), ("x", 25, 1, None), ("x", 260, 1, "d"), ("x", 260, 1, "d")]
    levels = merkle_levels(spark.createDataFrame(rows, SCHEMA), 2, range_bytes=10, fan_out=16)
    got = [{r.node: r.digest for r in level.collect()} for level in levels]
    ranges = {0: sha("0 5 a 1\n5 20 b 1"), 2: sha("25 1 - 1"), 26: sha("260 1 d 2")}
    middle = {0: sha(f"0 {ranges[0]}\n2 {ranges[2]}"), 1: sha(f"26 {ranges[26]}")}
    assert got == [ranges, middle, {0: sha(f"0 {middle[0]}\n1 {middle[1]}")}]


def test_finds_exactly_what_differs(spark):
    rng = random.Random(1)
    a = []
    for archive in ("p", "q", None, "r"):
        at = 0
        for _ in range(300):
            n = rng.randrange(1, 400)
            a.append((archive, at, n, sha(str(rng.random()))))
            at += n
    b, want = [], set()
    for row in a:
        case = rng.random() if row[0] != "q" else 1
        if case < 0.01:
            want.add((row[0], row[1], "missing"))
        elif case < 0.02:
            b.append((*row[:3], "changed"))
            want.add((row[0], row[1], "altered"))
        elif case < 0.03:
            b += [row, (row[0], row[1] + 10**6, 3, "new")]
            want.add((row[0], row[1] + 10**6, "extra"))
        else:
            b.append(row)
    rng.shuffle(b)
    frames = [spark.createDataFrame([(*r, 1) for r in t], SCHEMA + ", problem int") for t in (a, b)]
    for size, fan in ((1000, 4), (1 << 16, 16)):
        got = [(r.archive, r.offset, r.problem) for r in audit(*frames, range_bytes=size, fan_out=fan).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_edges(spark):
    t = spark.createDataFrame([("a", 0, 1, "x"), ("a", 0, 1, "x"), (None, None, None, None)], SCHEMA)
    assert audit(t, t).collect() == []
    assert audit(t.limit(0), t.limit(0)).collect() == []
    assert sorted(r.problem for r in audit(t, t.limit(0)).collect()) == ["missing", "missing"]
    lost = audit(t, t.dropDuplicates()).collect()
    assert [(r.archive, r.problem) for r in lost] == [("a", "altered")]
    laid = with_offsets(spark.createDataFrame([("a", 2, 5), ("a", 1, 7), ("a", 3, None)], "archive string, i int, length int"), "i")
    assert sorted((r.i, r.offset) for r in laid.collect()) == [(1, 0), (2, 7), (3, 12)]


def laid_out(records):
    """Rows (archive, offset, length, digest, record) of (archive, length, digest, record) in order."""
    at, rows = {}, []
    for archive, n, digest, record in records:
        rows.append((archive, at.get(archive, 0), n, digest, record))
        at[archive] = at.get(archive, 0) + n
    return rows


def test_records_that_moved_are_sound(spark):
    rng = random.Random(2)
    records = [
        (archive, rng.choice([50, 50, 70]), sha(f"{archive}twin{i // 2}" if i % 10 < 2 else f"{archive}{i}"), f"id{i}")
        for archive in ("p", None, "q") for i in range(400)
    ]
    kept, want = [], []
    first = laid_out(records)
    for record, row in zip(records, first, strict=True):
        case = rng.random() if record[0] != "q" and int(record[3][2:]) % 10 > 1 else 1
        if case < 0.02:
            want.append((row[0], row[1], "missing", None))
            continue
        if case < 0.04:
            record = (record[0], record[1] // 2, sha("cut" + record[3]), record[3])
        elif case < 0.06:
            record = (record[0], record[1], sha("bit" + record[3]), record[3])
        elif case < 0.07:
            kept.append((record[0], 33, sha("new" + record[3]), "new" + record[3]))
        kept.append(record)
    second = laid_out(kept)
    for row in second:
        if row[4].startswith("new"):
            want.append((row[0], row[1], "extra", row[1]))
        elif row[3] not in {r[3] for r in first if r[0] == row[0]}:
            old = next(r for r in first if (r[0], r[4]) == (row[0], row[4]))
            want.append((row[0], old[1], "altered", row[1]))
    schema = SCHEMA + ", record string"
    frames = [spark.createDataFrame(t, schema) for t in (first, second)]
    got = audit(*frames, record_col="record", range_bytes=1000, fan_out=4).collect()
    assert {r.problem for r in got} == {"missing", "altered", "extra"}
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.archive, r.offset, r.problem, r.offset_b) for r in got), key=key) == sorted(want, key=key)
    # Without ids a damaged record that moved is one that is missing and one that is extra.
    plain = audit(*frames, range_bytes=1000, fan_out=4).collect()
    gone = {r.digest_a for r in plain if r.digest_a}
    assert gone == {r.digest_a for r in got if r.digest_a}
    assert {r.digest_b for r in plain if r.digest_b} == {r.digest_b for r in got if r.digest_b}
