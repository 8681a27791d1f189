import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.hashing import xxh64
from touchline.llm.simhash import (
    block_masks,
    drop_near_duplicates,
    near_duplicates,
    near_links,
    simhash,
)


def brute_print(text, n=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(nodes, 2):
        if linked(x, y):
            a, b = sorted((find(x), find(y)))
            parent[b] = a
    return {x: find(x) for x in nodes}


def test_xxh64_of_all_lengths():
    rng = random.Random(1)
    text = bytes(rng.randrange(256) for _ in range(6000))
    spans = [(rng.randrange(2000), n) for n in [*range(200), 1023, 1024, 1025, 4000]]
    start, size = np.array(spans).T
    want = [xxhash.xxh64_intdigest(text[s : s + n], 42) for s, n in spans]
    assert xxh64(text, start, size, 42).tolist() == want


def test_prints_equal_rule():
    rng = random.Random(2)
    words = ["A", "bé", "C\xa0d", "x" * 300, "\x1cq", "the", "of", "Ünd"]
    texts = ["", " \n", "one", "one two three", "a b c d " * 700, *(
        rng.choice([" ", "\n", "\x0b ", "  "]).join(rng.choices(words, k=rng.randrange(1, 60)))
        for _ in range(60)
    )]
    assert simhash(texts, 4).tolist() == [brute_print(t) for t in texts]


def test_masks_meet_every_close_pair():
    rng = random.Random(3)
    for count in (10, 10**5, 10**7, 10**9):
        masks = block_masks(count, 4)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(not (x ^ y) & m % (1 << 64) for m in masks)


def flips(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x - (1 << 64) if x >> 63 else x


def test_links_with_crowded_blocks(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = {flips(rng, rng.choice(base), rng.randrange(9)) for _ in range(300)}
    prints |= {flips(rng, rng.getrandbits(64), 0) for _ in range(200)}
    df = spark.createDataFrame([(p,) for p in prints], "p long")
    want = brute_components(sorted(prints), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4)
    for tile in (4096, 16):
        roots = dict(map(tuple, components(near_links(df, 4, tile=tile)).collect()))
        assert {p: roots.get(p, p) for p in prints} == want


def test_components_of_paths(spark):
    rng = random.Random(5)
    names = rng.sample(range(10**6), 200)
    links = [*zip(names[:99], names[1:100], strict=True), *((names[100], x) for x in names[101:]), (None, 3), (4, 4)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: min(names[:100]) for x in names[:100]} | {x: min(names[100:]) for x in names[100:]}


def near_table(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    rows = [(None, None), (900, None), (901, ""), (5, "same text here twice"), (5, "same text here twice"), (None, "Same TEXT here twice")]
    for i in range(25):
        text = rng.choices(words, k=200)
        rows.append((10 * i + 10, " ".join(text)))
        if i % 2:
            text[rng.randrange(200)] = "changed"
            rows.append((10 * i + 7, " ".join(text)))
    rows += [(None, "only a null id of its own kind"), (None, "another null id that stands alone")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, p string")


def test_near_duplicates_and_dropping(spark):
    rows, docs = near_table(spark)
    got = near_duplicates(docs).collect()
    prints = {brute_print(t) for _, t in rows}
    roots = brute_components(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        if i is not None:
            root = roots[brute_print(t)]
            least[root] = min(i, least.get(root, i))
    want = [(i, brute_print(t), least.get(roots[brute_print(t)])) for i, t in rows]
    assert sorted(((a, b % (1 << 64), c) for a, b, c in got), key=str) == sorted(want, key=str)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*least.values(), None, None], key=str)
    assert near_duplicates(docs.limit(0)).collect() == []
    assert drop_near_duplicates(docs.limit(0)).collect() == []
