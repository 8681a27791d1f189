import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from touchline.llm.manifest import BLOCK, Appender, folded, levels_of, manifest, verify

FIELDS = ["doc_id", "source", "lang", "text"]
SCHEMA = "doc_id bigint, source string, lang string, text string, leaf string, tree int, witness string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(nodes):
    """Root and, per leaf, the siblings level by level."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        next_nodes, next_owners = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for j in range(len(run)):
                for i in owners[at + j]:
                    proofs[i].append(run[:j] + run[j + 1 :])
            next_nodes.append(sha("".join(run)))
            next_owners.append([i for own in owners[at : at + 8] for i in own])
        nodes, owners = next_nodes, next_owners
    return nodes[0], proofs


def brute(rows):
    """leaf -> (subroot, root, proof digest) of rows whose leaves are all different."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf(row)))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = [brute_tree([x[2] for x in sorted(trees[t])]) for t in names]
    root, uppers = brute_tree([g[0] for g in grown])
    out = {}
    for t, (subroot, proofs), upper in zip(names, grown, uppers, strict=True):
        for x, proof in zip(sorted(trees[t]), proofs, strict=True):
            out[x[2]] = (subroot, root, sha("".join(d for level in proof + upper for d in level)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "w") for r in rows], SCHEMA)


@pytest.mark.parametrize("size", [1, 7, 8, 9, 64, 65, BLOCK - 1, BLOCK, BLOCK + 1])
def test_appender_equals_the_rule(size):
    leaves = [sha(str(i)) for i in range(size)]
    root, proofs = brute_tree(leaves)
    first = leaves[:BLOCK]
    appender = Appender(levels_of(size))
    for x in first:
        appender.append(bytes.fromhex(x))
    top = appender.finish()
    if size <= BLOCK:
        assert top.hex() == root
        for x, proof, witness in zip(leaves, proofs, appender.witnesses, strict=True):
            found, siblings = folded(bytes.fromhex(x), bytes(witness))
            assert found.hex() == root and siblings.hex() == "".join(d for level in proof for d in level)


@pytest.mark.parametrize("sizes", [[1], [0, 1, 1], [9, 8, 1, 70], [3 * BLOCK + 5, BLOCK, 2, 1]])
def test_equals_the_rule(spark, sizes):
    rng = random.Random(3)
    langs = [None, "", "de", "éa", "z"]
    rows = [(rng.randrange(-(10**12), 10**12), rng.choice([None, "s", ""]), lang, f"T {i} ü")
            for lang, size in zip(langs, sizes, strict=False) for i in range(size)]
    rows += [(None, None, "de", None), (None, None, "de", ""), (5, "s", "de", "Tie"), (5, "s", "de", "tie")]
    rng.shuffle(rows)
    got = manifest(frame(spark, rows).repartition(5), FIELDS)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "witness"]
    checked = verify(got).collect()
    want = brute(rows)
    assert len(checked) == len(rows)
    assert {r.leaf: (r.subroot, r.root, r.proof_sha256) for r in checked} == want
    assert all(r.verified and r.folded_root == r.root for r in checked)


def test_many_trees_and_tampering(spark):
    rows = [(i, None, f"l{i % 700:04d}", f"Text {i}") for i in range(1500)]
    docs = frame(spark, rows)
    got = manifest(docs, FIELDS, carry={"claimed": F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.lit("0" * 64))})
    want = brute(rows)
    out = verify(got, "claimed").collect()
    assert {r.leaf: (r.subroot, r.root, r.proof_sha256) for r in out} == want
    assert all(not r.verified for r in out)
    assert all((r.folded_root is None) == (r.doc_id % 3 == 0) for r in out)


def test_rows_alike_and_empty(spark):
    rows = [(1, "s", "en", "a")] * 20 + [(2, "s", "en", "b")]
    out = verify(manifest(frame(spark, rows).repartition(3), FIELDS)).collect()
    assert len(out) == 21 and all(r.verified for r in out) and len({r.root for r in out}) == 1
    root, _ = brute_tree([leaf(rows[0])] * 20 + [leaf(rows[-1])])
    assert out[0].subroot == root == out[0].root
    assert len({r.proof_sha256 for r in out if r.doc_id == 1}) > 1
    assert verify(manifest(frame(spark, rows).limit(0), FIELDS)).collect() == []
