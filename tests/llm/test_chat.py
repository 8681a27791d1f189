import hashlib
import re

from touchline.llm.chat import digests, format_chats, read_chats


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["⟦e\n", "⟦q⟦", "⟦h user⟦b", "", "\\Q⟦e\\E", "é\U0001f600", "it's ⟦n", "</s>[INST] ok [/INST]"]


def chats(spark):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(zip(
        ["system", "user", "user", "assistant", "assistant", "assistant", "⟦b", None],
        ODD, strict=True))]
    rows += [(2, 0, "user", None), (2, 1, "assistant", None), (2, 1, "assistant", None)]
    rows += [(None, 3, "assistant", "b"), (None, None, "assistant", "a"), (3, 0, "user", "x" * 200_000)]
    # Equal turn numbers go by role, then text; a long conversation spans blocks.
    rows += [(5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "assistant", "z"), (5, 1, "assistant", "z")]
    rows += [(6, i, "user" if i % 7 < 2 else "assistant", "é⟦" * (i % 5)) for i in range(3000)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"{i} é") for i in range(400)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    return df, want


def test_round_trip(spark):
    df, want = chats(spark)
    formatted = format_chats(df)
    for r in read_chats(formatted).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss_texts == [x for role, x in want[r.conv_id] if role == "assistant"]
    for r in formatted.collect():
        runs = sum(i == 0 or t[0] != want[r.conv_id][i - 1][0] for i, t in enumerate(want[r.conv_id]))
        assert r.formatted.count("⟦h") == runs == len(re.findall("⟦e\n", r.formatted))


def test_digests(spark):
    df, want = chats(spark)
    got = digests(format_chats(df)).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert digests(format_chats(df.limit(0))).collect() == []
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_other_learned_role(spark):
    df = spark.createDataFrame([(1, 0, "it's", "a")], "conv_id long, turn long, role string, text string")
    assert read_chats(format_chats(df, learn="it's")).first().loss_texts == ["a"]
