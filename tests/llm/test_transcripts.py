import itertools

import numpy as np
import pytest

from dittograph.llm import transcripts as T

SAMPLE = "/root/testdata/sf0.01/conversations.parquet"


def test_viterbi_equals_enumeration():
    r = np.random.default_rng(0)
    tables = T.Tables(length=r.dirichlet(np.ones(T.LENGTHS), 6), question=r.dirichlet(np.ones(2), 6))
    begin, move, kind, look = T.logs(tables)
    sizes = [1, 4, 0, 5, 3]
    at = np.r_[0, np.cumsum(sizes)]
    kinds, lengths, asks = r.integers(0, T.KINDS, 13), r.integers(0, T.LENGTHS, 13), r.integers(0, 2, 13)
    got = T.viterbi(kinds, lengths, asks, at, tables)
    for a, b in zip(at, at[1:]):
        def score(path):
            return begin[path[0]] + sum(kind[s, kinds[k]] + look[s, lengths[k], asks[k]] for s, k in zip(path, range(a, b))) + sum(move[x, y] for x, y in zip(path, path[1:]))
        if b > a:
            assert score(got[a:b]) == pytest.approx(max(score(p) for p in itertools.product(range(6), repeat=b - a)))


@pytest.mark.parametrize(("line", "speaker", "rest"), [("User: hello", "user", "hello"), ("### Response:", "response", ""), ("<|system|>", "system", ""), ("**Human:** hi", "human", "hi"), ("[assistant] yes", "assistant", "yes"), ("Bob: hm", "bob", "hm"), ("the user: x", "", "the user: x"), ("plain text", "", "plain text"), ("A dog barks.", "", "A dog barks."), ("user", "", "user"), ("", "", "")])
def test_markers(line, speaker, rest):
    assert T.marker(line) == (speaker, rest)


def test_turns_and_rendering(spark):
    rows = [(1, "System: be brief\nUser: what is it?\nmore\nAssistant: this.\nUser: ok", "x", 3), (2, None, "x", 3), (3, " \n ", "x", 3), (None, "Q: a?\nA: b", "x", 3), (1, "User: hi", "x", 3), (4, "", "x", 3)]
    got = T.formatted(spark.createDataFrame(rows, "conv_id long, text string, chat string, n_turns int"), T.Tables()).collect()
    assert len(got) == 6
    first = next(r for r in got if r.n_turns == 4)
    assert first.roles == ["system", "user", "assistant", "user"]
    assert first.chat == "<|system|>\nbe brief\n<|end|>\n<|user|>\nwhat is it?\nmore\n<|end|>\n<|assistant|>\nthis.\n<|end|>\n<|user|>\nok\n<|end|>\n"
    by = {r.conv_id: r for r in got if r.conv_id != 1}
    assert by[2].n_turns is by[2].roles is by[2].chat is None
    assert (by[3].n_turns, by[3].chat) == (0, "") == (by[4].n_turns, by[4].chat)
    assert by[None].roles == ["user", "assistant"]
    assert T.formatted(spark.createDataFrame([], "conv_id long, text string"), T.Tables()).collect() == []


def test_very_long_transcript():
    text = "\n".join(f"{'User' if k % 2 == 0 else 'Assistant'}: line {k}" for k in range(20_000))
    turns = T.parse([text], T.Tables())[0]
    assert len(turns) == 20_000 and turns[19_999] == ("assistant", "line 19999")


def test_raw_transcripts_with_odd_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, None, "b"), (1, 2, "assistant", None), (1, 2, "assistant", None), (None, 0, "user", "x"), (2, None, " USER ", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    known = T.known_transcripts(turns)
    got = {r.conv_id: r.text for r in T.raw_transcripts(known).collect()}
    assert set(got) == {1, 2} and got[1].count("\n") >= 3
    tables = T.tables_from(known)
    assert all(np.allclose(x.sum(1), 1) for x in (tables.turn, tables.kind, tables.length, tables.question))
    nothing = T.tables_from(known.limit(0))
    assert nothing.more.shape == (3,) and np.allclose(nothing.kind, T.Tables().kind)
    assert sorted(r.conv_id for r in T.parsed_by_others(turns).collect()) == [1, 2] and T.parsed_by_others(turns.limit(0)).collect() == []


def test_tables_equal_plain_counts(spark):
    rows = [(1, 0, "system", "be brief\nplease"), (1, 1, "user", "why?"), (1, 2, "assistant", "so"), (2, 0, "user", "a\n\nb?"), (2, 1, "user", "c")]
    known = T.known_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = T.tables_from(known)
    kind, length, question, move = T._prior(), np.ones((6, T.LENGTHS)), np.ones((6, 2)), np.ones((4, 3))
    for r in known.collect():
        lines, states, was = [], [], 3
        for t in r.turns:
            k = T.ROLES.index(t.role)
            move[was, k] += 1
            was = k
            for n, line in enumerate(t.line.split("\n")):
                lines.append(line)
                states.append(k + 3 * (n > 0))
        for s, a, b, c in zip(states, *T.features("\n".join(lines))[:3]):
            kind[s, a] += 1
            length[s, b] += 1
            question[s, c] += 1
    for mine, want in ((got.kind, kind), (got.length, length), (got.question, question), (got.turn, move)):
        assert np.allclose(mine, want / want.sum(1, keepdims=True))


def test_held_out_accuracy(spark):
    turns = spark.read.parquet(SAMPLE)
    got = {r.conv_id: r.roles for r in T.parsed_by_others(turns).collect()}
    want = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append(r.role)
    print(sum(got[c] == w for c, w in want.items()), len(want))
    assert sum(got[c] == w for c, w in want.items()) >= 0.8 * len(want)
