import random
import tracemalloc

import numpy as np
import pytest

from dittograph.llm import piece_codec as C

from .conftest import prose

sentencepiece = pytest.importorskip("sentencepiece")


def texts():
    r = random.Random(1)
    alphabet = "aaabbcde  \n\t.,=-_é日本😀\0<>|▁0123"
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(400)]
    return [*out, "a" * 999, "ab" * 500, " " * 70, "mississippi " * 30, prose(5, 500), "<s> </s> <0x0A>", "x" * 20_000, "日本" * 3000]


def test_ids_are_the_librarys():
    import pyarrow as pa

    model = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    all_ = texts()
    ids, at = C.encode_chunk(pa.array([*all_, None, ""]), C.load())
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [*model.encode(all_), [], []]


def test_round_trip_and_odd_rows(odd, nothing):
    out = C.encode(odd)
    assert set(out.columns) == {*odd.columns, "n_ids", "exact"}
    back = C.decode(out.withColumnRenamed("text", "was")).collect()
    assert len(back) == odd.count()
    for r in back:
        assert r.text == r.was
        assert (r.ids is None and r.n_ids is None and r.exact is None) if r.was is None else (r.exact and r.n_ids == len(r.ids))
    assert C.encode(nothing).collect() == [] and C.decode(C.encode(nothing)).collect() == []


def test_a_literal_space_mark_is_reported(make):
    got = {r.doc_id: r.exact for r in C.encode(make([(1, "a▁b"), (2, "a b")])).collect()}
    assert got == {1: False, 2: True}


def test_a_long_text_in_parts_has_the_librarys_ids():
    model, pieces = sentencepiece.SentencePieceProcessor(model_file=C.MODEL), C.load()
    for text in [prose(5, 2000), "  two  spaces " * 300, "▁ ▁a ▁▁ b" * 300, "日本 語" * 500, "x" * 5000, " ", *texts()[:40]]:
        if not text:
            continue
        for most in (1, 50, 3000):
            ids, exact = C.encode_long(np.frombuffer(text.encode(), np.uint8), pieces, most)
            assert ids.tolist() == model.encode(text) and exact == (model.decode(ids.tolist()) == text)


def test_memory_of_a_very_long_text():
    pieces = C.load()
    text = prose(3, 20_000)
    raw = np.frombuffer((text * (64_000_000 // len(text))).encode(), np.uint8)
    tracemalloc.start()
    ids, exact = C.encode_long(raw, pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert exact and len(ids) > 10_000_000 and peak < 5e8, peak


def test_ids_that_the_model_lacks_are_unknown(spark):
    rows = spark.createDataFrame([(1, [0]), (2, [None]), (3, [-5]), (4, [32_000]), (5, []), (6, None)], "doc_id int, ids array<int>")
    got = {r.doc_id: r.text for r in C.decode(rows).collect()}
    assert got[1] == got[2] == got[3] == got[4] and got[5] == "" and got[6] is None
