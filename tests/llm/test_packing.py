import json

import numpy as np
import pyarrow as pa
import pytest

from dittograph.llm import packing as P

from .conftest import prose


def best_fit(sizes, length):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= s]
        if fit:
            rooms[min(fit, key=lambda k: rooms[k])] -= s
        else:
            rooms.append(length - s)
    return sorted(rooms)


@pytest.mark.parametrize("length", [1, 7, 100, 128])
def test_rooms_equal_plain_best_fit(length):
    r = np.random.default_rng(length)
    for _ in range(20):
        sizes = r.integers(1, length + 1, 200)
        rows = P.best_fit_decreasing(sizes, length)
        assert sorted(length - np.bincount(rows, sizes)) == best_fit(sizes.tolist(), length)


def unpacked(rows):
    """Documents' tokens from packed rows, and checks of the rows' form."""
    docs = {}
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == len(ids) == r.n_tokens
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert places[a:b].tolist() == list(range(b - a))
            docs.setdefault(r.doc_ids[k], []).append((r.doc_starts[k], ids[a:b].tolist()))
    return docs


def test_lossless_for_any_partitioning(make):
    texts = [(k, prose(k, 10 + 37 * (k % 9))) for k in range(50)] + [(99, prose(5, 4000))]
    rows = P.packed(make(texts), 256, group_bytes=20_000).collect()
    encoding = P._encoding(open(P.VOCABULARY, "rb").read())
    assert all(r.n_tokens <= 256 for r in rows)
    for k, text in texts:
        parts = sorted(unpacked(rows)[k])
        tokens = [t for _, p in parts for t in p]
        assert tokens == [*encoding.encode_ordinary(text), P.END] and encoding.decode(tokens[:-1]) == text
    again = P.packed(make(texts).repartition(5), 256, group_bytes=20_000).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len({r.grp for r in rows}) > 1


def test_odd_rows(odd, nothing):
    rows = P.packed(odd, 512).collect()
    docs = unpacked(rows)
    assert set(docs) == {2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, -13}
    assert docs[2] == [(0, [P.END])] and len(docs[5]) == 2 and len(docs[6]) > 100
    assert P.packed(nothing).collect() == []


def matrices(root, grp, length):
    """Both matrices of a group as uint32, in the types that its description names."""
    shape = json.loads((root / f"{grp:06d}.json").read_text())
    ids = np.fromfile(root / f"ids-{grp:06d}.bin", shape["types"]["ids"]).reshape(shape["rows"], length)
    raw = pa.input_stream(root / f"positions-{grp:06d}.bin.zst", compression="zstd").read()
    return ids.astype("<u4"), np.frombuffer(raw, shape["types"]["positions"]).reshape(shape["rows"], length).astype("<u4"), shape


def test_matrices(make, tmp_path):
    rows = P.packed(make([(k, prose(k, 30)) for k in range(30)]), 128, group_bytes=2000)
    files = P.write_matrices(rows, f"file://{tmp_path}/m", 128).collect()
    kept = {(r.grp, r.row): r for r in rows.collect()}
    for f in files:
        ids, places, shape = matrices(tmp_path / "m", f.grp, 128)
        assert shape["rows"] == f.n_rows and f.file == f"ids-{f.grp:06d}.bin"
        for k in range(f.n_rows):
            r = kept[f.grp, k]
            assert ids[k, : r.n_tokens].tobytes() == r.ids and places[k, : r.n_tokens].tobytes() == r.positions
            assert (ids[k, r.n_tokens :] == P.END).all()
    assert not list((tmp_path / "m").glob(".tmp*"))
    wide = P.write_matrices(rows, f"file://{tmp_path}/w", 128, most_id=70_000).collect()
    assert all(matrices(tmp_path / "w", f.grp, 128)[2]["types"] == {"ids": "<u4", "positions": "<u2"} for f in wide)
    assert all((matrices(tmp_path / "w", f.grp, 128)[0] == matrices(tmp_path / "m", f.grp, 128)[0]).all() for f in wide)


def test_query_writes_the_matrices(monkeypatch, spark, tmp_path, make, nothing):
    from dittograph.llm import queries as Q

    docs, uri = make([(k, prose(k, 400)) for k in range(40)]), f"file://{tmp_path}/m"
    monkeypatch.setattr(Q, "fresh", lambda spark, name: uri)
    monkeypatch.setattr(Q, "_table", lambda *a: docs)
    rows = Q.op2_packing(spark, "").collect()
    assert sorted(map(str, rows)) == sorted(map(str, P.packed(docs).collect()))
    ids, places, _ = matrices(tmp_path / "m", 0, P.LENGTH)
    for r in rows:
        assert ids[r.row, : r.n_tokens].tobytes() == r.ids and places[r.row, : r.n_tokens].tobytes() == r.positions
        assert (ids[r.row, r.n_tokens :] == P.END).all() and not places[r.row, r.n_tokens :].any()
    assert json.loads((tmp_path / "m" / "000000.json").read_text())["rows"] == len(rows)
    several = P.write(docs, f"file://{tmp_path}/s", 256, group_bytes=20_000).collect()
    assert sorted(map(str, several)) == sorted(map(str, P.packed(docs, 256, group_bytes=20_000).collect())) and len({r.grp for r in several}) > 1
    assert P.write(nothing, f"file://{tmp_path}/n").collect() == []
