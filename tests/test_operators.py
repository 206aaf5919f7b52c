"""The traps of duplicate search, one small case each."""

import os
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from dittograph.functions import formatting as fmt
from dittograph.functions import paths
from dittograph.functions.fingerprints import quick_hash, sha256_hex
from dittograph.operators import exact, policy, similar, view
from dittograph.operators.components import connected_components
from dittograph.sources import files, images
from dittograph.sources.settings import Settings, read_settings, write_settings

FILES = "path string, name string, size long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_name_and_size_or_content(spark, tmp_path):
    for name, text in {"a/f.txt": "hello", "b/f.txt": "hellp", "a/x.txt": "same!", "b/y.txt": "same!", "a/F2.txt": "q", "b/f2.txt": "q", "_u.txt": "u", ".hid/z.txt": "z"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    scan = files.scan_files(spark, [str(tmp_path)], content=True)
    assert {r.name for r in scan.collect()} == {"f.txt", "x.txt", "y.txt", "F2.txt", "f2.txt"}
    assert [r.group_key for r in exact.name_size_groups(scan).collect()] == ["f.txt_5"]
    assert exact.content_groups(scan).count() == 2 == exact.size_then_content(scan).count()
    nested = files.scan_files(spark, [str(tmp_path), str(tmp_path / "a")])
    assert nested.count() == scan.count() + 3
    (tmp_path / "top.txt").write_text("at the root")
    assert [r.name for r in files.scan_files(spark, [str(tmp_path)], max_depth=0).collect()] == ["top.txt"]
    assert files.scan_files(spark, [str(tmp_path) + "/"], max_depth=1).count() == 7
    (tmp_path / "top.txt").unlink()
    assert "content" not in nested.columns and exact.visible(nested.withColumn("is_hidden", F.col("name") == "x.txt")).count() == nested.count() - 2


def test_hashes(spark):
    a, b = b"x" * 65_536 + b"1", b"x" * 65_536 + b"2"
    rows = spark.createDataFrame([(1, bytearray(a)), (2, bytearray(b)), (3, bytearray(b"")), (4, None)], "id int, content binary")
    got = {r.id: r for r in rows.select("id", quick_hash(F.col("content")).alias("q"), sha256_hex(F.col("content")).alias("s")).collect()}
    assert got[1].q == got[2].q and got[1].s != got[2].s and got[4].s is None
    assert got[3].s == "E3B0C44298FC1C149AFBF4C8996FB92427AE41E4649B934CA495991B7852B855"


@pytest.mark.parametrize(("size", "text"), [(0, "0 B"), (512, "512 B"), (1024, "1 KB"), (1152, "1.13 KB"), (1536, "1.5 KB"), (1 << 20, "1 MB"), (5 << 40, "5 TB"), (5 << 50, "5120 TB"), (100 << 10, "100 KB")])
def test_size_text(spark, size, text):
    assert one(spark, fmt.format_size(F.lit(size))) == text


def test_other_texts(spark):
    assert one(spark, fmt.format_size(F.lit(3 << 40), max_unit="GB")) == "3072 GB"
    assert one(spark, fmt.format_size(F.lit(1536), fmt.SizeUnit.BYTES)) == "1536 B"
    assert one(spark, fmt.format_percent(F.lit(0.925))) == "93%"
    assert [one(spark, fmt.counted(F.lit(n), "file")) for n in (0, 1, 1234)] == ["0 files", "1 file", "1,234 files"]
    assert [fmt.parse_megabytes(x) for x in (None, " ", "12")] == [0, 0, 12]
    for bad in ("-1", "1.5", "x"):
        with pytest.raises(ValueError):
            fmt.parse_megabytes(bad)


def test_search_is_literal(spark):
    rows = spark.createDataFrame([("/a/50%_x", "50%_x", 1), ("/a/500x", "500x", 1), (None, "50%_Y", 1)], FILES)
    assert {r.name for r in view.searched(rows, " 50%_ ").collect()} == {"50%_x", "50%_Y"}
    assert view.searched(rows, "  ").count() == 3
    assert one(spark, paths.is_image(F.lit("a.TIF"))) is False and one(spark, paths.is_image(F.lit("a.Tiff"))) is True
    assert one(spark, paths.is_uncompressed(F.lit("a.TIF"))) is True


def test_limits_and_totals(spark):
    rows = [(f"/{k}", "a", 1) for k in range(3)] + [(f"/{k}", "b", 2) for k in range(3, 5)] + [("/9", "c", 3)]
    f = spark.createDataFrame(rows, FILES)
    assert [r.taken for r in exact.group_limits(exact.name_size_groups(f), 4).orderBy("size").collect()] == [3, 1]
    assert exact.limited_members(f, 4).count() == 4 and exact.limited_members(f, 0).count() == 5
    t = exact.totals(f).first()
    assert (t.files_scanned, t.distinct_keys, t.duplicate_groups, t.duplicate_files, t.wasted) == (6, 3, 2, 5, 2 + 2)
    assert tuple(exact.totals(f.limit(0)).first()) == (0, 0, 0, 0, 0)
    big = spark.createDataFrame([(f"/{k}", "m", 10 << 20) for k in range(3)], FILES)
    assert exact.name_size_groups(big).first().wasted == 20 << 20
    assert exact.size_between(big, 11).count() == 0 and exact.size_between(big, 10, 10).count() == 3
    for bad in ((-1, 0), (5, 4)):
        with pytest.raises(ValueError):
            exact.size_between(big, *bad)


def test_list_and_grid_differ(spark):
    rows = spark.createDataFrame([(1, "/a", "n", 1), (2, "/A", "n", 1), (3, "/b", "n", 1), (4, "/c", "n", 1)], "ord int, path string, name string, size long")
    order = [F.col("ord")]
    assert [r.ord for r in view.list_view(rows, order, 2, "").orderBy("ord").collect()] == [1, 3]
    assert [r.ord for r in view.grid_view(rows, order, 2, "").collect()] == [1]
    between = lambda keys, a, b: {r.ord for r in view.range_selected(rows, keys, "ord", a, b).collect()}
    assert between([("ord", False)], 3, 2) == between([("ord", True)], 2, 3) == {2, 3}
    assert between([("name", True), ("path", True)], 1, 4) == {1, 3, 4} and between([("path", False)], 2, 2) == {2}
    some = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, None)], "ord int, size int")
    pick = lambda down, a, b: {r.ord for r in view.range_selected(some, [("size", down), ("ord", False)], "ord", a, b).collect()}
    assert pick(False, 4, 2) == {4, 2} and pick(True, 3, 1) == {3, 2, 1}
    assert [r.ord for r in view.page(rows, order, 1, 1, 1, 0).collect()] == [2]


def test_keep_policies(spark):
    rows = spark.createDataFrame([("g", "/1", "a.jpg", 5, 2, 2), ("g", "/2", "a.png", 9, 3, 3), ("g", "/3", "b.jpg", 9, 1, 1), ("h", "/4", "c.jpg", 1, 1, 1)], "grp string, path string, name string, size long, width int, height int")
    larger = policy.Keep(False, False, True)
    got = lambda p, k=larger: {r.path for r in policy.auto_select(rows, ["grp"], ["path"], k, p).filter("selected").collect()}
    assert got("reference") == {"/1", "/2", "/3"} and got("safe") == {"/1", "/3"}
    assert got("safe", policy.Keep(True, True, True)) == {"/1", "/3"}
    with pytest.raises(ValueError):
        policy.auto_select(rows, ["grp"], ["path"], larger, "other")
    gone = policy.deletion_plan(policy.auto_select(rows, ["grp"], ["path"], larger, "safe"))
    assert policy.after_deletion(rows, gone, ["grp"]).count() == 0
    assert tuple(policy.saved_bytes(gone).first()) == (14, 2)


def test_log(spark):
    start = datetime(2024, 1, 1)
    log = spark.createDataFrame([(f"/{k}", f"n{k}", start + timedelta(hours=k)) for k in range(31)], "path string, name string, deleted_at timestamp")
    kept = policy.recent(log, "deleted_at")
    assert kept.count() == 30 and "/0" not in {r.path for r in kept.collect()}
    tried = spark.createDataFrame([("/1", True, None), ("/2", False, "missing")], "path string, ok boolean, error string")
    left = {r.path: r.error for r in policy.restored(log, tried).collect()}
    assert "/1" not in left and left["/2"] == "missing" and left["/3"] is None
    again = spark.createDataFrame([("/2", False, "still"), ("/2", True, None), ("/3", False, "b"), ("/3", False, "a")], "path string, ok boolean, error string")
    twice = {r.path: r.error for r in policy.restored(policy.restored(log, tried), again).collect()}
    assert len(twice) == 29 and "/2" not in twice and twice["/3"] == "a" and twice["/4"] is None
    more = policy.logged(log.withColumn("size", F.lit(1)), spark.createDataFrame([("/z", "z", 5)], FILES), F.lit(start + timedelta(hours=5)))
    assert more.count() == 30 and {"/z", "/1"} & {r.path for r in more.collect()} == {"/z"}
    assert policy.forgotten(log).count() == 0 and policy.forgotten(log, tried).count() == 29
    bin_ = spark.createDataFrame([("/bin/a", "N3")], "path string, name string")
    assert [r.bin_path for r in policy.restore_matches(log, bin_).collect()] == ["/bin/a"]


def test_block_pairs_equal_broadcast(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(int(k), int(h)) for k, h in enumerate(r.integers(-(2**63), 2**63, 150))] + [(999, None)], "id long, hash long")
    want = {tuple(x) for x in similar.hamming_pairs(rows).collect()}
    monkeypatch.setattr(similar, "BLOCK_ROWS", 40)
    got = [tuple(x) for x in similar.hamming_pairs(rows, broadcast_rows=10).collect()]
    assert set(got) == want and len(got) == len(want) > 10
    assert similar.threshold(50) == 0.85 and similar.threshold(100) == 0.99 and similar.threshold() == 0.92


def test_components_do_not_depend_on_order(spark):
    r = random.Random(0)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(None, 5), (7, None), (500, 500)]
    nodes = {n: n for p in pairs if None not in p for n in p}

    def find(x):
        while nodes[x] != x:
            x = nodes[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            nodes[y] = x
    for n in (1, 5):
        r.shuffle(pairs)
        edges = spark.createDataFrame(pairs, "src long, dst long").repartition(n)
        for local in (0, 10_000):
            assert {x.node: x.component for x in connected_components(edges, local_edges=local).collect()} == {x: find(x) for x in nodes}
    assert connected_components(edges.limit(0)).collect() == []


def png(path, pixels):
    path.write_bytes(images.png(pixels))


def test_images(spark, tmp_path):
    r = np.random.default_rng(0)
    base = r.integers(0, 256, (64, 64, 3))
    other = np.vstack([base[:2], r.integers(0, 256, (62, 64, 3))])
    png(tmp_path / "a.png", base)
    png(tmp_path / "b.png", other)
    png(tmp_path / "c.png", r.integers(0, 256, (40, 80, 3)))
    (tmp_path / "d.png").write_bytes(b"notpng")
    (tmp_path / "e.txt").write_text("no image")
    assert files.scan_images(spark, [str(tmp_path)]).count() == 4
    found = images.read_images(spark, str(tmp_path))
    assert found.count() == 3
    name = paths.file_name(F.col("path"))
    h = {x.n: x.hash for x in images.hashed(found).select(name.alias("n"), "hash").collect()}
    assert h["a.png"] == h["b.png"] != h["c.png"]  # only the first rows count
    g = base.sum(2) // 3
    bits = [g.ravel()[k + (k // 63)] < g.ravel()[k + (k // 63) + 1] for k in range(64)]
    assert h["a.png"] & (2**64 - 1) == sum(1 << k for k, b in enumerate(bits) if b)
    frames = images.frames(found).select(F.when(name == "a.png", 1).when(name == "b.png", 2).otherwise(3).alias("id"), "values")
    pairs = spark.createDataFrame([(1, 2, 0), (1, 3, 5), (1, 1, 0)], "i int, j int, hd int")
    s = {(x.i, x.j): x.ssim for x in similar.ssim_pairs(pairs, frames).collect()}
    assert s[1, 1] == 1 and s[1, 3] < 0.9
    thumb = images.thumbnails(found, 32).collect()
    assert all(x.width == 32 and len(x.data) == x.width * x.height * 3 for x in thumb)
    files.write_scores(similar.ssim_pairs(pairs, frames), str(tmp_path / "scores"))
    assert "1.0000\t1\t1" in "".join(p.read_text() for p in (tmp_path / "scores").glob("*.csv"))


def test_settings(tmp_path):
    where = str(tmp_path / "s.json")
    assert read_settings(where) == Settings()
    changed = Settings(SizeUnit="MB", MinFileSizeMB=3, ConfirmDelete=False)
    assert write_settings(changed, where) and read_settings(where) == changed
    (tmp_path / "s.json").write_text('{"Theme": "Dark", "MinFileSizeMB": "x", "SizeUnit": "PB", "Other": 1}')
    assert read_settings(where) == Settings(Theme="Dark")
    (tmp_path / "s.json").write_text("[")
    assert read_settings(where) == Settings() and not write_settings(changed, str(tmp_path / "no" / "s.json"))


def test_drive_usage_and_report(spark, tmp_path):
    row = files.drive_usage(spark, [str(tmp_path)]).first()
    assert row.used <= row.total and row.band in ("normal", "warning", "critical")
    f = spark.createDataFrame([("/1", "a", 1), ("/2", "a", 1), ("/3", "b", 1)], FILES)
    assert files.scan_report(f, exact.name_size_groups(f)).first().files_scanned == 3


def test_stream_grows_groups(spark, tmp_path):
    from dittograph.streaming import increment

    inbox, args = str(tmp_path / "in"), [str(tmp_path / x) for x in ("hashes", "edges", "checkpoint")]
    seen = []
    for rows in ([(1, 0), (2, 1)], [(3, 3), (4, -1), (2, 1)], [(5, -2), (6, None)]):
        spark.createDataFrame(rows, "id long, hash long").coalesce(1).write.mode("append").parquet(inbox)
        increment.start(increment.hash_stream(spark, inbox), *args).awaitTermination()
        seen.append({r.id: r.component for r in increment.groups(spark, args[1]).collect()})
    assert seen == [{1: 1, 2: 1}, {1: 1, 2: 1, 3: 1}, {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}]


def test_selection(spark):
    rows = spark.createDataFrame([(1, "g", True), (2, "g", False), (3, "h", None)], "id int, grp string, selected boolean")
    chosen = lambda d: {r.id for r in d.filter("selected").collect()}
    assert chosen(policy.toggled(rows)) == {1, 2, 3} and chosen(policy.toggled(policy.toggled(rows))) == set()
    assert chosen(policy.toggled(rows, F.col("id") == 1)) == set() and chosen(policy.toggled(rows, F.col("grp") == "g", True)) == {1, 2}
    assert policy.selected_count(rows).first().n_selected == 1


def test_counts_and_tags(spark):
    from dittograph.streaming import control

    rows, seen = control.observed(spark.range(10), "scan", even=F.col("id") % 2 == 0)
    with control.tagged(spark, "scan"):
        rows.collect()
    assert seen.get == {"rows": 10, "even": 5} and control.cancel(spark, "scan") == []


def test_cancelling_ends_a_running_plan(spark):
    from pyspark import InheritableThread

    from dittograph.streaming import control

    ended = []

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    def work():
        with control.tagged(spark, "slow"):
            try:
                spark.range(2).mapInArrow(slow, "id long").collect()
            except Exception as e:  # noqa: BLE001
                ended.append(e)

    thread, began = InheritableThread(target=work), time.time()
    thread.start()
    while thread.is_alive() and time.time() - began < 40:
        time.sleep(1)
        control.cancel(spark, "slow")
    thread.join(5)
    assert ended and not thread.is_alive() and time.time() - began < 45


def test_walk_has_real_flags(spark, tmp_path):
    for name in ("a/b/f.txt", ".hid/z.txt", "a/.h.txt", "t.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    os.symlink(tmp_path / "t.txt", tmp_path / "a/link.txt")
    os.symlink(tmp_path / "a", tmp_path / "loop")
    os.symlink(tmp_path / "gone", tmp_path / "a/broken.txt")
    for spread in (1, 64):
        rows = {r.name: r for r in files.walk_files(spark, [str(tmp_path)], spread=spread).collect()}
        assert set(rows) == {"f.txt", ".h.txt", "t.txt", "link.txt", "broken.txt"}
        assert rows[".h.txt"].is_hidden and rows["link.txt"].is_reparse and not rows["t.txt"].is_hidden
        assert rows["broken.txt"].size is None and rows["broken.txt"].path.endswith("a/broken.txt")
        assert {r.name for r in exact.visible(files.walk_files(spark, [str(tmp_path)], spread=spread)).collect()} == {"f.txt", "t.txt", "broken.txt"}
        assert {r.name for r in files.walk_files(spark, [str(tmp_path)], max_depth=0, spread=spread).collect()} == {"t.txt"}
        assert files.walk_files(spark, [str(tmp_path)], prune=False, spread=spread).count() == 6
    assert files.walk_files(spark, [str(tmp_path / "nothing")]).count() == 0


def test_images_from_files_to_groups(spark, tmp_path):
    """A run over a folder, and the same images as they arrive."""
    from dittograph.plans.similar_images import similar_images
    from dittograph.streaming import increment

    r = np.random.default_rng(1)
    base = r.integers(0, 256, (64, 64, 3))
    inbox = tmp_path / "in"
    inbox.mkdir()
    png(inbox / "a.png", base)
    png(inbox / "b.png", np.clip(base + r.integers(-1, 2, base.shape), 0, 255))
    png(inbox / "c.png", r.integers(0, 256, (64, 64, 3)))
    (inbox / "d.png").write_bytes(b"no image")
    for more in ({}, {"window": 8}, {"greedy": True}):
        got = similar_images(spark, [str(inbox)], **more).collect()
        assert sorted(x.path.rsplit("/")[-1] for x in got) == ["a.png", "b.png"] and all(x.group_id.endswith("a.png") and x.score > 0.95 for x in got)
    args = [str(tmp_path / x) for x in ("hashes", "edges", "checkpoint")]
    increment.start_images(spark, str(inbox), *args, max_files=2).awaitTermination()
    png(inbox / "e.png", base)
    increment.start_images(spark, str(inbox), *args).awaitTermination()
    assert sorted(x.path.rsplit("/")[-1] for x in increment.image_groups(spark, args[1]).collect()) == ["a.png", "b.png", "e.png"]


def test_cross_pairs_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    a, b = (spark.createDataFrame([(int(s + k), int(h)) for k, h in enumerate(r.integers(-(2**63), 2**63, n))], "id long, hash long") for s, n in ((0, 90), (1000, 50)))
    want = {tuple(x) for x in similar.hamming_cross(a, b).collect()}
    monkeypatch.setattr(similar, "BLOCK_ROWS", 20)
    got = [tuple(x) for x in similar.hamming_cross(a, b, broadcast_rows=10).collect()]
    assert set(got) == want and len(got) == len(want) > 10 and want == {tuple(x) for x in similar.hamming_cross(b, a).collect()}


def test_frames_in_blocks_equal_joined_vectors(spark):
    r = np.random.default_rng(4)
    frames = spark.createDataFrame([(k, r.random(64).tolist()) for k in range(12)], "id long, values array<double>")
    pairs = spark.createDataFrame([(i, j, 0) for i in range(12) for j in range(i + 1, 12)] + [(1, 99, 0)], "i long, j long, hd int")
    want = {(x.i, x.j): x.ssim for x in similar.ssim_pairs(pairs, frames).collect()}
    got = {(x.i, x.j): x.ssim for x in similar.ssim_frames(pairs, frames, block_rows=5).collect()}
    assert got == pytest.approx(want, abs=2e-6) and len(want) == 66
    windowed = {(x.i, x.j): x.ssim for x in similar.ssim_frames(pairs, frames, 4).collect()}
    x, y = (np.array(frames.filter(F.col("id") == k).first()["values"]).reshape(8, 8) for k in (0, 1))
    one_window = lambda a, b: (2 * a.mean() * b.mean() + 1e-4) * (2 * (a * b).mean() - 2 * a.mean() * b.mean() + 9e-4) / ((a.mean() ** 2 + b.mean() ** 2 + 1e-4) * (a.var() + b.var() + 9e-4))
    plain = np.mean([one_window(x[i : i + 4, j : j + 4], y[i : i + 4, j : j + 4]) for i in (0, 4) for j in (0, 4)])
    assert windowed[0, 1] == pytest.approx(max(0, plain), abs=2e-6)
