import base64
import gzip
import hashlib
import json

import pytest

from dittograph.llm import warc as W

SCHEMA = "page_id long, url string, html string, shard int, record string"
PAGES = [(k, f"http://{'abc'[k % 3]}.example/{k}", f"<p>{'x' * (k * 37 % 500)} {k} é</p>", 5, "r") for k in range(200)]
ODD = [
    (None, "http://z.example/", "null id", 1, "r"), (300, None, "no url", 1, "r"), (301, "http://a.example/n", None, 1, "r"), (302, "http://a.example/e", "", 1, "r"),
    (303, "http://a.example/\r\nX: y", "<b>", 1, "r"), (304, "http://b.example/long", "word " * 300_000, 1, "r"), (305, "http://b.example/d", "same", 1, "r"), (305, "http://b.example/d", "same", 1, "r"),
]


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize(("shard", "roll"), [(W.SHARD_BYTES, W.FILE_BYTES), (4000, 3000)])
def test_round_trip(spark, tmp_path, shard, roll):
    pages = spark.createDataFrame(PAGES + ODD, SCHEMA).repartition(5)
    index = W.write(pages, f"file://{tmp_path}/w", shard, roll).collect()
    records = [r for r in W.read(f"file://{tmp_path}/w")]
    full = [r for r in records if r["headers"]["WARC-Type"] == "response"]
    want = [(i, u, h) for i, u, h, *_ in PAGES + ODD if u is not None and h is not None]
    assert len(full) == len(index) == len(want)
    # in order of the key over all files
    urls = sorted((u, -1 if i is None else i) for i, u, _ in want)
    assert [r["headers"]["WARC-Target-URI"] for r in full] == [u.replace("\r\n", "%0D%0A").replace(" ", "%20") for u, _ in urls]
    by = {}
    for i, u, h in want:
        by.setdefault(u.replace("\r\n", "%0D%0A").replace(" ", "%20"), h)
    for r in full:
        head, _, body = r["block"].partition(b"\r\n\r\n")
        assert body.decode() == by[r["headers"]["WARC-Target-URI"]]
        assert r["headers"]["WARC-Payload-Digest"] == digest(body) and r["headers"]["WARC-Block-Digest"] == digest(r["block"])
        assert f"Content-Length: {len(body)}".encode() in head
    assert sorted((x.file, x.offset, x.length) for x in index) == sorted((r["file"], r["offset"], r["length"]) for r in full)
    for line in (tmp_path / "w" / "MANIFEST.jsonl").read_text().splitlines():
        f = json.loads(line)
        data = (tmp_path / "w" / f["file"]).read_bytes()
        assert f["bytes"] == len(data) and f["digest"] == "sha256:" + hashlib.sha256(data).hexdigest()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        if roll == 3000:
            assert f["records"] == 1 or f["bytes"] <= roll
    if roll == 3000:
        assert len({x.file for x in index}) > 10
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith(".tmp")]


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    for k, n in enumerate((1, 7)):
        W.write(spark.createDataFrame(PAGES, SCHEMA).repartition(n), f"file://{tmp_path}/{k}", 4000, 3000)
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / k).glob("part-*")} for k in "01")
    assert a == b and len(a) > 5
    assert (tmp_path / "0/MANIFEST.jsonl").read_text() == (tmp_path / "1/MANIFEST.jsonl").read_text()


def test_files_of_failed_attempts_go(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/.tmp-part-000000-00000.warc.gz-7-x").write_bytes(b"half a record")
    W.write(spark.createDataFrame(PAGES[:5], SCHEMA), f"file://{tmp_path}/w")
    assert sorted(p.name for p in (tmp_path / "w").iterdir() if not p.name.startswith(".part")) == ["MANIFEST.jsonl", "index", "part-000000-00000.warc.gz"]


def test_empty_table(spark, tmp_path):
    assert W.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w").collect() == []
    assert (tmp_path / "w/MANIFEST.jsonl").read_text() == ""
