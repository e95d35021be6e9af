"""Trees on a file system: what a listing sees, and what reading by ranges reads."""

import hashlib
import os
from pathlib import Path

from sharescope.sources import listing as G

from tests.fixtures import frame


def test_every_entry_once_whatever_the_shards(spark, tmp_path):
    want = set()
    for a in range(4):
        for deep in ("", "b", "b/c", "b/c/d/e"):
            folder = tmp_path / "s" / f"a{a}" / deep
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"f {a}.txt").write_bytes(b"x" * a)
            os.utime(folder / f"f {a}.txt", (1_600_000_000, 1_600_000_000))
    os.symlink(tmp_path / "s" / "a0", tmp_path / "s" / "loop")
    os.symlink(tmp_path / "s" / "nowhere", tmp_path / "s" / "broken")
    for place, folders, files in os.walk(tmp_path / "s"):
        path = os.path.relpath(place, tmp_path / "s").replace(".", "", 1) if place == str(tmp_path / "s") else os.path.relpath(place, tmp_path / "s")
        want |= {(path, n, True) for n in folders} | {(path, n, False) for n in files}
    for shards in (1, 3, 16):
        entries, unlisted = G.list_shares(spark, {7: str(tmp_path / "s"), 8: f"file:{tmp_path}/none"}, shards)
        rows = entries.collect()
        assert {(r.path, r.name, r.is_dir) for r in rows} == want and len(rows) == len(want)
        assert {r.name for r in rows if r.is_reparse_point} == {"loop", "broken"}
        assert all(str(r.mtime) == "2020-09-13 12:26:40" and r.ctime is not None for r in rows if r.name.startswith("f "))
        assert {r["size"] for r in rows if r.is_dir} == {0}
        assert [(r.share_id, r.path) for r in unlisted.collect()] == [(8, "")]


def test_no_shares(spark):
    entries, unlisted = G.list_shares(spark, {})
    assert entries.count() == 0 and unlisted.count() == 0


def test_ranges(spark, tmp_path):
    sizes = [0, 1, 99, 100, 101, 199, 200, 201, 5000]
    rows = []
    for i, n in enumerate(sizes):
        blob = bytes((i * 31 + j * 7) % 256 for j in range(n))
        Path(tmp_path / f"{i}").write_bytes(blob)
        rest = blob[-100:] if n > 200 else blob[100:]
        rows.append((i, hashlib.sha256(str(n).encode() + blob[:100] + rest).hexdigest(), hashlib.sha256(blob).hexdigest()))
    located = frame(spark, [(i, str(tmp_path / f"{i}")) for i in range(len(sizes))] + [(98, str(tmp_path / "absent")), (99, None)], "file_id bigint, location string")
    ends = {r.file_id: r for r in G.hash_files(located, 100).collect()}
    whole = {r.file_id: r for r in G.hash_files(located, None).collect()}
    for i, quick, full in rows:
        assert (ends[i].hash, ends[i].bytes_read, ends[i].error) == (quick, min(sizes[i], 200), None)
        assert (whole[i].hash, whole[i].bytes_read) == (full, sizes[i])
    assert ends[98].error.startswith("FileNotFoundError") and ends[99].error and ends[98].hash is None and ends[99].hash is None


def test_written_again(spark, tmp_path):
    files = frame(spark, [(f"{tmp_path}/x/a.txt", bytearray(b"one"), None), (f"{tmp_path}/x/b.txt", None, None)], "location string, content binary, mtime timestamp_ntz")
    for _ in range(2):
        assert sorted((Path(r.location).name, r["size"]) for r in G.write_tree(files).collect()) == [("a.txt", 3), ("b.txt", 0)]
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["a.txt", "b.txt"]
