"""Snapshots of files: whole copies, refused damage, hidden and empty files, unfinished snapshots."""

import datetime as dt
import hashlib
import os

import pytest

from jobsift.session import local_path, work_path
from jobsift.sources import files as FI
from jobsift.sources import sinks as K

TS = dt.datetime(2024, 2, 1)


@pytest.fixture()
def landed(tmp_path):
    root = tmp_path / "in"
    (root / "a" / "b").mkdir(parents=True)
    contents = {"top.bin": os.urandom(70_000), "a/_SUCCESS": b"", "a/b/ü name.json": b'{"x": 1}', "a/same": b"s", "a/b/same": b"s",
                "big": os.urandom(3) * (FI.BLOCK // 2)}
    for name, data in contents.items():
        (root / name).write_bytes(data)
    (root / "a" / f"left{FI.PART}").write_bytes(b"half")
    return root, contents


def _snap(spark, root):
    return K.snapshot(spark.range(5), work_path(spark, "backups"), TS, files_root=str(root))


def test_round_trip(spark, landed, tmp_path):
    root, contents = landed
    path = _snap(spark, root)
    manifest = {r["name"]: (r["size"], r["sha256"]) for r in spark.read.parquet(f"{path}/manifest").collect()}
    assert manifest == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in contents.items()}
    to = tmp_path / "out"
    assert {r["status"] for r in K.restore_snapshot_files(spark, path, str(to)).collect()} == {"ok"}
    assert {str(p.relative_to(to)): p.read_bytes() for p in to.rglob("*") if p.is_file()} == contents


@pytest.mark.parametrize("harm, word", [("flip", "damaged"), ("remove", "missing"), ("longer", "damaged")])
def test_damage_is_refused(spark, landed, tmp_path, harm, word):
    path = _snap(spark, landed[0])
    held = os.path.join(local_path(path), "files", "top.bin")
    if harm == "remove":
        os.rename(held, held + ".away")
    else:
        data = bytearray(open(held, "rb").read())
        data[1000] ^= harm == "flip"
        open(held, "wb").write(bytes(data) + (b"x" if harm == "longer" else b""))
    to = tmp_path / "out"
    with pytest.raises(ValueError, match=f"1 files .* top.bin {word}"):
        K.restore_snapshot_files(spark, path, str(to))
    assert not to.exists()  # nothing of it is restored


def test_snapshots_without_files(spark, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    path = _snap(spark, empty)
    assert K.restore_snapshot_files(spark, path, str(tmp_path / "out")).count() == 0
    plain = K.snapshot(spark.range(5), work_path(spark, "backups"), TS)
    with pytest.raises(ValueError, match="holds no files"):
        K.restore_snapshot_files(spark, plain, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        K.snapshot(spark.range(5), work_path(spark, "backups"), TS, files_root=str(tmp_path / "absent"))


def test_unfinished_snapshot_is_listed_without_metadata(spark):
    root = work_path(spark, "backups")
    K.snapshot(spark.range(5), root, TS)
    spark.range(3).write.parquet(f"{root}/snapshot=20240301_000000/data")
    rows = {r["name"]: r for r in K.list_snapshots(spark, root).collect()}
    assert rows["20240301_000000"]["metadata"] is None and rows["20240201_000000"]["metadata"]["n_rows"] == 5
    assert rows["20240201_000000"]["location"] == "local"
    with pytest.raises(Exception, match="(?i)path|metadata"):
        K.restore_snapshot(spark, f"{root}/snapshot=20240301_000000", work_path(spark, "table"), TS)
