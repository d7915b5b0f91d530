"""A folder as a manifest of one level."""

import os

import pytest
from pyspark.errors import AnalysisException

from quillspark.sources.listing import list_folder


def _put(folder, name, content=b"x"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    return path


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "my docs [1]")


def test_every_file_of_one_level_is_a_row(spark, folder):
    for name, content in {"a.html": b"<p>a</p>", "B.HtMl": b"b", "long.csv": b"1" * 50, "none.pdf": b"", "x.exe": b"x", ".h.html": b"h", "_t.csv": b"t", "ü %20.csv": b"\xff", "plain": b"p"}.items():
        _put(folder, name, content)
    _put(folder, "deep.html/c.html", b"never listed")
    os.symlink("nowhere", os.path.join(folder, "gone.html"))
    for place in (folder, f"file://{folder}/"):
        rows = {r["name"]: r for r in list_folder(spark, place, max_bytes=49, content=True, partitions=3).collect()}
        assert {n: r["content"] and bytes(r["content"]) for n, r in rows.items() if r["status"] == "FOUND"} == {"a.html": b"<p>a</p>", "B.HtMl": b"b", "ü %20.csv": b"\xff"}
        reasons = {n: r["reason"] for n, r in rows.items() if r["status"] == "SKIPPED"}
        assert set(reasons) == {"long.csv", "none.pdf", "x.exe", ".h.html", "_t.csv", "plain", "gone.html"}
        assert "longer than 49" in reasons["long.csv"] and "empty" in reasons["none.pdf"] and "cannot be read" in reasons["gone.html"]
        assert reasons["x.exe"] == reasons["plain"] and reasons[".h.html"] == reasons["_t.csv"]
        assert all(r["path"] == f"{folder}/{n}" and (r["length"] is None) == (n == "gone.html") for n, r in rows.items())
    everything = list_folder(spark, folder, exts=[]).collect()
    assert {r["name"] for r in everything if r["status"] == "FOUND"} == {"a.html", "B.HtMl", "long.csv", "x.exe", "ü %20.csv", "plain"}


def test_files_are_opened_only_for_their_content(spark, folder):
    _put(folder, "a.html")
    os.mkfifo(os.path.join(folder, "pipe.html"))  # to open it would block; its length is 0
    listed = list_folder(spark, folder).collect()
    assert {(r["name"], r["status"], r["content"]) for r in listed} == {("a.html", "FOUND", None), ("pipe.html", "SKIPPED", None)}


def test_missing_and_empty_folders(spark, folder):
    with pytest.raises(AnalysisException):
        list_folder(spark, folder)
    os.makedirs(folder)
    assert list_folder(spark, folder).count() == 0
    with pytest.raises(ValueError):
        list_folder(spark, "s3a://bucket/folder")


def test_more_files_than_a_lot(spark, folder):
    for i in range(1500):
        _put(folder, f"{i}.csv", str(i).encode())
    rows = list_folder(spark, folder, content=True, partitions=1).collect()
    assert sorted(int(r["content"]) for r in rows) == list(range(1500))
