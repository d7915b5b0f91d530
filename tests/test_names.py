import pytest
from pyspark.sql import functions as F

from quillspark.functions import names

from .helpers import column_values

EDGE_NAMES = {
    "a.html": ("a", ".html"),
    "a.tar.gz": ("a.tar", ".gz"),
    ".html": (".html", ""),
    "noext": ("noext", ""),
    "a.": ("a.", ""),
    "a..b": ("a.", ".b"),
    ".a.b": (".a", ".b"),
    "..x": (".", ".x"),
    "A.PDF": ("A", ".PDF"),
    "é.Html": ("é", ".Html"),
    "a b.csv": ("a b", ".csv"),
    "line\nbreak.txt": ("line\nbreak", ".txt"),
}


def test_stem_and_extension_of_edge_names(spark):
    got = column_values(spark, EDGE_NAMES, names.file_parts)
    assert [(r["stem"], r["ext"]) for r in got] == list(EDGE_NAMES.values())


def test_directories_and_a_trailing_slash_are_stripped(spark):
    got = column_values(spark, ["/x/y/a.csv", "x/a.csv/", "file:/x/a b.csv"], names.file_parts)
    assert [r["name"] for r in got] == ["a.csv", "a.csv", "a b.csv"]


def test_parents(spark):
    paths = ["/x/y/a.csv", "/a.csv", "a.csv", "x/a.csv/", "s3://b/k/a.csv"]
    assert column_values(spark, paths, names.parent_dir) == ["/x/y", "/", ".", "x", "s3://b/k"]


def test_url_path_drops_query_and_fragment(spark):
    urls = ["http://h/a.html?x=/b.c#d", "http://h/a#top?x", "http://h/a"]
    assert column_values(spark, urls, names.url_path) == ["http://h/a.html", "http://h/a", "http://h/a"]


def test_only_long_stems_are_cleaned_and_cut(spark):
    stems = ["a:b?c", "x" * 40, "x" * 41, '<>:"/\\|?*' + "y" * 40, "é" * 41]
    got = column_values(spark, stems, names.safe_name)
    assert got == ["a:b?c", "x" * 40, "x" * 30, "_" * 9 + "y" * 21, "é" * 30]


@pytest.mark.parametrize(
    "mode, base, asked, expected",
    [
        ("single", None, None, ("/in/sub", "/in/sub/a/a.md")),
        ("single", None, "", ("/in/sub", "/in/sub/a/a.md")),
        ("single", None, "/out/", ("/out", "/out/a/a.md")),
        ("folder", "/in", None, ("/in", "/in/a/a.md")),
        ("inbox", "/landing", None, ("/landing", "/landing/a/a.md")),
        ("folder", "/", None, ("/", "/a/a.md")),
    ],
)
def test_output_location(spark, mode, base, asked, expected):
    def place(path):
        requested = F.lit(asked).cast("string")
        return names.output_location(path, requested, names.file_parts(path)["stem"], mode, base)

    got = column_values(spark, ["/in/sub/a.pdf"], place)[0]
    assert (got["output_dir"], got["output_path"]) == expected


def test_unknown_output_modes_are_refused():
    with pytest.raises(ValueError):
        names.output_location(None, None, None, "other")
    with pytest.raises(ValueError):
        names.output_location(None, None, None, "folder")
