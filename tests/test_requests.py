"""Requests end to end, files named by requests, and columns of any name."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators.collisions import resolve_collisions
from quillspark.operators.matching import match_requests, may_match, missing_files
from quillspark.plans.requests import convert_requests

from .helpers import plan_of


@pytest.mark.parametrize("limit", [64 << 20, 20_000])
def test_files_nobody_asks_for_are_left_out(spark, limit):
    files = spark.range(40_000).select(F.concat(F.lit("/f"), "id").alias("file"), F.repeat(F.lit("x"), 50).alias("text"), F.lit(1).alias("_map"))
    asked = spark.range(39_000, 45_000).select(F.concat(F.lit("/f"), "id").alias("file"), "id").unionByName(spark.createDataFrame([(None, -1)], "file string, id long"))
    left = may_match(files, asked, "file", limit)
    assert left.columns == files.columns
    kept = left.count()
    assert kept == 1000 if limit > 100_000 else 1000 <= kept < 20_000
    found, lost = match_requests(asked, files, "file", limit), missing_files(asked, files, "file", limit)
    assert found.count() == 1000 and found.select("file").distinct().count() == 1000
    assert {r["id"] for r in lost.collect()} == {-1, *range(40_000, 45_000)}


def test_content_is_sifted_before_it_is_shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in before:
        spark.conf.set(k, "-1")
    try:
        files = spark.range(100_000).select(F.col("id").alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        asked = spark.range(0, 100_000, 2).select(F.col("id").alias("file"))
        done = match_requests(asked, files, "file", 70_000)
        assert done.count() == 50_000
        plan = plan_of(done, "simple")
        join = plan.index("SortMergeJoin")
        # The filter of bits stands below the exchange of the files.
        assert plan.index("BroadcastHashJoin", join) > plan.index("Exchange hashpartitioning", join)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_key_tells_requests_for_one_file_apart(spark):
    asked = spark.createDataFrame([(1, "/a.txt", None), (2, "/a.txt", "html"), (3, "/b.txt", None), (4, "/a.txt", "nope")], "request int, file_path string, engine string")
    files = spark.createDataFrame([("/a.txt", "<p>x</p>", 9)], "file_path string, text string, request int")
    got = {r["request"]: (r["status"], r["engine"], r["markdown"], r["n_same_path"], r["survives"]) for r in convert_requests(asked, files, collisions=True).collect()}
    assert got == {
        1: ("ok", "text", "<p>x</p>", 2, False), 2: ("ok", "html", "x", 2, True), 3: ("error", None, None, 0, False), 4: ("error", "nope", None, 0, False),
    }


def test_page_ranges_are_applied(spark):
    pages = [("/d.html", i, f"<p>page {i}</p>") for i in range(6)] + [("/j.json", 0, "1"), ("/j.json", 1, "{bad"), ("/j.json", 2, "{}")]
    asked = [
        ("all", "/d.html", 0, None, None), ("some", "/d.html", 2, 3, None), ("over", "/d.html", 4, 2, None), ("none", "/d.html", 50, None, None),
        ("extra", "/d.html", 0, None, {"start_page": "5"}), ("lost", "/e.html", 0, None, None), ("bad", "/j.json", 0, 1, None), ("good", "/j.json", 2, None, None),
    ]
    requests = spark.createDataFrame(asked, "key string, file_path string, start_page int, end_page int, extra map<string,string>")
    files = spark.createDataFrame(pages, "file_path string, page int, text string")
    got = {r["key"]: (r["status"], r["error_kind"], r["errors"], r["markdown"], r["piece"]) for r in convert_requests(requests, files, part="page").collect()}
    assert got == {
        "all": ("ok", None, [], "\n\n".join(f"page {i}" for i in range(6)), 0),
        "some": ("ok", None, [], "page 2\n\npage 3", 0),
        "over": ("error", "BAD_REQUEST", ["end_page comes before start_page"], None, 0),
        "none": ("error", "CONVERSION_FAILED", ["No page in the range: /d.html"], None, 0),
        "extra": ("ok", None, [], "page 5", 0),
        "lost": ("error", "NOT_FOUND", ["File not found: /e.html"], None, 0),
        "bad": ("error", "CONVERSION_FAILED", ["json error: not valid JSON"], None, 0),
        "good": ("ok", None, [], "{}", 0),
    }
    long = convert_requests(requests.filter("key = 'all'"), files, part="page", max_bytes=20).orderBy("piece").collect()
    assert [r["markdown"] for r in long] == ["page 0\n\npage 1", "page 2\n\npage 3", "page 4\n\npage 5"]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_collisions_of_tables_with_any_names(spark, limit):
    rows = [("/o/a", f"f{i}", i, 1, 2, 3, 4) for i in range(5)] + [("/o/b", "g", 9, 1, 2, 3, 4), (None, "h", 9, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "output_path string, file string, _path int, _file int, _n int, `_last` int, _salt int")
    got = {r["file"]: (r["_path"], r["n_same_path"], r["survives"]) for r in resolve_collisions(df, broadcast_bytes=limit, hot_rows=2).collect()}
    assert got == {**{f"f{i}": (i, 5, i == 4) for i in range(5)}, "g": (9, 1, True), "h": (9, 0, False)}
