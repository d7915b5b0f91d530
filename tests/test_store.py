"""Runs over one store, and an inbox whose files change."""

import os

from quillspark.catalog import inputs
from quillspark.catalog.queries import QUERIES
from quillspark.plans.sink import run_batch, saved_markdown
from quillspark.streaming.inbox import inbox_results, stream_inbox

from .helpers import plan_of

SCHEMA = "file string, text string"


def _saved(spark, folder):
    return sorted((r["output_path"], r["file"], r["markdown"]) for r in saved_markdown(spark, folder).collect())


def test_a_rerun_replaces_only_its_files(spark, folder):
    options = {"mode": "folder", "base_dir": "/out"}
    first = [("/a.txt", "a"), ("/b.txt", "b"), ("/x/c.txt", "old"), ("/y/c.txt", "new")]
    run_batch(spark.createDataFrame(first, SCHEMA), folder, **options)
    assert _saved(spark, folder) == [("/out/a/a.md", "/a.txt", "a"), ("/out/b/b.md", "/b.txt", "b"), ("/out/c/c.md", "/y/c.txt", "new")]
    before = {f: os.stat(f"{folder}/results/run=0/{f}").st_mtime_ns for f in os.listdir(f"{folder}/results/run=0")}
    status = run_batch(spark.createDataFrame([("/b.txt", "b2"), ("/y/c.json", "{bad"), ("/z/c.txt", "last")], SCHEMA), folder, **options)
    assert {r["file"]: (r["status"], r["n_same_path"], r["survives"]) for r in status.collect()} == {
        "/b.txt": ("ok", 1, True), "/y/c.json": ("error", 0, False), "/z/c.txt": ("ok", 3, True),
    }
    assert _saved(spark, folder) == [("/out/a/a.md", "/a.txt", "a"), ("/out/b/b.md", "/b.txt", "b2"), ("/out/c/c.md", "/z/c.txt", "last")]
    assert before == {f: os.stat(f"{folder}/results/run=0/{f}").st_mtime_ns for f in os.listdir(f"{folder}/results/run=0")}
    # The last file of a path fails now: the one before has the path again.
    run_batch(spark.createDataFrame([("/z/c.txt", None)], SCHEMA), folder, **options)
    assert _saved(spark, folder)[-1] == ("/out/c/c.md", "/y/c.txt", "new")


def test_reading_survivors_moves_no_text(spark, folder):
    for text in ("one", "two"):
        run_batch(spark.createDataFrame([(f"/{i % 40}/{i % 7}.txt", text) for i in range(60)][:40], SCHEMA), folder)
    plan = plan_of(saved_markdown(spark, folder), "simple")
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def _put(folder, name, data, seconds):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)
    os.utime(f"{folder}/{name}", (seconds, seconds))


def test_changed_files_are_converted_again(spark, folder):
    inbox, out, state = f"{folder}/inbox", f"{folder}/out", f"{folder}/state"

    def run(**options):
        stream_inbox(spark, inbox, out, state, landing="/l", **options).awaitTermination()
        rows = inbox_results(spark, out).collect()
        return {os.path.basename(r["file"]): (r["markdown"], r["batch_id"], r["survives"]) for r in rows}

    assert inbox_results(spark, out).count() == 0
    _put(inbox, "a.csv", b"a\n1", 1000)
    _put(inbox, "b.html", b"<p>one</p>", 2000)
    first = run()
    assert first == {"a.csv": ("| a |\n| --- |\n| 1 |", 0, True), "b.html": ("one", 0, True)}
    assert run() == first
    _put(inbox, "b.html", b"<p>two</p>", 3000)
    _put(inbox, "c.htm", b"<p>new</p>", 1500)
    third = run()
    assert {n: m for n, (m, _, _) in third.items()} == {"a.csv": "| a |\n| --- |\n| 1 |", "b.html": "two", "c.htm": "new"}
    assert third["a.csv"] == first["a.csv"] and all(s for _, _, s in third.values())
    # Back to an earlier version: differs from the last one, so it counts.
    _put(inbox, "b.html", b"<p>one</p>", 2000)
    assert run()["b.html"][0] == "one"
    os.makedirs(f"{out}/batch_id=99/_temporary")
    assert len(run()) == 3


def test_micro_batches_of_bounded_size(spark, folder):
    inbox, out, state = f"{folder}/inbox", f"{folder}/out", f"{folder}/state"
    for i in range(5):
        _put(inbox, f"{i}.html", b"x", 1000 + i)
    stream_inbox(spark, inbox, out, state, max_files=2).awaitTermination()
    rows = inbox_results(spark, out).groupBy("batch_id").count().collect()
    assert sum(r["count"] for r in rows) == 5 and len(rows) >= 3 and max(r["count"] for r in rows) <= 2


def test_the_inbox_query_keeps_addresses_and_paths(spark, folder):
    rows = [(0, "http://a/x.html", "<p>0</p>"), (1, "http://b/x.html", "<p>1</p>"), (2, "http://c/x.html", "<p>2</p>"), (3, "http://a/y.html", "<p>3</p>")]
    rows += [(4, "http://d/z.html", "<p>4</p>"), (5, "http://d/z.html", "<p>5</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = {(r["file"], r["markdown"], r["output_path"], r["n_same_path"], r["survives"]) for r in QUERIES["stream_inbox"](spark, folder).collect()}
    x, y, z = (f"/out/{n}/{n}.md" for n in "xyz")
    assert got == {
        ("http://a/x.html", "0", x, 3, False), ("http://b/x.html", "1", x, 3, True), ("http://c/x.html", "2", x, 3, False),
        ("http://a/y.html", "3", y, 1, True), ("http://d/z.html", "5", z, 1, True),
    }


def test_page_files_are_written_by_several_tasks(spark, folder):
    rows = spark.range(450).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "concat('<p>', id) AS html").coalesce(1)
    inputs.write_saved_pages(rows, f"{folder}/inbox")
    names = [n for n in os.listdir(f"{folder}/inbox") if n.startswith("part-")]
    assert len(names) == 450 and len({n.split("-")[1] for n in names}) == 3


def test_a_run_lists_and_opens_only_what_changed(spark, folder):
    inbox, out, state = f"{folder}/inbox", f"{folder}/out", f"{folder}/state"
    run = lambda: stream_inbox(spark, inbox, out, state).awaitTermination()
    for i in range(300):
        _put(inbox, f"{i}.html", b"x", 1000 + i)
    run()
    assert len([n for n in os.listdir(f"{state}/listings") if n.startswith("part-")]) <= 4
    assert len([n for n in os.listdir(f"{out}/batch_id=0") if n.startswith("part-")]) <= 8
    _put(inbox, "7.html", b"y", 5000)
    run()
    run()
    assert spark.read.parquet(f"{state}/listings").count() == 301
    assert sorted(r["batch_id"] for r in inbox_results(spark, out).collect()) == [0] * 299 + [1]


def test_page_files_hold_their_rows_and_come_beside_others(spark, folder):
    rows = spark.createDataFrame([("a",), ("é\n",), (None,), ("",)], "html string")
    inputs.write_page_files(rows, f"{folder}/pages")
    inputs.write_page_files(rows.limit(1), f"{folder}/pages")
    names = os.listdir(f"{folder}/pages")
    texts = [open(f"{folder}/pages/{n}", "rb").read() for n in names if n.startswith("part-")]
    assert sorted(texts) == sorted([b"a\n", "é\n\n".encode(), b"\n", b"\n", b"a\n"])
    # Written by the tasks themselves, no check sums beside them, and the mark of a write that ended.
    assert [n for n in names if not n.startswith("part-") and not n.endswith("_SUCCESS.crc")] == ["_SUCCESS"]
