import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillspark.functions import html
from quillspark.operators.fallback import convert_with_fallback
from quillspark.operators.registry import (
    ConverterRegistry,
    default_registry,
    list_converters,
)
from quillspark.operators.report import batch_summary, status_report
from quillspark.operators.routing import engine_for_extension
from quillspark.plans.batch import convert_batch
from quillspark.plans.requests import convert_requests
from quillspark.plans.sink import export_files, run_batch, saved_markdown, write_markdown
from quillspark.schema import STATUS_COLUMNS

DOCS = [
    ("/in/page.html", "<h1>Hi</h1></html>", None),
    ("/in/cut.HTM", "<h1>Hi</h1>", None),
    ("/in/table.csv", "a,b\n1,2", None),
    ("/in/bad.csv", 'a\n"b', None),
    ("/in/data.json", "{bad", None),
    ("/in/data.xml", "<a/>", None),
    ("/in/note.txt", "hello", None),
    ("/in/paper.pdf", "%PDF", None),
    ("/in/image.png", "x", None),
    ("/in/forced.png", "plain", "TEXT"),
    ("/in/wrong.txt", "x", "nope"),
    ("/in/none.txt", None, None),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "file string, text string, engine string")


def _by_file(df):
    return {r["file"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_one_bad_document_does_not_stop_the_batch(docs):
    got = _by_file(convert_batch(docs))
    assert len(got) == len(DOCS)
    ok = {n: (r["engine"], r["fallback"], r["markdown"]) for n, r in got.items() if r["status"] == "ok"}
    assert ok == {
        "page.html": ("html", False, "# Hi"),
        "cut.HTM": ("html", False, "# Hi"),
        "table.csv": ("csv", False, "| a | b |\n| --- | --- |\n| 1 | 2 |"),
        "data.xml": ("xml", False, "<a/>"),
        "note.txt": ("text", False, "hello"),
        "forced.png": ("text", False, "plain"),
    }
    errors = {n: (r["error_kind"], r["errors"]) for n, r in got.items() if r["status"] == "error"}
    assert errors == {
        "bad.csv": ("CONVERSION_FAILED", ["csv error: quoted field without end"]),
        "data.json": ("CONVERSION_FAILED", ["json error: not valid JSON"]),
        "paper.pdf": ("BAD_REQUEST", ["No converter registered for pdf"]),
        "image.png": ("BAD_REQUEST", ["No converter supports '.png'"]),
        "wrong.txt": ("BAD_REQUEST", ["Unknown engine: nope"]),
        "none.txt": ("CONVERSION_FAILED", ["text error: no text"]),
    }
    for name in errors:
        assert got[name]["markdown"] is None and got[name]["output_path"] is None
    assert got["page.html"]["output_path"] == "/in/page/page.md"


def test_batch_options(spark, docs):
    refused = convert_batch(docs, options={"lang": "xx"}, collisions=False)
    assert {r["error_kind"] for r in refused.collect()} == {"BAD_REQUEST"}
    elsewhere = convert_batch(docs, mode="folder", base_dir="/in", options={"output_dir": "/out"})
    assert _by_file(elsewhere)["note.txt"]["output_path"] == "/out/note/note.md"
    all_text = convert_batch(docs.drop("engine"), default_engine="TEXT", collisions=False)
    assert _by_file(all_text)["paper.pdf"]["engine"] == "text"
    with pytest.raises(ValueError):
        convert_batch(docs, default_engine="nope")


def test_an_upload_name_gives_stem_and_extension(spark):
    df = spark.createDataFrame(
        [("tmp/1", "C/x/Report.final.txt", "hi")], "file string, name string, text string"
    )
    row = convert_batch(df, mode="inbox", base_dir="/landing").first()
    assert (row["file"], row["output_path"]) == ("tmp/1", "/landing/Report.final/Report.final.md")


def test_both_failures_are_told(spark):
    df = spark.createDataFrame([(1, None), (2, "<p>"), (3, "<p>x</html>")], "id int, text string")
    done = convert_with_fallback(
        df,
        ("html", html.html_columns),
        ("text", html.tagless_columns),
        html.html_is_closed(F.col("text")),
    ).orderBy("id")
    rows = done.collect()
    assert rows[0]["errors"] == ["html error: no text", "text error: no text"]
    assert [r["engine"] for r in rows[1:]] == ["text (fallback from html)", "html"]
    assert [r["errors"] for r in rows[1:]] == [[], []]


def test_report_is_ordered_and_without_markdown(docs):
    report = status_report(convert_batch(docs, collisions=False))
    assert report.columns == STATUS_COLUMNS
    rows = report.collect()
    assert [r["file"] for r in rows] == sorted(d[0] for d in DOCS)
    for r in rows:
        assert (r["detail"] is None) == (r["status"] == "ok")
        assert (r["output_path"] is None) == (r["status"] == "error")


def test_summary_counts_every_document(docs):
    summary = batch_summary(convert_batch(docs, collisions=False))
    assert summary.agg(F.sum("n_docs")).first()[0] == len(DOCS)
    assert summary.filter("fallback").count() == 0


def test_registry_rules(spark):
    registry = ConverterRegistry()
    with pytest.raises(ValueError):
        registry.register_converter("", [".x"], lambda df: df)
    registry.register_converter("b", [".X"], "first")
    registry.register_converter("a", [".x", ".y"], "second", rank=1)
    registry.register_converter("b", [".x", ".z", ".tie"], "third")
    registry.register_converter("A2", [".tie"], "fourth")
    assert registry.list_converters() == ["b", "a", "a2"]
    assert registry.get("b").frame == "third"
    exts = spark.createDataFrame([(".X",), (".y",), (".z",), (".w",), (".tie",)], "ext string")
    joined = engine_for_extension(exts, registry.support(spark))
    assert {r["ext"]: r["engine"] for r in joined.collect()} == {".X": "a", ".y": "a", ".z": "b", ".w": None, ".tie": "b"}
    inline = exts.select("ext", registry.engine_of(F.col("ext")).alias("engine"))
    assert inline.exceptAll(joined).count() == 0
    assert list_converters() == ["pdf", "html", "csv", "json", "xml", "text"]


def test_a_pandas_converter_takes_its_own_rows(spark, docs):
    registry = default_registry()

    def parse(df):
        def run(batches):
            for pdf in batches:
                bad = pdf["text"].isna()
                yield pd.DataFrame(
                    {
                        **{c: pdf[c] for c in pdf.columns},
                        "markdown": pdf["text"].str.lower(),
                        "error": pd.Series(["empty" if b else None for b in bad], index=pdf.index, dtype=object),
                    }
                )

        added = [StructField("markdown", StringType()), StructField("error", StringType())]
        schema = StructType(df.schema.fields + added)
        return df.mapInPandas(run, schema)

    registry.register_converter("pdf", [".pdf"], parse, rank=0)
    got = _by_file(convert_batch(docs, registry=registry, collisions=False))
    assert len(got) == len(DOCS)
    assert (got["paper.pdf"]["engine"], got["paper.pdf"]["markdown"]) == ("pdf", "%pdf")
    assert got["note.txt"]["markdown"] == "hello"


def test_a_binary_parser_gets_the_raw_bytes(spark):
    registry = default_registry()

    def parse(df):
        return df.withColumns(
            {"markdown": F.hex("content"), "error": F.lit(None).cast("string")}
        )

    registry.register_converter("pdf", [".pdf"], parse)
    df = spark.createDataFrame(
        [("/a.pdf", b"\xff\x01"), ("/b.txt", b"\xff"), ("/c.txt", b"c")], "file string, content binary"
    )
    got = {r["file"]: (r["status"], r["markdown"]) for r in convert_batch(df, registry=registry).collect()}
    assert got == {"/a.pdf": ("ok", "FF01"), "/b.txt": ("error", None), "/c.txt": ("ok", "c")}


def test_requests_for_missing_files(spark):
    asked = spark.createDataFrame(
        [("/a.txt", None), ("/b.txt", None), ("/c.txt", "xx"), ("/a.txt", "en")],
        "file_path string, lang string",
    )
    files = spark.createDataFrame([("/a.txt", "hi")], "file_path string, text string")
    got = sorted(
        (r["file"], r["status"], r["error_kind"] or "", "; ".join(r["errors"])[:31])
        for r in convert_requests(asked, files).collect()
    )
    assert got == [
        ("/a.txt", "ok", "", ""),
        ("/a.txt", "ok", "", ""),
        ("/b.txt", "error", "NOT_FOUND", "File not found: /b.txt"),
        ("/c.txt", "error", "BAD_REQUEST", "lang 'xx' is not known; use one"),
    ]


COLLIDING = [("/x/a.txt", "old"), ("/y/a.html", "<p>new</p></html>"), ("/x/b.txt", "b"), ("/z/a.json", "{bad")]


def test_the_last_good_file_of_a_path_is_saved(spark, folder):
    df = spark.createDataFrame(COLLIDING, "file string, text string")
    results = convert_batch(df, mode="folder", base_dir="/out", collisions=True)
    write_markdown(results, f"{folder}/saved")
    saved = spark.read.parquet(f"{folder}/saved")
    rows = sorted((r["output_path"], r["file"], r["markdown"]) for r in saved.collect())
    assert rows == [("/out/a/a.md", "/y/a.html", "new"), ("/out/b/b.md", "/x/b.txt", "b")]
    write_markdown(results.filter("file like '/x/%'").drop("n_same_path", "survives"), f"{folder}/saved")
    again = spark.read.parquet(f"{folder}/saved")
    assert sorted(r["file"] for r in again.collect()) == ["/x/a.txt", "/x/b.txt"]
    export_files(again, f"{folder}/files")
    texts = spark.read.text(f"{folder}/files").collect()
    assert sorted((r["stem"], r["value"]) for r in texts) == [("a", "old"), ("b", "b")]


def test_run_batch_reports_from_the_store(spark, folder):
    df = spark.createDataFrame(COLLIDING, "file string, text string")
    status = run_batch(df, folder, mode="folder", base_dir="/out")
    assert "markdown" not in status.columns
    flags = {r["file"]: (r["n_same_path"], r["survives"]) for r in status.collect()}
    assert flags == {
        "/x/a.txt": (2, False),
        "/y/a.html": (2, True),
        "/x/b.txt": (1, True),
        "/z/a.json": (0, False),
    }
    assert sorted(r["file"] for r in saved_markdown(spark, folder).collect()) == ["/x/b.txt", "/y/a.html"]


LONG = "Quarterly report of the northern region {} 2024"


def test_long_names_that_begin_alike_are_all_saved(spark, folder):
    months = ["January", "February", "March"]
    df = spark.createDataFrame([(f"/in/{LONG.format(m)}.txt", m) for m in months], "file string, text string")
    status = run_batch(df, folder, mode="folder", base_dir="/out").collect()
    assert all((r["n_same_path"], r["survives"]) == (1, True) for r in status)
    saved = {r["output_path"]: r["markdown"] for r in saved_markdown(spark, folder).collect()}
    assert saved == {f"/out/{LONG.format(m)}/{LONG.format(m)}.md": m for m in months}


def test_a_report_keeps_every_reason(spark):
    rows = [("/a.txt", "error", [f"reason {i} " + "x" * 100 for i in range(20)])]
    df = spark.createDataFrame(rows, "file string, status string, errors array<string>")
    for name in ("engine", "output_path", "images_dir", "output_dir"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    detail = status_report(df.withColumn("fallback", F.lit(False))).first()["detail"]
    assert all(f"reason {i} " in detail for i in range(20))


def test_a_converter_of_mixed_case_runs_once_per_row(spark):
    registry, seen = default_registry(), spark.sparkContext.accumulator(0)

    def shout(df):
        @F.udf("string")
        def loud(text):
            seen.add(1)
            return text.upper()

        return df.withColumns({"markdown": loud("text"), "error": F.lit(None).cast("string")})

    registry.register_converter("Shout", [".sh"], shout)
    df = spark.createDataFrame([(f"/{i}.sh", "a", "SHOUT") for i in range(10)], "file string, text string, engine string")
    rows = convert_batch(df, registry=registry).collect()
    assert {(r["engine"], r["status"], r["markdown"]) for r in rows} == {("shout", "ok", "A")}
    assert seen.value == 10
