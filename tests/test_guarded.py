"""Registered converters that fail: error rows, second converters, call counts."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators.guarded import halving
from quillspark.operators.registry import default_registry
from quillspark.plans.batch import convert_batch


def _docs(spark, rows):
    return spark.createDataFrame(rows, "file string, text string, engine string").repartition(3)


def test_a_bad_row_is_found_by_halving():
    import pandas as pd

    calls = []

    def fn(pdf):
        calls.append(len(pdf))
        if (pdf["text"] == "bad").any():
            raise ValueError("bad text")
        return pdf["text"] + "!"

    pdf = pd.DataFrame({"text": ["a", "b", "bad", "c"]})
    assert halving("x", fn, pdf) == [("a!", None), ("b!", None), (None, "x error: bad text"), ("c!", None)]
    assert calls == [4, 2, 2, 1, 1]
    assert halving("x", lambda pdf: [None] * len(pdf), pdf)[0] == (None, "x error: no Markdown")
    assert halving("x", lambda pdf: ["a"], pdf)[1] == ("a", None)


def test_raising_hanging_and_dying_documents_are_error_rows(spark):
    bad = {17: "raise", 400: "raise", 999: "raise", 640: "hang", 77: "die"}

    def fn(pdf):
        for text in pdf["text"]:
            if text == "raise":
                raise RuntimeError("broken file")
            if text == "hang":
                time.sleep(3600)
            if text == "die":
                os._exit(3)
        return pdf["text"].str.upper()

    registry = default_registry()
    registry.register_function("Parser", [".bin"], fn, seconds=2)
    rows = [(f"/{i}.bin", bad.get(i, "fine"), None) for i in range(1000)]
    got = {r["file"]: r for r in convert_batch(_docs(spark, rows), registry=registry).collect()}
    assert len(got) == 1000 and sum(r["status"] == "ok" for r in got.values()) == 995
    assert {got[f"/{i}.bin"]["errors"][0] for i in (17, 400, 999)} == {"parser error: broken file"}
    assert got["/640.bin"]["errors"] == ["parser error: no answer within 2 seconds"]
    assert got["/77.bin"]["errors"] == ["parser error: the converter's process ended"]
    assert {r["markdown"] for r in got.values()} == {"FINE", None}


def test_failed_rows_alone_go_to_the_second_converter(spark):
    first, second = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    registry = default_registry()

    def parse(pdf):
        first.add(len(pdf))
        return [None if text.startswith("x") else f"pdf {text}" for text in pdf["text"]]

    def other(pdf):
        second.add(len(pdf))
        return [None if text == "xx" else f"other {text}" for text in pdf["text"]]

    registry.register_function("pdf", [".pdf"], parse, rank=0, fallback="Other")
    registry.register_function("other", [], other)
    rows = [("/a.pdf", "a", None), ("/b.pdf", "xb", None), ("/c.pdf", "xx", None), ("/d.txt", "d", None), ("/e.pdf", "xe", "nope"), ("/f.png", "f", None)]
    results = convert_batch(_docs(spark, rows), registry=registry)
    got = {r["file"]: (r["status"], r["engine"], r["fallback"], r["error_kind"], r["errors"], r["markdown"]) for r in results.collect()}
    assert got == {
        "/a.pdf": ("ok", "pdf", False, None, [], "pdf a"),
        "/b.pdf": ("ok", "other (fallback from pdf)", True, None, [], "other xb"),
        "/c.pdf": ("error", "other (fallback from pdf)", True, "CONVERSION_FAILED", ["pdf error: no Markdown", "other error: no Markdown"], None),
        "/d.txt": ("ok", "text", False, None, [], "d"),
        "/e.pdf": ("error", "nope", False, "BAD_REQUEST", ["Unknown engine: nope"], None),
        "/f.png": ("error", None, False, "BAD_REQUEST", ["No converter supports '.png'"], None),
    }
    assert (first.value, second.value) == (3, 2)
    results.count()
    assert first.value == 3  # stored, not run again


def test_fallback_of_binary_files(spark):
    registry = default_registry()
    registry.register_converter("pdf", [".pdf"], lambda df: df.withColumns({"markdown": F.lit("p"), "error": F.when(F.hex("content").startswith("00"), "pdf error: empty")}), fallback="text")
    rows = [("/a.pdf", b"\x01"), ("/b.pdf", b"\x00"), ("/c.pdf", b"\x00\xff")]
    got = {r["file"]: (r["engine"], r["errors"], r["markdown"]) for r in convert_batch(spark.createDataFrame(rows, "file string, content binary"), registry=registry).collect()}
    assert got["/a.pdf"] == ("pdf", [], "p")
    assert got["/b.pdf"] == ("text (fallback from pdf)", [], "\x00")
    assert got["/c.pdf"] == ("text (fallback from pdf)", ["pdf error: empty", "text error: not valid UTF-8"], None)


@pytest.mark.parametrize("fallback", ["nope", "pdf"])
def test_a_fallback_that_cannot_be(spark, fallback):
    registry = default_registry()
    registry.register_converter("pdf", [".pdf"], lambda df: df, fallback=fallback)
    with pytest.raises(ValueError):
        convert_batch(_docs(spark, [("/a.pdf", "a", None)]), registry=registry)
