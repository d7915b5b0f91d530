import pytest
from pyspark.sql import functions as F

from quillspark.functions import options
from quillspark.functions.errors import classify_error
from quillspark.operators.options import resolve_options, validate_requests
from quillspark.sources.requests import complete_requests, scan_requests

from .helpers import column_values


def test_the_language_tables_are_complete():
    assert len(options.LANGUAGES) == 12
    assert sum(len(a) for a in options.LANGUAGES.values()) == 58


def test_every_language_and_alias(spark):
    expected = {c: c for c in options.LANGUAGES}
    expected |= {a: c for c, aliases in options.LANGUAGES.items() for a in aliases}
    got = column_values(spark, expected, options.normalize_lang)
    assert [r["value"] for r in got] == list(expected.values())
    assert all(r["error"] is None for r in got)


def test_language_spelling_and_unknown(spark):
    got = column_values(spark, [" EN ", "\ten\n", " Ru ", "", None, "  ", "xx"], options.normalize_lang)
    assert [r["value"] for r in got] == ["ch", "ch", "east_slavic", "", "", "", None]
    assert got[-1]["error"].startswith("lang 'xx' is not known; use one of arabic, ch, ")


def test_normalising_twice_changes_nothing(spark):
    hints = ["en", "RU", "", "devanagari"]
    once = [r["value"] for r in column_values(spark, hints, options.normalize_lang)]
    twice = [r["value"] for r in column_values(spark, once, options.normalize_lang)]
    assert once == twice


def test_choices(spark):
    for backend in options.BACKENDS:
        got = column_values(spark, [f" {backend.upper()} "], options.normalize_backend)[0]
        assert (got["value"], got["error"]) == (backend, None)
    got = column_values(spark, [None, "", "max", " "], options.normalize_effort)
    assert [r["value"] for r in got] == ["medium", "medium", None, None]
    assert got[2]["error"] == "effort 'max' is not accepted; use one of medium, high"


def _requests(spark, *rows):
    fields = "file_path string, engine string, method string, lang string, backend string, " \
        "effort string, server_url string, start_page int, end_page int, extra map<string,string>"
    names = [f.split()[0] for f in fields.split(", ")]
    data = [tuple({"file_path": "/a.pdf", **r}.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, fields)


@pytest.mark.parametrize(
    "request_, reasons",
    [
        ({}, []),
        ({"start_page": 2, "end_page": 7}, []),
        ({"start_page": 3, "end_page": 3}, []),
        ({"start_page": 0, "end_page": 0}, []),
        ({"start_page": 5, "end_page": 2}, ["end_page comes before start_page"]),
        ({"start_page": -1, "end_page": 2}, ["start_page is below 0"]),
        ({"end_page": -2}, ["end_page is below 0", "end_page comes before start_page"]),
        ({"engine": "AUTO"}, []),
        ({"engine": "Html"}, []),
        ({"engine": "nope"}, ["Unknown engine: nope"]),
        ({"method": "guess"}, ["method 'guess' is not accepted; use one of auto, ocr, txt"]),
        ({"backend": "vlm-http-client", "server_url": "http://x"}, []),
        (
            {"backend": "VLM-http-client"},
            ["backend 'vlm-http-client' works on a remote server and server_url is empty"],
        ),
        ({"file_path": None}, ["file_path is required"]),
        ({"extra": {"end_page": "x"}}, ["end_page is not a whole number"]),
        ({"extra": {"table_enable": "maybe"}}, ["table_enable is not a boolean"]),
        ({"start_page": 3, "extra": {"end_page": "1"}}, ["end_page comes before start_page"]),
        ({"effort": "max", "extra": {"effort": "high"}}, ["effort 'max' is not accepted; use one of medium, high"]),
    ],
)
def test_request_rules(spark, request_, reasons):
    assert validate_requests(_requests(spark, request_)).first()["errors"] == reasons


def test_overrides_win_over_fields_and_fields_over_defaults(spark):
    rows = _requests(
        spark,
        {"lang": "en", "extra": {"lang": "uk", "start_page": "4", "formula_enable": "false"}},
        {"lang": "en", "start_page": 1, "end_page": 9},
        {},
    )
    got = [
        (r["lang"], r["start_page"], r["end_page"], r["formula_enable"], r["table_enable"], r["backend"])
        for r in resolve_options(rows).collect()
    ]
    assert got == [
        ("east_slavic", 4, None, False, True, "auto"),
        ("ch", 1, 9, True, True, "auto"),
        ("", 0, None, True, True, "auto"),
    ]


def test_requests_from_json_get_defaults(spark, folder):
    path = f"{folder}/requests"
    bodies = ['{"file_path": "/a.pdf"}', '{"file_path": "/b.pdf", "end_page": 3, "lang": "ru"}', "{bad"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    from_column = [r.asDict() for r in scan_requests(df).collect()]
    assert from_column[0]["method"] == "auto" and from_column[0]["start_page"] == 0
    assert from_column[0]["end_page"] is None and from_column[0]["formula_enable"] is True
    assert from_column[1]["end_page"] == 3 and from_column[1]["lang"] == "ru"
    df.withColumnRenamed("body", "value").limit(2).write.text(path)
    from_files = scan_requests(path, spark)
    assert sorted(r["file_path"] for r in from_files.collect()) == ["/a.pdf", "/b.pdf"]
    refused = validate_requests(scan_requests(df)).filter("size(errors) > 0").collect()
    assert [r["errors"] for r in refused] == [["file_path is required"]]


def test_unknown_batch_options_are_refused(spark):
    with pytest.raises(ValueError):
        complete_requests(spark.range(1), {"colour": "red"})


def test_error_kinds(spark):
    causes = ["unknown_engine", "bad_option", "missing_path", "conversion_failed", None]
    long = " \n" + "a" * 10 + "b" * 500 + "\n"
    got = column_values(spark, causes, lambda c: classify_error(c, F.lit(long), tail=500))
    assert [(r["kind"], r["code"]) for r in got] == [
        ("BAD_REQUEST", 400),
        ("BAD_REQUEST", 400),
        ("NOT_FOUND", 404),
        ("CONVERSION_FAILED", 500),
        (None, None),
    ]
    assert got[0]["detail"] == "b" * 500
