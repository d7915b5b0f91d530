"""Effective options of a request, and everything that can be wrong with it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.options import normalize_backend, normalize_effort, normalize_lang, normalize_method
from ..schema import REQUEST_DEFAULTS, REQUEST_SCHEMA
from ..sources.requests import complete_requests

_NORMALIZED = {
    "method": normalize_method,
    "lang": normalize_lang,
    "backend": normalize_backend,
    "effort": normalize_effort,
}


def _override(name):
    return F.try_element_at(F.col("extra"), F.lit(name))


def _effective(name, type_name="string"):
    """Override, then request, then default."""
    choices = [_override(name).try_cast(type_name), F.col(name).cast(type_name)]
    if name in REQUEST_DEFAULTS:
        choices.append(F.lit(REQUEST_DEFAULTS[name]))
    return F.coalesce(*choices)


def resolve_options(df: DataFrame) -> DataFrame:
    """Replace the option columns by their effective, normalised values.

    A value that cannot be normalised becomes null; ``validate_requests`` says
    why. A null ``end_page`` stays null and means: to the end.
    """
    df = complete_requests(df)
    return df.withColumns(
        {
            **{name: f(_effective(name))["value"] for name, f in _NORMALIZED.items()},
            "formula_enable": _effective("formula_enable", "boolean"),
            "table_enable": _effective("table_enable", "boolean"),
            "server_url": _effective("server_url"),
            "start_page": _effective("start_page", "int"),
            "end_page": _effective("end_page", "int"),
        }
    )


def request_errors(engines, fields=REQUEST_SCHEMA.names):
    """The array of reasons a request is refused; empty when it is fine.

    A field and its override are both looked at: a bad value is refused even
    where an override would replace it. ``fields`` are the request fields that
    can hold anything; the others are left at their defaults and need no rule.
    """
    overrides = "extra" in fields
    reasons = [F.when(F.coalesce("file_path", F.lit("")) == "", "file_path is required")]
    for name, normalize in _NORMALIZED.items():
        if name in fields:
            reasons.append(normalize(F.col(name))["error"])
        if overrides:
            reasons.append(normalize(_override(name))["error"])
    if overrides:
        typed = {
            "formula_enable": ("boolean", "boolean"),
            "table_enable": ("boolean", "boolean"),
            "start_page": ("int", "whole number"),
            "end_page": ("int", "whole number"),
        }
        for name, (type_name, called) in typed.items():
            given = _override(name)
            bad = given.isNotNull() & given.try_cast(type_name).isNull()
            reasons.append(F.when(bad, f"{name} is not a {called}"))
    if overrides or "start_page" in fields or "end_page" in fields:
        start, end = _effective("start_page", "int"), _effective("end_page", "int")
        reasons += [
            F.when(start < 0, "start_page is below 0"),
            F.when(end < 0, "end_page is below 0"),
            F.when(end < start, "end_page comes before start_page"),
        ]
    if overrides or "backend" in fields:
        backend = normalize_backend(_effective("backend"))["value"]
        unserved = F.endswith(backend, F.lit("-http-client")) & (
            F.coalesce(_effective("server_url"), F.lit("")) == ""
        )
        demand = "' works on a remote server and server_url is empty"
        reasons.append(F.when(unserved, F.concat(F.lit("backend '"), backend, F.lit(demand))))
    if "engine" in fields:
        engine = F.lower(F.coalesce("engine", F.lit("")))
        unknown = ~engine.isin("", "auto", *engines)
        reasons.append(F.when(unknown, F.concat(F.lit("Unknown engine: "), engine)))
    return F.array_distinct(F.array_compact(F.array(*reasons)))


def validate_requests(df: DataFrame, engines=("pdf", "html", "csv", "json", "xml", "text")):
    """Every request with ``errors array<string>``; callers split the two kinds."""
    return complete_requests(df).withColumn("errors", request_errors(engines))
