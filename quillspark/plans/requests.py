"""Requests for single files, answered as one table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unused
from ..operators.collisions import resolve_collisions
from ..operators.matching import match_requests, missing_files
from ..operators.options import request_errors, resolve_options
from ..operators.parts import MAX_DOCUMENT_BYTES, assemble_parts, part_bytes, slice_parts
from ..operators.registry import DEFAULT_REGISTRY
from ..schema import REQUEST_SCHEMA, RESULT_COLUMNS
from ..session import settle
from ..sources.requests import complete_requests
from .batch import convert_batch
from .sizing import broadcast_if_small


def _refusals(asked: DataFrame, reasons, otherwise, kind) -> DataFrame:
    """Error rows of requests that are not converted."""
    nothing = F.lit(None).cast("string")
    refused = F.size(reasons) > 0
    return asked.withColumns(
        {
            "file": F.col("file_path"),
            "status": F.lit("error"),
            "errors": F.when(refused, reasons).otherwise(F.array(otherwise)),
            "error_kind": F.when(refused, "BAD_REQUEST").otherwise(kind),
            "fallback": F.lit(False),
            **{c: nothing for c in ("engine", "output_dir", "output_path", "images_dir", "markdown")},
        }
    )


def convert_requests(
    requests: DataFrame, files: DataFrame, registry=None, default_engine="auto", part=None, max_bytes=MAX_DOCUMENT_BYTES, collisions=False
) -> DataFrame:
    """A result row per request; ``files`` has ``file_path`` and text or content.

    Columns of ``requests`` that are no request fields, such as a key, come back
    with the answer. A request for a file that does not exist is answered with an
    error row of kind ``NOT_FOUND``, unless its options are wrong as well.

    With ``part``, an ordinal column of ``files``, a file comes as one row per page.
    The pages a request asks for are converted one by one and joined in order;
    ``piece`` is 0 but for results over ``max_bytes``, which come in several rows. A
    page that fails fails its request, and so does a range without any page. Wrong
    ranges and unknown engines are refused before anything is converted. Without
    ``part`` a file is one page, and a range is only checked.

    ``collisions`` adds the columns of ``resolve_collisions``; of requests with the
    same output path the last by file and by the request's own columns wins.

    Requests that turn out small are broadcast, so the documents stay where they
    are; otherwise files that no request names are left out first and both sides are
    shuffled on the path.
    """
    registry = registry or DEFAULT_REGISTRY
    engines = registry.list_converters()
    own = [c for c in requests.columns if c not in REQUEST_SCHEMA.names]
    number = unused("_request", requests, files)
    asked = settle(complete_requests(requests).withColumn(number, F.monotonically_increasing_id()))
    content = [c for c in ("text", "content") if c in files.columns]
    fields = [f for f in REQUEST_SCHEMA.names if f in requests.columns]
    convert = lambda found, carry: convert_batch(found.withColumnRenamed("file_path", "file"), registry=registry, default_engine=default_engine, carry=carry)

    # A file that is not there is told before an engine that is not known.
    lost = missing_files(asked, files.select("file_path").distinct() if part else files, "file_path")
    known = [f for f in fields if f != "engine"]
    answered = _refusals(lost, request_errors(engines, known), F.concat(F.lit("File not found: "), F.col("file_path")), "NOT_FOUND")
    if part is None:
        found = match_requests(broadcast_if_small(asked), files.select("file_path", *content), "file_path")
        done = convert(found, own).unionByName(answered.select(*RESULT_COLUMNS, *own))
    else:
        done = _convert_ranges(asked, files.select("file_path", part, *content), lost, part, number, own, request_errors(engines, fields), convert, max_bytes)
        done = done.unionByName(answered.withColumn("piece", F.lit(0).cast("long")).select(*RESULT_COLUMNS, *own, "piece"))
    return resolve_collisions(done, file=["file", *own]) if collisions else done


def _convert_ranges(asked, pages, lost, part, number, own, reasons, convert, max_bytes):
    """The answers to requests for pages of files that are there."""
    present = settle(asked.join(lost.select(number), number, "left_anti").withColumn("_reasons", reasons))
    refused = present.filter(F.size("_reasons") > 0).drop("_reasons").withColumn("text", F.lit(None).cast("string"))
    valid = present.filter(F.size("_reasons") == 0).drop("_reasons")
    page = unused("_page", valid)
    bounds = resolve_options(valid).select(number, F.col("start_page").alias("_first"), F.col("end_page").alias("_last"))
    wanted = broadcast_if_small(settle(valid.join(bounds, number)))
    chosen = slice_parts(match_requests(wanted, pages.withColumnRenamed(part, page), "file_path"), page, F.col("_first"), F.col("_last"))
    parts = settle(convert(chosen.drop("_first", "_last"), [number, page]))

    outcome = parts.groupBy(number).agg(
        F.any_value("file").alias("file"), F.max_by("engine", "fallback").alias("engine"), F.max("fallback").alias("fallback"), F.max("output_dir").alias("output_dir"),
        F.max("output_path").alias("output_path"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("errors"),
    )
    bad = F.size("errors") > 0
    nothing = F.lit(None).cast("string")
    outcome = settle(
        outcome.withColumns(
            {
                "status": F.when(bad, "error").otherwise("ok"),
                "error_kind": F.when(bad, "CONVERSION_FAILED"),
                "output_dir": F.when(~bad, F.col("output_dir")),
                "output_path": F.when(~bad, F.col("output_path")),
                "images_dir": nothing,
            }
        ).join(valid.select(number, *own), number)
    )
    good = broadcast_if_small(outcome.filter("status = 'ok'").select(number))
    texts = parts.join(good, number).select(number, page, nothing.alias("_heading"), "markdown")
    joined = assemble_parts(texts, number, page, "_heading", "markdown", max_bytes)
    converted = joined.join(broadcast_if_small(outcome.filter("status = 'ok'")), number)
    zero = F.lit(0).cast("long").alias("piece")
    columns = [*RESULT_COLUMNS, *own]
    failed = outcome.filter("status = 'error'").withColumn("markdown", nothing).select(*columns, zero)
    empty = valid.join(outcome.select(number), number, "left_anti")
    empty = _refusals(empty, F.array().cast("array<string>"), F.concat(F.lit("No page in the range: "), F.col("file_path")), "CONVERSION_FAILED")
    return (
        converted.select(*columns, "piece")
        .unionByName(failed)
        .unionByName(empty.select(*columns, zero))
        .unionByName(convert(refused, own).select(*columns, zero))
    )


def assemble_requested(
    requests: DataFrame,
    parts: DataFrame,
    request: str,
    key: str,
    ord: str,
    heading: str,
    text: str,
    max_bytes=MAX_DOCUMENT_BYTES,
) -> DataFrame:
    """The parts each request asks for, as one text: ``(request, piece, markdown)``.

    ``requests`` has a unique ``request``, the ``key`` of a document and its
    ``start_page`` and ``end_page``; a null end means to the end. Requests that
    turn out small are broadcast, so parts move once only, to be joined.
    """
    bounds = broadcast_if_small(requests.select(request, key, "start_page", "end_page"))
    within = lambda of: slice_parts(of.join(bounds, key), ord, F.col("start_page"), F.col("end_page"))
    # Sizes are taken before the join, so the text is joined and moved once.
    narrow = parts.select(key, ord, part_bytes(heading, text).alias("bytes"))
    sizes = within(narrow).select(F.col(request).alias("key"), F.col(ord).alias("ord"), "bytes")
    return assemble_parts(within(parts), request, ord, heading, text, max_bytes, sizes)
