"""A whole batch: from documents to result rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import classify_error
from ..functions.formats import decode_text
from ..functions.names import file_parts, output_location
from ..operators.collisions import resolve_collisions
from ..operators.fallback import fallback_conversion, no_errors, single_conversion
from ..operators.options import request_errors
from ..operators.registry import DEFAULT_REGISTRY
from ..operators.routing import route_engine
from ..schema import REQUEST_SCHEMA, RESULT_COLUMNS
from ..session import settle
from ..sources.requests import complete_requests


def _with_text(df: DataFrame) -> DataFrame:
    """``text`` and the reason there is none; binary ``content`` is decoded."""
    if "content" not in df.columns:
        return df.withColumn("_unreadable", F.lit(None).cast("string"))
    decoded = decode_text(F.col("content"))
    return df.withColumns({"text": decoded["text"], "_unreadable": decoded["error"]})


def _test_of(converter):
    return f"_accepted_by_{converter.name}"


def _accepted(converter):
    return F.col(_test_of(converter)) if converter.accepts else F.lit(True)


def _conversion_of(converter, text):
    if converter.secondary is None:
        return single_conversion(converter.name, converter.columns, text)
    return fallback_conversion(
        (converter.name, converter.columns), converter.secondary, _accepted(converter), text
    )


def _convert_columns(docs: DataFrame, converters) -> DataFrame:
    """All column converters in one pass: one ``CASE`` on the engine per result."""
    # Columns of their own for what several results depend on, so that each
    # document is tested and checked once.
    tests = {
        _test_of(c): F.when(F.col("_engine") == c.name, c.accepts(F.col("text")))
        for c in converters
        if c.secondary and c.accepts
    }
    docs = docs.withColumns(tests) if tests else docs
    engine, fallback = F.col("_engine"), F.lit(False)
    markdown = F.lit(None).cast("string")
    errors = no_errors()
    for converter in converters:
        result = _conversion_of(converter, F.col("text"))
        chosen = F.col("_engine") == converter.name
        engine = F.when(chosen, result.engine).otherwise(engine)
        fallback = F.when(chosen, result.fallback).otherwise(fallback)
        errors = F.when(chosen, result.errors).otherwise(errors)
        markdown = F.when(chosen, result.markdown).otherwise(markdown)
    refused = F.size("_refused") > 0
    checked = docs.withColumns(
        {
            "errors": F.when(refused, F.col("_refused"))
            .when(F.col("_unreadable").isNotNull(), F.array("_unreadable"))
            .otherwise(errors),
            "engine": F.when(refused, F.col("_engine")).otherwise(engine),
            "fallback": F.when(refused, False).otherwise(fallback),
        }
    )
    return checked.withColumn("markdown", F.when(F.size("errors") == 0, markdown))


def _answered(done: DataFrame, engine, fallback: bool, errors) -> DataFrame:
    """The outcome columns of rows with ``markdown`` and ``error``."""
    good = F.col("error").isNull()
    return done.withColumns(
        {
            "errors": F.when(good, no_errors()).otherwise(errors),
            "engine": F.lit(engine),
            "fallback": F.lit(fallback),
            "markdown": F.when(good, F.col("markdown")),
        }
    )


def _convert_frame(docs: DataFrame, converter, second=None) -> DataFrame:
    """The rows of one registered ``DataFrame -> DataFrame`` converter.

    With a second converter the first one's outcomes are stored: the Markdown of
    the rows that came through and the source of those that failed, so the first
    runs once per row and the second only over the failed, which need no join.
    """
    done = converter.frame(docs)
    if second is None:
        return _answered(done, converter.name, False, F.array("error"))
    failed = F.col("error").isNotNull()
    source = {c: F.when(failed, F.col(c)).alias(c) for c in ("text", "content") if c in done.columns}
    kept = settle(done.withColumns(source).withColumn("markdown", F.when(~failed, F.col("markdown"))))
    first = _answered(kept.filter(~failed), converter.name, False, F.array("error"))
    left = kept.filter(failed).withColumnRenamed("error", "_first").drop("markdown")
    if second.frame:
        again = second.frame(left)
    else:
        markdown, error = second.columns(F.col("text"))
        again = left.withColumns({"markdown": markdown, "error": F.coalesce(F.col("_unreadable"), error)})
    name = f"{second.name} (fallback from {converter.name})"
    return first.unionByName(_answered(again, name, True, F.array("_first", "error")), allowMissingColumns=True)


def convert_batch(
    df: DataFrame,
    registry=None,
    mode="single",
    base_dir=None,
    default_engine="auto",
    options=None,
    collisions=False,
    carry=(),
) -> DataFrame:
    """Result rows of a table of documents, one per document.

    ``df`` has ``file`` (unique) and either ``text`` or binary ``content``; any
    request column (engine, output_dir, lang, ...) may stand beside them, and
    ``options`` gives batch-wide values for the others. A ``name`` column, as of an
    upload, replaces ``file`` as the source of stem and extension. ``mode`` and
    ``base_dir`` are those of ``output_location``.

    Conversion is a projection: documents are read once and do not move. A bad
    document becomes an error row. The output path has the whole stem, so files
    with different names never meet. ``collisions`` adds the columns of
    ``resolve_collisions``, which runs the conversion, registered converters
    included, a second time for the paths; ``run_batch`` takes them from the
    stored result instead.

    ``carry`` names columns of ``df`` that each result row keeps, such as the key of
    a request; a registered converter sees them as ``_carry0`` and on.

    A registered converter with a fallback is run when the frame is built: its
    outcomes are stored, and the rows it gave an error for go to the second
    converter; if that fails too, both reasons are kept. Refused requests never
    come so far.
    """
    registry = registry or DEFAULT_REGISTRY
    names = registry.list_converters()
    if default_engine != "auto" and default_engine.lower() not in names:
        raise ValueError(f"Unknown engine: {default_engine}")
    given = set(df.columns) | set(options or {})
    fields = [name for name in REQUEST_SCHEMA.names if name in given]
    docs = complete_requests(_with_text(df).withColumn("file_path", F.col("file")), options)
    parts = file_parts(F.col("name" if "name" in df.columns else "file"))
    docs = docs.select(
        "file",
        "text",
        *[c for c in ("content",) if c in df.columns],
        "_unreadable",
        "output_dir",
        *[F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)],
        parts["ext"].alias("ext"),
        parts["stem"].alias("_stem"),
        request_errors(names, fields).alias("_reasons"),
        route_engine(F.col("engine"), default_engine, registry.engine_of(parts["ext"])).alias(
            "_engine"
        ),
    )
    eligible = registry.converters()
    named = (options or {}).get("engine") if "engine" not in df.columns else None
    if named and named.lower() != "auto":
        eligible = [c for c in eligible if c.name == named.lower()]
    built_in = [c for c in eligible if c.columns]
    plugged = [c for c in eligible if c.frame]
    runnable = F.col("_engine").isin([c.name for c in built_in + plugged])
    docs = docs.withColumn(
        "_refused",
        F.when(F.size("_reasons") > 0, F.col("_reasons"))
        .when(
            F.col("_engine").isNull(),
            F.array(F.concat(F.lit("No converter supports '"), "ext", F.lit("'"))),
        )
        .when(
            ~runnable, F.array(F.concat(F.lit("No converter registered for "), "_engine"))
        )
        .otherwise(no_errors()),
    )
    carried = [f"_carry{i}" for i in range(len(carry))]
    # A registered converter gets the raw content too, UTF-8 or not.
    to_plugged = F.col("_engine").isin([c.name for c in plugged]) & (F.size("_refused") == 0)
    columns = ["file", "output_dir", "_stem", "_refused", "errors", "engine", "fallback", "markdown", *carried]
    rest = docs.filter(~F.coalesce(to_plugged, F.lit(False))) if plugged else docs
    done = _convert_columns(rest, built_in).select(*columns)
    for converter in plugged:
        mine = docs.filter(to_plugged & (F.col("_engine") == converter.name))
        second = registry.fallback_of(converter)
        done = done.unionByName(_convert_frame(mine, converter, second).select(*columns))

    failed = F.size("errors") > 0
    cause = F.when(F.size("_refused") > 0, "bad_option").when(failed, "conversion_failed")
    location = output_location(F.col("file"), F.col("output_dir"), F.col("_stem"), mode, base_dir)
    results = done.withColumns(
        {
            "status": F.when(failed, "error").otherwise("ok"),
            "output_dir": F.when(~failed, location["output_dir"]),
            "output_path": F.when(~failed, location["output_path"]),
            "images_dir": F.lit(None).cast("string"),
            "error_kind": classify_error(cause, F.lit(""))["kind"],
        }
    ).select(*RESULT_COLUMNS, *[F.col(c).alias(name) for c, name in zip(carried, carry)])
    return resolve_collisions(results) if collisions else results
