"""One query per operator over the given tables."""

from pyspark.sql import functions as F

from ..functions import formats, html, names, options
from ..functions.errors import MESSAGE_TAIL, classify_error
from ..operators.collisions import resolve_collisions
from ..operators.fallback import convert_with_fallback
from ..operators.matching import match_requests, missing_files
from ..operators.options import resolve_options, validate_requests
from ..operators.parts import assemble_parts, slice_parts
from ..operators.registry import default_registry
from ..operators.report import batch_summary, status_report
from ..operators.routing import engine_for_extension, route_engine
from ..plans.batch import convert_batch
from ..plans.requests import assemble_requested, convert_requests
from ..plans.sink import run_batch, saved_markdown, write_markdown
from ..session import new_shared_path
from ..sources.csv_blocks import scan_csv
from ..sources.files import filter_supported, scan_folder
from ..sources.listing import list_folder
from ..sources.requests import scan_requests
from ..streaming.inbox import inbox_results, stream_documents, stream_inbox
from . import inputs

PAGE_OPTIONS = {"mode": "folder", "base_dir": "/out", "options": {"engine": "html"}}


def _long(*columns):
    return [F.col(c).cast("long").alias(c) for c in columns]


def _joined(column="errors"):
    return F.concat_ws("; ", column)


def q_scan_folder(spark, sf_dir):
    """The files of the tables, all their bytes read."""
    pieces = scan_folder(spark, sf_dir, exts=[".parquet"], piece_bytes=8 << 20)
    files = pieces.groupBy("path", "name", "ext", "length").agg(F.sum(F.octet_length("content")).alias("n"))
    return files.select("name", "ext", (F.col("n") == F.col("length")).alias("whole"))


def q_filter_supported(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir).select("name")
    docs = inputs.requests(spark, sf_dir).select(F.col("file_path").alias("name"))
    parts = names.file_parts(F.col("name"))
    return filter_supported(pages.unionByName(docs).select("name", parts["ext"].alias("ext")))


def q_scan_requests(spark, sf_dir):
    rows = inputs.requests(spark, sf_dir)
    fields = [c for c in rows.columns if c != "doc_id"]
    bodies = rows.select("doc_id", F.to_json(F.struct(*fields)).alias("body"))
    return scan_requests(bodies).select(
        "doc_id", "file_path", "engine", "method", "lang", "formula_enable", "table_enable",
        "backend", "effort", "server_url", *_long("start_page", "end_page"),
        F.col("extra")["lang"].alias("extra_lang"),
    )


def q_file_parts(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir)
    return pages.select("page_id", names.file_parts(F.col("name")).alias("p")).select("page_id", "p.*")


def q_route_engine(spark, sf_dir):
    registry = default_registry()
    ext = names.file_parts(F.col("file_path"))["ext"]
    engine = F.col("engine")
    by_extension = registry.engine_of(ext)
    return inputs.requests(spark, sf_dir).select(
        "doc_id",
        route_engine(engine, "auto", by_extension).alias("engine_auto"),
        route_engine(engine, "Text", by_extension).alias("engine_text"),
    )


def q_engine_for_extension(spark, sf_dir):
    ext = names.file_parts(F.col("file_path"))["ext"]
    docs = inputs.requests(spark, sf_dir).select("doc_id", ext.alias("ext"))
    return engine_for_extension(docs, default_registry().support(spark))


def q_resolve_options(spark, sf_dir):
    return resolve_options(inputs.requests(spark, sf_dir)).select(
        "doc_id", "method", "lang", "formula_enable", "table_enable", "backend", "effort",
        "server_url", *_long("start_page", "end_page"),
    )


def q_normalize_lang(spark, sf_dir):
    own = inputs.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("hint"))
    asked = inputs.requests(spark, sf_dir).select("doc_id", F.col("lang").alias("hint"))
    both = own.withColumn("origin", F.lit("own")).unionByName(
        asked.withColumn("origin", F.lit("asked"))
    )
    result = options.normalize_lang(F.col("hint"))
    return both.select("doc_id", "origin", result["value"].alias("value"), result["error"].alias("error"))


def q_normalize_choice(spark, sf_dir):
    backend = options.normalize_backend(F.col("backend"))
    effort = options.normalize_effort(F.col("effort"))
    return inputs.requests(spark, sf_dir).select(
        "doc_id",
        backend["value"].alias("backend"),
        backend["error"].alias("backend_error"),
        effort["value"].alias("effort"),
        effort["error"].alias("effort_error"),
    )


def q_validate_requests(spark, sf_dir):
    return validate_requests(inputs.requests(spark, sf_dir)).select(
        "doc_id", (F.size("errors") == 0).alias("valid"), _joined().alias("reasons")
    )


def q_output_location(spark, sf_dir):
    pages = inputs.pages(spark, sf_dir)
    stem = names.file_parts(F.col("name"))["stem"]
    asked = F.when(F.col("page_id") % 3 == 0, "/asked/")
    places = {
        "single": names.output_location(F.col("name"), asked, stem),
        "folder": names.output_location(F.col("name"), asked, stem, "folder", "/folder"),
        "inbox": names.output_location(F.col("name"), asked, stem, "inbox", "/landing"),
    }
    return pages.select(
        "page_id", *[p[f].alias(f"{m}_{f}") for m, p in places.items() for f in ("output_dir", "output_path")]
    )


def q_safe_name(spark, sf_dir):
    urls = inputs.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("stem"))
    texts = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("stem"))
    both = urls.withColumn("origin", F.lit("url")).unionByName(texts.withColumn("origin", F.lit("text")))
    return both.select("id", "origin", names.safe_name(F.col("stem")).alias("safe_name"))


def q_slice_parts(spark, sf_dir):
    return slice_parts(inputs.table(spark, sf_dir, "conversations"), "turn", 1, 3)


def q_classify_error(spark, sf_dir):
    d = F.col("doc_id")
    cause = (
        F.when(d % 6 == 5, "unknown_engine")
        .when(d % 3 == 2, "bad_option")
        .when(d % 4 == 1, "missing_path")
        .when(d % 4 == 2, "conversion_failed")
    )
    docs = inputs.table(spark, sf_dir, "documents")
    result = classify_error(cause, F.col("text"), tail=MESSAGE_TAIL)
    return docs.select(
        "doc_id",
        result["kind"].alias("kind"),
        result["code"].cast("long").alias("code"),
        result["detail"].alias("detail"),
    )


def q_match_requests(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return match_requests(docs, inputs.table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "lang", "source", *_long("quality", "toxic")
    )


def q_missing_files(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return missing_files(docs, inputs.table(spark, sf_dir, "labels"), "doc_id")


def _pair(df, key, convert):
    return df.select(key, convert(F.col("text")).alias("r")).select(key, "r.markdown", "r.error")


def q_html_to_markdown(spark, sf_dir):
    return _pair(inputs.pages(spark, sf_dir), "page_id", html.html_to_markdown)


def q_html_structure(spark, sf_dir):
    return _pair(inputs.order_pages(spark, sf_dir), "o_orderkey", html.html_to_markdown)


def q_csv_to_markdown(spark, sf_dir):
    return _pair(inputs.csv_files(spark, sf_dir), "o_orderkey", formats.csv_to_markdown)


def q_scan_csv(spark, sf_dir):
    location = new_shared_path(spark)
    inputs.write_csv_files(spark, sf_dir, location)
    part = F.regexp_extract("file", r"part=(\d+)/", 1).cast("long")
    return scan_csv(spark, location).select(part.alias("part"), "row", "markdown", "error")


def q_json_to_markdown(spark, sf_dir):
    return _pair(inputs.json_texts(spark, sf_dir), "event_id", formats.json_to_markdown)


def q_xml_to_markdown(spark, sf_dir):
    return _pair(inputs.xml_texts(spark, sf_dir), "event_id", formats.xml_to_markdown)


def q_text_to_markdown(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    content = F.col("text").cast("binary")
    damaged = F.when(F.col("lang") == "de", F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    return _pair(
        docs.select("doc_id", damaged.cast("string").alias("text")), "doc_id", formats.text_to_markdown
    )


def q_convert_with_fallback(spark, sf_dir):
    done = convert_with_fallback(
        inputs.pages(spark, sf_dir),
        ("html", html.html_columns),
        ("text", html.tagless_columns),
        html.html_is_closed(F.col("text")),
    )
    return done.select("page_id", "engine", "fallback", _joined().alias("reasons"), "markdown")


def q_status_report(spark, sf_dir):
    return status_report(convert_batch(inputs.pages(spark, sf_dir), collisions=False, **PAGE_OPTIONS))


def q_assemble_parts(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    return assemble_parts(turns, "conv_id", "turn", "role", "text")


def q_assemble_sliced_parts(spark, sf_dir):
    turns = slice_parts(inputs.table(spark, sf_dir, "conversations"), "turn", 1, 3)
    return assemble_parts(turns, "conv_id", "turn", "role", "text")


def q_assemble_requested_parts(spark, sf_dir):
    asked = resolve_options(inputs.requests(spark, sf_dir)).select(
        F.col("doc_id").alias("request_id"),
        F.col("doc_id").alias("conv_id"),
        F.greatest("start_page", F.lit(0)).alias("start_page"),
        "end_page",
    )
    turns = inputs.table(spark, sf_dir, "conversations")
    return assemble_requested(asked, turns, "request_id", "conv_id", "turn", "role", "text")


def q_resolve_collisions(spark, sf_dir):
    pages = inputs.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file"))
    stem = names.file_parts(names.url_path(F.col("file")))["stem"]
    place = names.output_location(F.col("file"), F.lit(None), stem, "folder", "/out")
    return resolve_collisions(pages.withColumn("output_path", place["output_path"]))


def q_write_markdown(spark, sf_dir):
    location = new_shared_path(spark)
    write_markdown(convert_batch(inputs.pages(spark, sf_dir), **PAGE_OPTIONS), location)
    return spark.read.parquet(location)


def q_run_batch(spark, sf_dir):
    location = new_shared_path(spark)
    run_batch(inputs.pages(spark, sf_dir), location, **PAGE_OPTIONS)
    return saved_markdown(spark, location)


def q_batch_summary(spark, sf_dir):
    return batch_summary(_mixed(spark, sf_dir, collisions=False))


def _batch_rows(results):
    return results.select(
        "file", "status", "engine", "output_path", "fallback", _joined().alias("reasons"),
        "error_kind", "markdown", "n_same_path", "survives",
    )


def q_convert_batch(spark, sf_dir):
    return _batch_rows(convert_batch(inputs.pages(spark, sf_dir), collisions=True, **PAGE_OPTIONS))


def _mixed(spark, sf_dir, **more):
    corpus = inputs.corpus(spark, sf_dir).withColumnRenamed("file_path", "file")
    return convert_batch(corpus, mode="folder", base_dir="/out", **{"collisions": True, **more})


def q_convert_mixed_batch(spark, sf_dir):
    return _batch_rows(_mixed(spark, sf_dir))


def q_convert_requests(spark, sf_dir):
    labelled = inputs.table(spark, sf_dir, "labels").select("doc_id")
    files = inputs.corpus(spark, sf_dir).join(labelled, "doc_id", "left_semi").drop("doc_id")
    return convert_requests(inputs.requests(spark, sf_dir), files).select(
        "doc_id", "file", "status", "engine", "fallback", _joined().alias("reasons"), "error_kind", "output_path", "markdown"
    )


def q_convert_request_pages(spark, sf_dir):
    """Requests for turns of conversations as pages of HTML files."""
    turns = inputs.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("/chats/"), F.col("conv_id").cast("string"), F.lit(".html")).alias("file_path"),
        F.col("turn").alias("page"), F.concat(F.lit("<h2>"), "role", F.lit("</h2><p>"), "text", F.lit("</p>")).alias("text"),
    )
    asked = inputs.requests(spark, sf_dir).withColumn("file_path", F.concat(F.lit("/chats/"), (F.col("doc_id") % 150).cast("string"), F.lit(".html"))).drop("engine")
    done = convert_requests(asked, turns, part="page")
    return done.select("doc_id", "piece", "file", "status", "engine", _joined().alias("reasons"), "error_kind", "output_path", "markdown")


def q_register_converter(spark, sf_dir):
    registry = default_registry()
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def shout(df):
        return df.withColumns(
            {"markdown": F.translate("text", lower, upper), "error": F.lit(None).cast("string")}
        )

    registry.register_converter("shout", [".docx", ".txt"], shout, rank=1)
    results = _mixed(spark, sf_dir, registry=registry, collisions=False)
    return results.select("file", "status", "engine", "markdown")


def _bracketed(pdf):
    """A parser that can't read documents of odd length."""
    if any(len(text) % 2 for text in pdf["text"]):
        raise ValueError("odd length")
    return "[" + pdf["text"] + "]"


def q_fallback_plugin(spark, sf_dir):
    registry = default_registry()
    registry.register_function("pdf", [".pdf"], _bracketed, rank=0, fallback="text")
    registry.register_function("office", [".docx"], _bracketed, fallback="json")
    results = _mixed(spark, sf_dir, registry=registry, collisions=False)
    return results.select("file", "status", "engine", "output_path", "fallback", _joined().alias("reasons"), "error_kind", "markdown")


def q_guarded_plugin(spark, sf_dir):
    registry = default_registry()
    registry.register_function("shout", [".docx", ".txt"], _bracketed, rank=1)
    results = _mixed(spark, sf_dir, registry=registry, collisions=False)
    return results.select("file", "status", "engine", "fallback", _joined().alias("reasons"), "markdown")


def q_stream_documents(spark, sf_dir):
    schema = inputs.table(spark, sf_dir, "pages").schema
    stream = (
        spark.readStream.schema(schema)
        .parquet(f"{sf_dir}/pages.parquet*")
        .select(
            F.col("url").alias("file"),
            names.url_path(F.col("url")).alias("name"),
            F.col("html").alias("text"),
        )
    )
    location = new_shared_path(spark)
    stream_documents(stream, f"{location}/out", f"{location}/state", **PAGE_OPTIONS).awaitTermination()
    return inbox_results(spark, f"{location}/out").select(
        "file", "status", "engine", "output_path", "fallback", "markdown", "n_same_path", "survives"
    )


def q_stream_inbox(spark, sf_dir):
    """Saved pages as files of one folder, in two runs over one checkpoint; of one address the later run counts."""
    location = new_shared_path(spark)
    pages = inputs.table(spark, sf_dir, "pages")
    for turn in (0, 1):
        inputs.write_saved_pages(pages.filter(F.col("page_id") % 2 == turn), f"{location}/inbox")
        run = stream_inbox(
            spark, f"{location}/inbox", f"{location}/out", f"{location}/state", exts=[".txt"], describe=inputs.saved_from, **PAGE_OPTIONS
        )
        run.awaitTermination()
    return inbox_results(spark, f"{location}/out").select(
        "file", "status", "engine", "output_path", "fallback", "markdown", "n_same_path", "survives"
    )


def q_rerun_batch(spark, sf_dir):
    """All pages, then some of them changed: the store holds the new text of these and the old of the others."""
    location = new_shared_path(spark)
    pages = inputs.pages(spark, sf_dir)
    run_batch(pages, location, **PAGE_OPTIONS)
    changed = pages.filter(F.col("page_id") % 3 == 0).withColumn("text", F.lit("<p>changed</p></html>"))
    run_batch(changed, location, **PAGE_OPTIONS)
    return saved_markdown(spark, location)


def q_list_folder(spark, sf_dir):
    """Pages as files of one folder and the empty mark of their write, as a manifest."""
    location = new_shared_path(spark)
    pages = inputs.table(spark, sf_dir, "pages")
    inputs.write_page_files(pages, f"{location}/pages")
    listed = list_folder(spark, f"{location}/pages", exts=[".txt"], content=True)
    # Names are the writer's own, and so are its hidden files.
    digest = F.when(F.col("status") == "FOUND", F.sha2("content", 256))
    kept = listed.filter(~F.startswith(F.col("name"), F.lit(".")))
    return kept.select("length", "status", "reason", digest.alias("digest"))


QUERIES = {name[2:]: query for name, query in list(globals().items()) if name.startswith("q_")}
