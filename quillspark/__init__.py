"""Batch document-to-Markdown conversion as Spark DataFrame jobs."""

from .functions.errors import classify_error
from .functions.formats import csv_to_markdown, json_to_markdown, text_to_markdown, xml_to_markdown
from .functions.html import html_is_closed, html_to_markdown, strip_tags
from .functions.names import file_parts, output_location, safe_name, url_path
from .functions.options import normalize_choice, normalize_lang
from .operators.collisions import resolve_collisions
from .operators.fallback import convert_with_fallback
from .operators.guarded import guarded_frame
from .operators.matching import match_requests, missing_files
from .operators.options import resolve_options, validate_requests
from .operators.parts import assemble_parts, slice_parts
from .operators.registry import (
    Converter,
    ConverterRegistry,
    default_registry,
    list_converters,
    register_converter,
    register_function,
)
from .operators.report import batch_summary, status_report
from .operators.routing import engine_for_extension, route_engine
from .plans.batch import convert_batch
from .plans.folder import convert_folder
from .plans.requests import assemble_requested, convert_requests
from .plans.sink import export_files, run_batch, saved_markdown, write_markdown
from .sources.csv_blocks import scan_csv
from .sources.files import filter_supported, scan_folder
from .sources.listing import list_folder
from .sources.requests import complete_requests, scan_requests
from .streaming.inbox import inbox_results, stream_documents, stream_inbox
