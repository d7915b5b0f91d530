"""Everything supported in one folder, as one call."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import status_report
from ..sources.files import MAX_FILE_BYTES, scan_folder
from .sink import run_batch


def convert_folder(
    spark,
    folder_path: str,
    location: str,
    output_dir=None,
    engine=None,
    exts=None,
    max_bytes=MAX_FILE_BYTES,
    registry=None,
    default_engine="auto",
    **options,
) -> DataFrame:
    """Convert a folder and return its report, one row per file, ordered by file.

    The results are stored below ``location`` (see ``run_batch``); output paths
    are below ``output_dir``, or the folder itself. ``options`` are the request
    options, the same for all files.
    """
    files = scan_folder(spark, folder_path, exts, max_bytes)
    given = {"output_dir": output_dir, "engine": engine, **options}
    status = run_batch(
        files.select(F.col("path").alias("file"), "content"),
        location,
        registry=registry,
        default_engine=default_engine,
        mode="folder",
        base_dir=folder_path.rstrip("/") or "/",
        options={name: value for name, value in given.items() if value is not None},
    )
    return status_report(status)
