"""What became of each document, and how many went which way."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STATUS_COLUMNS


def status_report(results: DataFrame) -> DataFrame:
    """One row per document, ordered by file; the Markdown is not read.

    Only the narrow status columns are sorted. Sorting samples its input, so
    take the results from the stored table where converting is costly.
    """
    failed = F.col("status") == "error"
    detail = F.concat_ws("; ", "errors")
    report = results.withColumns(
        {
            "engine": F.when(~failed, F.col("engine")),
            "output_path": F.when(~failed, F.col("output_path")),
            "fallback": F.when(~failed, F.col("fallback")),
            "detail": F.when(failed, detail),
        }
    )
    return report.select(*STATUS_COLUMNS).orderBy("file")


def batch_summary(results: DataFrame) -> DataFrame:
    """Documents per engine, status and fallback, and per error kind if known."""
    keys = ["engine", "status", "fallback"]
    if "error_kind" in results.columns:
        keys.append("error_kind")
    return results.groupBy(*keys).agg(F.count("*").alias("n_docs"))
