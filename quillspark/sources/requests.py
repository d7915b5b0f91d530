"""Conversion requests as a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import REQUEST_DEFAULTS, REQUEST_SCHEMA


def _constant(value, data_type):
    if isinstance(value, dict):
        return F.create_map(*[F.lit(x) for pair in value.items() for x in pair]).cast(data_type)
    return F.lit(value).cast(data_type)


def complete_requests(df: DataFrame, values=None) -> DataFrame:
    """Add the request fields a table lacks, from ``values`` or as nulls."""
    given = values or {}
    unknown = set(given) - set(REQUEST_SCHEMA.names)
    if unknown:
        raise ValueError(f"Unknown request fields: {', '.join(sorted(unknown))}")
    present = df.columns
    missing = {
        field.name: _constant(given.get(field.name), field.dataType)
        for field in REQUEST_SCHEMA
        if field.name not in present
    }
    return df.withColumns(missing) if missing else df


def scan_requests(source, spark=None) -> DataFrame:
    """Requests from a path of JSON lines, or from a ``body`` column of JSON.

    The schema is declared, never inferred. Fields left out take their default;
    a body that is no JSON gives a request without ``file_path``, which
    validation rejects.
    """
    if isinstance(source, DataFrame):
        others = [F.col(c) for c in source.columns if c != "body"]
        parsed = source.select(*others, F.from_json("body", REQUEST_SCHEMA).alias("r"))
        requests = parsed.select(*others, "r.*")
    else:
        requests = spark.read.schema(REQUEST_SCHEMA).json(source)
    return requests.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(default))
            for name, default in REQUEST_DEFAULTS.items()
        }
    )
