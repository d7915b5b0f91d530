"""Size checks before data is broadcast."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIB = 1 << 20
# What may be broadcast once it has been measured.
BROADCAST_BYTES = 64 * MIB


def measured_bytes(df: DataFrame) -> int:
    """Bytes of a table with an allowance per row and fixed-size column; one job."""
    row = F.lit(64 + 16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            row = row + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("map", "array", "struct")):
            row = row + F.coalesce(F.octet_length(F.to_json(name)), F.lit(0))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes=BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size allows; else leave it to a shuffle."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
