"""Which converter a document goes to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizing import BROADCAST_BYTES, measured_bytes
from ..session import settle


def route_engine(requested: Column, default: str, by_extension: Column) -> Column:
    """A named engine wins, then the configured default, then the extension.

    ``auto`` in either place leaves the choice to the extension.
    """
    named = F.lower(requested)
    fallback = by_extension if default == "auto" else F.lit(default.lower())
    return (
        F.when(named == "auto", by_extension)
        .when(F.length(named) > 0, named)
        .otherwise(fallback)
    )


def engine_for_extension(df: DataFrame, support: DataFrame, ext="ext") -> DataFrame:
    """Add ``engine``: the supporting converter of lowest rank, or null.

    ``support`` has one row per (ext, engine, rank); of equal ranks the smallest
    ``place`` wins, where there is one, then the first by name. It is reduced to one row
    per extension first, so the document side is not grouped. The reduced side
    is measured and broadcast if small, so documents do not move and a common
    extension is no hot key. Past the limit it is stored, which leaves a plain
    shuffle join where adaptive execution can split such a key.
    """
    order = ["rank", *[c for c in ("place",) if c in support.columns], "engine"]
    best = support.groupBy(F.lower("ext").alias("_ext")).agg(
        F.min_by("engine", F.struct(*order)).alias("engine")
    )
    if measured_bytes(best) <= BROADCAST_BYTES:
        best = F.broadcast(best)
    else:
        best = settle(best)
    return df.join(best, F.lower(F.col(ext)) == F.col("_ext"), "left").drop("_ext")
