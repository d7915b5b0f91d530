"""Documents that come in ordered parts: pages, turns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.result import bind
from ..plans.sizing import broadcast_if_small
from ..session import settle
from .running import running_sums

# A document up to this size becomes one row; a cell holds 2 GiB at most.
MAX_DOCUMENT_BYTES = 256 << 20
# Starts of pieces that are searched at once.
SEARCH = 512


def slice_parts(df: DataFrame, ord_col: str, start=0, end=None) -> DataFrame:
    """Parts with ordinal in ``[start, end]``; a null end means: to the end.

    Plain numbers are pushed down to the scan. Bounds may also be columns, for
    a table joined with its requests.
    """
    position = F.col(ord_col)
    if isinstance(start, Column) or isinstance(end, Column):
        first = start if isinstance(start, Column) else F.lit(start)
        last = end if isinstance(end, Column) else F.lit(end)
        return df.filter((position >= F.coalesce(first, F.lit(0))) & (position <= F.coalesce(last, position)))
    if start < 0 or (end is not None and end < 0):
        raise ValueError("start_page or end_page is below 0")
    if end is not None and end < start:
        raise ValueError("end_page comes before start_page")
    df = df.filter(position >= start)
    return df if end is None else df.filter(position <= end)


def _part(heading: str, text: str) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("## "), F.col(heading)), F.coalesce(F.col(text), F.lit("")))


def part_bytes(heading: str, text: str) -> Column:
    """Bytes of one part in its document, the blank line before the next included."""
    return F.octet_length(_part(heading, text)).cast("long") + 2


def piece_starts(sizes: DataFrame, max_bytes: int) -> DataFrame | None:
    """``_long, _firsts, _starts`` of every document over the limit; None without any.

    ``sizes`` has ``key, ord, bytes``. Running bytes, summed over ranges of all
    parts, put the parts of a document into units of a 64th of the limit; a part
    of more than half the limit is a unit of its own. Units, which are few and
    narrow, are then put together in order as long as they stay under the limit.
    ``_starts`` holds the first ordinal of each piece, in runs of ``SEARCH``;
    ``_firsts`` the first of each run. Only long documents are numbered.
    """
    grouped = sizes.groupBy("key", "ord").agg(F.sum("bytes").alias("bytes"))
    long = settle(grouped.groupBy(F.col("key").alias("_key")).agg(F.sum("bytes").alias("_all")).filter(F.col("_all") > max_bytes).select("_key"))
    if long.isEmpty():
        return None
    big = (F.col("bytes") > max_bytes // 2).cast("long")
    kept = grouped.join(broadcast_if_small(long), F.col("key").eqNullSafe(F.col("_key"))).drop("_key").withColumn("_big", big)
    placed = running_sums(kept, "key", "ord", before="bytes", bigs="_big")
    unit = F.struct((2 * F.col("bigs") + F.col("_big")).alias("a"), F.when(F.col("_big") == 0, F.floor(F.col("before") / max(max_bytes // 64, 1))).alias("b"))
    units = placed.groupBy("key", unit.alias("unit")).agg(F.min("ord").alias("first"), F.min("before").alias("at"), F.sum("bytes").alias("bytes"))

    def pack(batches):
        import pyarrow as pa

        here, number, size = None, 0, 0
        for batch in batches:
            keep, numbers = [], []
            for i, (key, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if here != (key,):
                    here, number, size = (key,), 0, n
                elif size + n > max_bytes + 2:  # no blank line behind the last part
                    number, size = number + 1, n
                else:
                    size += n
                    continue
                keep.append(i)
                numbers.append(number)
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(numbers, pa.int64())], ["key", "first", "number"])

    ordered = units.repartition("key").sortWithinPartitions("key", "at").select("key", "first", "bytes")
    kinds = ordered.schema
    numbered = ordered.mapInArrow(pack, T.StructType([kinds["key"], kinds["first"], T.StructField("number", T.LongType())]))
    runs = numbered.groupBy("key", F.floor(F.col("number") / SEARCH).alias("run")).agg(F.sort_array(F.collect_list(F.struct("number", "first"))).alias("x"))
    runs = runs.select("key", "run", F.transform("x", lambda s: s["first"]).alias("starts"))
    # Two pieces in a row hold more than ``max_bytes``, so a document's list is far below a cell's limit.
    return runs.groupBy(F.col("key").alias("_long")).agg(F.sort_array(F.collect_list(F.struct("run", "starts"))).alias("x")).select(
        "_long", F.transform("x", lambda s: s["starts"]).alias("_starts"), F.transform("x", lambda s: F.get(s["starts"], F.lit(0))).alias("_firsts")
    )


def _piece_of(position: Column) -> Column:
    """The piece a part is in: the last that does not start behind it."""

    reached = lambda starts: F.size(F.filter(starts, lambda x: x.isNull() | (x <= position)))
    run = F.greatest(reached(F.col("_firsts")) - 1, F.lit(0))
    within = bind(run, lambda r: r * SEARCH + F.greatest(reached(F.get("_starts", r)) - 1, F.lit(0)))
    return F.when(F.col("_firsts").isNull(), 0).otherwise(within).cast("long")


def assemble_parts(
    df: DataFrame, key: str, ord: str, heading: str, text: str, max_bytes=MAX_DOCUMENT_BYTES, sizes=None
) -> DataFrame:
    """Join the parts of each document in order: ``(key, piece, markdown)``.

    The parts are grouped by key and joined, one shuffle of the text. A document
    over ``max_bytes`` would not fit one task (or one cell), so it comes as
    several rows instead: pieces 0, 1, 2, ... in order, without gaps whatever the
    ordinals, each under the limit unless a single part is over it, and each
    grouped on its own. Nothing is left out, and one key holding a large share of
    all parts is spread like any other data.

    Pieces come from the sizes of the parts alone (``key, ord, bytes``, taken from
    ``df`` unless given). What is joined to the parts is a list of starts per long
    document; it is broadcast if it measures small. Parts of equal ordinal stay
    together, those of null ordinal come first.
    """
    if sizes is None:
        sizes = df.select(F.col(key).alias("key"), F.col(ord).alias("ord"), part_bytes(heading, text).alias("bytes"))
    starts = piece_starts(sizes, max_bytes)
    parts = F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), _part(heading, text).alias("p"))))
    if starts is None:
        dealt, piece = df, F.lit(0).cast("long")
    else:
        dealt, piece = df.join(broadcast_if_small(settle(starts)), F.col(key).eqNullSafe(F.col("_long")), "left"), _piece_of(F.col(ord))
    return (
        dealt.groupBy(key, piece.alias("piece"))
        .agg(F.array_join(F.transform(parts, lambda x: x["p"]), "\n\n").alias("markdown"))
    )
