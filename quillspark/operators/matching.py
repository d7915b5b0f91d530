"""Requests against the files that exist.

Both joins shuffle plainly on the key, the form in which adaptive execution can
see a hot key and split it: many requests may name the same file. Files that no
request names are left out while they are scanned, so their content is not
shuffled.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unused
from ..plans.sizing import BROADCAST_BYTES, measured_bytes
from ..session import settle

BITS = 1 << 15  # of one bitmap
BITS_PER_KEY = 10


def may_match(df: DataFrame, keys: DataFrame, on, broadcast_bytes=BROADCAST_BYTES) -> DataFrame:
    """Rows of ``df`` whose key may be one of ``keys``; no row whose key is one is lost.

    Keys that measure small are broadcast and the answer is exact. Of more keys a
    filter of bits is made, ten a key as long as all fit in ``broadcast_bytes``:
    the hash of a key names a bitmap and a bit of it, and only the bitmaps are
    broadcast. About one row in ten of the others passes, more when the bits are
    fewer. Null keys match nothing. The input does not move.
    """
    on = [on] if isinstance(on, str) else list(on)
    wanted = settle(keys.select(*on).dropna().distinct())
    if measured_bytes(wanted) <= broadcast_bytes:
        return df.join(F.broadcast(wanted), on, "left_semi")
    maps = max(1, min(broadcast_bytes // (BITS // 8 + 128), -(-wanted.count() * BITS_PER_KEY // BITS)))
    number, bits = unused("_map", df), unused("_bits", df)

    def place(frame):
        # One form of the key on both sides, whatever its types.
        kinds = dict(wanted.dtypes)
        return F.pmod(F.xxhash64(*[frame[c].cast(kinds[c]) for c in on]), F.lit(maps * BITS))

    filled = wanted.groupBy(F.floor(place(wanted) / BITS).alias(number)).agg(F.bitmap_construct_agg(place(wanted) % BITS).alias(bits))
    at = place(df) % BITS
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (at % 8).cast("int")) == 1
    marked = df.withColumn(number, F.floor(place(df) / BITS))
    return marked.join(F.broadcast(filled), number).filter(found).select(*df.columns)


def match_requests(requests: DataFrame, files: DataFrame, on, broadcast_bytes=BROADCAST_BYTES) -> DataFrame:
    """Each request with its file."""
    return requests.join(may_match(files, requests, on, broadcast_bytes), on, "inner")


def missing_files(requests: DataFrame, files: DataFrame, on, broadcast_bytes=BROADCAST_BYTES) -> DataFrame:
    """Requests whose file does not exist; only the key of ``files`` is read."""
    keys = [on] if isinstance(on, str) else list(on)
    return requests.join(may_match(files.select(*keys), requests, keys, broadcast_bytes), on, "left_anti")
