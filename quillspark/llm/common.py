"""Helpers that the operators of this folder share."""

import math

from pyspark.sql import functions as F

from ..plans.sizing import measured_bytes
from ..session import settle

# Rows taken from an Arrow batch at a time, so that long texts are decoded in small lots.
# Spark itself bounds the bytes of a batch (spark.sql.execution.arrow.maxBytesPerBatch).
LOT = 256
# A table is broadcast only if it was stored and measured below this.
BROADCAST_BYTES = 64 << 20


def lots(batches, size=LOT):
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def texts_of(column):
    """Texts of a binary column; invalid UTF-8 is replaced, null stays null."""
    return [None if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()]


def fold(key, parts):
    """crc32 of the key as text, modulo ``parts``; null keys fall into fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(0))


def broadcast_if_small(df, limit=BROADCAST_BYTES):
    """The table, stored; hinted for broadcast only if it measures small."""
    kept = settle(df)
    return F.broadcast(kept) if measured_bytes(kept) <= limit else kept


def labelled_texts(docs, labels, label, key, text, learn, most):
    """At most ``most[c]`` texts of class c, as ``label int, text binary``.

    Labels that are null, not 0 or 1, or of a null key are left out; of several
    labels of a key the largest counts. Which rows are taken follows from a hash
    of the key alone, so the sample is the same in every run. Only the chosen
    keys, whose number is bounded, are broadcast; the texts do not move.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learn)
        .groupBy(F.col(key).alias("_k"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = [
        known.filter(F.col("label") == c).orderBy(F.xxhash64("_k"), "_k").limit(most[c])
        for c in (0, 1)
    ]
    wanted = settle(chosen[0].unionByName(chosen[1]))
    return settle(
        docs.select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("text"))
        .join(F.broadcast(wanted), "_k")
        .select("label", "text")
    )


def logistic(x):
    """1 / (1 + exp(-x)) without overflow."""
    if x >= 0:
        return 1.0 / (1.0 + math.exp(-min(x, 700.0)))
    e = math.exp(max(x, -700.0))
    return e / (1.0 + e)


def text_id(text):
    """128 bits that stand for a text; null is a text of its own."""
    return F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2")


def one_row_each(docs, kept, key, text):
    """The rows of ``docs`` that ``kept`` names by ``k, h1, h2``, one for each; ``n`` is how many there are."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("k"), *text_id(docs[text]))
    mine = lambda named: packed["k"].eqNullSafe(named["k"]) & (packed["h1"] == named["h1"]) & (packed["h2"] == named["h2"])
    again = settle(kept.filter("n > 1"))
    if again.isEmpty():
        return packed.join(kept, mine(kept), "left_semi").select("row.*")
    single = kept.filter("n = 1")
    once = packed.join(single, mine(single), "left_semi")
    return once.unionByName(packed.join(again, mine(again), "left_semi").dropDuplicates(["k", "h1", "h2"])).select("row.*")
