"""SimHash near-duplicates, found through tables of distances to pivots."""

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import lots

SEED = 42
SHINGLE = 3
RADIUS = 2
PIVOTS = 16
BLOCKS = [0xFFFF << (16 * b) for b in range(4)]
# Fingerprints that may be compared pairwise within one bucket.
BUCKET = 64
_ALL = (1 << 64) - 1
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def _signed(x):
    x &= _ALL
    return x - (1 << 64) if x >> 63 else x


def pivots(count=PIVOTS):
    """Reference fingerprints from a fixed rule, spread evenly over all bits."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(count)]


def fingerprint(data):
    """The fingerprint of UTF-8 bytes as a signed 64-bit integer.

    A-Z are lower-cased, words are split at ASCII white space, shingles of three
    words count as often as they occur. Fewer words: the whole sequence is one
    shingle. Null or no word: 0.
    """
    words = (data or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    places = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + _PLACES
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel()
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs, key="doc_id", text="text"):
    """``key, fp long, text_hash long`` for every row; no row is moved."""
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            fp = pa.array([fingerprint(x) for x in lot.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([lot.column(0), lot.column(1), fp], ["k", "text_hash", "fp"])

    return docs.select(
        F.col(key).alias("k"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("b")
    ).mapInArrow(each, schema)


def pivot_table(distinct):
    """Distances of each fingerprint to the pivots, and keys of unchanged blocks.

    ``near`` holds the distances to the 16 pivots, seven bits used of each byte
    of two longs. A second set of references is each pivot with one 16-bit block
    inverted: the difference of the two distances depends on that block alone.
    At most two of 64 bits differ in a link, so at least two of the four blocks
    agree in all these differences; each pair of blocks gives one key.
    """
    fp = F.col("fp")
    to = lambda p: F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)).cast("long"))).cast("long")
    refs = pivots()
    tables = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    for i, p in enumerate(refs):
        tables[i // 8] = tables[i // 8].bitwiseOR(F.shiftleft(to(p), 8 * (i % 8)))
    blocks = [F.xxhash64(*[to(p) - to(p ^ mask) for p in refs]).alias(f"b{b}") for b, mask in enumerate(BLOCKS)]
    keyed = distinct.select("fp", tables[0].alias("near0"), tables[1].alias("near1"), *blocks)
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    keys = F.array(*[F.xxhash64(F.lit(4 * a + b), f"b{a}", f"b{b}") for a, b in pairs])
    return keyed.select("fp", "near0", "near1", F.explode(keys).alias("key"))


def _within(a, b):
    """No pivot tells the two fingerprints apart by more than the radius."""
    test = F.lit(True)
    for part in ("near0", "near1"):
        for i in range(8):
            x, y = (F.shiftright(F.col(f"{s}.{part}"), 8 * i).bitwiseAND(F.lit(127)) for s in (a, b))
            test = test & (F.abs(x - y) <= RADIUS)
    return test


def links(distinct, bucket=BUCKET):
    """Pairs ``u < v`` that join all fingerprints within the radius of each other.

    In buckets of up to ``bucket`` fingerprints, pairs are dropped by the largest
    difference of their pivot distances and the rest is verified. Larger buckets
    would give too many pairs; each of their fingerprints names itself and its 64
    neighbours by one bit as centres. Two fingerprints within two bits share a
    centre, a centre has 65 members at most, and each is linked to the smallest.
    Both ways are exact, so no link between two groups is lost.
    """
    table = settle(pivot_table(distinct))
    full = settle(table.groupBy("key").count().filter(F.col("count") > bucket).select("key"))
    light = table.join(full, "key", "left_anti")
    a, b = light.alias("a"), light.alias("b")
    near = (
        a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _within("a", "b"))
        .filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    hot = table.join(full, "key", "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    stars = (
        hot.select("fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        .agg(F.collect_set("fp").alias("members"))
        .filter(F.size("members") > 1)
        .select(F.array_min("members").alias("u"), F.explode("members").alias("v"))
        .filter(F.col("u") != F.col("v"))
    )
    return near.unionByName(stars).distinct()


def connected(edges):
    """``node, root``: the smallest node each node of ``edges`` can reach.

    Each round takes the smallest root among a node's neighbours, then the root
    of that root, and is written to the shared folder, so lineage stays short.
    """
    both = settle(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    roots = settle(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        heard = both.join(roots.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("heard"))
        nearer = roots.join(heard, "node").select("node", F.col("root").alias("was"), F.least("root", "heard").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        now = settle(nearer.join(up, "root").select("node", "was", F.least("root", "up").alias("root")))
        if now.filter(F.col("was") != F.col("root")).isEmpty():
            return now.select("node", "root")
        roots = now.select("node", "root")


def near_duplicates(docs, key="doc_id", text="text", bucket=BUCKET):
    """``key, fp, text_hash, component_id`` for every row of ``docs``.

    Rows of one fingerprint are one class; classes are linked as in ``links``.
    ``component_id`` is the smallest key reachable, null only if all keys of the
    component are null. Null and empty texts have fingerprint 0 and are linked
    like any other; repeated rows stay; an empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    rows = settle(fingerprints(docs, key, text))
    classes = settle(rows.groupBy("fp").agg(F.min("k").alias("first")))
    roots = connected(links(classes.select("fp"), bucket))
    member = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = settle(member)
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    classed = member.join(smallest, "root").select("fp", "component_id")
    return rows.join(classed, "fp").select(F.col("k").alias(key), "fp", "text_hash", "component_id")


def one_row_each(docs, kept, key="doc_id", text="text"):
    """The rows of ``docs`` that ``kept`` names by ``_key, _hash``, one for each; ``_rows`` is how many there are."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("k"), F.xxhash64(docs[text]).alias("h"))
    mine = (F.col("_key").eqNullSafe(F.col("k"))) & (F.col("_hash") == F.col("h"))
    again = settle(kept.filter("_rows > 1").drop("_rows"))
    if again.isEmpty():
        return packed.join(kept, mine, "left_semi").select("row.*")
    once = packed.join(kept.filter("_rows = 1"), mine, "left_semi")
    return once.unionByName(packed.join(again, mine, "left_semi").dropDuplicates(["k", "h"])).select("row.*")


def keep_one(docs, key="doc_id", text="text"):
    """One document of each component stays: that with the smallest key.

    Rows that repeat a kept key and text are one document and leave one row. The
    texts of all other rows are not moved but by the join with the kept keys.
    """
    found = near_duplicates(docs, key, text)
    kept = settle(
        found.filter(F.col(key).eqNullSafe(F.col("component_id")))
        .groupBy(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"))
        .agg(F.count("*").alias("_rows"))
    )
    return one_row_each(docs, kept, key, text)
