"""Near copies by the Jaccard similarity of word shingles.

Fingerprints and the tables of their distances to pivots find the nearest texts,
MinHash bands those that differ by more bits; texts found either way are verified.
"""

import numpy as np
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import broadcast_if_small, lots, one_row_each, text_id
from .simhash import connected, fingerprint, links

SHINGLE = 5
SIMILARITY = 0.8
# Two texts at the similarity share a band with a chance of 1 - (1 - 0.8**5)**20 = 0.9996.
BANDS, BAND_ROWS = 20, 5
SEED = 42
CHUNK = 4096  # shingles whose hashes are mixed at a time
STARS = 3  # rounds that compare with one member of a bucket, before other pairs are looked for
PAIRS = 2  # pairs left for each entry of a bucket that are few enough to compare
BITS = 8192  # of the map of a text's shingles
BEGIN = 16  # shingles of a text that go along with each of its keys
_MIX = np.array([xxhash.xxh64_intdigest(f"mix {i}".encode(), SEED) | 1 for i in range(BANDS * BAND_ROWS)], np.uint64)


def shingles_of(data):
    """The set of five-word shingles of UTF-8 bytes, split and lower-cased as for fingerprints.

    Fewer words: the whole sequence is one shingle. Null or no word: none.
    """
    words = (data or b"").lower().split()
    if len(words) < SHINGLE:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)])))


def bands_of(shingles):
    """One signed 64-bit key for each band of smallest mixed hashes."""
    least = np.full(len(_MIX), np.iinfo(np.uint64).max)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    for s in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[s : s + CHUNK, None] * _MIX[None, :]).min(0))
    parts = least.reshape(BANDS, BAND_ROWS)
    keys = np.array([xxhash.xxh64_intdigest(p.tobytes(), b) for b, p in enumerate(parts)], np.uint64)
    return keys.view(np.int64)


def similarity(a, b):
    """Jaccard similarity of two sets of shingles; two texts without a word are alike."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def signatures(docs, key="doc_id", text="text"):
    """``k, h1, h2, size, bands, fp`` for every row: 128 bits of the text, number of shingles, band keys, fingerprint."""
    fields = [("k", docs.schema[key].dataType), ("h1", T.LongType()), ("h2", T.LongType()), ("size", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("fp", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            texts = lot.column(3).to_pylist()
            sets = [shingles_of(x) for x in texts]
            fps = pa.array([fingerprint(x) for x in texts], pa.int64())
            bands = pa.array([bands_of(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*lot.columns[:3], pa.array(map(len, sets), pa.int64()), bands, fps], ["k", "h1", "h2", "size", "bands", "fp"])

    return docs.select(F.col(key).alias("k"), *text_id(docs[text]), docs[text].cast("binary").alias("b")).mapInArrow(each, schema)


def verified(pairs, texts):
    """The pairs ``u, v`` whose whole texts reach the similarity."""

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            last, kept = None, []
            for u, a, b in zip(*[lot.column(c).to_pylist() for c in (0, 2, 3)]):
                if last is None or last[0] != u:
                    last = (u, shingles_of(a))
                kept.append(similarity(last[1], shingles_of(b)) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([lot.column(0), lot.column(1)], ["u", "v"]).filter(pa.array(kept, pa.bool_()))

    second = pairs.join(texts.select(F.col("node").alias("v"), F.col("b").alias("second")), "v")
    both = second.join(texts.select(F.col("node").alias("u"), F.col("b").alias("first")), "u")
    return both.select("u", "v", "first", "second").mapInArrow(each, "u long, v long")


def _alike(a, b):
    """Sizes from which the similarity can be reached."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILARITY


def _ordered(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def joined_roots(roots, new):
    """``node, root`` of all linked texts after new links ``u, v``; the others are their own roots.

    The links join the components there are, not all texts from the start.
    """
    end = lambda column, name: broadcast_if_small(roots.select(F.col("node").alias(column), F.col("root").alias(name)))
    ends = new.join(end("u", "a"), "u", "left").join(end("v", "b"), "v", "left")
    ends = ends.select(*_ordered(F.coalesce("a", "u"), F.coalesce("b", "v"))).filter("u <> v").distinct()
    step = settle(connected(ends))
    moved = roots.join(broadcast_if_small(step.select(F.col("node").alias("root"), F.col("root").alias("now"))), "root", "left")
    added = step.join(roots.select("node"), "node", "left_anti")
    return settle(moved.select("node", F.coalesce("now", "root").alias("root")).unionByName(added))


def pivot_pairs(classes):
    """``u, v``: texts that the pivot tables bring together and whose sizes allow the similarity.

    ``classes``: ``node, fp, size``. Texts of one fingerprint are paired with the first
    of them; the first ones of two fingerprints where ``simhash.links`` joins these.
    """
    heads = settle(classes.groupBy("fp").agg(F.min_by(F.struct("node", "size"), "node").alias("head"), F.count("*").alias("n")))
    several = broadcast_if_small(heads.filter("n > 1").select("fp", "head"))
    same = classes.join(several, "fp").filter(F.col("node") != F.col("head.node")).select(F.col("head").alias("a"), F.struct("node", "size").alias("b"))
    end = lambda fp, name: broadcast_if_small(heads.select(F.col("fp").alias(fp), F.col("head").alias(name)))
    near = settle(links(heads.select("fp"))).join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    return same.unionByName(near).filter(_alike(F.col("a.size"), F.col("b.size"))).select(*_ordered(F.col("a.node"), F.col("b.node")))


def still_mixed(entries, roots):
    """``node, size, key, root`` of the buckets whose texts lie in several components."""
    placed = entries.join(broadcast_if_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("key")
    return settle(placed.join(mixed, "key", "left_semi").select("node", "size", "key", "root"))


def components(entries, texts, roots, tested):
    """``node, root`` of all texts of the buckets that are near copies of another.

    ``entries``: ``node, size, key``; ``roots`` and ``tested``: what the pivot tables
    joined, and the pairs ``u, v`` verified for it. A round compares the members of each bucket
    with one of them and joins what is alike, so a large group of near copies
    falls together in few rounds of as many comparisons as members. Pairs within
    one component need no comparison. If few pairs of other components are left in
    the buckets, these are compared; else those that share a rare shingle, as
    ``prefix_pairs`` states. So no link between two groups is lost, and families
    that share a passage but are not alike make no pairs.
    """
    total = entries.count()
    placed = still_mixed(entries, roots)
    for turn in range(STARS):
        heads = placed.groupBy("key").agg(F.min_by("root", "node").alias("main"))
        other = F.col("root") != F.col("main") if turn else F.lit(True)
        chosen = F.min_by(F.struct("node", "root", "size"), F.when(other, F.xxhash64("node", F.lit(turn))))
        heads = broadcast_if_small(placed.join(heads, "key").groupBy("key").agg(chosen.alias("head")))
        stars = placed.join(heads, "key").filter((F.col("root") != F.col("head.root")) & _alike(F.col("size"), F.col("head.size")))
        stars = settle(stars.select(*_ordered(F.col("node"), F.col("head.node"))).distinct().join(tested, ["u", "v"], "left_anti"))
        tested = settle(tested.unionByName(stars))
        new = settle(verified(stars, texts))
        roots = joined_roots(roots, new)
        # Buckets that fell together are done, so only the others go on.
        placed = still_mixed(placed.drop("root"), roots)
        sizes = placed.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("own"))
        left = sizes.agg(F.sum(F.col("n") * F.col("n") - F.col("own"))).first()[0] or 0
        if left / 2 <= PAIRS * total:
            break
    else:
        rest = prefix_pairs(placed.groupBy("node").agg(F.min("root").alias("root")), texts)
        rest = settle(rest.join(tested, ["u", "v"], "left_anti"))
        return joined_roots(roots, settle(verified(rest, texts)))
    a, b = placed.alias("a"), placed.alias("b")
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & _alike(F.col("a.size"), F.col("b.size")))
    rest = settle(rest.select(*_ordered(F.col("a.node"), F.col("b.node"))).distinct().join(tested, ["u", "v"], "left_anti"))
    return joined_roots(roots, settle(verified(rest, texts)))


def prefix_pairs(nodes, texts):
    """``u, v``: all pairs of ``node, root`` that may reach the similarity and lie in different roots.

    The shingles of each text are put in order, rarest first. Two texts reach the
    similarity only if they share one of their first size - ceil(0.8 size) + 1
    shingles, only if what stands behind that one leaves enough to share, and only
    if the maps of their shingles, a bit for each hash, share enough bits. So a
    text that differs from all others in a fifth of its shingles has no partner at
    all, and passages that many texts share are the key of none.
    """

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            sets = [np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles_of(t)], np.uint64).view(np.int64) for t in lot.column(2).to_pylist()]
            size = pa.array([len(x) for x in sets], pa.int64())
            maps = np.zeros((len(sets), BITS), np.uint8)
            for row, x in zip(maps, sets):
                row[x.view(np.uint64) % BITS] = 1
            lost = pa.array([len(x) for x in sets] - maps.sum(1, dtype=np.int64), pa.int64())
            longs = pa.array(list(np.packbits(maps, axis=1, bitorder="little").view("<i8")), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([lot.column(0), lot.column(1), size, lost, longs, pa.array(sets, pa.list_(pa.int64()))], ["node", "root", "size", "lost", "map", "hashes"])

    sets = settle(
        texts.join(broadcast_if_small(nodes), "node").select("node", "root", "b")
        .mapInArrow(each, "node long, root long, size long, lost long, map array<long>, hashes array<long>")
    )
    held = sets.select("node", "root", "size", F.explode("hashes").alias("h"))
    often = held.groupBy("h").count().filter("count > 1")
    # Shingles of one text come before all that are shared; of these only the place is needed.
    shared = held.join(often, "h")
    ranked = shared.groupBy("node", "root", "size").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("order"))
    single = F.col("size") - F.size("order")
    first = (F.col("size") - F.ceil(SIMILARITY * F.col("size")) + 1).cast("long")
    kept = F.slice("order", F.lit(1), F.greatest(first - single, F.lit(0)).cast("int"))
    begin = F.transform(F.slice(kept, 1, BEGIN), lambda x: x["h"]).alias("begin")
    keyed = settle(
        ranked.join(sets.select("node", "lost", "map"), "node")
        .select("node", "root", "size", "lost", "map", begin, single.alias("single"), F.posexplode(kept).alias("at", "x"))
        .select("node", "root", "size", "lost", "map", "begin", (F.col("single") + F.col("at")).alias("at"), F.col("x.h").alias("h"))
    )
    a, b = keyed.alias("a"), keyed.alias("b")
    least = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("a.size") + F.col("b.size")) - 1e-9)
    reach = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at"))
    # No more is shared than bits are, and shingles that fell on a bit already set.
    bits = F.aggregate(F.zip_with("a.map", "b.map", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda n, x: n + x)
    enough = (reach >= least) & (bits + F.least("a.lost", "b.lost") >= least)
    # A pair that shares one of the first few comes from the first of these alone.
    once = F.coalesce(F.get(F.array_intersect(F.col("a.begin"), F.col("b.begin")), F.lit(0)) == F.col("a.h"), F.lit(True))
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.root") < F.col("b.root")) & _alike(F.col("a.size"), F.col("b.size")) & enough & once)
    return met.select(*_ordered(F.col("a.node"), F.col("b.node"))).distinct()


def keep_one(docs, key="doc_id", text="text"):
    """One document of each group of near copies stays: that with the smallest key.

    Two texts are near copies from a Jaccard similarity of 0.8 of their sets of
    five-word shingles; groups are what such links connect. Pairs within two bits of
    their fingerprints come from the pivot tables of ``simhash``, as exactly as there;
    pairs that differ by more bits, most of those near the similarity, from the bands
    of the groups that these leave. All are verified on the whole texts. Null keys count as
    largest; texts without a word, null among them, are one group; repeated rows
    leave one row; columns may have any names; an empty table stays empty.
    """
    rows = settle(signatures(docs, key, text))
    grouped = rows.groupBy("h1", "h2").agg(F.min("k").alias("first"), F.min("size").alias("size"), F.min("bands").alias("bands"), F.min("fp").alias("fp"))
    classes = settle(grouped.withColumn("node", F.monotonically_increasing_id()))
    entries = classes.select("node", "size", F.explode("bands").alias("key"))
    shared = broadcast_if_small(entries.groupBy("key").count().filter("count > 1").select("key"))
    entries = settle(entries.join(shared, "key", "left_semi").select("node", "size", "key"))
    close = settle(pivot_pairs(classes.select("node", "fp", "size")))
    met = entries.select("node").union(close.select("u")).union(close.select("v")).distinct()
    wanted = broadcast_if_small(classes.join(met, "node", "left_semi").select("node", "first", "h1", "h2"))
    named = docs.select(docs[key].alias("k"), *text_id(docs[text]), docs[text].cast("binary").alias("b"))
    mine = (wanted["h1"] == named["h1"]) & (wanted["h2"] == named["h2"]) & wanted["first"].eqNullSafe(named["k"])
    texts = settle(named.join(wanted, mine).select("node", "b").dropDuplicates(["node"]))
    alone = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = components(entries, texts, joined_roots(alone, settle(verified(close, texts))), close)
    member = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = member.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "h1", "h2")).alias("m"))
    least = settle(least.select(F.col("m.first").alias("k"), F.col("m.h1").alias("h1"), F.col("m.h2").alias("h2")))
    counted = rows.join(least, rows["k"].eqNullSafe(least["k"]) & (rows["h1"] == least["h1"]) & (rows["h2"] == least["h2"])).groupBy(rows["k"], rows["h1"], rows["h2"]).agg(F.count("*").alias("n"))
    return one_row_each(docs, settle(counted), key, text)
