"""WARC archives: writing with revisits, reading by verified boundary chains."""

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import new_shared_path, settle
from .common import broadcast_if_small, lots

# Fixed values of the format.
MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
# Payloads below this are stored however often they occur.
REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"


def revisits(pages, key="page_id", payload="html", least=REVISIT_BYTES):
    """``pages`` with ``_digest, _size, _head``: the key that holds an equal payload.

    Of rows with equal payloads of ``least`` bytes or more the largest key is the
    head; ``_head`` is null for heads (repeated rows of the largest key all are),
    for smaller payloads and for rows without a key. Only digests that occur more
    than once are joined, as a broadcast if they measure small; else rows are
    shuffled on the digest, where adaptive execution splits a hot one.
    """
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    marked = pages.withColumn("_digest", F.sha1(data)).withColumn("_size", F.octet_length(data).cast("long"))
    able = F.col(key).isNotNull() & (F.col("_size") >= least)
    heads = (
        marked.filter(able).groupBy("_digest", "_size").agg(F.max(key).alias("_max"), F.count("*").alias("_n"))
        .filter("_n > 1").select(F.col("_digest").alias("_d"), F.col("_size").alias("_s"), "_max")
    )
    same = (F.col("_digest") == F.col("_d")) & (F.col("_size") == F.col("_s")) & able
    joined = marked.join(broadcast_if_small(heads), same, "left")
    return joined.withColumn("_head", F.when(F.col("_max") != F.col(key), F.col("_max"))).drop("_d", "_s", "_max")


def write_archives(pages, path, key="page_id", url="url", payload="html", date=DATE):
    """One record per row, in the files of a folder that Spark's text writer makes.

    Null payloads are empty, null URLs leave their field out; control characters
    and the magic are escaped in URLs. Revisits have no block and carry digest and
    size of the full payload in their header. An empty table gives an archive
    without records. Other columns are not read.
    """
    rows = revisits(pages.select(key, url, payload), key, payload)
    address = F.col(url)
    for bad, good in (("\r", "%0D"), ("\n", "%0A"), ("WARC/", "WARC%2F")):
        address = F.replace(address, F.lit(bad), F.lit(good))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("_head").isNotNull()
    field = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        field("WARC-Record-ID", name(F.col(key))),
        field("WARC-Date", F.lit(date)),
        F.coalesce(field("WARC-Target-URI", address), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        field("WARC-Payload-Length", F.col("_size").cast("string")),
        F.coalesce(field("WARC-Refers-To", F.when(again, name(F.col("_head")))), F.lit("")),
        field("Content-Type", F.lit("text/html")),
        F.lit("Content-Length: "), F.when(again, F.lit(0).cast("long")).otherwise(F.col("_size")).cast("string"),
        F.lit(END.decode()),
        F.when(again, "").otherwise(F.coalesce(F.col(payload), F.lit(""))),
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).text(path)


def parse(data):
    """(fields, where the payload starts, its length) of what follows a magic, or None."""
    head = data.find(END)
    if head < 0:
        return None
    fields = {}
    for line in data[:head].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    size = fields.get(b"content-length", "")
    return (fields, head + 4, int(size)) if size.isascii() and size.isdigit() else None


def _described(fields, payload):
    """Columns of a record from its fields and, unless None, its payload."""
    of = lambda k: fields.get(k)
    page = lambda k: (of(k) or "").removeprefix("<urn:page:").removesuffix(">") or None
    told = (of(b"warc-payload-digest") or "").removeprefix("sha1:")
    kind = of(b"warc-type")
    if kind == "revisit":
        size = of(b"warc-payload-length") or "0"
        return [kind, page(b"warc-record-id"), page(b"warc-refers-to"), told, int(size) if size.isdigit() else 0, True]
    if payload is None:
        return [kind, page(b"warc-record-id"), None, told, None, None]
    digest = hashlib.sha1(payload).hexdigest()
    return [kind, page(b"warc-record-id"), None, digest, len(payload), digest == told]


_RECORD = "type string, id string, refers string, digest string, size long, intact boolean"
_CANDIDATE = f"file string, block long, rel long, bytes long, next long, exit long, whole boolean, {_RECORD}"


def _candidates(batches):
    """One row per magic with its successor, and one per block with its bytes.

    A position is that after the magic. Successors that stay in the block are
    followed at once, last to first, so ``exit`` is where a chain leaves it; -1
    where it breaks. The row with ``rel`` -1 tells how many bytes a block's rows
    take up, as its own place in the file is not known before.
    """
    import pyarrow as pa

    names = [x.split()[0] for x in _CANDIDATE.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def flush(place, rows, total):
        at = {r[0]: i for i, r in enumerate(rows)}
        exits = [-1] * len(rows)
        for i in range(len(rows) - 1, -1, -1):
            following = rows[i][2]
            exits[i] = exits[at[following]] if following in at else following if following >= total else -1
        out = [[*place, -1, total, -1, -1, False, *[None] * 6]]
        out += [[*place, r[0], r[1], r[2], e, *r[3:]] for r, e in zip(rows, exits)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    place, rows, total = None, [], 0
    for lot in lots(batches):
        for data, file, block in zip(*(lot.column(i).to_pylist() for i in range(3))):
            if (file, block) != place:
                if place:
                    yield flush(place, rows, total)
                place, rows, total = (file, block), [], 0
            if total or block:
                found = parse(data)
                if found:
                    fields, start, size = found
                    end = start + size + len(END)
                    whole = end == len(data) and data.endswith(END)
                    rows.append([total, len(data), total + end + len(MAGIC), whole, *_described(fields, data[start : start + size] if whole else None)])
            total += len(data) + len(MAGIC)
    if place:
        yield flush(place, rows, total)


def _rows(spark, path):
    """The archives cut at every magic, in order within each block of a file."""
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("length"))


def _reachable(starts, jumps):
    """Nodes on the chains from ``starts`` by pointer jumping.

    With every round the pointers skip twice as many blocks, so the rounds are
    the logarithm of the blocks of a file. Each round is written to the shared
    folder.
    """
    reached = settle(starts)
    jumps = settle(jumps)
    while True:
        new = settle(reached.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at")))
        if new.isEmpty():
            return reached
        reached = settle(reached.unionByName(new).distinct())
        further = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("far"))
        jumps = settle(jumps.join(further, ["file", "exit"]).select("file", "at", F.col("far").alias("exit")))


def read_archives(spark, path):
    """Records of all archives in a folder: ``file, at, type, id, refers, digest, size, intact``.

    Files are read in blocks by many tasks, cut at every magic, be it a record's
    or one in a payload. Each candidate names its successor; only candidates that
    a chain from the start of their file reaches are records. A chain that breaks
    ends there: what follows a damaged record is not believed. ``digest`` and
    ``size`` are of the payload as read; ``intact`` tells whether the digest is
    the one the header gives. Revisits tell those of the payload they refer to.
    The magic must be that of version 1.0, and no header field may end in it.
    """
    found = settle(_rows(spark, path).mapInArrow(_candidates, _CANDIDATE))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = settle(found.filter("rel = -1").select("file", "block", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("base")))
    nodes = found.filter("rel >= 0").join(bases, ["file", "block"])
    for c in ("next", "exit"):
        nodes = nodes.withColumn(c, F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(-1))
    nodes = settle(nodes.withColumn("at", F.col("rel") + F.col("base")).drop("rel", "base"))
    starts = bases.select("file", F.lit(len(MAGIC)).cast("long").alias("at")).distinct()
    entered = nodes.filter("exit >= 0").select("file", F.col("exit").alias("at")).unionByName(starts).distinct()
    jumps = nodes.filter("exit >= 0").select("file", "at", "exit").join(entered, ["file", "at"], "left_semi")
    reached = _reachable(starts, jumps)
    entries = settle(nodes.select("file", "block", "at").join(reached, ["file", "at"], "left_semi"))

    def walk(entry, inside):
        follow = dict(zip(inside["at"], inside["next"]))
        kept = set()
        for at in entry["at"]:
            while at in follow and at not in kept:
                kept.add(at)
                at = follow[at]
        return inside[inside["at"].isin(kept)][["file", "at"]]

    kept = entries.groupBy("file", "block").cogroup(nodes.select("file", "block", "at", "next").groupBy("file", "block")).applyInPandas(walk, "file string, at long")
    records = settle(nodes.join(kept, ["file", "at"], "left_semi"))
    columns = ["file", "at", "type", "id", "refers", "digest", "size", "intact"]
    whole = records.filter("whole").select(*columns)
    cut = records.filter("not whole")
    if cut.isEmpty():
        return whole
    return whole.unionByName(_rejoined(spark, path, bases, records, cut).select(*columns))


def _rejoined(spark, path, bases, records, cut):
    """Records whose payload holds a magic, put together from the pieces it was cut to."""

    def pieces(batches):
        import pyarrow as pa

        place, total = None, 0
        for lot in lots(batches):
            files, blocks, rels = [], [], []
            for data, file, block in zip(*(lot.column(i).to_pylist() for i in range(3))):
                if (file, block) != place:
                    place, total = (file, block), 0
                files.append(file)
                blocks.append(block)
                rels.append(total)
                total += len(data) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(blocks, pa.int64()), pa.array(rels, pa.int64()), lot.column(0)], ["file", "block", "rel", "value"])

    def places(batches):
        for batch in pieces(batches):
            yield batch.select(["file", "block", "rel"])

    spots = _rows(spark, path).mapInArrow(places, "file string, block long, rel long").join(bases, ["file", "block"]).select("file", (F.col("rel") + F.col("base")).alias("at"))
    known = records.select("file", "at", F.col("at").alias("owner"))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = spots.join(known, ["file", "at"], "left").withColumn("owner", F.last("owner", ignorenulls=True).over(before))
    wanted = settle(owned.join(cut.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi"))
    texts = _rows(spark, path).mapInArrow(pieces, "file string, block long, rel long, value binary").join(bases, ["file", "block"]).withColumn("at", F.col("rel") + F.col("base"))
    parts = texts.join(wanted, ["file", "at"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))

    @F.udf(f"struct<{_RECORD.replace(' ', ':').replace(',:', ',')}>")
    def joined(parts):
        data = MAGIC.join(bytes(p["value"]) for p in parts)
        found = parse(data)
        if not found or len(data) < found[1] + found[2]:
            return None
        return tuple(_described(found[0], data[found[1] : found[1] + found[2]]))

    return parts.withColumn("r", joined("parts")).filter("r is not null").select("file", F.col("owner").alias("at"), "r.*")


def round_trip(pages, key="page_id", url="url", payload="html"):
    """Write the archives of ``pages`` to the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_shared_path(spark)
    write_archives(pages, path, key, url, payload)
    return read_archives(spark, path)
