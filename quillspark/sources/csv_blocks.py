"""CSV files of any size as Markdown table rows, read in blocks."""

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

# A field from its first character: quoted with what follows the closing quote, or plain; then its end.
_FIELD = re.compile(rb'(?:"((?:[^"]++|"")*+)(?:(")([^,\r\n]*+))?|([^,\r\n]*+))(,|\r\n|\r|\n|\Z)')
# What is left of a quoted field that began on an earlier line.
_REST = re.compile(rb'(?:[^"]++|"")*+(?:"[^,\r]*+(,|\r|\Z))?')
# The longest record that is put together across blocks; a cell holds no more.
MAX_RECORD_BYTES = 1 << 30
_MARK = b"\xef\xbb\xbf"


def cut(line: bytes, quoted: bool):
    """Where records end in one physical line: ``(records, tail)``.

    ``quoted`` says that the line starts inside a quoted field; its first record
    is then the end of one that began before. ``records`` are (begin, end) of the
    complete ones; ``tail`` is where one begins that ends inside quotes, else -1.
    """
    if b'"' not in line:
        if quoted:
            return [], 0
        if b"\r" not in line:
            return [(0, len(line))], -1
    records, begin, at = [], 0, 0
    if quoted:
        m = _REST.match(line)
        if m[1] is None:
            return [], 0
        at = m.end()
        if m[1] != b",":
            records.append((0, m.start(1)))
            if at == len(line):
                return records, -1
            begin = at
    while True:
        m = _FIELD.match(line, at)
        if m[1] is not None and m[2] is None:
            return records, begin
        at = m.end()
        if m[5] != b",":
            records.append((begin, m.start(5)))
            if at == len(line):
                return records, -1
            begin = at


def blank(record: bytes):
    return not record.strip(b" ")


def cells(record: bytes) -> list:
    """The cells of one record, as they stand in a Markdown table."""
    out, at = [], 0
    while True:
        m = _FIELD.match(record, at)
        if m[1] is None:
            cell = m[4]
        else:
            cell = m[1].replace(b'""', b'"') + (m[3] or b"")
            cell = cell.replace(b"\r\n", b"<br>").replace(b"\r", b"<br>").replace(b"\n", b"<br>")
        out.append(cell.replace(b"|", b"\\|"))
        at = m.end()
        if m[5] != b",":
            return out


def _row(record, width):
    found = cells(record)[:width]
    return b"| " + b" | ".join(found + [b""] * (width - len(found))) + b" |"


def markdown_row(record: bytes, width: int, number: int) -> str:
    """The table row of a record; the first is the header and brings the rule."""
    row = _row(record, width)
    if number == 0:
        row += b"\n| " + b" | ".join([b"---"] * width) + b" |"
    return row.decode()


def _lines(spark, path) -> DataFrame:
    """Physical lines with their file and block; the source deals out blocks of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    # As the path stands in a listing; a plus sign is no blank.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return lines.select(name.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _by_block(batches):
    """Lines in order, with True where a block begins."""
    here = None
    for batch in batches:
        for file, start, line, *more in zip(*(c.to_pylist() for c in batch.columns)):
            first = here != (file, start)
            here = (file, start)
            yield first, file, start, line[3:] if first and not start and line.startswith(_MARK) else line, more


def _transitions(batches):
    """One row per block: what it makes of either state that it may begin in.

    ``end0, n0, width0`` hold for a block that begins outside quotes, ``end1, n1,
    width1`` for one that begins inside: whether it ends inside, how many records
    that are not blank begin in it, and the cells of the first of them (null if
    it ends in a later block).
    """
    import pyarrow as pa

    names = ["file", "start", "end0", "n0", "width0", "end1", "n1", "width1", "valid"]
    kinds = [pa.string(), pa.int64(), *[pa.int64()] * 6, pa.bool_()]
    rows, now = [], None

    class Run:
        def __init__(self, quoted):
            self.quoted, self.n, self.width, self.held = quoted, 0, None, [] if not quoted else None

        def take(self, line):
            records, tail = cut(line, self.quoted)
            for i, (begin, end) in enumerate(records):
                if self.quoted and i == 0:  # the end of a record counted where it began
                    if self.held and self.n == 1:
                        self.width = len(cells(b"\n".join([*self.held, line[:end]])))
                    continue
                if not blank(line[begin:end]):
                    self.n += 1
                    if self.n == 1:
                        self.width = len(cells(line[begin:end]))
            if tail < 0:
                self.held = []
            elif self.quoted and not records:
                if self.held and self.n == 1:
                    self.held.append(line)
            else:
                self.n += 1
                self.held = [line[tail:]] if self.n == 1 else []
            self.quoted = tail >= 0

    def done():
        file, start, a, b, valid = now
        return (file, start, int(a.quoted), a.n, a.width, int(b.quoted), b.n, b.width, valid)

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)
        rows.clear()
        return batch

    for first, file, start, line, _ in _by_block(batches):
        if first:
            if now:
                rows.append(done())
            now = [file, start, Run(False), Run(True), True]
            if len(rows) >= 4096:
                yield out()
        now[2].take(line)
        now[3].take(line)
        if now[4]:
            try:
                line.decode()
            except UnicodeDecodeError:
                now[4] = False
    if now:
        rows.append(done())
    yield out()


_TRANSITIONS = "file string, start long, end0 long, n0 long, width0 long, end1 long, n1 long, width1 long, valid boolean"


def block_states(blocks: DataFrame) -> DataFrame:
    """``file, start, quoted, place, width, open, total, valid``: how each block begins.

    A block keeps, fixes or turns the state it begins in. So the state is that of
    the last block before that fixes it, turned by those since; sums and last
    values over the blocks of a file, which are few beside its rows. ``place`` is
    the number of the first record that begins in the block; ``open`` says that
    the file ends inside quotes, ``total`` counts its records.
    """
    order = Window.partitionBy("file").orderBy("start")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    fixed = F.when(F.col("end0") == F.col("end1"), F.col("end0"))
    turns = ((F.col("end0") == 1) & (F.col("end1") == 0)).cast("long")
    marked = blocks.withColumns({"_fixed": fixed, "_turns": F.sum(turns).over(order)})
    at_fixed = F.last(F.when(F.col("_fixed").isNotNull(), F.col("_turns")), ignorenulls=True).over(before)
    since = F.coalesce(F.last("_turns").over(before), F.lit(0)) - F.coalesce(at_fixed, F.lit(0))
    quoted = (F.coalesce(F.last("_fixed", ignorenulls=True).over(before), F.lit(0)) + since) % 2
    known = marked.withColumn("quoted", quoted == 1)
    pick = lambda name: F.when(F.col("quoted"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    known = known.withColumns({"n": pick("n"), "end": pick("end"), "own": pick("width")})
    header = F.min(F.when(F.col("n") > 0, F.struct("start", "own"))).over(whole)["own"]
    return known.select(
        "file", "start", "quoted", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place"), header.alias("width"), (F.col("end") == 1).alias("ends_quoted"),
        (F.max(F.struct("start", "end")).over(whole)["end"] == 1).alias("open"), F.sum("n").over(whole).alias("total"), F.min("valid").over(whole).alias("valid"),
    )


def _records(whole: bool):
    """Complete records as rows, or with ``whole`` false the parts of those that cross blocks."""

    def run(batches):
        import pyarrow as pa

        out, held, size, number, quoted, width, key = [], [], 0, 0, False, None, None
        names = ["file", "row", "markdown"] if whole else ["file", "row", "start", "part"]
        kinds = [pa.string(), pa.int64(), pa.string()] if whole else [pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def flush():
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), kinds)], names)
            out.clear()
            size = 0
            return batch

        def give(record, crossing):
            if crossing:
                if not whole:
                    out.append((key[0], number, key[1], record))
            elif not blank(record):
                if whole and width is not None:
                    out.append((key[0], number, markdown_row(record, width, number)))
                return 1
            return 1 if crossing else 0

        for first, file, start, line, (enters, place, columns) in _by_block(batches):
            if first:
                if held:
                    give(b"\n".join(held), True)
                key, quoted, number, width, held, entered = (file, start), enters, place - enters, columns, [], enters
            records, tail = cut(line, quoted)
            for i, (begin, end) in enumerate(records):
                if quoted and i == 0:
                    number += give(b"\n".join([*held, line[:end]]), entered)
                    held, entered = [], False
                else:
                    number += give(line[begin:end], False)
            if tail >= 0:
                if quoted and not records:
                    held.append(line)
                else:
                    held = [line[tail:]]
            quoted = tail >= 0
            size += len(line)
            if len(out) >= 4096 or size >= 1 << 22:
                yield flush()
        if held:
            give(b"\n".join(held), True)
        yield flush()

    return run


def scan_csv(spark, path) -> DataFrame:
    """``file, row, markdown, error``: the Markdown table rows of CSV files of any size.

    The rows of a file, in order and joined with line ends, are the table that
    ``csv_to_markdown`` makes of its text; row 0 is the header with its rule. No
    task reads a whole file: the source deals out blocks
    (``spark.sql.files.maxPartitionBytes``), a first scan tells what each block
    makes of the quote state it may begin in, a scan over the blocks composes
    that, and a second scan cuts and numbers the records. Records that cross
    blocks are put together from their parts. A quoted field without end, text
    that is not UTF-8, or a file of blank lines gives one error row for the file.
    Lines end with LF or CR LF; a CR outside quotes ends a record too, though a
    file with CR alone is one block.
    """
    lines = _lines(spark, path)
    blocks = settle(block_states(settle(lines.mapInArrow(_transitions, _TRANSITIONS))))
    problem = (
        F.when(~F.col("valid"), "text error: not valid UTF-8").when(F.col("open"), "csv error: quoted field without end").when(F.col("total") == 0, "csv error: empty file")
    )
    nothing = F.lit(None).cast("string")
    errors = blocks.select("file", problem.alias("error")).filter("error is not null").distinct().select("file", F.lit(0).cast("long").alias("row"), nothing.alias("markdown"), "error")
    sound = blocks.filter(problem.isNull()).select("file", "start", "quoted", "place", "width", "ends_quoted")
    # One row per block of a file: a few bytes for every maxPartitionBytes of text.
    entered = lambda kept: lines.join(F.broadcast(kept.select("file", "start", "quoted", "place", "width")), ["file", "start"]).select("file", "start", "line", "quoted", "place", "width")
    crossing = sound.filter("quoted or ends_quoted")
    if crossing.isEmpty():
        rows = entered(sound).mapInArrow(_records(True), "file string, row long, markdown string")
        return rows.withColumn("error", nothing).unionByName(errors)

    parts = entered(crossing).mapInArrow(_records(False), "file string, row long, start long, part binary")
    joined = parts.groupBy("file", "row").agg(F.sum(F.octet_length("part")).alias("size"), F.sort_array(F.collect_list(F.struct("start", "part"))).alias("parts"))

    def put_together(batches):
        import pyarrow as pa

        for batch in batches:
            records = [b"\n".join(p["part"] for p in x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(records, pa.binary()), pa.array([len(cells(r)) for r in records], pa.int64())], ["file", "row", "record", "cells"])

    long = settle(joined.filter(F.col("size") <= MAX_RECORD_BYTES).select("file", "row", "parts").mapInArrow(put_together, "file string, row long, record binary, cells long"))
    # A header that crosses blocks tells its width only now.
    widths = long.filter("row = 0").select("file", F.col("cells").alias("_width"))
    sound = sound.join(widths, "file", "left").withColumn("width", F.coalesce("width", "_width")).drop("_width")

    def render(batches):
        import pyarrow as pa

        for batch in batches:
            made = [markdown_row(r, w, n) for r, w, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], ["file", "row", "markdown"])

    rows = entered(sound).mapInArrow(_records(True), "file string, row long, markdown string")
    files = sound.select("file", "width").distinct()
    far = long.join(files, "file").select("file", "row", "record", "width").mapInArrow(render, "file string, row long, markdown string")
    return rows.unionByName(far).withColumn("error", nothing).unionByName(errors)
