"""Documents and requests derived from the given tables, for the queries."""

import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..functions.names import url_path
from ..session import mounted

# Extensions given to document rows in turn, in every case and kind.
EXTENSIONS = [".txt", ".PDF", ".html", ".Csv", ".json", ".xml", ".docx", "", ".a.HTM"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows, most=10_000):
    """Rows that cost far more to convert than to move, dealt out to tasks of ``most`` at any size.

    A file's row group is one task, whatever the number of cores.
    """
    return rows.repartition(max(1, -(-rows.count() // most)))


def pages(spark, sf_dir):
    """Web pages as files: ``file`` is the URL, ``name`` its path."""
    df = table(spark, sf_dir, "pages")
    return df.select(
        "page_id",
        F.col("url").alias("file"),
        url_path(F.col("url")).alias("name"),
        F.col("html").alias("text"),
    )


def _pick(number, values):
    """The value at ``number`` counted round; None stays null."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.pmod(number, F.lit(len(values))))


def requests(spark, sf_dir):
    """One request per document, with good and bad values of every option."""
    d = F.col("doc_id")
    lang = _pick(d, ["", " EN ", "ru", "", "xx", "hi", "ch_server"])
    extra = (
        F.when(d % 10 == 0, F.create_map(F.lit("lang"), F.lit("uk")))
        .when(
            d % 10 == 5,
            F.create_map(*[F.lit(x) for x in ("start_page", "2", "table_enable", "false")]),
        )
        .when(d % 10 == 7, F.create_map(F.lit("end_page"), F.lit("x")))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("/inbox/"), "source", F.lit("/"), d.cast("string"), _pick(d, EXTENSIONS)
        ).alias("file_path"),
        _pick(d, [None, "auto", "HTML", "text", "", "nope"]).alias("engine"),
        F.when(d % 7 == 0, F.col("lang")).otherwise(lang).alias("lang"),
        _pick(d, [None, "auto", "Pipeline", "vlm-http-client", "bogus"]).alias("backend"),
        _pick(d, [None, "HIGH", "max"]).alias("effort"),
        F.when(d % 2 == 0, "http://host.example").alias("server_url"),
        (d % 6 - 1).cast("int").alias("start_page"),
        F.when(d % 4 != 0, (d % 9).cast("int")).alias("end_page"),
        extra.alias("extra"),
    )


def corpus(spark, sf_dir):
    """Document rows as files of many formats: ``file_path`` and ``text``."""
    d, kind = F.col("doc_id"), F.col("doc_id") % len(EXTENSIONS)
    number, text, lang = d.cast("string"), F.col("text"), F.col("lang")

    def escaped(pairs):
        out = text
        for old, new in pairs:
            out = F.replace(out, F.lit(old), F.lit(new))
        return out

    quoted = escaped([('"', '""')])
    in_json = escaped([("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])
    in_xml = escaped([("&", "&amp;"), ("<", "&lt;")])
    body = (
        F.when(kind == 2, F.concat(F.lit("<html><body><p>"), text, F.lit("</p></body></html>")))
        .when(kind == 3, F.concat(F.lit("doc,lang,note\n"), number, F.lit(',"'), lang, F.lit('","'), quoted, F.lit('"')))
        .when(kind == 4, F.concat(F.lit('{"doc": '), number, F.lit(', "text": "'), in_json, F.lit('"}')))
        .when(kind == 5, F.concat(F.lit("<doc><text>"), in_xml, F.lit("</text></doc>")))
        .otherwise(text)
    )
    df = table(spark, sf_dir, "documents")
    return df.select(
        "doc_id",
        F.concat(
            F.lit("/inbox/"), "source", F.lit("/"), number, _pick(d, EXTENSIONS)
        ).alias("file_path"),
        body.alias("text"),
    )


def csv_files(spark, sf_dir):
    """One CSV file per order: quoted, short, long, blank and unfinished lines."""
    key, who = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = F.concat(
        F.lit("key,status,priority\r\n"),
        key, F.lit(","), status, F.lit(',"'), priority, F.lit(', x"\n\n'),
        who, F.lit("\n"),
        F.lit('a|b,"say ""'), status, F.lit('""",'), who, F.lit(",extra"),
        F.when(status == "P", '\n"open').otherwise(""),
    )
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", text.alias("text"))


def write_page_files(pages, location):
    """Each page as a file of its own in one folder, beside those that are there."""
    one_each(pages.select(F.col("html").alias("value")), location)


def one_each(values, location):
    """A text file for each row; tasks put their files in place themselves, not the driver one after the other.

    In a mounted folder they write them without Hadoop, whose local file system starts two
    processes for each file to set its rights. A task that is run again replaces its own files.
    """
    spark, folder = values.sparkSession, mounted(values.sparkSession, location)
    if folder is None:
        writer = dealt(values, 200).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.option("maxRecordsPerFile", 1).text(location)
        return
    run = uuid.uuid4().hex

    def put(batches):
        os.makedirs(folder, exist_ok=True)
        task, n = TaskContext.get(), 0
        for batch in batches:
            for value in batch.column(0):
                name = f"part-{task.partitionId():05d}-{run}-{n:06d}.txt"
                unfinished = f"{folder}/.{name}.{task.taskAttemptId()}"
                with open(unfinished, "wb") as file:
                    file.write((value.as_py() or b"") + b"\n")
                os.replace(unfinished, f"{folder}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt(values.select(F.col("value").cast("binary")), 200).mapInArrow(put, "n long").agg(F.sum("n")).first()
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()


def write_saved_pages(pages, location):
    """Like page files, with the address that each was saved from in a comment at its start."""
    mark = F.concat(F.lit("<!-- saved from "), F.coalesce(F.hex(F.col("url").cast("binary")), F.lit("nowhere")), F.lit(" -->\n"))
    one_each(pages.select(F.concat(mark, F.coalesce("html", F.lit(""))).alias("value")), location)


def saved_from(files):
    """``file, content`` of saved pages, called by their address; null where they have none."""
    text = F.col("content").cast("string")
    mark = F.regexp_extract(F.substring_index(text, "\n", 1), r"\A<!-- saved from ([0-9A-F]*) -->", 1)
    known = F.startswith(text, F.lit("<!-- saved from nowhere"))
    address = F.when(~known, F.unhex(mark).cast("string"))
    return files.select(address.alias("file"), url_path(address).alias("name"), "content")


def order_pages(spark, sf_dir):
    """One page per order with a table, nested and numbered lists, a quotation and preformatted text."""
    key, who = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = F.concat(
        F.lit("<html><body><h2>Order "), key, F.lit("</h2><TABLE><tr><th>key<th>state|note</tr><tr><td>"), key, F.lit("</td><td><p>"), status,
        F.lit("</p>it&#39;s</td></tr><tr><td>"), who, F.lit("</table><ol start='3'><li>"), priority, F.lit("<ul><li>"), status, F.lit("</li><li><b>"), who,
        F.lit("</b></ul><li><p>last</p></ol><pre>\n  a = "), key, F.lit("\n\n  <i>b</i>\n</pre><blockquote>"), priority, F.lit("<br>by <a href='/c/"), who,
        F.lit("'><b>buyer</b> "), who, F.lit('</a></blockquote><img alt="seal" src=/s.png> &#x20AC;</body></html>'),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return dealt(orders).select("o_orderkey", text.alias("text"))


def write_csv_files(spark, sf_dir, location):
    """Orders as one CSV file per group of customers, each as large as its group.

    The header and every second record have a line break in quotes; quotes also
    stand inside plain fields and text behind closing ones.
    """
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    body = F.when(
        key % 2 == 0, F.concat(key.cast("string"), F.lit(',"'), priority, F.lit('\nsays ""'), status, F.lit('""",5" pipe,more\r'))
    ).otherwise(F.concat(key.cast("string"), F.lit(',"a|b" '), status, F.lit("\n")))
    records = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 8).alias("part"), key.alias("place"), body.alias("value"))
    headers = records.select("part").distinct().select("part", F.lit(-1).alias("place"), F.lit('key,"the\nnote",size').alias("value"))
    ordered = records.unionByName(headers).repartition("part").sortWithinPartitions("part", "place")
    ordered.select("part", "value").write.partitionBy("part").text(location)


def json_texts(spark, sf_dir):
    """Event properties, cut short or followed by more for some event types."""
    props, kind = F.col("props"), F.col("event_type")
    text = (
        F.when(kind == "error", F.substring(props, F.lit(1), F.length(props) - 1))
        .when(kind == "view", F.concat(props, F.lit(" more")))
        .otherwise(props)
    )
    df = table(spark, sf_dir, "events")
    return df.select("event_id", text.alias("text"))


def xml_texts(spark, sf_dir):
    """Events as XML, left open for some event types."""
    kind = F.col("event_type")
    text = F.concat(
        F.lit('<event id="'), F.col("event_id").cast("string"), F.lit('"><type>'), kind,
        F.lit("</type><props>"), "props",
        F.when(kind == "error", "</event>").otherwise("</props></event>"),
    )
    df = table(spark, sf_dir, "events")
    return df.select("event_id", text.alias("text"))
