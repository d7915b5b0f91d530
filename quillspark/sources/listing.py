"""One level of a folder as a manifest: every file is a row, picked up or skipped with a reason."""

import os
import zlib
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import FOLDER_EXTENSIONS, MAX_FILE_BYTES

FORMAT = "quillspark_listing"
SCHEMA = "path string, name string, length long, modified timestamp, status string, reason string, content binary"
LOT_FILES, LOT_BYTES = 1024, 32 << 20  # files, and bytes of content, handed over at a time


class _Names(InputPartition):
    """The names whose hash falls on ``value``."""


class ListingReader(DataSourceReader):
    def __init__(self, options):
        path = options["path"]
        self.folder = (path[len("file:") :].replace("//", "", 1) if path.startswith("file:/") else path).rstrip("/") or "/"
        self.extensions = tuple(options["extensions"].lower().split("\n")) if options.get("extensions") else ()
        self.max_bytes = int(options["max_bytes"])
        self.content = options["content"] == "true"
        self.count = int(options["partitions"])

    def partitions(self):
        return [_Names(i) for i in range(self.count)]

    def _row(self, entry):
        """path, name, length, modified, status, reason, content of a file; None for a folder."""
        name = os.fsencode(entry.name).decode("utf-8", "replace")
        path = f"{self.folder.rstrip('/')}/{name}"
        length = modified = content = None
        try:
            if entry.is_dir():
                return None
            stat = entry.stat()
            length, modified = stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc)
            if name.startswith((".", "_")):
                reason = "the name begins with a dot or underscore"
            elif self.extensions and not name.lower().endswith(self.extensions):
                reason = "the extension is not supported"
            elif not length:
                reason = "the file is empty"
            elif length > self.max_bytes:
                reason = f"the file is longer than {self.max_bytes} bytes"
            else:
                reason = None
                if self.content:
                    with open(entry.path, "rb") as f:
                        content = f.read()
        except OSError as error:
            reason = f"the file cannot be read: {error.strerror}"
        return path, name, length, modified, "SKIPPED" if reason else "FOUND", reason, content

    def read(self, partition):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.binary()]
        names = [field.split()[0] for field in SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

        rows, size = [], 0
        with os.scandir(self.folder) as entries:
            for entry in entries:
                if zlib.crc32(os.fsencode(entry.name)) % self.count != partition.value:
                    continue
                row = self._row(entry)
                if row is None:
                    continue
                rows.append(row)
                size += len(row[-1] or b"")
                if len(rows) >= LOT_FILES or size >= LOT_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


class ListingSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ListingReader(self.options)


def list_folder(spark, path, exts=None, max_bytes=MAX_FILE_BYTES, content=False, partitions=8) -> DataFrame:
    """Every file directly inside a folder: path, name, length, modified, status, reason, content.

    Folders in it are neither listed nor rows. Files that a batch would take are
    ``FOUND``; names that begin with a dot or underscore, unsupported extensions
    (in any case; ``exts=[]`` takes all), empty and too long files and those that
    can't be read are ``SKIPPED`` with the reason. Only found files are opened, and
    these only with ``content``. Names are dealt to ``partitions`` tasks by their
    hash, each of which asks for the names of the folder and looks at its own files.
    A missing folder is an error; an empty one gives no rows. The folder must be
    mounted on every executor; ``scan_folder`` reads from any file system of Spark.
    """
    scheme = path.split(":/", 1)[0] if ":/" in path else "file"
    if scheme != "file":
        raise ValueError(f"a mounted folder is needed, not {scheme}: (scan_folder reads it)")
    exts = FOLDER_EXTENSIONS if exts is None else exts
    spark.dataSource.register(ListingSource)
    options = {"extensions": "\n".join(exts), "max_bytes": str(max_bytes), "content": str(bool(content)).lower(), "partitions": str(partitions)}
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise AnalysisException(f"[PATH_NOT_FOUND] no folder {path}")
    return spark.read.format(FORMAT).options(**options).load(path)
