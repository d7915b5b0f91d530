"""Record layouts shared by the whole package."""

from pyspark.sql import types as T

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("output_dir", T.StringType()),
        T.StructField("engine", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("formula_enable", T.BooleanType()),
        T.StructField("table_enable", T.BooleanType()),
        T.StructField("backend", T.StringType()),
        T.StructField("effort", T.StringType()),
        T.StructField("server_url", T.StringType()),
        T.StructField("start_page", T.IntegerType()),
        T.StructField("end_page", T.IntegerType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Values a request gets for a field it leaves out; fields not listed stay null.
REQUEST_DEFAULTS = {
    "method": "auto",
    "lang": "",
    "formula_enable": True,
    "table_enable": True,
    "backend": "auto",
    "effort": "medium",
    "start_page": 0,
}

BINARY_FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# Columns of one result row of a batch, Markdown included.
RESULT_COLUMNS = [
    "file",
    "status",
    "engine",
    "output_dir",
    "output_path",
    "images_dir",
    "fallback",
    "errors",
    "error_kind",
    "markdown",
]

# Columns of the report; the Markdown never appears in it.
STATUS_COLUMNS = [
    "file",
    "status",
    "engine",
    "output_path",
    "images_dir",
    "fallback",
    "detail",
]
