"""Benchmark decontamination by a broadcast set of hashed n-grams."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import lots, text_id

WINDOW = 10
# Bytes of benchmark words and windows that a broadcast may hold; beyond it the
# windows are joined by a shuffle.
SET_BYTES = 32 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(data):
    """Words of UTF-8 bytes: A-Z lower-cased, then runs of 0-9, a-z and non-ASCII."""
    return _WORD.findall((data or b"").lower())


def windows_of(words, window=WINDOW):
    """All windows of consecutive words; a shorter, non-empty list is one window."""
    if not words:
        return []
    if len(words) <= window:
        return [tuple(words)]
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


def benchmark_windows(benchmark, key="item_id", text="text", window=WINDOW):
    """``item string, gram binary`` (words joined by a space), distinct."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("gram", T.BinaryType())])

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            out = [(i, b" ".join(w)) for i, t in zip(lot.column(0).to_pylist(), lot.column(1).to_pylist()) for w in windows_of(words_of(t), window)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["item", "gram"])

    narrow = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).cast("binary").alias("b"))
    return narrow.mapInArrow(each, schema).distinct()


class GramSet:
    """Windows by length, hashed over numbered words; hits are verified word by word."""

    def __init__(self, grams):
        self.number, self.items, byte_length = {}, {}, {}
        for item, gram in grams:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in gram.split(b" "))
            self.items.setdefault(ids, set()).add(item)
            byte_length.setdefault(len(ids), []).append(ids)
        self.hashes = {n: np.unique(self._roll(np.array(v, np.uint64).reshape(-1, n).T)) for n, v in byte_length.items()}

    @staticmethod
    def _roll(columns):
        total = np.zeros(columns.shape[1:], np.uint64)
        for c in columns:
            total = total * _BASE + c
        return total

    def scan(self, words):
        """Pairs (start, length, items) of every occurring window."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        known = np.concatenate(([0], np.cumsum(ids == 0)))
        for n, hashes in self.hashes.items():
            starts = np.flatnonzero(known[n:] == known[:-n]) if len(ids) >= n else np.array([], int)
            if not len(starts):
                continue
            rolled = self._roll(ids[starts[None, :] + np.arange(n)[:, None]])
            at = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for s in starts[hashes[at] == rolled]:
                found = self.items.get(tuple(int(x) for x in ids[s : s + n]))
                if found:
                    yield int(s), n, found


def _report(n_words, hits):
    """n_hit, sorted items and the merged spans of word positions."""
    marked, items = np.zeros(n_words + 1, np.int64), set()
    for start, n, found in hits:
        marked[start : start + n] = 1
        items |= found
    items.discard(None)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marked))))
    spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    return int(marked.sum()), sorted(items), spans


_FIELDS = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("n_items", T.LongType()),
    ("items_sha256", T.StringType()),
    ("contaminated", T.BooleanType()),
    ("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def _out(keys, found, kind):
    import pyarrow as pa

    rows = [(n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, [list(s) for s in spans]) for n, (hit, items, spans) in found]
    cols = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([keys, *[pa.array(list(c), t) for c, t in zip(cols, types)]], ["k", *[f[0] for f in _FIELDS]])


def decontaminate(docs, benchmark, key="doc_id", text="text", item="item_id", item_text="text", window=WINDOW, set_bytes=SET_BYTES):
    """Which words of each document lie in a window of the benchmark.

    Per row of ``docs``: ``key, n_words, n_hit, n_items, items_sha256,
    contaminated, spans`` (word ranges that are hit). The windows are stored and
    measured first; only up to ``set_bytes`` they are broadcast as a set, else
    windows of documents and benchmark meet in a join. Null and empty texts have
    no words; a null item id marks words but is no item; items of equal text all
    count; repeated rows stay; an empty benchmark hits nothing. Other columns
    are not read.
    """
    spark = docs.sparkSession
    grams = settle(benchmark_windows(benchmark, item, item_text, window))
    size = grams.agg(F.sum(F.octet_length("gram") + 64)).first()[0] or 0
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("k", kind), *[T.StructField(n, t) for n, t in _FIELDS]])
    narrow = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("b"))
    if size > set_bytes:
        return _joined(narrow, grams, schema, window).withColumnRenamed("k", key)
    shared = spark.sparkContext.broadcast([(r[0], bytes(r[1])) for r in grams.collect()])
    state = {}

    def each(batches):
        grams = state.get("set") or state.setdefault("set", GramSet(shared.value))
        for lot in lots(batches):
            found = []
            for data in lot.column(1).to_pylist():
                words = words_of(data)
                found.append((len(words), _report(len(words), grams.scan(words))))
            yield _out(lot.column(0), found, kind)

    return narrow.mapInArrow(each, schema).withColumnRenamed("k", key)


def _joined(narrow, grams, schema, window):
    """The same report for a benchmark of any size: windows meet by a shuffle.

    Rows are numbered as they are scanned and stored once, so repeated keys stay
    apart and a lost task gives the same numbers again.
    """
    rows = settle(narrow.withColumn("row", F.monotonically_increasing_id()))
    lengths = [r[0] for r in grams.select((F.size(F.split(F.col("gram").cast("string"), " ")))).distinct().collect()]

    def cut(batches):
        import pyarrow as pa

        for lot in lots(batches, 16):
            out = []
            for row, data in zip(lot.column(1).to_pylist(), lot.column(0).to_pylist()):
                words = words_of(data)
                for n in lengths:
                    out.extend((row, i, n, b" ".join(words[i : i + n])) for i in range(len(words) - n + 1))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["row", "start", "n", "gram"])

    hits = (
        rows.select("b", "row").mapInArrow(cut, "row long, start long, n long, gram binary")
        .join(grams, "gram")
        .groupBy("row", "start", "n").agg(F.collect_set("item").alias("items"))
        .groupBy("row").agg(F.collect_list(F.struct("start", "n", "items")).alias("hits"))
    )

    def report(batches):
        for lot in lots(batches):
            found = []
            for data, hits in zip(lot.column(1).to_pylist(), lot.column(2).to_pylist()):
                n = len(words_of(data))
                found.append((n, _report(n, [(h["start"], h["n"], set(h["items"]) or {None}) for h in hits or []])))
            yield _out(lot.column(0), found, None)

    return rows.join(hits, "row", "left").select("k", "b", "hits").mapInArrow(report, schema)


def cut_spans(data, spans):
    """The text without the words of the spans; what stands between them goes too."""
    at = [(m.start(), m.end()) for m in _WORD.finditer((data or b"").lower())]
    kept, last = [], 0
    for a, b in spans:
        kept.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, data[last:]])


def remove_spans(docs, benchmark, key="doc_id", text="text", **options):
    """``docs`` with the hit words cut out of ``text``; null and clean texts unchanged.

    Every row stays, repeated ones and those of null keys too; the other columns,
    of any names, are kept; an empty table stays empty.
    """
    import pandas as pd

    rows = settle(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("id"), docs[text].alias("text")))
    found = settle(decontaminate(rows.select("id", "text"), benchmark, "id", "text", **options).filter("contaminated").select("id", "spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else cut_spans(t.encode(), s).decode("utf-8", "replace") for t, s in zip(texts, spans)], dtype=object)

    joined = rows.join(found, "id", "left").withColumn("text", F.when(F.col("spans").isNotNull(), cut("text", "spans")).otherwise(F.col("text")))
    return joined.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def drop_contaminated(docs, benchmark, key="doc_id", text="text", least=1, **options):
    """``docs`` without the documents that hold ``least`` hit words or more.

    A document is known by its key, null or not, and 128 bits of its text; repeated
    rows stay or go together. Null and empty texts stay; other columns, of any
    names, are kept; an empty table stays empty.
    """
    named = docs.select(F.struct(docs[key].alias("k"), *text_id(docs[text])).alias("id"), docs[text].alias("t"))
    found = decontaminate(named, benchmark, "id", "t", **options).filter(F.col("n_hit") >= least)
    bad = settle(found.select("id.k", "id.h1", "id.h2").distinct())
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("k"), *text_id(docs[text]))
    same = packed["k"].eqNullSafe(bad["k"]) & (packed["h1"] == bad["h1"]) & (packed["h2"] == bad["h2"])
    return packed.join(bad, same, "left_anti").select("row.*")
