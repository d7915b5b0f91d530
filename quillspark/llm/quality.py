"""Quality of documents by regularised quadratic discriminant analysis."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_texts, lots

# Labelled documents of either class that the fit uses at most.
PER_CLASS = 10_000
SHRINKAGE = 0.1
THRESHOLD = 0.7

STATISTICS = [
    "log_words", "word_length", "word_length_spread", "upper", "digit", "bang", "bar",
    "symbol", "other_mark", "space", "line_break", "distinct", "neighbours_equal", "pairs_distinct", "longest_run",
]
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.frombuffer(b"%$&*#@^~<>{}[]\\=+_", np.uint8).astype(int)
_MARK = np.frombuffer(b".,;:?'\"()-/", np.uint8).astype(int)


def _logit(count, total, prior=0.5):
    """Log odds of a share, smoothed so that short texts stay near the middle."""
    return np.log((count + prior) / (max(total - count, 0) + prior * 10))


def statistics(data):
    """Transformed statistics of the UTF-8 bytes of a whole text; null is empty."""
    data = data or b""
    freq = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    n, size = len(words), len(data)
    lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
    letters = freq[_UPPER].sum() + freq[_LOWER].sum() + freq[128:].sum() / 2
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    run = longest = 1
    if same:
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    return [
        np.log1p(n),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        _logit(freq[_UPPER].sum(), letters),
        _logit(freq[_DIGIT].sum(), size),
        _logit(freq[33], size),
        _logit(freq[124], size),
        _logit(freq[_SYMBOL].sum(), size),
        _logit(freq[_MARK].sum(), size),
        _logit(freq[32] + freq[9], size),
        _logit(freq[10], size),
        np.log((len(set(words)) + 1) / (n + 1)) / (1 + np.log1p(n) / 4),
        _logit(same, max(n - 1, 0)),
        np.log((len(set(zip(words, words[1:]))) + 1) / (n + 1)),
        np.log(longest),
    ]


class Discriminant:
    """Two Gaussians with shrunken covariances; Cholesky factors are kept."""

    def __init__(self, x, y, shrinkage=SHRINKAGE):
        self.means, self.inverses, self.logs, self.constant = [], [], [], None
        sizes = [int((y == c).sum()) for c in (0, 1)]
        if not all(sizes):
            self.constant = 0.5 if not sum(sizes) else float(sizes[1] > 0)
            return
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.centre) / self.scale
        pooled = sum(np.cov(z[y == c].T, bias=True) * s for c, s in enumerate(sizes)) / len(y)
        for c in (0, 1):
            own = np.cov(z[y == c].T, bias=True)
            ball = np.eye(z.shape[1]) * np.trace(pooled) / z.shape[1]
            cov = (1 - shrinkage) * own + shrinkage * (0.5 * pooled + 0.5 * ball)
            factor = np.linalg.cholesky(cov + 1e-6 * np.eye(len(cov)))
            self.means.append(z[y == c].mean(0))
            self.inverses.append(np.linalg.inv(factor).T)
            self.logs.append(np.log(np.diag(factor)).sum() - np.log(sizes[c] / len(y)))

    def scores(self, x):
        """Posterior of class 1: half the difference of squared Mahalanobis distances."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ inv) ** 2).sum(1) - log for m, inv, log in zip(self.means, self.inverses, self.logs)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def train_quality(docs, labels, learn=None, key="doc_id", text="text", label="quality", per_class=PER_CLASS, shrinkage=SHRINKAGE):
    """Fit on at most ``per_class`` labelled documents of either class.

    ``learn`` is a condition on the key that says which rows may be learned from.
    Only statistics reach the driver. With labels of one class alone every score
    is that class; with none it is 0.5.
    """
    sample = labelled_texts(docs, labels, label, key, text, F.lit(True) if learn is None else learn, (per_class, per_class))

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            yield pa.RecordBatch.from_arrays([lot.column(0), pa.array([statistics(x) for x in lot.column(1).to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    rows = sample.mapInArrow(each, "label int, x array<double>").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(STATISTICS))
    return Discriminant(x, np.array([r["label"] for r in rows], int), shrinkage)


def score_quality(docs, model, key="doc_id", text="text"):
    """``key, score`` of every row, from its whole text and nothing else.

    Null and empty texts score as empty; repeated rows stay; an empty table
    gives no rows; other columns are not read.
    """
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            x = np.array([statistics(t) for t in lot.column(1).to_pylist()], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(shared.value.scores(x))], ["k", "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("b")).mapInArrow(each, schema).withColumnRenamed("k", key)


def keep_good(docs, model, text="text", threshold=THRESHOLD):
    """``docs`` without the rows that score below the threshold; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(data):
        import pandas as pd

        x = np.array([statistics(t) for t in data], float).reshape(-1, len(STATISTICS))
        return pd.Series(shared.value.scores(x) >= threshold)

    return docs.filter(good(F.col(text).cast("binary")))
