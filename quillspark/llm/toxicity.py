"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear SVM.

The unit of the kernel is a word: a sentence is the bag of its words and scores
as its worst word, a document as its worst sentence. The kernel counts common
subsequences of three letters, each weighted by a decay to the power of the
letters it spans, so a gap or an inserted letter weakens a match and does not
end it. Signs between letters are dropped and runs of single letters are joined
before, so spaced and dotted spellings are whole words again.
"""

import re
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import labelled_texts, lots, texts_of

# Labelled documents of the classes that the fit uses at most. Clean ones are more,
# so that a word that stands in toxic documents alone does so by meaning.
TOXIC_DOCS, CLEAN_DOCS = 2_500, 7_500
EVIDENCE = 9.0  # of a first word, as the negative logarithm of its chance
LANDMARKS = 256
SPREAD = 600  # words that landmarks are chosen from
WORDS = 1_500  # words of either class in one of the first fits, which find toxic words and landmarks
ROUNDS = 3
STEPS = 12  # of the last fit, which takes all clean words
CLEAN_SIDE = 10.0  # weight of all clean words together in the last fit, against the toxic ones
HELD = 5  # one text in so many is held back from the words to set the line of scores
RIDGE = 1e-5
DECAY = 0.6
LONGEST = 18  # longer words are read in overlapping windows of this length
STRIDE = 8
CACHE = 400_000  # words whose scores a worker remembers
THRESHOLD = 0.5
CODES = 42  # letters, and the edges of a word
# Characters commonly written for a letter.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

_SIGNS = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"[^\W\d_]*\Z")
_RUN = re.compile(r"(?<!\S)(?:[^\W_]\W{0,2}\s+){2,}[^\W_](?=\W{0,2}(?:\s|\Z))")


def words_of(text):
    """Words of a text in order: lower case, letters alone, single letters joined."""
    low = text.lower()
    raw = low.split()
    if _RUN.search(low):
        raw += [m.group() for m in _RUN.finditer(low)]
    return raw


def spelled(raw):
    """The letters of a raw word; digits and signs that stand for letters are read so."""
    if _PLAIN.match(raw):
        return raw
    core = raw.strip(".,;:?!\"'()[]*#%&|-")
    return _SIGNS.sub("", core.translate(LOOKALIKES))


def codes(text):
    """Numbers below 42 for letters and edges; letters beyond a-z share thirteen."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    inner = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 13)
    return np.where(points <= 2, 39 + points, inner)


_TRIPLES = {}


def _triples(n):
    """Index triples of a word of n letters and the weight of what they span."""
    if n not in _TRIPLES:
        t = np.array(list(combinations(range(n), 3)), int).reshape(-1, 3)
        _TRIPLES[n] = (t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32))
    return _TRIPLES[n]


def _subsequences(matrix):
    """For words of one length, numbers and weights of all their subsequences."""
    t, weight = _triples(matrix.shape[1])
    return (matrix[:, t[:, 0]] * CODES + matrix[:, t[:, 1]]) * CODES + matrix[:, t[:, 2]], weight


def _norms(matrix):
    """Square roots of the kernel of each word with itself.

    Pairs of equal subsequences are added up by the last letters of both; a
    decay matrix on either side carries them on to all later letters.
    """
    n = matrix.shape[1]
    gap = np.subtract.outer(np.arange(n), np.arange(n)) - 1
    carry = np.where(gap >= 0, DECAY ** np.maximum(gap, 0), 0.0).astype(np.float32)
    same = (matrix[:, :, None] == matrix[:, None, :]).astype(np.float32) * DECAY**2
    ending = same
    for _ in range(2):
        ending = same * (carry @ ending @ carry.T)
    return np.sqrt(ending.sum((1, 2)))


def _grouped(words):
    """(positions, code matrix) for words cut to windows, by window length."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    flat = codes("".join([f"\x01{w}\x02" for w in words]))
    at = [np.flatnonzero(size <= LONGEST)]
    begin, length = [start[at[0]]], [size[at[0]]]
    for i in np.flatnonzero(size > LONGEST):
        first = np.arange(0, size[i] - LONGEST + STRIDE, STRIDE)
        at.append(np.full(len(first), i))
        begin.append(start[i] + first)
        length.append(np.minimum(LONGEST, size[i] - first))
    at, begin, length = np.concatenate(at), np.concatenate(begin), np.concatenate(length)
    for n in range(3, LONGEST + 1):
        mine = np.flatnonzero(length == n)
        for s in range(0, len(mine), 1000):
            some = mine[s : s + 1000]
            yield at[some], flat[begin[some, None] + np.arange(n)]


def dense(words):
    """Normalised feature rows of short words, over the subsequences they have.

    Returns the matrix, whose last column is empty, and for every possible
    subsequence its column.
    """
    found = [(at, *_subsequences(matrix)) for at, matrix in _grouped([w[: LONGEST - 2] for w in words])]
    used = np.unique(np.concatenate([t.ravel() for _, t, _ in found])) if found else np.empty(0, np.int64)
    column = np.full(CODES**3, len(used), np.int32)
    column[used] = np.arange(len(used))
    out = np.zeros((len(words), len(used) + 1), np.float32)
    for at, t, weight in found:
        np.add.at(out, (at[:, None], column[t]), weight[None, :])
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-12), column


def kernel(words, table, column):
    """Kernel of each word with each landmark, a column of ``table``; its best window counts."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for at, matrix in _grouped(words):
        norms = _norms(matrix)[:, None]
        for s in range(0, len(at), 50):
            t, weight = _subsequences(matrix[s : s + 50])
            k = np.matmul(weight[None, None, :], table[column[t]])[:, 0] / norms[s : s + 50]
            np.maximum.at(out, at[s : s + 50], k)
    return out


class KernelMachine:
    """Squared-hinge SVM over Nystrom features of the kernel."""

    def __init__(self, landmarks):
        landmarks = list(dict.fromkeys(landmarks))
        rows, self.column = dense(landmarks)
        value, vector = np.linalg.eigh((rows @ rows.T).astype(float))
        keep = value > 1e-4
        self.map = vector[:, keep] / np.sqrt(value[keep])
        self.table = np.ascontiguousarray(rows.T)

    def fit(self, words, y, times, ridge=RIDGE):
        """``times``: how often each word was seen; its logarithm weighs the word."""
        x = np.hstack([kernel(words, self.table, self.column) @ self.map, np.ones((len(words), 1))])
        weight = np.log1p(times)
        for side in (y > 0, y < 0):
            weight[side] *= len(y) / (2 * max(weight[side].sum(), 1e-9))
        w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge * len(y)
        eye[-1, -1] = 1e-6
        active = np.ones(len(y), bool)
        for _ in range(30):
            xa = x[active] * weight[active, None]
            w = np.linalg.solve(xa.T @ x[active] + eye, xa.T @ y[active])
            now = y * (x @ w) < 1
            if (now == active).all():
                break
            active = now
        self.take(w)

    def take(self, w):
        """The decision is linear in subsequence weights, so one table holds it."""
        self.bias, self.weights = float(w[-1]), (self.table @ (self.map @ w[:-1])).astype(np.float32)[self.column]

    def slim(self):
        """What only a fit needs is let go."""
        del self.table, self.column, self.map

    def sums(self, words, y, weight):
        """Matrix and vector of a Newton step over the windows of words inside the margin.

        Every window of a clean word is to be clean; of a toxic one the worst counts.
        """
        size = self.map.shape[1] + 1
        a, b, active = np.zeros((size, size)), np.zeros(size), 0
        worst = self.decide(words)
        for at, matrix in _grouped(words):
            t, span = _subsequences(matrix)
            norms = _norms(matrix)
            d = (self.weights[t] @ span) / norms + self.bias
            inside = np.flatnonzero((y[at] * d < 1) & ((y[at] < 0) | (d >= worst[at] - 1e-4)))
            for s in range(0, len(inside), 50):
                some = inside[s : s + 50]
                k = np.matmul(span[None, None, :], self.table[self.column[t[some]]])[:, 0] / norms[some, None]
                x = np.hstack([k @ self.map, np.ones((len(some), 1))])
                xw = x * weight[at[some], None]
                a, b, active = a + xw.T @ x, b + xw.T @ y[at[some]], active + len(some)
        return a, b, active

    def decide(self, words):
        """Decision of each word, that of its worst window if it is long."""
        out = np.full(len(words), -np.inf, np.float32)
        for at, matrix in _grouped(words):
            t, weight = _subsequences(matrix)
            np.maximum.at(out, at, (self.weights[t] @ weight) / _norms(matrix))
        return np.where(np.isfinite(out), out, 0.0) + self.bias


def fit_all(machine, words, ridge=RIDGE):
    """Newton steps over all of ``words`` (word, y, n), whose sums are added up in Spark tasks.

    A clean word weighs as often as it was seen, so common ones are seldom misjudged.
    """
    total = {r["y"]: (r["n"], r["w"]) for r in words.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") > 0, F.log1p("n")).otherwise(F.col("n"))).alias("w")).collect()}
    count = sum(n for n, _ in total.values())
    share = {1: count / (1 + CLEAN_SIDE) / total[1][1], -1: count * CLEAN_SIDE / (1 + CLEAN_SIDE) / total[-1][1]}
    spark, before = words.sparkSession, None
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast(machine)

        def each(batches, shared=shared):
            import pyarrow as pa

            a, b, active = 0.0, 0.0, 0
            for lot in lots(batches, 4096):
                y = lot.column(1).to_numpy().astype(float)
                n = lot.column(2).to_numpy()
                weight = np.where(y > 0, np.log1p(n) * share[1], n * share[-1])
                some = shared.value.sums(lot.column(0).to_pylist(), y, weight)
                a, b, active = a + some[0], b + some[1], active + some[2]
            if active:
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()]), pa.array([active], pa.int64())], ["a", "b", "active"])

        rows = words.select("word", "y", "n").mapInArrow(each, "a binary, b binary, active long").collect()
        shared.unpersist()
        now = sum(r["active"] for r in rows)
        if not rows or now == before:
            break
        size = machine.map.shape[1] + 1
        eye = np.eye(size) * ridge * count
        eye[-1, -1] = 1e-6
        a = sum(np.frombuffer(r["a"]) for r in rows).reshape(size, size)
        machine.take(np.linalg.solve(a + eye, sum(np.frombuffer(r["b"]) for r in rows)))
        before = now


class ToxicityModel:
    """A machine, and a line from a document's worst decision to its score."""

    def __init__(self, machine=None, slope=1.0, offset=0.0, constant=None):
        self.machine, self.slope, self.offset, self.constant = machine, slope, offset, constant
        self.known = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def worst(self, texts):
        """The largest decision among the words of each text; no word: the bias."""
        bags = [set(words_of(t)) if t else set() for t in texts]
        new = list(set().union(*bags).difference(self.known)) if bags else []
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(set().union(*bags))
        if new:
            spells = [spelled(w) for w in new]
            each = list(set(spells))
            value = dict(zip(each, self.machine.decide(each).tolist()))
            self.known.update((raw, value[w]) for raw, w in zip(new, spells))
        get = self.known.__getitem__
        return np.array([max(map(get, b)) if b else self.machine.bias for b in bags])

    def scores(self, texts):
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.offset, -500, 500)))


def word_counts(sample):
    """``word, toxic, clean, docs``: in how many different surroundings each word stands.

    A surrounding is the word with its two neighbours. Copies of a document repeat
    the surroundings of its words and add nothing; a surrounding that a clean
    document has as well counts as clean. ``docs`` is the number of toxic
    documents, where those with an equal smallest hash of surroundings are one.
    """

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            out = []
            for y, text in zip(lot.column(0).to_pylist(), texts_of(lot.column(1))):
                spells = [spelled(w) for w in (text or "").lower().split()]
                seen = {(w, zlib.crc32(f"{a} {w} {b}".encode())) for w, a, b in zip(spells, [""] + spells[:-1], spells[1:] + [""])}
                mark = min((h for _, h in seen), default=0)
                out += [(w, h, y, mark) for w, h in seen if len(w) > 1]
            cols = list(zip(*out)) if out else [[]] * 4
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["word", "around", "label", "mark"])

    found = sample.mapInArrow(each, "word string, around long, label int, mark long")
    once = found.groupBy("word", "around").agg(F.min("label").alias("label"), F.min("mark").alias("mark"))
    return once.groupBy("word").agg(
        F.sum("label").alias("toxic"),
        F.sum(1 - F.col("label")).alias("clean"),
        F.approx_count_distinct(F.when(F.col("label") == 1, F.col("mark"))).alias("docs"),
    )


def _spread(words, count):
    """Landmarks far from each other: each next one is least like those taken."""
    words = words[:SPREAD]
    if len(words) <= count:
        return list(words)
    rows = dense(words)[0]
    taken, near = [0], rows @ rows[0]
    while len(taken) < count:
        i = int(np.argmin(near))
        taken.append(i)
        near = np.maximum(near, rows @ rows[i])
    return [words[i] for i in taken]


def spread_over(spark):
    return max(spark.sparkContext.defaultParallelism, 2)


def train_toxicity(docs, labels, learn=None, key="doc_id", text="text", label="toxic", most=(CLEAN_DOCS, TOXIC_DOCS)):
    """Fit on at most ``most`` labelled documents of the classes 0 and 1.

    Labels are given for documents; which words make a sentence toxic is learned
    in rounds: the first machine takes words that stand in many surroundings of
    toxic documents and in none of clean ones, later ones add the clean words it
    scores highest and the words of toxic documents it agrees on. The last fit
    takes all clean words of the sample, whose sums are added up in tasks; the line
    from decisions to scores is set on texts held back from all of these. The driver
    gets bounded lists of words. With one class alone every score is that class.
    """
    sample = labelled_texts(docs, labels, label, key, text, F.lit(True) if learn is None else learn, most)
    present = {r["label"] for r in sample.select("label").distinct().collect()}
    if len(present) < 2:
        return ToxicityModel(constant=0.0 if not present else float(min(present)))
    back = F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0
    held, taught = sample.filter(back), sample.filter(~back)
    if min(df.select("label").distinct().count() for df in (held, taught)) < 2:
        held = taught = sample
    counts = settle(word_counts(taught))
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    toxic, clean = float(total["t"] or 0), float(total["c"] or 0)
    share = (toxic + 1) / (toxic + clean + 2)
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - float(np.log(share / (1 - share)))
    # How unlikely it is that a word of no meaning meets toxic documents alone.
    chance = F.col("docs") * float(-np.log(share)) - F.col("clean") * 3
    rated = counts.withColumn("odds", odds).withColumn("evidence", chance)

    times = {}

    def top(df, *order):
        rows = df.orderBy(*order, "word").limit(WORDS).select("word", (F.col("toxic") + F.col("clean")).alias("n")).collect()
        times.update((r["word"], r["n"]) for r in rows)
        return [r["word"] for r in rows]

    bad = top(rated.filter((F.col("evidence") > EVIDENCE) & (F.col("odds") > 3)), F.desc("docs"))
    if not bad:
        bad = top(rated.filter((F.col("toxic") > 0) & (F.col("clean") == 0)), F.desc("docs"))[:20]
    good = top(rated.filter("clean > 0 and odds < 1"), F.desc("clean")) + top(rated.filter("clean > 0 and odds < 1"), F.xxhash64("word"))
    good = list(dict.fromkeys(good))
    if not bad or not good:
        return ToxicityModel(constant=0.0)
    hard = []
    for turn in range(ROUNDS):
        machine = KernelMachine(_spread(bad, LANDMARKS // 2) + hard[: LANDMARKS // 4] + _spread(hard or good, LANDMARKS // 4))
        clean = list(dict.fromkeys(good + hard))
        machine.fit(bad + clean, np.array([1.0] * len(bad) + [-1.0] * len(clean)), np.array([float(times[w]) for w in bad + clean]))
        if turn + 1 == ROUNDS:
            break
        shared = docs.sparkSession.sparkContext.broadcast(machine)

        @F.pandas_udf("double")
        def decide(words, shared=shared):
            import pandas as pd

            return pd.Series(shared.value.decide(list(words)), dtype=float)

        seen = settle(rated.withColumn("d", decide("word")))
        hard = list(dict.fromkeys(top(seen.filter("clean > 0 and odds < 1"), F.desc("d")) + hard))
        bad = list(dict.fromkeys(bad + top(seen.filter("clean = 0 and toxic > 0 and evidence > 2 and d > 0.5"), F.desc("d"))))
    marked = F.when(F.col("word").isin(bad), 1).when(F.expr("clean > 0 and odds < 1"), -1)
    words = rated.select("word", marked.alias("y"), (F.col("toxic") + F.col("clean")).alias("n")).filter("y is not null")
    fit_all(machine, settle(words.repartition(spread_over(docs.sparkSession))))
    machine.slim()
    model = ToxicityModel(machine)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(shared.value.worst(texts_of(lot.column(1))))], ["label", "d"])

    rows = held.mapInArrow(each, "label int, d double").collect()
    model.slope, model.offset = _line(np.array([r["d"] for r in rows]), np.array([r["label"] for r in rows], float))
    return model


def _line(d, y):
    """Logistic line by Newton's method, classes weighted equally, lightly damped."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    x, w = np.stack([d, np.ones_like(d)], 1), np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * w * np.array([1, 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    slope = max(float(w[0]), 1e-3)
    return slope, -slope * _cut(d, y)


def _cut(d, y):
    """The decision between the classes that misjudges the smallest shares of both together."""
    order = np.argsort(d, kind="stable")
    d, y = d[order], y[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(y.sum(), 1)
    called = 1 - np.concatenate([[0], np.cumsum(1 - y)]) / max((1 - y).sum(), 1)
    edges = np.concatenate([[d[0] - 1], d, [d[-1] + 1]])
    wide = edges[1:] > edges[:-1]
    loss = np.where(wide, missed + called, np.inf)
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    best = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[best] + edges[best + 1]) / 2)


def score_toxicity(docs, model, key="doc_id", text="text"):
    """``key, score`` of every row, from its whole text and nothing else.

    Null and empty texts score as a text without a toxic word; repeated rows stay;
    an empty table gives no rows; other columns are not read.
    """
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        import pyarrow as pa

        for lot in lots(batches):
            yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(shared.value.scores(texts_of(lot.column(1))).astype(float))], ["k", "score"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("b")).mapInArrow(each, schema).withColumnRenamed("k", key)


def keep_civil(docs, model, text="text", threshold=THRESHOLD):
    """``docs`` without the rows that score at the threshold or above; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def civil(data):
        import pandas as pd

        out = []
        for s in range(0, len(data), 256):
            some = [None if x is None else bytes(x).decode("utf-8", "replace") for x in data.iloc[s : s + 256]]
            out.extend(shared.value.scores(some) < threshold)
        return pd.Series(out, dtype=bool)

    return docs.filter(civil(F.col(text).cast("binary")))
