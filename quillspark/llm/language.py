"""Language of words in code-switched text by a linear-chain conditional random field."""

import functools
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import lots, texts_of

# The fit uses about this many documents of each language, chosen by a hash of their keys, ...
DOCS_PER_LANGUAGE = 400
# ... and of all segments that their whole texts are cut into about so many, likewise by a hash:
SEGMENTS = 2000  # of a language
ALL_SEGMENTS = 100_000  # of all languages, in equal shares
SEGMENT_WORDS = 12
SEQUENCE = 4  # segments joined to one training sequence
LANGUAGES = 512  # more languages than this are refused
BUCKETS = 1 << 16  # the upper 16 bits of a hash
_PRIME = np.uint64(0x9E3779B97F4A7C15)
LEXICON_TIMES = 3  # a word seen as often in training belongs to a language's lexicon
EPOCHS = 40
CACHE = 300_000  # words whose features a worker remembers
CHAIN_WORDS = 200_000  # words of texts whose chains run side by side; a longer text runs alone
RESCALE = 8  # steps between scalings
AFFIX = 4  # letters of the longest prefix and suffix

_WORD = re.compile(r"[^\W\d_]+")


def _read(text):
    """The text in lower case, as long as before, and its runs of letters.

    Other characters that count as numbers are no letters; where there are any in
    a run, they are blanks in the text that comes back.
    """
    # The only letter whose lower case is longer.
    low = text.replace("\u0130", "i").lower()
    found = _WORD.findall(low)
    if not (low.isascii() or all(map(str.isalpha, found))):
        low = "".join([c if c.isalpha() else " " for c in low])
        found = _WORD.findall(low)
    return low, found


def words_of(text):
    """Runs of letters, lower-cased; other characters that count as numbers are none."""
    return _read(text)[1]


@functools.cache
def _letters():
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.int8, 0x110000)


def _starts(low):
    """Where the runs of letters begin, which are the words of ``_read``."""
    letter = _letters()[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")]
    return np.flatnonzero(np.diff(letter, prepend=np.int8(0)) == 1)


def _mixed(hashes, codes):
    return (hashes ^ codes) * _PRIME


def features(words):
    """Hashed features of many words: ``(grams, starts, whole)``.

    ``grams`` has two rows, the buckets of the letter pairs and triples that begin
    at each letter of all words with their edges, and word i begins at
    ``starts[i]``. ``whole`` has a row for each word: the word itself, its first
    one to four letters, and its last ones. A feature that a word lacks is in
    bucket ``BUCKETS``, which has no weight.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 2)
    starts = ends - size - 2
    flat = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    behind = np.concatenate([flat[1:], flat[:2]])
    pairs = _mixed(_mixed(np.uint64(2), flat), behind[:-1])
    grams = np.stack([pairs, _mixed(pairs, behind[1:])]) >> np.uint64(48)
    grams = grams.astype(np.int64)
    grams[:, ends - 1] = BUCKETS
    grams[1, ends - 2] = BUCKETS
    whole = np.full((len(words), 1 + 2 * AFFIX), BUCKETS)
    whole[:, 0] = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words]
    front, back = np.full(len(words), 3, np.uint64), np.full(len(words), 5, np.uint64)
    for n in range(AFFIX):
        has = size > n
        front = _mixed(front, flat[np.where(has, starts + 1 + n, 0)])
        back = _mixed(back, flat[np.where(has, ends - 2 - n, 0)])
        whole[has, 1 + n] = (front[has] >> np.uint64(48)).astype(np.int64)
        whole[has, 1 + AFFIX + n] = (back[has] >> np.uint64(48)).astype(np.int64)
    return grams, starts, whole


def known_in(words, lexicon):
    """(position, bucket) of each language whose lexicon has a word."""
    found = [(i, zlib.crc32(f"lexicon {x}".encode()) % BUCKETS) for i, w in enumerate(words) for x in lexicon.get(w, ())]
    return np.array(found, np.int64).reshape(-1, 2).T


def forward_backward(emit, length, transition, first):
    """Posteriors of all labels of padded sequences; ``emit`` is (rows, steps, labels).

    Works with scaled probabilities. Steps past a row's length do not count.
    Also returns the expected transitions and the log likelihood's partition.
    """
    rows, steps, labels = emit.shape
    top = emit.max(2, keepdims=True)
    e = np.exp(emit - top)
    move, start = np.exp(transition), np.exp(first)
    inside = np.arange(steps)[None, :] < length[:, None]
    alpha, scale = np.empty_like(e), np.ones((rows, steps))
    for t in range(steps):
        a = e[:, t] * (start[None] if t == 0 else alpha[:, t - 1] @ move)
        scale[:, t] = a.sum(1)
        alpha[:, t] = a / scale[:, t, None]
    beta = np.ones_like(e)
    for t in range(steps - 2, -1, -1):
        b = ((e[:, t + 1] * beta[:, t + 1]) @ move.T) / scale[:, t + 1, None]
        beta[:, t] = np.where(inside[:, t + 1, None], b, 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    return post, alpha, beta, e, scale, inside, move


def packed_posteriors(emit, lengths, transition, first):
    """Posteriors of all labels of chains of falling ``lengths``, one below the other.

    The chains run side by side, each step over those that reach it alone, so long
    chains pad no short ones. Scaling every few steps is enough against underflow.
    """
    rows, steps, total = len(lengths), int(lengths[0]), int(lengths.sum())
    active = rows - np.searchsorted(lengths[::-1], np.arange(steps), "right")
    at = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = at[step] + np.repeat(np.arange(rows), lengths)
    e = np.empty((total, emit.shape[1]))
    e[place] = np.exp(emit - emit.max(1, keepdims=True))
    move, back = np.exp(transition), np.ascontiguousarray(np.exp(transition).T)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    at, active = at.tolist(), active.tolist()
    alpha[:rows] = e[:rows] * np.exp(first)
    for t in range(1, steps):
        now = alpha[at[t] : at[t + 1]]
        np.matmul(alpha[at[t - 1] : at[t - 1] + active[t]], move, out=now)
        now *= e[at[t] : at[t + 1]]
        if t % RESCALE == 0:
            now /= now.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        now = beta[at[t] : at[t] + active[t + 1]]
        np.matmul(e[at[t + 1] : at[t + 2]] * beta[at[t + 1] : at[t + 2]], back, out=now)
        if t % RESCALE == 0:
            now /= now.sum(1, keepdims=True)
    post = alpha * beta
    post /= post.sum(1, keepdims=True)
    return post[place]


class ChainModel:
    def __init__(self, labels, lexicon):
        self.labels, self.lexicon = labels, lexicon
        k = len(labels)
        self.weights = np.zeros((BUCKETS + 1, k), np.float32)
        self.transition, self.first = np.zeros((k, k)), np.zeros(k)
        self._forget()

    def _forget(self):
        self.row, self.table, self.used = {}, np.empty((0, len(self.labels)), np.float32), 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "table", "used")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def fit(self, sequences, epochs=EPOCHS, rate=0.2, decay=1e-5):
        """Gradient ascent with per-weight steps on the conditional likelihood.

        ``sequences``: lists of (word, label number), all of one length.
        """
        words = sorted({w for s in sequences for w, _ in s})
        number = {w: i for i, w in enumerate(words)}
        grams, starts, whole = features(words)
        known, lexical = known_in(words, self.lexicon)
        letters = np.repeat(np.arange(len(words)), np.diff(np.append(starts, grams.shape[1])))
        owner = np.concatenate([letters, letters, np.repeat(np.arange(len(words)), whole.shape[1]), known])
        bucket = np.concatenate([grams[0], grams[1], whole.ravel(), lexical])
        owner, bucket = owner[bucket < BUCKETS], bucket[bucket < BUCKETS]
        at = np.array([[number[w] for w, _ in s] for s in sequences])
        gold = np.array([[y for _, y in s] for s in sequences])
        rows, steps = at.shape
        k = len(self.labels)
        truth = np.eye(k)[gold]
        length = np.full(rows, steps)
        seen_moves = np.zeros((k, k))
        np.add.at(seen_moves, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        square = np.full(self.weights.shape, 1e-8, np.float32)
        square_move, square_first = np.full((k, k), 1e-8), np.full(k, 1e-8)
        for _ in range(epochs):
            score = np.stack([np.bincount(owner, self.weights[bucket, c], len(words)) for c in range(k)], 1)
            post, alpha, beta, e, scale, _, move = forward_backward(score[at], length, self.transition, self.first)
            pair = np.einsum("rti,rtj->ij", alpha[:, :-1], (e * beta / scale[:, :, None])[:, 1:]) * move
            error = truth - post
            by_word = np.stack([np.bincount(at.ravel(), error[:, :, c].ravel(), len(words)) for c in range(k)], 1)
            grad = np.stack([np.bincount(bucket, by_word[owner, c], BUCKETS + 1) for c in range(k)], 1).astype(np.float32)
            grad -= decay * rows * self.weights
            square += grad**2
            self.weights += rate * grad / np.sqrt(square)
            grad = seen_moves - pair - 0.01 * rows * self.transition
            square_move += grad**2
            self.transition += rate * grad / np.sqrt(square_move)
            grad = error[:, 0].sum(0) - 0.01 * rows * self.first
            square_first += grad**2
            self.first += rate * grad / np.sqrt(square_first)

    def _rows_of(self, words):
        """Row numbers of the words in the table of emission scores."""
        new = list(set(words).difference(self.row))
        if new:
            if len(self.row) + len(new) > CACHE:
                self._forget()
                new = list(set(words))
            grams, starts, whole = features(new)
            scores = self.weights[whole].sum(1)
            for row in grams:
                scores += np.add.reduceat(self.weights[row], starts, axis=0)
            known, lexical = known_in(new, self.lexicon)
            np.add.at(scores, known, self.weights[lexical])
            need = self.used + len(new)
            if need > len(self.table):
                grown = np.empty((max(need, 2 * len(self.table), 4096), len(self.labels)), np.float32)
                grown[: self.used] = self.table[: self.used]
                self.table = grown
            self.table[self.used : need] = scores
            self.row.update(zip(new, range(self.used, need)))
            self.used = need
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def posteriors(self, bags):
        """Posterior (words, labels) of each list of words, chains run side by side."""
        out = [np.empty((0, len(self.labels)))] * len(bags)
        order = sorted((i for i, b in enumerate(bags) if b), key=lambda i: -len(bags[i]))
        ends = np.cumsum([len(bags[i]) for i in order])
        s = 0
        while s < len(order):
            before = ends[s - 1] if s else 0
            some = order[s : max(s + 1, int(np.searchsorted(ends, before + CHAIN_WORDS, "right")))]
            rows = self._rows_of([w for i in some for w in bags[i]])
            lengths = np.array([len(bags[i]) for i in some])
            post = packed_posteriors(self.table[rows], lengths, self.transition, self.first)
            for i, part in zip(some, np.split(post, np.cumsum(lengths)[:-1])):
                out[i] = part
            s += len(some)
        return out

    def label(self, texts):
        """``(language, score, spans)`` of each text.

        A word has the label of its largest posterior, and neighbours of one label
        make a span ``(label, begin, end, score)``: characters of the text from its
        first word to behind its last, and the mean posterior. The language is the
        label of the largest mean posterior of all words.
        """
        read = [_read(t or "") for t in texts]
        if not self.labels:
            return [("und", 0.0, [])] * len(texts)
        found = []
        for (low, words), post in zip(read, self.posteriors([w for _, w in read])):
            if not len(post):
                found.append(("und", 0.0, []))
                continue
            tags = post.argmax(1)
            first = np.flatnonzero(np.diff(tags, prepend=-1))
            size = np.diff(first, append=len(tags))
            means = np.add.reduceat(post.max(1), first) / size
            at = _starts(low)
            last = (first + size - 1).tolist()
            spans = [
                (self.labels[tags[i]], int(at[i]), int(at[j]) + len(words[j]), min(float(x), 1.0))
                for i, j, x in zip(first.tolist(), last, means)
            ]
            mean = post.mean(0)
            best = int(mean.argmax())
            found.append((self.labels[best], float(min(mean[best], 1.0)), spans))
        return found


def _share(number, total, *columns):
    """Whether a row is among about ``number`` of ``total`` rows, by a hash of the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 32)) < F.lit(float(1 << 32)) * number / total


def train_language(docs, learn=None, key="doc_id", text="text", lang="lang", per_language=DOCS_PER_LANGUAGE):
    """Fit on segments of about ``per_language`` documents of each language.

    The whole texts of these documents are cut into segments, the last one of each
    reaching back over its full length, and of all of a language about ``SEGMENTS``
    are learned from, wherever in a text they are. Training sequences join segments
    of several documents, so the chain sees switches of language; transitions are
    learned from them. Rows with null key, language or text, or without a letter,
    teach nothing; of rows with one key and language the smallest text does. With no
    such row every prediction is ``und``.
    """
    known = docs.filter((F.lit(True) if learn is None else learn) & F.col(key).isNotNull() & F.col(lang).isNotNull())
    known = known.select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).cast("binary").alias("b"))
    sizes = settle(known.groupBy("_l").agg(F.approx_count_distinct("_k").alias("n")).limit(LANGUAGES + 1))
    languages = sizes.count()
    if languages > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not languages:
        return ChainModel([], {})
    chosen = known.join(F.broadcast(sizes), "_l").filter(_share(per_language, F.col("n"), "_k"))
    texts = chosen.groupBy("_k", "_l").agg(F.min("b").alias("b"))

    def cut(batches):
        import pyarrow as pa

        for lot in lots(batches):
            out = []
            for k, label, t in zip(lot.column(0).to_pylist(), lot.column(1).to_pylist(), texts_of(lot.column(2))):
                words = words_of(t or "")
                for s in range(0, len(words), SEGMENT_WORDS):
                    part = words[max(0, min(s, len(words) - SEGMENT_WORDS)) :][:SEGMENT_WORDS]
                    out.append((zlib.crc32(f"{k} {s}".encode()), label, (part * SEGMENT_WORDS)[:SEGMENT_WORDS]))
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.list_(pa.string())))], ["order", "lang", "words"])

    segments = settle(texts.mapInArrow(cut, "order long, lang string, words array<string>"))
    most = min(SEGMENTS, ALL_SEGMENTS // languages)
    counted = F.broadcast(segments.groupBy("lang").agg(F.count("*").alias("n")))
    rows = segments.join(counted, "lang").filter(_share(most, F.col("n"), "order", "words")).select("order", "lang", "words").collect()
    rows.sort(key=lambda r: (r["order"], r["lang"], r["words"]))
    labels = sorted({r["lang"] for r in rows})
    number = {x: i for i, x in enumerate(labels)}
    counts = {}
    for r in rows:
        for w in set(r["words"]):
            own = counts.setdefault(w, {})
            own[r["lang"]] = own.get(r["lang"], 0) + 1
    lexicon = {w: sorted(x for x, n in c.items() if n >= LEXICON_TIMES) for w, c in counts.items()}
    lexicon = {w: x for w, x in lexicon.items() if x}
    model = ChainModel(labels, lexicon)
    whole = rows + (rows * SEQUENCE)[: -len(rows) % SEQUENCE]
    joined = [[(w, number[r["lang"]]) for r in whole[s : s + SEQUENCE] for w in r["words"]] for s in range(0, len(whole), SEQUENCE)]
    # Two neighbours of each sequence share a language more often than chance
    # would have it in text, so each segment also stands in a sequence of its own.
    alone = [[(w, number[r["lang"]]) for w in r["words"] * SEQUENCE] for r in rows[:: SEQUENCE]]
    if joined or alone:
        model.fit(joined + alone)
    return model


def language_spans(docs, model, key="doc_id", text="text"):
    """``key, lang_pred, score, spans`` of every row, from its whole text and nothing else.

    Every word gets posteriors by forward-backward over the whole text. ``spans``
    holds ``lang, begin, end, score`` for each run of words of one language in the
    order of the text, ``begin`` and ``end`` counted in characters from 0. The
    document takes the language of the largest mean posterior. Null texts and texts
    without a letter are ``und`` with score 0 and no span; repeated rows stay; an
    empty table gives no rows; other columns are not read.
    """
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64()]
        for lot in lots(batches):
            found = shared.value.label(texts_of(lot.column(1)))
            flat = list(zip(*[x for _, _, spans in found for x in spans])) or [[]] * 4
            parts = pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(flat, kinds)], ["lang", "begin", "end", "score"])
            ends = np.cumsum([0] + [len(spans) for _, _, spans in found])
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([lot.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], schema.names)

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("b")).mapInArrow(each, schema).withColumnRenamed("k", key)


def identify_language(docs, model, key="doc_id", text="text"):
    """``key, lang_pred, score`` of every row, as ``language_spans`` finds them."""
    return language_spans(docs, model, key, text).drop("spans")
