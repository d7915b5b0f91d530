"""Piece encoding by an Aho-Corasick automaton and Viterbi, and decoding."""

import hashlib
import zlib
from array import array

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lots, texts_of
from .pieces import Vocabulary

CACHE = 400_000  # parts of text whose ids a worker remembers
LONG = 1024  # a longer part is not remembered
CHUNK = 1 << 16  # ids decoded at a time


class PieceCoder:
    """Best segmentations under the unigram scores of a vocabulary.

    One pass over a part: at each position the automaton gives, along its output
    links, all pieces that end there, longest first, and each relaxes the best
    score of the position. Of equal scores the longest piece counts.
    """

    def __init__(self, vocabulary):
        import ahocorasick

        self.vocabulary, self.known = vocabulary, {}
        self.automaton = ahocorasick.Automaton()
        self.length, self.score = {}, {}
        for piece, score in vocabulary.scores.items():
            number = vocabulary.ids[piece]
            self.length[number], self.score[number] = len(piece), score
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()

    def _segment(self, part):
        """Ids of a part. Beyond the part itself, a position takes 16 bytes if the part is long."""
        size, unknown, length = len(part), self.vocabulary.unknown, self.length
        long = size > LONG
        best = array("d", bytes(8 * size + 8)) if long else [0.0] * (size + 1)
        back = array("i", bytes(4 * size + 4)) if long else [0] * (size + 1)
        done = 0
        # Matches come by their ends, and of one end the longest first.
        for last, number in self.automaton.iter(part) if length else ():
            while done <= last:
                best[done + 1] = best[done] + unknown
                done += 1
            score = best[done - length[number]] + self.score[number]
            if score > best[done]:
                best[done], back[done] = score, number + 1
        ids, end = array("i") if long else [], size
        while end:
            if end <= done and back[end]:
                ids.append(back[end] - 1)
                end -= length[back[end] - 1]
            else:
                ids.extend([self.vocabulary.bytes[b] for b in reversed(part[end - 1].encode("utf-8", "replace"))])
                end -= 1
        ids.reverse()
        return ids

    def encode(self, texts):
        """Ids of each text as a 32-bit array; an empty text has none."""
        parts = [self.vocabulary.parts(t) for t in texts]
        for words in parts:
            new = set(words).difference(self.known)
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set(words)
            for word in new:
                self.known[word] = np.array(self._segment(word), "<u4").tobytes()
            found = np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")
            for word in new:
                if len(word) > LONG:
                    del self.known[word]
            yield found

    def decode(self, ids):
        """The text of some ids; the space set in front of it is taken off."""
        lots_of_ids = (ids[s : s + CHUNK].tolist() for s in range(0, len(ids), CHUNK))
        raw = b"".join([b"".join(map(self.vocabulary.text.__getitem__, x)) for x in lots_of_ids])
        return raw.decode("utf-8", "replace")[1:]


def _coder(state, pieces):
    return state.get("coder") or state.setdefault("coder", PieceCoder(Vocabulary(pieces)))


def encode_pieces(docs, pieces, key="doc_id", text="text", compare=False):
    """``key, ids array<int>`` of every row, from its whole text; with ``compare`` also ``same``.

    ``same`` tells whether the ids, decoded in the same pass, give the text back.

    Null and empty texts have no ids. Line breaks and characters that are no
    piece, the space sign U+2581 among them, are spelled in byte pieces, so
    decoding gives every text back. A word of any length is coded whole. Repeated rows stay; an empty table gives no
    rows; other columns are not read and no text is moved.
    """
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("same", T.BooleanType())] * compare)
    shared, state = docs.sparkSession.sparkContext.broadcast(pieces), {}

    def each(batches):
        import pyarrow as pa

        coder = _coder(state, shared.value)
        for lot in lots(batches):
            texts = [t or "" for t in texts_of(lot.column(1))]
            ids = list(coder.encode(texts))
            same = [pa.array([coder.decode(x) == t for x, t in zip(ids, texts)], pa.bool_())] if compare else []
            ids = [x.astype(np.int32) for x in ids]
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            ends = np.cumsum([0] + [len(x) for x in ids])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([lot.column(0), column, *same], schema.names)

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("b")).mapInArrow(each, schema).withColumnRenamed("k", key)


def decode_pieces(encoded, pieces, key="doc_id", ids="ids"):
    """``key, text`` from ids; null or no ids: an empty text."""
    schema = T.StructType([T.StructField("k", encoded.schema[key].dataType), T.StructField("text", T.StringType())])
    shared, state = encoded.sparkSession.sparkContext.broadcast(pieces), {}

    def each(batches):
        import pyarrow as pa

        coder = _coder(state, shared.value)
        for lot in lots(batches):
            texts = [coder.decode(np.array(x.as_py() or [], np.int64)) for x in lot.column(1)]
            yield pa.RecordBatch.from_arrays([lot.column(0), pa.array(texts, pa.string())], ["k", "text"])

    return encoded.select(F.col(key).alias("k"), ids).mapInArrow(each, schema).withColumnRenamed("k", key)


def round_trip(docs, pieces, key="doc_id", text="text"):
    """``key, n_ids, ids_crc32, text_sha256, same`` after encoding and decoding each row."""
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("same", T.BooleanType())])
    shared, state = docs.sparkSession.sparkContext.broadcast(pieces), {}

    def each(batches):
        import pyarrow as pa

        coder = _coder(state, shared.value)
        for lot in lots(batches):
            texts = [t or "" for t in texts_of(lot.column(1))]
            out = []
            for text, ids in zip(texts, coder.encode(texts)):
                back = coder.decode(ids)
                out.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([lot.column(0), *[pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))]], ["k", "n_ids", "ids_crc32", "text_sha256", "same"])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("b")).mapInArrow(each, schema).withColumnRenamed("k", key)
