"""Token ids in binary shards, found through a minimal perfect hash."""

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_shared_path
from .common import broadcast_if_small, lots, texts_of

END_ID = 0
SHARD_TOKENS = 1 << 20  # a shard is closed once it holds as many ids
LOT = 1024  # documents encoded at a time, of an Arrow batch whose bytes Spark bounds
GAMMA = 2.0  # bits of a level of the hash per key
CACHE = 400_000  # pieces of either generation that a worker remembers
JOINED = 1024  # pieces encoded as one text
_CUT = re.compile(r" (?=\S)")
_ODD = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)"  # of Arrow's own patterns: a space that begins no pre-token


class Encoder:
    """Ids of texts; ``spec`` is the JSON of a tokenizer of the tokenizers library.

    A byte-level tokenizer without normaliser begins a pre-token at each space
    that a non-space follows, so texts are cut there and the ids of pieces are
    remembered, in two generations. Pieces not seen before are encoded many at a
    time, as one text; an id that begins with a space begins a piece. Any other
    tokenizer gets whole texts.
    """

    def __init__(self, spec):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        told = json.loads(spec)
        before = told.get("pre_tokenizer") or {}
        added = told.get("added_tokens", [])
        self.cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and told.get("normalizer") is None
            and told["model"]["type"] == "BPE" and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in added)
        )
        self.added = [t["content"] for t in added]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known, self.older = {}, {}
        if self.cuts:
            space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
            vocabulary = told["model"]["vocab"]
            self.begins = np.zeros(1 + max([*vocabulary.values(), *(t["id"] for t in added)]), bool)
            self.begins[[i for t, i in vocabulary.items() if t.startswith(space) and t not in self.added]] = True

    def _arrays(self, texts):
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, texts):
        return [x.tobytes() for x in self._arrays(texts)]

    def _unseen(self, pieces):
        """Ids of pieces, each with a space in front of it."""
        out, chunks = [], [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        for chunk, ids in zip(chunks, self._arrays([" " + " ".join(c) for c in chunks])):
            starts = np.flatnonzero(self.begins[ids])
            # Other spaces within a piece, or texts of added tokens: these pieces one by one.
            if len(starts) != len(chunk) or starts[0]:
                out += self._plain([" " + p for p in chunk])
                continue
            data, at = ids.tobytes(), [*(starts * ids.itemsize).tolist(), ids.nbytes]
            out += [data[a:b] for a, b in zip(at, at[1:])]
        return out

    def _remember(self, pieces, out):
        while pieces:
            if len(self.known) >= CACHE:
                self.known, self.older = {}, self.known
            free = CACHE - len(self.known)
            self.known.update(zip(pieces[:free], out))
            pieces, out = pieces[free:], out[free:]

    def _pieces(self, pieces):
        """Ids of different pieces, each with a space in front of it."""
        out = list(map(self.known.get, pieces))
        missed = [i for i, ids in enumerate(out) if ids is None]
        older, new = self.older, []
        for i in missed:
            ids = out[i] = older.get(pieces[i])
            if ids is None:
                new.append(i)
        whole = [i for i in new if " " in pieces[i] or any(t in pieces[i] for t in self.added)]
        apart = set(whole)
        rest = [i for i in new if i not in apart] if whole else new
        for at, found in ((whole, self._plain([" " + pieces[i] for i in whole])), (rest, self._unseen([pieces[i] for i in rest]))):
            for i, ids in zip(at, found):
                out[i] = ids
        self._remember([pieces[i] for i in missed], [out[i] for i in missed])
        return out

    def encode(self, texts):
        """Ids of each text as little-endian bytes, one text after the other.

        Texts whose spaces all begin pre-tokens are split by Arrow, and each
        different piece of the lot is looked up once.
        """
        if not self.cuts:
            return self._plain(texts)
        out = [None] * len(texts)
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, _ODD).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(odd):
            first, *rest = _CUT.split(texts[i])
            words = list(dict.fromkeys(rest))
            ids = dict(zip(words, self._pieces(words)))
            out[i] = self._plain([first])[0] + b"".join([ids[w] for w in rest])
        even = np.flatnonzero(~odd)
        split = pc.split_pattern(whole.take(pa.array(even)), " ")
        if not len(even):
            return out
        pieces = split.flatten().dictionary_encode()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        firsts, rank = bounds[:-1], pieces.indices.to_numpy().copy()
        # No piece holds a space, so all go to Python as one text.
        listed = pa.ListArray.from_arrays([0, len(pieces.dictionary)], pieces.dictionary)
        words = pc.binary_join(listed, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        begins = self._plain([words[i] for i in rank[firsts]])
        rank[firsts] = len(words) + np.arange(len(even))
        used = np.zeros(len(words), bool)
        used[rank[rank < len(words)]] = True
        places = np.flatnonzero(used).tolist()
        ids = [b""] * len(words)
        for i, found in zip(places, self._pieces([words[i] for i in places])):
            ids[i] = found
        laid = pa.array(ids + begins, pa.large_binary()).take(pa.array(rank))
        ends = np.frombuffer(laid.buffers()[1], np.int64)[bounds].tolist()
        data = memoryview(laid.buffers()[2] or b"")
        for i, start, end in zip(even.tolist(), ends, ends[1:]):
            out[i] = bytes(data[start:end])
        return out


@lru_cache(maxsize=1)
def encoder_of(spec):
    """The encoder of a worker process, which keeps what it remembers from task to task."""
    return Encoder(spec)


def hashes_of(keys, times):
    """128 bits for each pair of a key and how often it stood before."""
    raw = b"".join(xxhash.xxh3_128_digest(f"{k}:{t}".encode()) for k, t in zip(keys, times))
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def _places(hashes, level, size):
    mixed = (hashes[:, 0] ^ np.uint64((level * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Bit levels: a key rests at the first level where no other key meets its bit.

    Its number is the rank of that bit, so n keys get the numbers below n. A slot
    holds 32 further bits of the key's hash; other keys are told by them.
    """

    def __init__(self, sizes, bits, slots):
        self.sizes, self.slots = sizes, slots
        self.starts = np.cumsum(sizes) - sizes
        self.bits = np.unpackbits(bits, bitorder="little")[: int(sizes.sum())]
        self.ranks = np.cumsum(self.bits) - self.bits

    @classmethod
    def build(cls, hashes, start, count):
        sizes, levels, left, at = [], [], np.arange(len(hashes)), np.zeros(len(hashes), np.int64)
        while len(left):
            size = max(64, int(GAMMA * len(left)) // 64 * 64 + 64)
            place = _places(hashes[left], len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            rests = alone[place]
            at[left[rests]] = sum(sizes) + place[rests]
            sizes.append(size)
            levels.append(alone)
            left = left[~rests]
            if len(sizes) > 200:
                raise ValueError("keys of a shard are not distinct")
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        slots = np.zeros(len(hashes), [("print", "<u4"), ("start", "<u4"), ("count", "<u4")])
        number = (np.cumsum(bits) - bits)[at] if len(at) else at
        slots["print"][number] = (hashes[:, 1] & np.uint64(0xFFFFFFFF)).astype("<u4")
        slots["start"][number], slots["count"][number] = start, count
        return cls(np.array(sizes, np.int64), np.packbits(bits, bitorder="little"), slots)

    def pack(self):
        return self.sizes.astype("<i8").tobytes(), np.packbits(self.bits, bitorder="little").tobytes(), self.slots.tobytes()

    @classmethod
    def unpack(cls, sizes, bits, slots):
        return cls(np.frombuffer(sizes, "<i8"), np.frombuffer(bits, np.uint8), np.frombuffer(slots, [("print", "<u4"), ("start", "<u4"), ("count", "<u4")]))

    def find(self, hashes):
        """Slot number of each hash, -1 for keys that are not in the shard."""
        slot, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            at = start + _places(hashes[left], level, int(size))
            hit = self.bits[at] == 1
            slot[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        known = slot >= 0
        wrong = np.flatnonzero(known)[self.slots["print"][slot[known]] != (hashes[known, 1] & np.uint64(0xFFFFFFFF)).astype("<u4")]
        slot[wrong] = -1
        return slot


_SHARD = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("first_key", T.LongType()), T.StructField("last_key", T.LongType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("first_time", T.LongType()),
    T.StructField("sizes", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("slots", T.BinaryType()), T.StructField("payload", T.BinaryType()),
])


def write_ids(docs, path, spec, key="doc_id", text="text", end_id=END_ID, shard_ids=SHARD_TOKENS):
    """Encode and store all documents in ascending order of the key.

    The documents are dealt out by ranges of the key and sorted, then each task
    writes shards one after the other: raw ids, little-endian, two bytes where the
    vocabulary allows, each document with ``end_id`` behind it; and the shard's
    own index. A shard is one row, so it is never cut, and holds ``shard_ids`` ids
    or one document more. Null texts are empty; null keys come first; rows that
    repeat a key are told apart by their order, that of their texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def each(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = encoder_of(shared.value)
        end = np.array([end_id], encoder.kind).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        keys, times, starts, counts, payload, total = [], [], [], [], [], 0
        last, times_seen = object(), 0

        def close():
            index = PerfectHash.build(hashes_of(keys, times), np.array(starts, np.int64), np.array(counts, np.int64))
            row = [part, seq, keys[0], keys[-1], len(keys), total, len(end), keys, times[0], *index.pack(), b"".join(payload)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        arrow = _arrow(pa)
        for lot in lots(batches, LOT):
            texts = [t or "" for t in texts_of(lot.column(1))]
            for k, ids in zip(lot.column(0).to_pylist(), encoder.encode(texts)):
                times_seen = times_seen + 1 if k == last else 0
                last = k
                n = len(ids) // len(end) + 1
                keys.append(k)
                times.append(times_seen)
                starts.append(total)
                counts.append(n)
                payload += [ids, end]
                total += n
                if total >= shard_ids:
                    yield close()
                    seq += 1
                    keys, times, starts, counts, payload, total = [], [], [], [], [], 0
        if keys:
            yield close()

    narrow = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("binary").alias("b"))
    narrow.repartitionByRange("k").sortWithinPartitions("k", "b").mapInArrow(each, _SHARD).write.parquet(path)


def _arrow(pa):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_SHARD)


def _shards(batches):
    """(row, index, ids) of each shard of some Arrow batches."""
    for lot in lots(batches, 1):
        row = {n: lot.column(i)[0].as_py() for i, n in enumerate(lot.schema.names)}
        yield row, PerfectHash.unpack(row["sizes"], row["bits"], row["slots"]), np.frombuffer(row["payload"], f"<u{row['width']}")


def _times(keys, first):
    """How often each of sorted keys stood before, ``first`` for the first of them."""
    out = []
    for i, k in enumerate(keys):
        out.append(first if not i else out[-1] + 1 if k == keys[i - 1] else 0)
    return out


def read_all(spark, path):
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    Each shard's keys are looked up in its index and their ids read from its
    payload; ``start`` adds the ids of all shards before. Only one row per task of
    the writer is added up in one place.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    narrow = shards.select("part", "seq", "n_ids")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = narrow.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    bases = narrow.withColumn("own", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(F.broadcast(before), "part").select("part", "seq", (F.col("base") + F.col("own")).alias("base"))

    def each(batches):
        import pyarrow as pa

        for row, index, ids in _shards(batches):
            slot = index.find(hashes_of(row["keys"], _times(row["keys"], row["first_time"])))
            start, count = index.slots["start"][slot].astype(np.int64), index.slots["count"][slot].astype(np.int64)
            crc = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n in zip(start, count)]
            n = len(slot)
            yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(start), pa.array(count), pa.array(crc, pa.int64())], ["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(each, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    return rows.join(broadcast_if_small(bases), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark, path, keys):
    """``key, time, ids`` of the documents of a short list of keys.

    The key ranges of the shards go to the Parquet scan as a filter; within a
    shard each key costs one probe of the index, whatever the shard's size.
    """
    keys = sorted(set(keys))
    near = F.lit(False)
    for k in keys:
        near = near | ((F.col("first_key") <= k) & (F.col("last_key") >= k))

    def each(batches):
        import pyarrow as pa

        for row, index, ids in _shards(batches):
            out = []
            for k in keys:
                time = row["first_time"] if k == row["keys"][0] else 0
                while (slot := int(index.find(hashes_of([k], [time]))[0])) >= 0:
                    s, n = int(index.slots["start"][slot]), int(index.slots["count"][slot])
                    out.append((k, time, ids[s : s + n].tolist()))
                    time += 1
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["key", "time", "ids"])

    return spark.read.schema(_SHARD).parquet(path).filter(near).mapInArrow(each, "key long, time long, ids array<long>")


def round_trip(docs, spec, key="doc_id", text="text", end_id=END_ID, shard_ids=SHARD_TOKENS):
    """Write to the shared folder and read back."""
    path = new_shared_path(docs.sparkSession)
    write_ids(docs, path, spec, key, text, end_id, shard_ids)
    return read_all(docs.sparkSession, path)
