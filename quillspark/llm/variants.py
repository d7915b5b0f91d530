"""Spelling variants: words one edit apart, found by sorting permuterm rotations."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from ..session import settle
from .common import lots

LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2  # a form occurs at least so many times as often as the word
NOISE = 97
END = "$"  # marks the end of a word; no word holds it
# Longer rotations are keyed by digests, as their texts would be quadratic in the word.
LONG = 64
# Different words a task counts before it hands its counts on.
HELD = 200_000
LETTERS = re.compile("[a-zÀ-ÿ]+")
_PRIME, _BASES = (1 << 61) - 1, (0x1F3D5B79A2C4E687 % ((1 << 61) - 1), 0x0B7E151628AED2A6 % ((1 << 61) - 1))


def runs_of(data):
    """Runs of letters of a UTF-8 text with A-Z lower-cased, with their counts; null has none."""
    text = (data or b"").lower().decode("utf-8", "replace")
    return Counter(LETTERS.findall(text) if len(text) < 1 << 20 else (m.group() for m in LETTERS.finditer(text)))


def noisy(prefix, run):
    """The run, or the run without one code point where its checksum says so."""
    h = zlib.crc32((prefix + run).encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs, key="doc_id", text="text", least_length=LEAST_LENGTH, least_count=LEAST_COUNT):
    """``word, n``: words of whole texts that are long and frequent enough.

    A null key counts as an empty one, a null or empty text has no words, repeated
    rows count as often as they occur, other columns are not read. Counts are
    added up in the task before they are shuffled.
    """

    def count(batches):
        import pyarrow as pa

        held = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for lot in lots(batches):
            for name, data in zip(lot.column(0).to_pylist(), lot.column(1)):
                prefix = f"{'' if name is None else name}:"
                for run, n in runs_of(data.as_py()).items():
                    word = noisy(prefix, run)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("binary").alias("b")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def rotations(word):
    """Keys of a word's rotations: ``(key, letter, first)``.

    The rotation that starts at place i is ``word[i:] + END + word[:i]``. Whole, with
    an empty letter, it is the prefix under which all words stand that have one
    letter more at that place. Cut before its last letter it skips the letter at
    one place; words that share it differ in that letter alone. ``first`` marks
    the first of equal letters in a row: leaving out any of them gives the same
    shorter word, so only that place may stand for an inserted letter.
    """
    n = len(word)
    digest = _digests(word) if n > LONG else None
    key = lambda x, y: word[y:] + END + word[:x] if x + n - y <= LONG else digest(x, y)
    for i in range(n + 1):
        yield key(i, i), "", True
    for i in range(n):
        yield key(i, i + 1), word[i], i == 0 or word[i - 1] != word[i]


def _digests(word):
    """Digests of 122 bits that stand for the rotations of a long word."""
    heads, powers = [], []
    for base in _BASES:
        head, power = [0], [1]
        for c in word:
            head.append((head[-1] * base + ord(c)) % _PRIME)
            power.append(power[-1] * base % _PRIME)
        heads.append(head)
        powers.append(power)
    n = len(word)

    def key(x, y):
        parts = [f"{(h[n] - h[y] * p[n - y]) % _PRIME:x}{END}{h[x]:x}" for h, p in zip(heads, powers)]
        return f"{END}{x}{END}{n - y}{END}{END.join(parts)}"

    return key


def rotation_table(words):
    """``key, id, n, letter, first``: every rotation of ``id, word, n``."""

    def rotate(batches):
        import pyarrow as pa

        names = ["key", "id", "n", "letter", "first"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        rows = [[] for _ in names]
        for lot in lots(batches):
            for i, word, n in zip(*(c.to_pylist() for c in lot.columns)):
                for key, letter, first in rotations(word):
                    for column, value in zip(rows, (key, i, n, letter, first)):
                        column.append(value)
                    if len(rows[0]) >= 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)
                        rows = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names)

    return words.select("id", "word", "n").mapInArrow(rotate, "key string, id long, n long, letter string, first boolean")


def near_words(words):
    """``id, n_near, best_n, best_id`` of words ``id, word, n`` with a word one edit away.

    Rotations are sorted and grouped by key. Words are distinct, so a group has one
    word per letter of the alphabet and one whole word at most, and two near words
    meet in one group alone. Every member gives how many near words it has in the
    group and the best of them (largest n, then smallest id), not one row per pair.
    """
    groups = (
        rotation_table(words)
        .groupBy("key")
        .agg(F.collect_list(F.struct("id", "n", "letter", "first")).alias("members"))
        .filter(F.size("members") > 1)
    )
    near = lambda a, b: (a["letter"] != b["letter"]) & a["first"] & b["first"] | (a["letter"] != b["letter"]) & (a["letter"] != "") & (b["letter"] != "")
    others = F.transform("members", lambda a: F.struct(a["id"].alias("id"), F.transform(F.filter("members", lambda b: near(a, b)), lambda b: F.struct(b["n"].alias("n"), (-b["id"]).alias("id"))).alias("near")))
    each = groups.select(F.explode(F.filter(others, lambda x: F.size(x["near"]) > 0)).alias("x"))
    return (
        each.select("x.id", F.size("x.near").alias("n_near"), F.array_max("x.near").alias("best"))
        .groupBy("id")
        .agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
        .select("id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.id")).alias("best_id"))
    )


def roots(forms):
    """``id, root``: the last word when forms (``id, up``) are followed.

    Counts at least double from a word to its form, so no chain is longer than the
    binary logarithm of the largest count, and each round halves what is left.
    """
    at = settle(forms)
    while True:
        up = at.select(F.col("id").alias("up"), F.col("up").alias("above"))
        now = settle(at.join(up, "up", "left").select("id", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("id", F.col("up").alias("root"))
        at = now.select("id", "up")


def spelling_variants(docs, key="doc_id", text="text", least_length=LEAST_LENGTH, least_count=LEAST_COUNT, ratio=RATIO):
    """``word, form, root, n, n_near, form_n``: each word with the form it varies.

    Words are runs of Latin letters of whole texts, A-Z lower-cased, as
    ``count_words`` states, nulls, empty texts and repeated rows included. Near
    words differ by one inserted, deleted or replaced code point. The form is the
    near word of largest n (ties: smallest in code-point order) if that is at least
    ``ratio`` times the word's own, else null; the root is the end of the chain of
    forms, the word itself without a form. An empty table gives no rows.
    """
    counted = count_words(docs, key, text, least_length, least_count)
    # Ids follow the order of the words: ranges of words by partition, sorted inside.
    words = settle(counted.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()))
    found = settle(
        words.join(near_words(words), "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("best_n") >= ratio * F.col("n"), F.struct(F.col("best_id").alias("id"), F.col("best_n").alias("n"))).alias("form"),
        )
    )
    ends = roots(found.filter(F.col("form").isNotNull()).select("id", F.col("form.id").alias("up")))
    named = lambda name, word: words.select(F.col("id").alias(name), F.col("word").alias(word))
    return (
        found.select("id", "word", "n", "n_near", F.col("form.n").alias("form_n"), F.col("form.id").alias("_form"))
        .join(ends.select("id", F.col("root").alias("_root")), "id", "left")
        .join(named("_form", "form"), "_form", "left")
        .join(named("_root", "root"), "_root", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )
