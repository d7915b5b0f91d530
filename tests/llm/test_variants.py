import re
import zlib
from collections import Counter

import numpy as np

from quillspark.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    count = Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w], n_near[w] = (best if best and words[best] >= 2 * n else None), len(others)

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, n_near[w], words.get(form[w])) for w, n in words.items())


def found(spark, rows, schema="doc_id long, text string"):
    return sorted(tuple(r) for r in variants.spelling_variants(spark.createDataFrame(rows, schema)).collect())


def test_equals_plain(spark):
    rng = np.random.default_rng(1)
    stems = ["colour", "color", "Colours", "aaaaaa", "aaaaa", "éééééé", "ÉÉÉÉÉ", "banana", "bananas", "bannana", "cabana"]
    rows = []
    for i in range(300):
        words = []
        for w in rng.choice(stems, 8):
            at = int(rng.integers(0, len(w)))
            words.append([w, w, w, w[:at] + w[at + 1 :], w[:at] + "xyé"[i % 3] + w[at:], w[:at] + "zq"[i % 2] + w[at + 1 :]][int(rng.integers(0, 6))])
        rows.append((i, " ".join(words) + "., "[i % 3]))
    rows.append((900, "mother " * 400 + "mothar " * 120 + "motharx " * 40))
    want = plain(rows)
    assert len(want) > 50 and any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want)
    assert found(spark, rows) == want


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(1, None), (2, ""), (3, "12 . İ Ÿ"), (None, "words words words wordy wordy wordy"), (4, "sword sword sword Sword words$words word's")] * 2
    rows = [(*r, 1, "w", 2) for r in rows]
    assert found(spark, rows, "doc_id long, text string, id long, word string, n long") == plain(rows)


def test_words_of_any_length(spark):
    long = "ab" * 3000
    rows = [(i, t) for i, t in enumerate([long] * 9 + [long[:17] + long[18:]] * 4 + [long[:90] + "z" + long[91:]] * 4 + ["x" * 64] * 4 + ["x" * 65] * 9)]
    want = plain(rows)
    assert sum(r[1] is not None and len(r[0]) > variants.LONG for r in want) > 1
    assert found(spark, rows) == want


def test_very_long_text(spark):
    rows = [(1, "letter lettre letter " * 100_000), (2, "lettar")]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
