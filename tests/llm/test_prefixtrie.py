import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(x[2:] for x in sorted(own.get(c - c % 20, []))[:h] + sorted(own[c])[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += kids[p] == 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    out = [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items()]
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r[n] for n in NAMES) for r in prefixtrie.prefix_trie(df, **options).collect()), key=lambda r: r[:2])


def chats(seed, count, alphabet=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(count):
        for t in range(rng.integers(1, 9)):
            rows.append((c, t, ("user", "assistant")[t % 2], " ".join(["a"] * int(rng.integers(0, alphabet)))))
    return rows


@pytest.mark.parametrize("shard", [1, 7, 1000])
def test_equals_plain_in_any_shards(spark, shard):
    rows = chats(shard, 90)
    assert found(spark, rows, shard=shard, chunk=3) == plain(rows)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [
        (0, None, None, None), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (None, 0, "user", "lost"),
        (20, 0, "user", "x"), (21, 5, "user", "x"), (41, 0, "user", ""), (3, 0, "", ""), (7, 0, "r" * 200, "word " * 50_000),
    ]
    rows = [(*r, 1, "k", 2) for r in rows]
    assert found(spark, rows, SCHEMA + ", c long, k1 string, conv int") == plain(rows)


def test_one_conversation_of_many_turns_and_its_copies(spark):
    long = [(c, t, "user", f"turn {t % 5}") for c in (100, 101, 160) for t in range(700)]
    rows = long + chats(3, 40)
    assert found(spark, rows) == plain(rows)


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", "hi there") for c in range(0, 900) for t in range(3)] + chats(4, 30)
    assert found(spark, rows, shard=50, chunk=40) == plain(rows)


def test_turnless_conversation_is_at_the_root_alone(spark):
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "user", "only")]
    assert found(spark, rows) == plain(rows)
    assert [r[1] for r in found(spark, rows)] == [0]


def test_empty_table(spark):
    assert found(spark, []) == []


def test_findclose_over_blocks():
    rng = np.random.default_rng(5)
    bits, depth = [], 0
    while len(bits) < 5000 or depth:
        up = (rng.random() < 0.6 or not depth) and len(bits) < 5000
        bits.append(int(up))
        depth += 1 if up else -1
    tree = prefixtrie.Parentheses(bits)
    stack, close = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    assert tree.findclose(tree.opens).tolist() == [close[i] for i in tree.opens]
