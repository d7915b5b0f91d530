import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, nearcopies, simhash


def family(seed, count, common, own):
    """Texts that share a passage and have words of their own: alike at common / (common + 2 own), about."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(common)]
    return [" ".join(passage + [word() for _ in range(own)]) for _ in range(count)]


def test_families_below_the_similarity_make_no_square_of_pairs(spark, monkeypatch):
    compared = []
    verified = nearcopies.verified
    monkeypatch.setattr(nearcopies, "verified", lambda pairs, texts: compared.append(pairs.count()) or verified(pairs, texts))
    totals = []
    for count in (100, 300):
        compared.clear()
        df = spark.createDataFrame(list(enumerate(family(count, count, 150, 45))), "doc_id long, text string")
        assert nearcopies.keep_one(df).count() == count
        totals.append(sum(compared))
    assert totals[1] <= 4 * totals[0] + 100


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(130)]
    texts = ["", "one two"]
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy[: 130 - i // 3]))
    data = [(i, i, t.encode()) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame([(i, r) for i, r, _ in data], "node long, root long")
    got = {(r["u"], r["v"]) for r in nearcopies.prefix_pairs(nodes, spark.createDataFrame([(i, t) for i, _, t in data], "node long, b binary")).collect()}
    sets = [nearcopies.shingles_of(t) for _, _, t in data]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and nearcopies.similarity(sets[i], sets[j]) >= 0.8}
    assert len(want) > 100 and want <= got and len(got) < 90 * 89 / 2


@pytest.mark.parametrize("count", [40, 150])
def test_pivot_tables_join_near_copies_without_bands(spark, monkeypatch, count):
    """Buckets of few and of many fingerprints; without a shared band only pairs within two bits are left."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = family(9, 20, 5, 100) + ["", " ", None]
    for _ in range(count):
        copy = list(base)
        copy[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    data = [t and t.encode() for t in texts]
    sets, fps = [nearcopies.shingles_of(t) for t in data], [simhash.fingerprint(t) for t in data]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2 and nearcopies.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    expected = sorted(set(root))
    assert len(set(fps)) > count / 2 and 20 < len(expected) < len(texts) - count / 2
    own = lambda shingles: xxhash.xxh64_intdigest(b"|".join(sorted(shingles))) // 2 + np.arange(20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "bands_of", own)
    assert sorted(r["doc_id"] for r in nearcopies.keep_one(df).collect()) == expected


NAMES = ["_key", "_hash", "k", "h1", "h2", "node", "first", "row", "n", "id", "spans", "_row", "_spans", "size", "h", "_rows"]


@pytest.mark.parametrize("keep", [nearcopies.keep_one, simhash.keep_one])
def test_tables_with_columns_of_any_names(spark, keep):
    texts = ["a b c d e f g", "a b c d e f g", "other words stand in this one here", None, "", "a b c d e f g"]
    rows = [(i, t, *range(len(NAMES))) for i, t in enumerate(texts)] + [(None, "only without a key", *range(len(NAMES)))]
    df = spark.createDataFrame(rows + rows[2:3], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES))
    left = keep(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, 0), (False, 2), (False, 3), (True, 0)]
    assert keep(df.filter("false")).count() == 0


def test_benchmark_stages_keep_columns_of_any_names(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([("b1", passage)], "item_id string, text string")
    rows = [(1, f"so {passage} it is"), (1, "clean"), (2, None), (2, ""), (None, passage), (None, "clean")]
    df = spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES))
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, "clean"), (2, None), (2, ""), (None, "clean")], key=str)
    cut = decontaminate.remove_spans(df, bench)
    assert cut.columns == df.columns and cut.count() == 6
    texts = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str)
    assert (1, "clean") in texts and (2, None) in texts and not any(passage in (t or "") for _, t in texts)
    assert cut.select(F.sum("_row")).first()[0] == 6 * NAMES.index("_row")
