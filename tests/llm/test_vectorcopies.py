import numpy as np

from quillspark.llm import vectorcopies


def plain(rows, cosine=0.9):
    sound = [i for i, (_, v, *_) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, label = [0] * len(rows), list(range(len(rows)))
    pairs = []
    for i in sound:
        for j in sound:
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine - 1e-12:
                links[i] += 1
                pairs.append((i, j))
    before = None
    while before != label:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    least = {}
    for i, l in enumerate(label):
        if rows[i][0] is not None:
            least[l] = min(least.get(l, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], links[i], least.get(label[i])) for i in range(len(rows))), key=repr)


def found(spark, rows, schema="vec_id long, embedding array<float>", **options):
    df = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in vectorcopies.near_vectors(df, **options).select("id", "n_links", "component_id").collect()), key=repr)


def family(rng, dim, centres, copies, noise):
    out = []
    for _ in range(centres):
        base = rng.standard_normal(dim)
        out += [base + noise * rng.standard_normal(dim) for _ in range(copies)]
    return out


def test_equals_plain_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    vectors = family(rng, 24, 12, 25, 0.25) + family(rng, 24, 150, 1, 0)
    rows = [(int(i), [float(np.float32(x)) for x in vectors[i]]) for i in rng.permutation(len(vectors))]
    want = plain(rows)
    assert sum(r[1] for r in want) > 1000
    assert found(spark, rows, block=40) == want
    assert found(spark, rows) == want


def test_copies_make_no_pairs_and_all_links(spark):
    rng = np.random.default_rng(2)
    base = [float(np.float32(x)) for x in rng.standard_normal(16)]
    near = [float(np.float32(x)) for x in np.array(base) + 0.05 * rng.standard_normal(16)]
    rows = [(i, base) for i in range(3000, 0, -1)] + [(5000, near), (5001, near)]
    got = found(spark, rows)
    assert got == sorted(((i, 3001, 1) for i, _ in rows), key=repr)


def test_broken_vectors_lengths_repeats_and_other_columns(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 0.0], [2.0, 0.1], [0.0, 0.0], None, [], [nan, 1.0], [1.0, None], [inf, 1.0], [1.0], [-1.0], [3.0], [1.0, 0.0, 0.0], [-0.0, 1.0], [0.0, 1.0]]
    rows = [(i, v, i, "x") for i, v in enumerate(vectors)] + [(0, [1.0, 0.0], 7, "y"), (None, [1.0, 0.0], 8, "z"), (None, None, 9, "z")]
    assert found(spark, rows, "vec_id long, embedding array<double>, c long, c1 string") == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_codes_bound_distances():
    rng = np.random.default_rng(3)
    units = rng.standard_normal((400, 20)).astype(np.float32)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    model = vectorcopies.Quantiser(units, 400)
    cell, codes, error = model.encode(units)
    for c in np.unique(cell):
        own = np.flatnonzero(cell == c)
        far = model.distances(units[:50], int(c), codes[own])
        true = np.sqrt(((units[:50, None] - units[None, own]) ** 2).sum(2))
        assert (far - error[own] <= true + 1e-4).all() and (true <= far + error[own] + 1e-4).all()
