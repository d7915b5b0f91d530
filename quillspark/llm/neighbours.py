"""Nearest neighbours by inner product over randomly rotated one-bit codes."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import settle
from .common import lots

K = 20
BLOCK = 16384  # candidates of one cell
QUERY_BLOCK = 1024  # queries of one cell
SEED = 42
SLACK = 1e-11  # of the product of two norms
ERROR = 3.0  # error bounds of an estimate, in standard deviations


def rotation(dim, seed=SEED):
    """A random orthogonal matrix that follows from the dimension alone."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors):
    """Packed signs of the rotated directions, norms and correction scalars."""
    dim = vectors.shape[1]
    norm = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norm[:, None]) @ rotation(dim).T
    return np.packbits(turned > 0, axis=1, bitorder="little"), norm, np.abs(turned).sum(1) / np.sqrt(dim)


def exact(vectors, query):
    """Inner products in double precision, added up in the order of the components."""
    total = np.zeros(len(vectors))
    for column, q in zip(vectors.T, query):
        total += column * q
    return total


def search_block(queries, query_rows, rows, ids, codes, norm, correction, vectors, k=K):
    """For each query the ``k`` nearest of a block: (positions, scores), nearest first.

    The estimate of an inner product needs the packed bits and two scalars only.
    The ``4 k`` best by estimate are measured; the k-th of them is a floor, and
    all whose upper bound reaches it are measured too. Products in any order of
    addition, which are quick, tell those that may be among the ``k``; their
    scores are then added up in the order of the components. ``SLACK`` is far
    more than both can differ by.
    """
    dim, lot = queries.shape[1], 128
    signs = np.unpackbits(codes, axis=1, bitorder="little")[:, :dim].astype(np.float32) * 2 - 1
    error = np.sqrt(np.maximum(1 - correction**2, 0)) / correction * ERROR / np.sqrt(max(dim - 1, 1)) * norm
    scale, turn, largest = norm / correction / np.sqrt(dim), rotation(dim), norm.max(initial=0.0)
    scale, error = scale.astype(np.float32), error.astype(np.float32)
    for begin in range(0, len(queries), lot):
        some = queries[begin : begin + lot]
        estimates = ((some @ turn.T).astype(np.float32) @ signs.T) * scale
        for query, row, estimate in zip(some, query_rows[begin : begin + lot], estimates):
            own = np.flatnonzero(rows == row)
            estimate[own] = -np.inf
            length = float(np.linalg.norm(query))
            slack = SLACK * length * largest
            if len(ids) - len(own) > 4 * k:
                first = np.argpartition(estimate, len(estimate) - 4 * k)[-4 * k :]
                floor = np.partition(vectors[first] @ query, 3 * k)[3 * k] - slack
                reach = estimate + error * np.float32(length) >= floor
                reach[first] = True
            else:
                reach = np.ones(len(ids), bool)
            reach[own] = False
            chosen = np.flatnonzero(reach)
            if len(chosen) > k:
                quick = vectors[chosen] @ query
                chosen = chosen[quick >= np.partition(quick, len(quick) - k)[len(quick) - k] - slack]
            scores = exact(vectors[chosen], query)
            order = np.lexsort((ids[chosen], -scores))[:k]
            yield chosen[order], scores[order]


def nearest(vectors, is_query, key="vec_id", column="embedding", k=K, block=BLOCK, query_block=QUERY_BLOCK):
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each query row.

    ``is_query`` is a condition on the table's columns. Nearness is the inner
    product, ties go to the smaller key. Null keys, null or zero vectors and
    vectors with null or non-finite components take no part; a vector meets those
    of its own length only. A query's own row is no candidate, other rows of its key
    are; a repeated query row gets a list of its own; repeated candidates are
    listed as often. Every pair of a query block and a candidate block is one cell of
    bounded size, so equal vectors are spread like any others.
    """
    v = F.col(column).cast("array<double>")
    sound = F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = settle(vectors.filter(sound).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row")))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, query_blocks = max(1, -(-counts["n"] // block)), max(1, -(-counts["q"] // query_block))

    def code(batches):
        import pyarrow as pa

        for lot in lots(batches, 4096):
            lists = lot.column(1).to_pylist()
            packed, norm, fit = [None] * len(lists), np.zeros(len(lists)), np.zeros(len(lists))
            for dim in {len(x) for x in lists}:
                at = [i for i, x in enumerate(lists) if len(x) == dim]
                bits, norm[at], fit[at] = encode(np.array([lists[i] for i in at]))
                for i, b in zip(at, bits):
                    packed[i] = b.tobytes()
            flat = [np.array(x, "<f8").tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([lot.column(0), lot.column(2), pa.array(list(map(len, lists)), pa.int32()), pa.array(packed, pa.binary()), pa.array(norm), pa.array(fit), pa.array(flat, pa.binary())], ["id", "row", "dim", "code", "norm", "fit", "v"])

    coded = rows.select("id", "v", "row").mapInArrow(code, "id long, row long, dim int, code binary, norm double, fit double, v binary")
    spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = coded.withColumn("cb", spread(blocks)).withColumn("qb", every(query_blocks))
    queries = rows.filter("q").select("id", "row", F.size("v").alias("dim"), "v").withColumn("qb", spread(query_blocks)).withColumn("cb", every(blocks))

    def cell(qs, cs):
        import pandas as pd

        ends, at, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        ids = cs["id"].to_numpy(np.int64)
        if len(qs) and len(cs):
            dim = int(cs["dim"].iloc[0])
            codes = np.frombuffer(b"".join(cs["code"]), np.uint8).reshape(len(cs), -1)
            matrix = np.frombuffer(b"".join(cs["v"]), "<f8").reshape(-1, dim)
            queries = np.array([np.asarray(x, float) for x in qs["v"]])
            for near, score in search_block(queries, qs["row"].to_numpy(np.int64), cs["row"].to_numpy(np.int64), ids, codes, cs["norm"].to_numpy(), cs["fit"].to_numpy(), matrix, k):
                ends.append(len(near))
                at.append(near)
                scores.append(score)
        asked = qs.iloc[np.repeat(np.arange(len(ends)), np.array(ends, np.int64))]
        return pd.DataFrame({"query_id": asked["id"].to_numpy(np.int64), "row": asked["row"].to_numpy(np.int64), "vec_id": ids[np.concatenate(at)], "score": np.concatenate(scores)})

    cells = queries.groupBy("dim", "qb", "cb").cogroup(candidates.groupBy("dim", "qb", "cb"))
    found = cells.applyInPandas(cell, "query_id long, row long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
