"""Near-copies among embeddings: product quantisation over coarse inverted lists."""

import math

import numpy as np
from pyspark.sql import functions as F

from ..session import settle
from .common import lots
from .simhash import connected

COSINE = 0.9
CELLS = 4096  # coarse cells at most; about the root of the number of vectors
SAMPLE = 131_072  # vectors of one length the cells and codebooks are fitted on, about
WIDTH = 8  # components of a subspace
WORDS = 256  # entries of a codebook
ROUNDS = 8
SEED = 42
# Cells are probed unless a neighbour would have to lie this many standard deviations off.
PROBE = 4.0
BLOCK = 8192  # vectors whose codes one task holds
VISITORS = 32768  # vectors that are compared with one copy of a block
LOT = 512


def _fit(points, k, rng, spherical=False):
    """k-means centres of the points; an empty centre stays where it is."""
    centres = points[np.sort(rng.choice(len(points), k, replace=False))].copy()
    for _ in range(ROUNDS if k > 1 else 1):
        own = _nearest(points, centres)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        if spherical:
            length = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(length > 0, centres / np.maximum(length, 1e-30), centres)
    return centres


def _nearest(points, centres):
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(points[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(points), 4096)])


class Quantiser:
    """Unit coarse centres and a codebook of residuals for each subspace.

    Cells are numbered so that similar ones stand close together, for the blocks
    that are cut from the line of cells.
    """

    def __init__(self, units, count, cells=CELLS, cosine=COSINE, probe=PROBE, seed=SEED):
        rng = np.random.default_rng([seed, units.shape[1]])
        self.dim, self.cosine = units.shape[1], cosine
        centres = _fit(units, max(1, min(cells, math.isqrt(count), len(units) // 8)), rng, spherical=True)
        groups = _nearest(centres, _fit(centres, max(1, math.isqrt(len(centres))), rng))
        self.centres = centres[np.argsort(groups, kind="stable")]
        residuals = units - self.centres[_nearest(units, self.centres)]
        self.cuts = list(range(0, self.dim, WIDTH))
        words = min(WORDS, len(units))
        self.books = [_fit(residuals[:, a : a + WIDTH], words, rng) for a in self.cuts]
        self.reach = math.sqrt(max(0.0, 2 - 2 * cosine))
        # The centre of another cell may be nearer to a neighbour y of x only if y's part across x
        # reaches over the plane between the centres: never beyond ``reach``, and for a part of
        # random direction not beyond ``probe`` standard deviations.
        spread = probe * math.sqrt(1 - cosine * cosine) / math.sqrt(max(self.dim - 1, 1)) / max(cosine, 1e-9)
        self.slack = min(self.reach, spread)
        square = (self.centres**2).sum(1)
        self.apart = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * self.centres @ self.centres.T))

    def encode(self, units):
        """Cells, codes and the lengths of the errors that codes leave."""
        cell = _nearest(units, self.centres)
        left = units - self.centres[cell]
        codes = np.empty((len(units), len(self.cuts)), np.uint8)
        for m, a in enumerate(self.cuts):
            codes[:, m] = _nearest(left[:, a : a + WIDTH], self.books[m])
            left[:, a : a + WIDTH] -= self.books[m][codes[:, m]]
        return cell, codes, np.linalg.norm(left, axis=1)

    def probes(self, units, cell):
        """Which cells may hold neighbours of each vector, its own included."""
        products = units @ self.centres.T
        margin = products[np.arange(len(units)), cell][:, None] - products
        return margin <= self.slack * self.apart[cell] + 1e-6

    def distances(self, units, cell, codes):
        """Distances of vectors to the coded vectors of one cell, summed from lookup tables."""
        left, total = units - self.centres[cell], np.zeros((len(units), len(codes)), np.float32)
        for m, a in enumerate(self.cuts):
            part, book = left[:, a : a + WIDTH], self.books[m]
            table = (part**2).sum(1)[:, None] + (book**2).sum(1)[None, :] - 2 * part @ book.T
            total += table.astype(np.float32)[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def cosines(a, b):
    """Cosines of paired rows in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Block:
    """The coded vectors of one block; visitors come in lots and leave counts and edges."""

    def __init__(self, model, ids, weights, cells, codes, errors, vectors):
        order = np.argsort(cells, kind="stable")
        self.model, self.ids, self.weights = model, ids[order], weights[order]
        self.cells, self.codes, self.errors, self.vectors = cells[order], codes[order], errors[order], vectors[order]
        self.count, self.top = np.zeros(len(ids), np.int64), self.ids.copy()

    def meet(self, ids, weights, cells, vectors, at_home):
        """Linked rows of the visitors with the block: counts of visitors, and edges.

        A vector at home meets those of larger id only, so each pair counts once.
        All that is linked gets one edge to the smallest id it is linked with here,
        not one per pair.
        """
        units = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
        probed = self.model.probes(units, cells)
        pairs = [np.zeros((0, 2), np.int64)]
        starts = np.flatnonzero(np.r_[True, self.cells[1:] != self.cells[:-1]])
        for begin, end in zip(starts, np.r_[starts[1:], len(self.cells)]):
            some = np.flatnonzero(probed[:, self.cells[begin]])
            for b in range(begin, end, 4096):
                e = min(end, b + 4096)
                far = self.model.distances(units[some], self.cells[begin], self.codes[b:e]) - self.errors[None, b:e]
                x, y = np.nonzero(far <= self.model.reach + 1e-4)
                x, y = some[x], y + b
                right = (self.ids[y] > ids[x]) | ~at_home[x]
                x, y = x[right], y[right]
                for i in range(0, len(x), 1 << 15):
                    u, v = x[i : i + (1 << 15)], y[i : i + (1 << 15)]
                    near = cosines(vectors[u], self.vectors[v]) >= self.model.cosine
                    pairs.append(np.stack([u[near], v[near]], 1))
        x, y = np.concatenate(pairs).T
        np.add.at(self.count, y, weights[x])
        seen = np.bincount(x, self.weights[y], len(ids)).astype(np.int64)
        nodes, flat = np.unique(np.r_[ids[x], self.top[y]], return_inverse=True)
        a, b, label = flat[: len(x)], flat[len(x) :], np.arange(len(nodes))
        while True:
            low, before = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        linked = np.unique(y)
        self.top[linked] = nodes[label[np.searchsorted(nodes, self.top[linked])]]
        moved = label != np.arange(len(nodes))
        return seen, nodes[moved], nodes[label[moved]]


def _matrix(column, kind):
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _sound(v):
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _train(classes, cosine, cells, probe, kind):
    """A quantiser for each length of vector, and how many vectors have it."""
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    sample = classes.join(F.broadcast(classes.groupBy("dim").agg(F.count("*").alias("of"))), "dim")
    sample = sample.filter(F.pmod(F.xxhash64("c1", "c2", F.lit(SEED)), F.col("of")) < SAMPLE).select("dim", "c1", "c2", "v")
    kept = {}
    for r in sample.sort("dim", "c1", "c2").toLocalIterator():
        kept.setdefault(r["dim"], []).append(np.frombuffer(r["v"], kind).astype(np.float32))
    models = {}
    for dim, of in counts.items():
        points = np.array(kept.get(dim) or [np.eye(1, dim, dtype=np.float32)[0]])
        models[dim] = Quantiser((points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32), of, cells, cosine, probe)
    return models


def class_links(classes, cosine=COSINE, cells=CELLS, probe=PROBE, block=BLOCK, kind="<f8"):
    """``node, other, n`` of distinct vectors ``c, c1, c2, dim, m, v``.

    Rows without ``other`` add ``n`` to the links of a node; the others are edges
    that join all that is linked. Every vector is coded and has a place in one
    block of bounded size; it visits the blocks from its own on that hold a cell
    it probes. Blocks are cut from the line of cells, so a cell that holds a
    third of all vectors fills many blocks, and a block with many visitors is
    copied for shares of them.
    """
    spark = classes.sparkSession
    models = _train(classes, cosine, cells, probe, kind)
    if not models:
        return spark.createDataFrame([], "node long, other long, n long")

    def code(batches):
        import pyarrow as pa

        for lot in lots(batches, 2048):
            dims = np.array(lot.column(1).to_pylist(), np.int64)
            for dim in np.unique(dims):
                part = lot.filter(pa.array(dims == dim))
                vectors = _matrix(part.column(3), kind)
                cell, codes, error = models[int(dim)].encode((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32))
                packed = pa.array([x.tobytes() for x in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int64)), packed, pa.array(error.astype(np.float64))], ["c", "dim", "m", "v", "cell", "code", "error"])

    coded = settle(classes.select("c", "dim", "m", "v").mapInArrow(code, "c long, dim int, m long, v binary, cell long, code binary, error double"))
    # Where each cell begins in the line of cells, and from that the blocks it fills.
    size, line, at, count = {(r["dim"], r["cell"]): r["count"] for r in coded.groupBy("dim", "cell").count().collect()}, {}, 0, 0
    for dim in sorted(models):
        for cell in range(len(models[dim].centres)):
            n = size.get((dim, cell), 0)
            line[dim, cell] = (at, n)
            at += n
        at = -(-at // block) * block
        count = at // block
    span = {dim: np.array([(line[dim, c][0] // block, max(line[dim, c][0], sum(line[dim, c]) - 1) // block, line[dim, c][1]) for c in range(len(models[dim].centres))]) for dim in models}
    places = F.broadcast(spark.createDataFrame([(d, c, b, n) for (d, c), (b, n) in line.items() if n], "dim int, cell long, begin long, of long"))
    placed = coded.join(places, ["dim", "cell"]).withColumn("home", F.floor((F.col("begin") + F.pmod(F.xxhash64("c"), F.col("of"))) / block)).drop("begin", "of")

    def visit(batches):
        import pyarrow as pa

        for lot in lots(batches, 1024):
            dims, homes = (np.array(lot.column(i).to_pylist(), np.int64) for i in (1, 5))
            cell = np.array(lot.column(4).to_pylist(), np.int64)
            for dim in np.unique(dims):
                part = np.flatnonzero(dims == dim)
                vectors, reach = _matrix(lot.column(3).take(pa.array(part)), kind), span[int(dim)]
                probed = models[int(dim)].probes((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32), cell[part]) & (reach[:, 2] > 0)
                first, last = int(reach[:, 0].min()), int(reach[:, 1].max())
                # Blocks that hold a probed cell, from the places where cells begin and end.
                edges = np.zeros((len(part), last - first + 2), np.int32)
                np.add.at(edges.T, reach[:, 0] - first, probed.T.astype(np.int32))
                np.add.at(edges.T, reach[:, 1] - first + 1, -probed.T.astype(np.int32))
                who, where = np.nonzero(np.cumsum(edges, axis=1)[:, :-1] > 0)
                where = where + first
                keep = where >= homes[part][who]
                who, where = part[who[keep]], where[keep]
                rows = lot.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), rows.column(3), rows.column(4), rows.column(5), pa.array(where.astype(np.int64))], ["c", "dim", "m", "v", "cell", "home", "block"])

    visits = placed.select("c", "dim", "m", "v", "cell", "home").mapInArrow(visit, "c long, dim int, m long, v binary, cell long, home long, block long")
    narrow = settle(visits)
    load = narrow.groupBy("block").count().select("block", F.ceil(F.col("count") / VISITORS).alias("shares"))
    shares = F.broadcast(settle(load))  # a row per block
    guests = narrow.join(shares, "block").select("block", F.pmod(F.xxhash64("c"), F.col("shares")).alias("share"), F.lit(1).alias("guest"), "c", "dim", "m", "v", "cell", (F.col("home") == F.col("block")).alias("home"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"))
    hosts = placed.withColumnRenamed("home", "block").join(shares, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("guest"), "c", "dim", "m", "v", "cell", F.lit(True).alias("home"), "code", "error")

    def compare(batches):
        import pyarrow as pa

        schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])
        out = lambda node, other, n: pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), other if other is not None else pa.nulls(len(node), pa.int64()), pa.array(n, pa.int64())], schema=schema)
        key, held, here = None, [], None

        def start():
            rows = pa.Table.from_batches(held).combine_chunks()
            column = lambda i: np.array(rows.column(i).to_pylist())
            codes = np.frombuffer(b"".join(rows.column(9).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            return Block(models[rows.column(4)[0].as_py()], column(3), column(5), column(7), codes, column(10), np.frombuffer(b"".join(rows.column(6).to_pylist()), kind).reshape(rows.num_rows, -1).astype(np.float64))

        def finish():
            if here is not None:
                some = np.flatnonzero(here.count)
                yield out(here.ids[some], None, here.count[some])

        for lot in lots(batches, LOT):
            blocks, share, guest = (np.array(lot.column(i).to_pylist(), np.int64) for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (share[1:] != share[:-1]) | (guest[1:] != guest[:-1])])
            for begin, end in zip(cuts, np.r_[cuts[1:], lot.num_rows]):
                part, now = lot.slice(begin, end - begin), (blocks[begin], share[begin])
                if now != key:
                    yield from finish()
                    key, held, here = now, [], None
                if not guest[begin]:
                    held.append(part)
                    continue
                here = here or start()
                ids, weights, cells = (np.array(part.column(i).to_pylist(), np.int64) for i in (3, 5, 7))
                seen, low, high = here.meet(ids, weights, cells, _matrix(part.column(6), kind), np.array(part.column(8).to_pylist(), bool))
                some = np.flatnonzero(seen)
                yield out(ids[some], None, seen[some])
                yield out(low, pa.array(high, pa.int64()), np.zeros(len(low), np.int64))
        yield from finish()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = hosts.unionByName(guests).repartition(parts, "block", "share").sortWithinPartitions("block", "share", "guest")
    return dealt.mapInArrow(compare, "node long, other long, n long")


def near_vectors(vectors, key="vec_id", column="embedding", cosine=COSINE, cells=CELLS, probe=PROBE, block=BLOCK):
    """``id, n_links, component_id`` for every row.

    Rows link if the cosine of their vectors, in double precision, is at least
    ``cosine``. Null or zero vectors and vectors with null or non-finite components
    link with nothing; vectors of different lengths never do. Equal vectors are one
    class: its members link with each other and with all members of linked
    classes, and only classes are compared. ``component_id`` is the smallest key
    that links reach, the row's own included; a null key counts as larger than
    any. Repeated rows are copies. Other columns are not read; an empty table
    gives no rows.
    """
    kind = "<f4" if "float" in vectors.schema[column].dataType.simpleString() else "<f8"
    v = F.col(column)
    doubles = F.transform(v.cast("array<double>"), lambda x: x + F.lit(0.0))  # one zero, not two
    rows = settle(
        vectors.select(F.col(key).cast("long").alias("id"), F.when(_sound(v.cast("array<double>")), doubles).alias("v")).select(
            "id", F.xxhash64(F.lit(1), "v").alias("c1"), F.xxhash64(F.lit(2), "v").alias("c2"), "v"
        )
    )

    def pack(batches):
        import pyarrow as pa

        for lot in lots(batches, 2048):
            flat = [np.asarray(x, kind).tobytes() for x in lot.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*lot.columns[:5], pa.array([len(x) // np.dtype(kind).itemsize for x in flat], pa.int32()), pa.array(flat, pa.binary())], ["c", "c1", "c2", "m", "least", "dim", "v"])

    # A class is known by 128 bits of its vector, so rows move without their vectors.
    groups = rows.filter("v is not null").groupBy("c1", "c2").agg(F.count("*").alias("m"), F.min("id").alias("least"), F.any_value("v").alias("v"))
    classes = settle(groups.select(F.monotonically_increasing_id().alias("c"), "c1", "c2", "m", "least", "v").mapInArrow(pack, "c long, c1 long, c2 long, m long, least long, dim int, v binary"))
    met = settle(class_links(classes, cosine, cells, probe, block, kind))
    counts = met.filter("other is null").groupBy(F.col("node").alias("c")).agg(F.sum("n").alias("n"))
    joined = connected(met.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")).distinct())
    members = classes.select("c", "c1", "c2", "m", "least").join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    found = members.join(counts, "c", "left").join(least, "root").select("c1", "c2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    linked = rows.filter("v is not null").select("id", "c1", "c2").join(found, ["c1", "c2"]).select("id", "n_links", "component_id")
    alone = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)
