"""Shared beginnings of conversations: a trie in balanced parentheses, shard by shard."""

import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import settle
from .common import lots

GROUP = 20  # conversations that share the head of one of them
HEADS = 4  # a head has fewer turns than this
SHARD = 65_536  # paths of one shard at most
SPAN = 512  # parentheses of one block of the range min-max index
CHUNK = 1 << 16  # bytes of one piece of a list that is hashed
_EMPTY = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def running(rows, key, order, *finer, **columns):
    """Running values of each key's rows in ``order``, then ``finer``, the row itself included.

    ``columns`` name ``(column, "sum" or "xor")``. The rows are cut into ranges of
    (key, order), so a key with any share of all rows fills many partitions; inside
    each, a window runs over its part of the key, and the parts before it are added
    from one row per key and partition.
    """
    fold = {"sum": F.sum, "xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "xor": lambda a, b: a.bitwiseXOR(b)}
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order, *finer)
    kept = settle(dealt.withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}))
    inside = Window.partitionBy(key, "_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy(key, "_part").agg(*[fold[how](c).alias(n) for n, (c, how) in columns.items()])
    carried = totals.select(key, "_part", *[F.coalesce(fold[how](n).over(before), F.lit(0).cast("long")).alias(f"_{n}") for n, (c, how) in columns.items()])
    local = kept.withColumns({n: fold[how](c).over(inside) for n, (c, how) in columns.items()})
    return local.join(carried, [key, "_part"]).withColumns({n: join[how](F.col(n), F.col(f"_{n}")) for n, (c, how) in columns.items()}).drop("_part", "_seq", *[f"_{n}" for n in columns])


def rebuilt_turns(turns, conv="conv_id", turn="turn", role="role", text="text"):
    """``(turns, conversations)`` after rebuilding: ``c, d, h1, h2, words`` and ``c, size``.

    A conversation c gets the first h turns of c - c % 20 and its own after the
    first h, with h = crc32(c) % 4. Turns are ordered by ``turn``, null first, then
    role and text; null roles and texts are empty; rows without a conversation are
    left out. ``h1`` and ``h2`` are 128 bits of role and text.
    """
    said = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    digested = said.select(
        "c", "t", "role", "text", F.substring("text", 1, 64).alias("start"), F.lit(1).cast("long").alias("one"), F.xxhash64(F.lit(1), "role", "text").alias("h1"),
        F.xxhash64(F.lit(2), "role", "text").alias("h2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    # Bounds of ranges are drawn from the beginnings of texts, which are short.
    order = [F.col("t").asc_nulls_first(), F.col("role"), F.col("start")]
    placed = settle(running(digested, "c", order, F.col("text"), place=("one", "sum")).select("c", (F.col("place") - 1).alias("p"), "h1", "h2", "words"))
    head = (F.crc32(F.col("c").cast("string")) % HEADS).alias("h")
    sizes = placed.groupBy("c").agg(F.count("*").alias("n")).select("c", "n", head, (F.col("c") - F.col("c") % GROUP).alias("base"))
    lengths = sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    plan = settle(sizes.join(lengths, "base", "left").select("c", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    heads = placed.filter((F.col("p") < HEADS - 1) & (F.col("c") % GROUP == 0)).withColumnRenamed("c", "base")
    lent = plan.join(heads, "base").filter(F.col("p") < F.col("h")).select("c", (F.col("p") + 1).alias("d"), "h1", "h2", "words")
    own = placed.join(plan.select("c", "h", "taken"), "c").filter(F.col("p") >= F.col("h")).select("c", (F.col("p") - F.col("h") + F.col("taken") + 1).alias("d"), "h1", "h2", "words")
    return lent.unionByName(own), plan.select("c", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))


def paths_and_chains(rows, conversations):
    """Nodes, their chains, and the path of every conversation.

    A prefix is known by 128 bits: its turns' digests with their depths, joined by
    exclusive or, so they are found by running over ranges. Nodes with the same
    members stand one below the other; such a chain is known by its smallest
    member and the number of members and stands in the trie as one. So the tail
    of a conversation that nothing shares, of any length, is a single entry, and
    a path has one entry per place where members part.
    """
    marked = rows.withColumns({"x1": F.xxhash64("d", "h1", "h2"), "x2": F.xxhash64("h2", "d", "h1")}).drop("h1", "h2")
    kept = settle(running(marked, "c", ["d"], k1=("x1", "xor"), k2=("x2", "xor"), total=("words", "sum")).select("c", "d", "k1", "k2", "words", "total"))
    nodes = settle(
        kept.groupBy("k1", "k2", "d").agg(F.min("c").alias("conv"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("total").alias("total"))
    )
    # ``low`` is the depth of the deepest node of a chain, ``above`` the words above its top.
    chains = settle(
        nodes.groupBy("conv", "n").agg(F.max("d").alias("low"), F.min("d").alias("high"), F.min(F.col("total") - F.col("words")).alias("above"), F.sum("words").alias("own"), F.max_by(F.struct("k1", "k2"), "d").alias("k"))
        .select("conv", "n", "low", "high", "above", "own", F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2"))
    )
    entry = F.struct(F.col("conv"), F.col("low"), F.col("n"), ((F.col("n") - 1) * F.col("own")).alias("saved"))
    steps = kept.select("c", "d", "k1", "k2").join(chains.withColumn("entry", entry).select(F.col("low").alias("d"), "k1", "k2", "entry"), ["k1", "k2", "d"])
    found = steps.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("d", "entry"))).alias("steps"))
    least, count = conversations.agg(F.min("c"), F.count("*")).first()
    root = F.struct(F.lit(least).cast("long").alias("conv"), F.lit(0).cast("long").alias("low"), F.lit(count).cast("long").alias("n"), F.lit(0).cast("long").alias("saved"))
    below = F.coalesce(F.transform("steps", lambda s: s["entry"]), F.array().cast("array<struct<conv:bigint,low:bigint,n:bigint,saved:bigint>>"))
    paths = conversations.join(found, "c", "left").select("c", F.concat(F.array(root), below).alias("path"))
    return nodes, chains, settle(paths)


class Parentheses:
    """A trie in preorder as balanced parentheses, with blocks of least and largest excess."""

    def __init__(self, bits):
        self.bits = np.asarray(bits, np.int8)
        self.excess = np.cumsum(self.bits * 2 - 1)
        pad = -len(self.bits) % SPAN
        blocks = np.pad(self.excess, (0, pad), mode="edge").reshape(-1, SPAN)
        self.low, self.high = blocks.min(1), blocks.max(1)
        opens = self.bits == 1
        self.opens = np.flatnonzero(opens)
        self.rank = np.cumsum(opens)  # opening parentheses up to and with each place
        pairs = np.r_[opens[:-1] & ~opens[1:], False]
        self.pairs = np.cumsum(pairs)  # leaf pairs "()" that begin up to each place

    def findclose(self, at):
        """The closing parentheses of the opening ones at ``at``.

        The first place after i whose excess is one less than at i: looked for in
        the block of i, then by the blocks' least excess, then in one block.
        """
        target = self.excess[at] - 1
        close = np.full(len(at), -1, np.int64)
        block = at // SPAN
        for b in np.unique(block):
            some = np.flatnonzero(block == b)
            self._inside(b, some, at, target, close)
        left = np.flatnonzero(close < 0)
        # By target: the next block after one's own whose least excess reaches it.
        for t in np.unique(target[left]):
            some = left[target[left] == t]
            reaching = np.flatnonzero((self.low <= t) & (self.high >= t))
            ahead = reaching[np.searchsorted(reaching, block[some], side="right")]
            for b in np.unique(ahead):
                line = self.excess[b * SPAN : (b + 1) * SPAN]
                close[some[ahead == b]] = b * SPAN + int(np.argmax(line == t))
        return close

    def _inside(self, b, some, at, target, close):
        line = self.excess[b * SPAN : (b + 1) * SPAN]
        order = np.argsort(line, kind="stable")  # by excess, then place
        ranked = line[order]
        width = len(line) + 1
        places = (ranked - ranked.min(initial=0)) * width + order
        wanted = (target[some] - ranked.min(initial=0)) * width + (at[some] - b * SPAN)
        hit = np.searchsorted(places, wanted)
        ok = hit < len(places)
        ok[ok] = ranked[hit[ok]] == target[some][ok]
        close[some[ok]] = b * SPAN + order[hit[ok]]


def shard_rows(paths):
    """Nodes of one shard of sorted paths: what it knows of every subtree.

    ``paths`` are lists of (conv, low, n, saved). Returns a list per node of
    (path up to it if it lies on the first or the last path, entry, parent, ends,
    leaves, saved); nodes on these two paths may go on in other shards, so their
    own leaf and saving are left out of all sums and added after shards are merged.
    """
    bits, entries, depth, parent, ends = [], [], [], [], []
    stack = []
    for path in paths:
        same = 0
        for a, b in zip(stack, path):
            if entries[a][:2] != b[:2]:
                break
            same += 1
        bits.extend([0] * (len(stack) - same))
        del stack[same:]
        for e in path[same:]:
            parent.append(stack[-1] if stack else -1)
            depth.append(len(stack))
            stack.append(len(entries))
            entries.append(e)
            ends.append(0)
            bits.append(1)
        ends[stack[-1]] += 1
    bits.extend([0] * len(stack))
    tree = Parentheses(bits)
    close = tree.findclose(tree.opens)
    last = list(stack)
    spine = np.zeros(len(entries), bool)
    spine[: len(paths[0])] = True  # the first path opens the first parentheses
    spine[last] = True
    saved = np.cumsum(np.r_[0, np.where(spine, 0, [e[3] for e in entries])])
    begin, end = tree.rank[tree.opens] - 1, tree.rank[close]  # preorder numbers of a subtree
    total = saved[end] - saved[begin]
    leaves = tree.pairs[close] - np.r_[0, tree.pairs][tree.opens]
    single = np.flatnonzero(spine & (close == tree.opens + 1))  # leaf pairs that may have children elsewhere
    leaves = leaves - (np.searchsorted(single, end) - np.searchsorted(single, begin))
    out = []
    for i, e in enumerate(entries):
        up = None if parent[i] < 0 else entries[parent[i]][:2]
        way = None
        if spine[i]:
            way, j = [], i
            while j >= 0:
                way.append(entries[j][:2])
                j = parent[j]
            way.reverse()
        out.append((way, e, up, ends[i], int(leaves[i]), int(total[i])))
    return out


def subtree_sums(paths, size=SHARD):
    """``conv, low, n, up_conv, up_low, n_leaves, saved`` of every entry of the paths.

    Paths are sorted in ranges; every range is cut into shards. Nodes inside a
    shard are done there. Those on a border, a path or two per shard, are added up
    over the shards, then each distinct one gives its own leaf and saving to
    itself and all above it.
    """
    names = ["way", "conv", "low", "n", "own", "up_conv", "up_low", "ends", "leaves", "saved"]
    schema = "way array<struct<conv:bigint,low:bigint>>, conv long, low long, n long, own long, up_conv long, up_low long, ends long, leaves long, saved long"

    def encode(batches):
        import pyarrow as pa

        pair = pa.struct([("conv", pa.int64()), ("low", pa.int64())])
        kinds = [pa.list_(pair), *[pa.int64()] * 9]

        def shard(rows):
            done = shard_rows(rows)
            for begin in range(0, len(done), 1 << 14):
                part = done[begin : begin + (1 << 14)]
                columns = [
                    [None if w is None else [{"conv": c, "low": d} for c, d in w] for w, *_ in part], *([e[i] for _, e, *_ in part] for i in range(4)),
                    [u and u[0] for _, _, u, *_ in part], [u and u[1] for _, _, u, *_ in part], *([x[i] for x in part] for i in (3, 4, 5)),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        held = []
        for lot in lots(batches, 4096):
            for path in lot.column(0).to_pylist():
                held.append([(e["conv"], e["low"], e["n"], e["saved"]) for e in path])
                if len(held) >= size:
                    yield from shard(held)
                    held = []
        if held:
            yield from shard(held)

    done = settle(paths.select("path").repartitionByRange("path").sortWithinPartitions("path").mapInArrow(encode, schema))
    inner = done.filter("way is null").select("conv", "low", "n", "up_conv", "up_low", F.col("leaves").alias("n_leaves"), "saved")
    border = settle(
        done.filter("way is not null").groupBy("conv", "low").agg(
            F.any_value("way").alias("way"), F.any_value("n").alias("n"), F.any_value("own").alias("own"), F.any_value("up_conv").alias("up_conv"),
            F.any_value("up_low").alias("up_low"), F.sum("ends").alias("ends"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        )
    )
    given = border.select(F.explode("way").alias("to"), "own", (F.col("ends") == F.col("n")).cast("long").alias("leaf"))
    added = given.groupBy(F.col("to.conv").alias("conv"), F.col("to.low").alias("low")).agg(F.sum("own").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    merged = border.join(added, ["conv", "low"]).select("conv", "low", "n", "up_conv", "up_low", (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"))
    return settle(inner.unionByName(merged))


def digests_of_ends(ends, chunk=CHUNK):
    """``conv, low, ends_sha256``: digests of the comma-joined ascending ids ``c`` of each node.

    Ids are sorted in ranges, so a node with any share of all ids fills many
    partitions, and are written as pieces of text of bounded size. A node that one
    piece holds is done. The pieces of the others are put through one digest in
    order, each let go before the next is read; more than that a digest of a
    sequence does not allow.
    """

    def write(batches):
        import pyarrow as pa

        names, kinds = ["conv", "low", "part", "k", "alone", "piece"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        part = _partition()
        rows, node, held, size, k, begun = [], None, [], 0, 0, None

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)
            rows.clear()
            return batch

        for lot in lots(batches, 4096):
            for conv, low, c in zip(*(x.to_pylist() for x in lot.columns)):
                if node != (conv, low):
                    if node is not None:
                        # The first node of a partition may have begun in the one before.
                        rows.append((*node, part, k, begun != node and k == 0, b",".join(held)))
                    begun = begun or (conv, low)
                    node, held, size, k = (conv, low), [], 0, 0
                elif size >= chunk:
                    rows.append((*node, part, k, False, b",".join(held)))
                    held, size, k = [], 0, k + 1
                held.append(b"%d" % c)
                size += len(held[-1]) + 1
            if len(rows) >= 4096 or sum(len(r[-1]) for r in rows[-64:]) > 16 * chunk:
                yield out()
        if node is not None:
            rows.append((*node, part, k, False, b",".join(held)))
        yield out()

    def digest(batches):
        import pyarrow as pa

        node, whole, done = None, None, []
        for lot in lots(batches, 64):
            for conv, low, piece in zip(*(x.to_pylist() for x in lot.columns)):
                if node != (conv, low):
                    if node is not None:
                        done.append((*node, whole.hexdigest()))
                    node, whole = (conv, low), hashlib.sha256(piece)
                else:
                    whole.update(b",")
                    whole.update(piece)
        if node is not None:
            done.append((*node, whole.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 3, [pa.int64(), pa.int64(), pa.string()])], ["conv", "low", "ends_sha256"])

    ranged = ends.select("conv", "low", "c").repartitionByRange("conv", "low", "c").sortWithinPartitions("conv", "low", "c")
    pieces = settle(ranged.mapInArrow(write, "conv long, low long, part int, k long, alone boolean, piece binary"))
    alone = pieces.filter("alone").select("conv", "low", F.sha2("piece", 256).alias("ends_sha256"))
    parted = pieces.filter("not alone").repartition("conv", "low").sortWithinPartitions("conv", "low", "part", "k").select("conv", "low", "piece")
    return alone.unionByName(parted.mapInArrow(digest, "conv long, low long, ends_sha256 string"))


def _partition():
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def prefix_trie(turns, conv="conv_id", turn="turn", role="role", text="text", shard=SHARD, chunk=CHUNK):
    """One row per node of the trie of rebuilt conversations, the textless root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    Conversations are rebuilt as ``rebuilt_turns`` states. Turns of null order come
    first, ties follow role and text, repeated rows are turns of their own, null
    roles and texts are empty, rows without a conversation are left out, other
    columns are not read. A conversation without turns is a member of the root
    alone. An empty table gives no rows.
    """
    rows, conversations = rebuilt_turns(turns, conv, turn, role, text)
    nodes, chains, paths = paths_and_chains(rows, conversations)
    sums = subtree_sums(paths, shard)
    kids = sums.filter("up_conv is not null").groupBy(F.col("up_conv").alias("conv"), F.col("up_low").alias("low")).agg(F.count("*").alias("kids"))
    last = F.element_at("path", -1)
    ends = digests_of_ends(paths.select(last["conv"].alias("conv"), last["low"].alias("low"), "c"), chunk)
    known = settle(sums.join(kids, ["conv", "low"], "left").join(ends, ["conv", "low"], "left"))
    each = nodes.join(chains.select("conv", "n", "low", "high", "above"), ["conv", "n"]).join(known.drop("n"), ["conv", "low"])
    deepest = F.col("d") == F.col("low")
    below_top = (F.col("n") - 1) * (F.col("total") - F.col("words") - F.col("above"))
    found = each.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("high"), F.col("up_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(deepest, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - below_top).alias("saved_tokens"), F.when(deepest, F.col("ends_sha256")).alias("ends_sha256"),
    )
    root = known.filter("low = 0").select(
        F.col("conv").alias("conv_id"), F.col("low").alias("depth"), F.col("up_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("kids", F.lit(0)).cast("long").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256",
    )
    return found.unionByName(root).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
