"""The trie of conversations that begin alike, by a splitter skeleton.

Paths (digests of turns, end to end) are dealt to shards by splitter paths drawn from the paths
themselves. A node's members stand together in path order, so a node that two shards hold is a
prefix of a splitter between them: the splitters' own trie, the skeleton, is all that shards
share. It is broadcast; every shard sorts its paths, finishes all other nodes in one pass over a
stack, and gives partial counts for skeleton nodes, which a reduction adds up.

A path row holds at most ``TURNS_PER_ROW`` turns. Longer conversations go on in layers: each layer
is a forest of tries below the nodes where the layer before it ends, and hands its totals up to
them. What only one conversation reaches needs no trie and is laid out row by row, so the layers
that are worked through are those that two conversations share.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ehrseq.llm.common import ROWS_AT_ONCE, stage
from ehrseq.operators.numbering import number_rows

# Bounds a path row; orders work only.
TURNS_PER_ROW = 256
# Paths a shard is meant to hold, the most shards, and paths drawn for each splitter; order work only.
PATHS_PER_SHARD, MOST_SHARDS, DRAWN_PER_SPLITTER = 20_000, 2_048, 8
# Bound of the drawn paths, which are what the driver and the broadcast hold.
DRAWN_BYTES = 1 << 25
# Turns numbered in one window at a time, and member ids in one piece of a list; order work only.
TURNS_PER_BLOCK, IDS_PER_PIECE = 1 << 16, 4_096
# Output rows of a shard handed on at a time; bounds memory only.
NODES_AT_ONCE = 20_000
DIGEST = 16
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, trie string, shared bigint, shared_parent bigint, bytes bigint"
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, bytes) of every turn: by turn (null first), then role, then text.

    Equal rows are turns each. Rows without a conversation are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    given = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")
    )
    block = F.coalesce(F.floor(F.col("turn") / TURNS_PER_BLOCK), F.lit(-(1 << 62)))
    placed = number_rows(given.withColumn("_block", block), "place", ["conv_id"], "_block", [F.asc_nulls_first("turn"), "role", "text"])
    return placed.select(
        "conv_id", "place", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).alias("digest"), F.octet_length("text").cast("bigint").alias("bytes")
    )


def rebuilt_turns(turns: DataFrame, lengths: DataFrame, donor: Column, most: Column, at_most: int) -> DataFrame:
    """(conv_id, place, digest, bytes) after each conversation's first turns became its donor's.

    ``donor`` and ``most`` are expressions of ``conv_id``: whose first turns it gets, and how many
    (never more than ``at_most``); it loses as many of its own.
    """
    plan = lengths.select("conv_id", donor.alias("donor"), most.cast("bigint").alias("most"))
    sizes = lengths.select(F.col("conv_id").alias("donor"), F.col("n").alias("held"))
    taken = F.least("most", F.coalesce("held", F.lit(0)))
    plan = plan.join(sizes, "donor", "left").select("conv_id", "donor", "most", taken.alias("taken"))
    heads = turns.where(F.col("place") <= at_most).withColumnRenamed("conv_id", "donor")
    head = plan.join(heads, "donor").where("place <= most").select("conv_id", "place", "digest", "bytes")
    moved = F.col("place") - F.col("most") + F.col("taken")
    rest = turns.join(plan, "conv_id").where("place > most").select("conv_id", moved.alias("place"), "digest", "bytes")
    return head.unionByName(rest)


def _chunks(turns: DataFrame, lengths: DataFrame, per_row: int) -> DataFrame:
    """A row per conversation and layer: its path there, and the tries it stands in and goes on in.

    The trie of a layer is named by a hash of all turns before it; of layer 0 by nothing.
    """
    layer = F.floor((F.col("place") - 1) / per_row)
    parts = F.array_sort(F.collect_list(F.struct("place", "digest", "bytes")))
    rows = turns.groupBy("conv_id", layer.alias("layer")).agg(parts.alias("parts"))
    # Conversations without turns end at the root.
    rows = rows.join(lengths.select("conv_id"), "conv_id", "right").withColumn("layer", F.coalesce("layer", F.lit(0)))
    path = F.unhex(F.array_join(F.coalesce(F.col("parts.digest"), F.array().cast("array<string>")), ""))
    rows = rows.select("conv_id", "layer", path.alias("path"), F.coalesce("parts.bytes", F.array().cast("array<bigint>")).alias("sizes"))
    digest = F.md5(F.concat(F.encode(F.col("layer").cast("string"), "UTF-8"), F.encode(F.lit(":"), "UTF-8"), "path"))
    before = Window.partitionBy("conv_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 17)]
    mixed = [F.coalesce(F.bit_xor(half).over(before), F.lit(0)) for half in halves]
    named = F.when(F.col("layer") == 0, F.lit("")).otherwise(F.md5(F.concat_ws(":", "layer", *mixed)))
    rows = rows.withColumn("trie", named)
    return rows.withColumn("next_trie", F.lead("trie").over(Window.partitionBy("conv_id").orderBy("layer")))


def _ends(paths: DataFrame, members: DataFrame) -> DataFrame:
    """(leaf, ends) of paths where several conversations end: SHA-256 of their ids, ascending.

    The ids of a path are sorted over as many tasks as they need and joined into pieces; the
    pieces of a path then pass through one hash in order, a piece at a time.
    """
    several = paths.where("ending > 1").select("leaf")
    rows = stage(members.where("next_trie IS NULL").join(several, "leaf", "left_semi").select("leaf", "conv_id"), "several_ends")

    def pieces(batches):
        leaf, ids = None, []
        for batch in batches:
            for now, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now != leaf or len(ids) == IDS_PER_PIECE:
                    if ids:
                        yield leaf, ids
                    leaf, ids = now, []
                ids.append(one)
        if ids:
            yield leaf, ids

    def join(batches):
        for leaf, ids in pieces(batches):
            yield pa.RecordBatch.from_pydict({"leaf": [leaf], "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    def hashed(batches):
        leaf, state = None, None
        for batch in batches:
            for now, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if now != leaf:
                    if leaf is not None:
                        yield pa.RecordBatch.from_pydict({"leaf": [leaf], "ends": [state.hexdigest()]})
                    leaf, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b",")
                    state.update(ids.encode())
        if leaf is not None:
            yield pa.RecordBatch.from_pydict({"leaf": [leaf], "ends": [state.hexdigest()]})

    ranged = rows.repartitionByRange("leaf", "conv_id").sortWithinPartitions("leaf", "conv_id")
    joined = ranged.mapInArrow(join, "leaf string, first bigint, ids string")
    return joined.repartition("leaf").sortWithinPartitions("leaf", "first").mapInArrow(hashed, "leaf string, ends string")


def _alike(one: bytes, other: bytes) -> int:
    """Digests that both begin with."""
    n = min(len(one), len(other))
    if one[:n] == other[:n]:
        return n // DIGEST
    a, b = np.frombuffer(one[:n], np.uint8), np.frombuffer(other[:n], np.uint8)
    return int(np.argmax(a != b)) // DIGEST


class Skeleton:
    """The trie of the splitter paths: node (the first splitter that has the prefix, its length)."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = splitters
        self._first = []
        for n, path in enumerate(splitters):
            mine = np.full(len(path) // DIGEST + 1, n, np.int64)
            if n:
                both = _alike(splitters[n - 1], path) + 1
                mine[:both] = self._first[-1][:both]
            self._first.append(mine)
        self.width = max((len(p) // DIGEST for p in splitters), default=0) + 1

    def shard(self, path: bytes) -> int:
        low, high = 0, len(self.splitters)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.splitters[middle] <= path else (low, middle)
        return low

    def on(self, path: bytes, shard: int) -> tuple[int, int]:
        """How many digests of ``path`` lead along the skeleton, and along which splitter."""
        below = _alike(path, self.splitters[shard - 1]) if shard else -1
        above = _alike(path, self.splitters[shard]) if shard < len(self.splitters) else -1
        return (below, shard - 1) if below >= above else (above, shard)

    def number(self, splitter: int, length: int) -> int:
        return int(self._first[splitter][length]) * self.width + length


class _Open:
    """A node on the stack."""

    __slots__ = ("conv", "convs", "children", "leaves", "saved", "size", "ends", "shared", "waiting")

    def __init__(self, size, shared):
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.size, self.shared, self.ends, self.waiting = size, shared, None, []


def _finish(rows, skeleton: Skeleton, start: int):
    """Nodes of sorted (shard, key, trie, sizes, convs, conv, ends, below) rows, as tuples in the order of NODE.

    A key is the digest of the trie's name, then the path. ``below`` are the children, leaves and
    savings that the next layer found under the path's end. A node of the skeleton comes with what
    this shard alone knows: its savings leave out itself, its children and leaves those on the skeleton.
    """
    stack, last, out = [], (None, b""), []

    def pop():
        node, depth = stack.pop(), start + len(stack)
        parent = stack[-1] if stack else None
        if parent is not None:
            parent.convs += node.convs
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
        if node.shared is None:
            if not node.children:
                node.leaves = 1
            node.saved += (node.convs - 1) * node.size
            if parent is not None:
                parent.children += 1
                parent.leaves += node.leaves
                parent.saved += node.saved
        hung = None if parent is None else parent.shared
        row = [node.conv, depth, None, node.convs, node.children, node.leaves, node.saved, node.ends, trie, node.shared, hung, node.size]
        out.extend([*r[:2], node.conv, *r[3:]] for r in node.waiting)
        # A node waits for the id of its parent, which the skeleton's nodes learn from the reduction.
        (out if parent is None or hung is not None else parent.waiting).append(row)

    for shard, key, trie_now, sizes, convs, conv, ends, below in rows:
        both = _alike(key, last[1]) if shard == last[0] else 0
        while len(stack) > both:
            pop()
        trie = trie_now
        on, along = skeleton.on(key, shard)
        for length in range(len(stack) + 1, len(key) // DIGEST + 1):
            shared = skeleton.number(along, length) if length <= on else None
            stack.append(_Open(sizes[length - 2] if length > 1 else 0, shared))
        end = stack[-1]
        end.convs += convs
        end.conv = conv if end.conv is None else min(end.conv, conv)
        end.ends = ends
        end.children, end.leaves, end.saved = (a + b for a, b in zip((end.children, end.leaves, end.saved), below))
        last = shard, key
        if len(out) > NODES_AT_ONCE:
            yield out
            out = []
    while stack:
        pop()
    yield out


def _reduced(partial: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """Whole skeleton nodes, in the order of NODE: partial counts added up, then along the skeleton.

    There are no more than the digests of the splitters, which the draw bounds.
    """
    summed = partial.groupBy("shared").agg(
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.min(c).alias(c) for c in ("conv_id", "depth", "ends_sha256", "trie", "shared_parent", "bytes")],
    )
    nodes = {r.shared: r.asDict() for r in summed.collect()}
    # Prefixes come after what they begin, so totals go up.
    for number in sorted(nodes, key=lambda n: -(n % skeleton.width)):
        node = nodes[number]
        node["n_leaves"] = node["n_leaves"] or (0 if node["n_children"] else 1)
        node["saved_tokens"] += (node["n_convs"] - 1) * node["bytes"]
        above = nodes.get(node["shared_parent"])
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved_tokens"] += node["saved_tokens"]
            node["parent_conv_id"] = above["conv_id"]
    names = [part.split()[0] for part in NODE.split(", ")]
    return [tuple(node.get(name) for name in names) for node in nodes.values()]


def _forest(paths: DataFrame, start: int, per_shard: int) -> DataFrame:
    """Nodes of one layer's tries from (key, trie, sizes, convs, conv, ends, below) rows of different keys."""
    spark = paths.sparkSession
    rows, longest = paths.agg(F.count("*"), F.max(F.octet_length("key"))).first()
    fits = DRAWN_BYTES // (DRAWN_PER_SPLITTER * (longest or DIGEST))
    shards = max(1, min(rows // per_shard + 1, MOST_SHARDS, fits))
    drawn = paths.select("key").orderBy(F.xxhash64("key"), "key").limit(DRAWN_PER_SPLITTER * shards) if shards > 1 else None
    held = sorted(bytes(r.key) for r in drawn.collect()) if shards > 1 else []
    skeleton = Skeleton(sorted({held[len(held) * n // shards] for n in range(1, shards)}))
    known = spark.sparkContext.broadcast(skeleton)

    def deal(batches):
        for batch in batches:
            place = batch.schema.get_field_index("key")
            shard = [known.value.shard(key) for key in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    def rows_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns))

    types = [pa.string() if " string" in part else pa.int64() for part in NODE.split(", ")]
    names = [part.split()[0] for part in NODE.split(", ")]

    def scan(batches):
        given = ((*r[:7], tuple(r[7].values())) for r in rows_of(batches))
        for out in _finish(given, known.value, start):
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    columns = ["key", "trie", "sizes", "convs", "conv", "ends", "below"]
    given = paths.select(*columns)
    dealt = given.mapInArrow(deal, "shard int, " + ", ".join(f"{c} {t}" for c, t in given.dtypes))
    # Each shard is a partition; a hash of the number would put several into one.
    sorted_rows = dealt.repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "key")
    nodes = stage(sorted_rows.mapInArrow(scan, NODE), "nodes")
    whole = spark.createDataFrame(_reduced(nodes.where("shared IS NOT NULL"), skeleton), NODE)
    # As many rows as the skeleton has nodes at most.
    parents = F.broadcast(whole.select(F.col("shared").alias("shared_parent"), F.col("conv_id").alias("of_parent")))
    own = nodes.where("shared IS NULL").join(parents, "shared_parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_parent"))
    return own.select(*whole.columns).unionByName(whole)


def conversation_trie(
    conversations: DataFrame, donor: Column, most: Column, at_most: int, turns_per_row: int = TURNS_PER_ROW, paths_per_shard: int = PATHS_PER_SHARD
) -> DataFrame:
    """A row for each different beginning (first d turns, d from 0) of the rebuilt conversations.

    ``conversations`` has conv_id, turn, role, text; every conversation's first ``most`` turns are
    replaced by those of conversation ``donor`` (both expressions of ``conv_id``, ``most`` at most
    ``at_most``). Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (of the ids of members that end there).

    Null roles and texts are empty ones; turns of equal number go by role, then text, and equal rows
    are turns each; rows without conv_id are left out; a conversation may hold any number of turns.
    Without conversations there is no node. Other columns are ignored.
    """
    own = stage(ordered_turns(conversations), "turns")
    lengths = stage(own.groupBy("conv_id").agg(F.count("*").alias("n")), "lengths")
    turns = stage(rebuilt_turns(own, lengths, donor, most, at_most), "rebuilt")
    chunks = _chunks(turns, lengths, turns_per_row)
    key = F.concat(F.unhex(F.md5("trie")), "path")
    chunks = stage(chunks.withColumn("key", key).withColumn("leaf", F.concat(F.md5("key"), F.col("layer").cast("string"))), "paths")

    # Tries that one conversation alone goes on in have a row per turn and nothing to add up.
    reached = chunks.where("layer > 0").groupBy("trie").agg(F.count("*").alias("convs"), F.min("layer").alias("layer"), F.min("conv_id").alias("conv_id"))
    reached = stage(reached, "reached")
    alone = reached.where("convs = 1").groupBy("conv_id").agg(F.min("layer").alias("layer"))
    deepest = reached.where("convs > 1").agg(F.max("layer")).first()[0] or 0

    several = chunks.where("layer = 0").unionByName(chunks.where("layer > 0").join(reached.where("convs > 1"), "trie", "left_semi"), allowMissingColumns=True)
    ending = F.count_if(F.col("next_trie").isNull())
    paths = several.groupBy("key", "layer").agg(
        F.count("*").alias("convs"),
        F.min("conv_id").alias("conv"),
        ending.alias("ending"),
        F.min(F.when(F.col("next_trie").isNull(), F.col("conv_id"))).alias("first_end"),
        *[F.first(c, ignorenulls=True).alias(c) for c in ("trie", "sizes", "next_trie", "leaf")],
    )
    paths = stage(paths, "different_paths")
    one = F.sha2(F.col("first_end").cast("string"), 256)
    ends = F.when(F.col("ending") == 0, F.lit(NOBODY)).when(F.col("ending") == 1, one).otherwise(F.col("ends"))
    paths = stage(paths.join(_ends(paths, several), "leaf", "left").withColumn("ends", ends).drop("leaf"), "ended_paths")

    result, below = [], None
    for layer in range(deepest, -1, -1):
        mine = paths.where(F.col("layer") == layer)
        # Where one conversation alone goes on, the end has one child and one leaf more.
        plain = F.when(F.col("next_trie").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
        children, leaves, saved = plain, plain, F.lit(0).cast("bigint")
        if below is not None:
            mine = mine.join(below, "next_trie", "left")
            children, leaves, saved = (F.coalesce(f"more_{c}", other) for c, other in (("children", plain), ("leaves", plain), ("saved", saved)))
        mine = mine.withColumn("below", F.struct(children.alias("children"), leaves.alias("leaves"), saved.alias("saved")))
        nodes = _forest(mine, layer * turns_per_row, paths_per_shard)
        if layer:
            nodes = stage(nodes, f"nodes_{layer}")
            roots = nodes.where(F.col("depth") == layer * turns_per_row)
            below = roots.select(
                F.col("trie").alias("next_trie"), F.col("n_children").alias("more_children"), F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved")
            )
            nodes = nodes.where(F.col("depth") > layer * turns_per_row)
            # The node a trie hangs from has members that end there, so its id is the layer above's.
            first = F.col("depth") == layer * turns_per_row + 1
            above = paths.where(F.col("layer") == layer - 1).where("next_trie IS NOT NULL").select(F.col("next_trie").alias("trie"), F.col("conv").alias("hung_from"))
            nodes = nodes.join(above, "trie", "left").withColumn("parent_conv_id", F.when(first, F.col("hung_from")).otherwise(F.col("parent_conv_id"))).drop("hung_from")
        result.append(nodes)

    final = result[0]
    for nodes in result[1:]:
        final = final.unionByName(nodes)
    shape = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    final = final.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY))).select(*shape)
    if alone.isEmpty():
        return final
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    tails = turns.join(alone, "conv_id").where(F.col("place") > F.col("layer") * turns_per_row).join(lengths, "conv_id")
    hung = chunks.join(alone.withColumnRenamed("layer", "alone"), "conv_id").where("layer = alone - 1").select("conv_id", "key")
    hung = hung.join(paths.select("key", F.col("conv").alias("hung_from")), "key").select("conv_id", "hung_from")
    tails = tails.join(hung, "conv_id").withColumns({"goes_on": F.col("place") < F.col("n"), "starts": F.col("place") == F.col("layer") * turns_per_row + 1})
    count = F.lit(1).cast("bigint")
    tails = tails.select(
        "conv_id",
        F.col("place").alias("depth"),
        F.when(F.col("starts"), F.col("hung_from")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        count.alias("n_convs"),
        F.when(F.col("goes_on"), count).otherwise(F.lit(0)).alias("n_children"),
        count.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("goes_on"), F.lit(NOBODY)).otherwise(F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"),
    )
    return final.unionByName(tails)
