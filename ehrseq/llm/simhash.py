"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius are found in three steps.

1. Equal fingerprints become one, so copies cost nothing further.
2. Two fingerprints that differ in at most ``radius`` bits agree on at least two of ``radius + 2``
   bit ranges. Each is filed once per pair of ranges. A bucket that grew beyond a task's share is
   filed again under pairs of ranges of its remaining bits; what is still too large is cut into
   blocks, and every pair of blocks becomes a task. No pair of fingerprints within the radius is
   lost.
3. A task holds the bit planes of its fingerprints vertically: word w of plane b has bit b of 64
   fingerprints. One exclusive-or compares a fingerprint with 64 others in that bit, and carry-save
   adders keep all 64 distances in three bit-sliced counters. Words whose 64 distances all exceed
   the radius are abandoned. Of the links it finds, a task returns a spanning forest.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import WORD, lowered, map_rows, stage
from ehrseq.llm.components import stars

SHINGLE_WORDS = 4
RADIUS = 4
HASH_SEED = 42
BITS = 64
# Small buckets are compared together, about so many fingerprints at a time.
BLOCK = 512
# A bucket above this is filed again or cut into blocks of half this size.
BUCKET = 2048
# Shingles hashed at a time; orders work only.
SHINGLES_AT_ONCE = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, as a signed integer: a bit is set if over half the shingles set it."""
    words = WORD.findall(lowered(text or ""))
    if not words:
        return 0
    size = min(len(words), SHINGLE_WORDS)
    count = len(words) - size + 1
    sums = np.zeros(BITS, np.int64)
    for at in range(0, count, SHINGLES_AT_ONCE):
        some = min(SHINGLES_AT_ONCE, count - at)
        shingles = map(" ".join, zip(*(words[at + k : at + k + some] for k in range(size))))
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64, some)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > count, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint bigint) of every document."""

    def each(lists):
        for rows in lists:
            yield {id_column: [r[0] for r in rows], "fingerprint": [fingerprint(r[1]) for r in rows]}

    given = docs.select(F.col(id_column), F.col(text).alias("_text"))
    kind = given.schema.fields[0].dataType.simpleString()
    return map_rows(given, each, f"`{id_column}` {kind}, fingerprint bigint")


def _ranges(bits: list[int], pieces: int) -> list[int]:
    """Masks that cut the given bit numbers into nearly equal pieces."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), pieces)]


def _masks(within: int, radius: int) -> list[int]:
    """All pairs of ``radius + 2`` ranges of the bits that ``within`` leaves open, added to it."""
    free = [b for b in range(BITS) if not within >> b & 1]
    return [within | a | b for a, b in combinations(_ranges(free, radius + 2), 2)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _filed(rows: DataFrame, masks) -> DataFrame:
    return rows.select(F.explode(masks).alias("mask"), "fingerprint").select(
        "mask", F.col("mask").bitwiseAND(F.col("fingerprint")).alias("key"), "fingerprint"
    )


def _full(rows: DataFrame, name: str) -> DataFrame:
    """Buckets above the limit, as a table."""
    sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("rows"))
    return stage(sizes.where(F.col("rows") > BUCKET), name)


def _tasks(prints: DataFrame, radius: int) -> DataFrame:
    """(mask, key, part, fingerprint): fingerprints to be compared with each other share the first three."""
    literal = [F.lit(_signed(m)) for m in _masks(0, radius)]
    first = _filed(prints, F.array(*literal))
    full = _full(first, "full_buckets")
    plain = first.join(full, ["mask", "key"], "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    if full.isEmpty():
        return plain
    finer = F.create_map(
        *[x for m in _masks(0, radius) for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in _masks(m, radius)]))]
    )
    again = _filed(first.join(full, ["mask", "key"], "left_semi"), finer[F.col("mask")]).distinct()
    still = _full(again, "full_again")
    small = again.join(still, ["mask", "key"], "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    blocks = F.ceil(F.col("rows") / (BUCKET // 2)).cast("bigint")
    mine = F.pmod(F.xxhash64("fingerprint"), blocks)
    # A block meets every block: the task (i, j), i <= j, holds blocks i and j.
    met = F.transform(
        F.sequence(F.lit(0).cast("bigint"), blocks - 1), lambda other: F.least(mine, other) * blocks + F.greatest(mine, other)
    )
    cut = again.join(still, ["mask", "key"]).select("mask", "key", F.explode(met).alias("part"), "fingerprint")
    return plain.unionByName(small).unionByName(cut)


def close_lanes(prints: np.ndarray, radius: int = RADIUS, first_bits: int = 0):
    """Pairs (i, j), i < j, of fingerprints that differ in at most ``radius`` (0 to 6) bits.

    Yields i and the array of its j. ``first_bits``: mask of bits to compare last (those known to
    be equal tell nothing). Distances of seven or more stick.
    """
    n = len(prints)
    width = -(-n // 64)
    lanes = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    padded = np.zeros((BITS, width * 64), np.uint8)
    padded[:, :n] = lanes
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    asked = np.where(lanes.astype(bool), _ALL, np.uint64(0))
    # Lanes up to the fingerprint itself, and those past the end, count as too far from the start.
    out = np.arange(width * 64)[None, :] <= np.arange(n)[:, None]
    out[:, n:] = True
    far = np.packbits(out, axis=1, bitorder="little").view(np.uint64)
    query, word = np.nonzero(far != _ALL)
    far = far[query, word]
    ones, twos, fours = np.zeros_like(far), np.zeros_like(far), np.zeros_like(far)
    order = sorted(range(BITS), key=lambda b: first_bits >> b & 1)

    def add(a, b, c):
        half = a ^ b
        return half ^ c, (a & b) | (half & c)

    for at in range(0, BITS, 4):
        d = [planes[b][word] ^ asked[b][query] for b in order[at : at + 4]]
        ones, two_a = add(ones, d[0], d[1])
        ones, two_b = add(ones, d[2], d[3])
        twos, four = add(twos, two_a, two_b)
        far |= fours & four
        fours |= four
        if at >= 20:
            alive = (far | _beyond(radius, ones, twos, fours)) != _ALL
            if not alive.all():
                query, word, far, ones, twos, fours = (x[alive] for x in (query, word, far, ones, twos, fours))
            if not len(query):
                return
    close = ~(far | _beyond(radius, ones, twos, fours))
    found = np.unpackbits(close.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    cell, lane = np.nonzero(found)
    a, b = query[cell], word[cell] * 64 + lane
    for i, start in zip(*np.unique(a, return_index=True)):
        yield int(i), b[start : np.searchsorted(a, i, "right")]


def _beyond(radius, ones, twos, fours):
    """Lanes whose count, in three bits, is above the radius: the comparison bit by bit."""
    above, equal = np.zeros_like(ones), np.full_like(ones, _ALL)
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            equal = equal & plane
        else:
            above = above | (equal & plane)
            equal = equal & ~plane
    return above


def spanning_links(prints: np.ndarray, radius: int = RADIUS, first_bits: int = 0) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links within the radius do, none of them idle."""
    labels, out = np.arange(len(prints)), []
    for i, near in close_lanes(prints, radius, first_bits):
        roots, at = np.unique(labels[near], return_index=True)
        for root, j in zip(roots, near[at]):
            if root != labels[i]:
                out.append((int(prints[i]), int(prints[j])))
                labels[labels == root] = labels[i]
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct ``fingerprint`` values that connect all those within the radius."""

    def compare(batches):
        """Rows come sorted by bucket; whole buckets gather until a block is full."""
        held, held_rows, last = [], 0, None

        def flush(mask):
            nonlocal held, held_rows
            found = spanning_links(np.concatenate(held).view(np.uint64), radius, mask) if held_rows > 1 else []
            held, held_rows = [], 0
            return found

        for batch in batches:
            mask, key, part, prints_ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            found = []
            starts = [0, *edges.tolist(), len(mask)]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                bucket = (mask[start], key[start], part[start])
                if bucket != last and held_rows + (end - start) > BLOCK:
                    found += flush(int(last[0]) & (2**64 - 1)) if last else []
                held.append(prints_[start:end])
                held_rows += end - start
                last = bucket
            a, b = zip(*found) if found else ((), ())
            yield _edges(a, b)
        a, b = zip(*found) if last and (found := flush(int(last[0]) & (2**64 - 1))) else ((), ())
        yield _edges(a, b)

    tasks = _tasks(prints, radius).select("mask", "key", "part", "fingerprint")
    together = tasks.repartition("mask", "key", "part").sortWithinPartitions("mask", "key", "part")
    return together.mapInArrow(compare, "a bigint, b bigint").distinct()


def _edges(a, b):
    arrays = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint of 16 hexadecimal digits, component_id) for every document.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest id that can be reached. Null, empty and blank texts have fingerprint zero, which is
    linked like any other. Null ids count as no id: a component of null ids has a null
    component_id. Repeated rows stay repeated; an empty table gives an empty result. Other columns
    are left out.
    """
    signed = stage(fingerprints(docs, id_column, text), "fingerprints")
    prints = stage(signed.groupBy("fingerprint").agg(F.min(id_column).alias("first")), "prints")
    roots = stage(stars(links(prints.select("fingerprint"), radius)), "roots")
    members = roots.join(prints, F.col("vertex") == F.col("fingerprint")).select("vertex", "root", "first")
    firsts = members.groupBy("root").agg(F.min("first").alias("component_id"))
    reached = members.join(firsts, "root").select(F.col("vertex").alias("fingerprint"), "component_id")
    named = prints.join(reached, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    # As a table of its own it meets the documents in a plain join, which can split a fingerprint many of them share.
    named = stage(named, "named")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return signed.join(named, "fingerprint").select(id_column, hexed.alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Rows are numbered first, so of repeated rows one stays; null ids come last.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    numbered = stage(rows, "numbered")
    given = F.col("row").getField(id_column)
    key = F.struct(given.isNull().alias("missing"), given.alias("given"), F.col("number"))
    keyed = numbered.select(key.alias("key"), F.col("row").getField(text).alias("text"))
    first = near_duplicates(keyed, "key", "text", radius).where("key = component_id").select("key.number")
    return numbered.join(first, "number", "left_semi").select("row.*")
