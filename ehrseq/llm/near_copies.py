"""Near copies of documents: five-word shingles, similarity 0.8 or more, by wide SimHash fingerprints.

A 64-bit fingerprint cannot tell a Jaccard similarity of 0.8 from 0.5, so this one has 256 bits, of
the different shingles of a text. Two texts of Jaccard similarity s differ in a share of
arccos(2 s / (1 + s)) / pi of the bits: 39 of 256 at 0.8, 59 at 0.6, 128 for unrelated ones. They are
linked up to ``RADIUS`` bits. Links are found in three steps.

1. Equal fingerprints become one.
2. Each is filed in ``TABLES`` tables under ``KEY_BITS`` of its bits, chosen by a fixed draw. Two texts
   of similarity 0.8 agree on the bits of some table at 0.93, more similar ones surely but for
   little. A bucket above a task's share is cut into blocks, every two of which meet in a task.
3. A task compares by bit planes held vertically: a word has one bit of 64 neighbours in the sorted
   buckets. Carry-save adders keep 64 distances in bit-sliced counters; after each 64 bits, words
   all of whose distances are past what a link can have by then are abandoned. A task returns a
   spanning forest of what it links.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import WORD, lowered, map_rows, stage
from ehrseq.llm.components import stars

SHINGLE_WORDS = 5
HASH_SEED = 42
BITS, RADIUS = 256, 46
TABLES, KEY_BITS = 36, 16
# Distances a link may have after 64 and 128 bits: 3.5 deviations above those of similarity 0.8.
ON_THE_WAY = {64: 20, 128: 34}
# A bucket above this is cut into blocks of half this size.
BUCKET = 2048
# Fingerprints compared at a time, of whole buckets, and cells of 64 distances; bound memory only.
TOGETHER, CELLS = 8192, 1 << 15
# Shingles whose bits are summed at a time; bounds memory only.
SHINGLES_AT_ONCE = 1 << 14
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
# Counters of six bits; distances of 64 or more stick.
_COUNTERS = 6


def _words_of(hashes: np.ndarray) -> np.ndarray:
    """Four words for every hash: itself, and three that a mixing of it gives."""
    out = np.empty((len(hashes), BITS // 64), np.uint64)
    for n in range(BITS // 64):
        mixed = hashes + np.uint64((0x9E3779B97F4A7C15 * n) & (2**64 - 1))
        if n:
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
        out[:, n] = mixed
    return out


def shingle_hashes(text: str | None) -> np.ndarray:
    """Hashes of the different shingles of a text; a text of fewer words is one shingle."""
    words = WORD.findall(lowered(text or ""))
    size = min(len(words), SHINGLE_WORDS)
    if not size:
        return np.zeros(0, np.uint64)
    shingles = map(" ".join, zip(*(words[k : len(words) - size + 1 + k] for k in range(size))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles), np.uint64))


def wide_fingerprint(text: str | None) -> bytes:
    """256 bits, set where over half the different shingles set them; all clear without words."""
    hashes = shingle_hashes(text)
    sums = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        some = _words_of(hashes[at : at + SHINGLES_AT_ONCE]).view(np.uint8)
        sums += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * sums > len(hashes), bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, print) of every document."""

    def each(lists):
        for rows in lists:
            yield {id_column: [r[0] for r in rows], "print": [wide_fingerprint(r[1]) for r in rows]}

    given = docs.select(F.col(id_column), F.col(text).alias("_text"))
    kind = given.schema.fields[0].dataType.simpleString()
    return map_rows(given, each, f"`{id_column}` {kind}, print binary")


def _bits(prints: list[bytes]) -> np.ndarray:
    """One row of bits a fingerprint."""
    return np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), BITS // 8), axis=1, bitorder="little")


def _buckets(prints: list[bytes]) -> np.ndarray:
    """The bucket of every fingerprint in each table: the table's number and key in one integer."""
    draw = np.random.default_rng(HASH_SEED)
    chosen = np.stack([draw.choice(BITS, KEY_BITS, replace=False) for _ in range(TABLES)])
    keys = _bits(prints)[:, chosen] @ (1 << np.arange(KEY_BITS))
    return keys + (np.arange(TABLES) << KEY_BITS)


def _tasks(prints: DataFrame) -> DataFrame:
    """(bucket, part, vertex, print): fingerprints to be compared with each other share the first two."""

    def each(lists):
        for rows in lists:
            buckets = _buckets([r[1] for r in rows]).astype(np.int32)
            ends = pa.array(np.arange(len(rows) + 1) * TABLES, pa.int32())
            yield {
                "vertex": [r[0] for r in rows],
                "print": [r[1] for r in rows],
                "buckets": pa.ListArray.from_arrays(ends, pa.array(buckets.ravel())),
            }

    keyed = stage(map_rows(prints, each, "vertex bigint, print binary, buckets array<int>"), "keyed")
    filed = keyed.select(F.explode("buckets").alias("bucket"), "vertex", "print")
    sizes = filed.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > BUCKET)
    full = stage(sizes, "full_buckets").select("bucket", F.ceil(F.col("rows") / (BUCKET // 2)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    # A block meets every block: the task (i, j), i <= j, holds blocks i and j.
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(mine, other) * F.col("blocks") + F.greatest(mine, other)
    )
    parts = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(met)
    return filed.join(full, "bucket", "left").select("bucket", F.explode(parts).alias("part"), "vertex", "print")


def _beyond(limit: int, counters: list[np.ndarray]) -> np.ndarray:
    """Lanes whose bit-sliced count is above the limit: the comparison bit by bit."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for n in reversed(range(_COUNTERS)):
        if limit >> n & 1:
            equal = equal & counters[n]
        else:
            above = above | (equal & counters[n])
            equal = equal & ~counters[n]
    return above


def _add(a, b, c):
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def close_pairs(prints: list[bytes], ends: np.ndarray, radius: int = RADIUS, on_the_way: dict[int, int] = ON_THE_WAY):
    """Arrays (i, j) of fingerprints that differ in at most ``radius`` (0 to 62) bits, for j from i + 1 to
    ``ends[i]`` - 1 (the end of the bucket of i, in sorted order)."""
    n, lanes = len(prints), _bits(prints)
    width = -(-n // 64)
    padded = np.zeros((BITS, width * 64), np.uint8)
    padded[:, :n] = lanes.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    asked = np.where(lanes.T.astype(bool), _ALL, np.uint64(0))
    first = np.arange(n) >> 6
    many = np.where(ends - 1 > np.arange(n), (ends - 1 >> 6) - first + 1, 0)
    queries = np.flatnonzero(many)
    stops = np.cumsum(many[queries])
    start = 0
    while start < len(queries):
        before = stops[start - 1] if start else 0
        stop = max(int(np.searchsorted(stops, before + CELLS, "right")), start + 1)
        mine = queries[start:stop]
        start = stop
        query = np.repeat(mine, many[mine])
        word = first[query] + np.arange(len(query)) - np.repeat(np.cumsum(many[mine]) - many[mine], many[mine])
        # Lanes up to the fingerprint itself and from the end of its bucket on are too far from the start.
        low, high = np.clip(query + 1 - word * 64, 0, 64), np.clip(ends[query] - word * 64, 0, 64)
        far = ~(_below(high) & ~_below(low))
        counters = [np.zeros_like(far) for _ in range(_COUNTERS)]
        for at in range(0, BITS, 4):
            d = [planes[b][word] ^ asked[b][query] for b in range(at, at + 4)]
            counters[0], two_a = _add(counters[0], d[0], d[1])
            counters[0], two_b = _add(counters[0], d[2], d[3])
            counters[1], carry = _add(counters[1], two_a, two_b)
            for level in range(2, _COUNTERS):
                counters[level], carry = counters[level] ^ carry, counters[level] & carry
            far |= carry
            limit = on_the_way.get(at + 4, radius if at >= 128 and at % 32 == 28 else None)
            if limit is not None:
                alive = (far | _beyond(min(limit, radius), counters)) != _ALL
                query, word, far = query[alive], word[alive], far[alive]
                counters = [c[alive] for c in counters]
                if not len(query):
                    break
        if len(query):
            close = ~(far | _beyond(radius, counters))
            cell, lane = np.nonzero(np.unpackbits(close.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[cell], word[cell] * 64 + lane


def _below(lane: np.ndarray) -> np.ndarray:
    """Words with the bits below ``lane`` (0 to 64) set."""
    lane = lane.astype(np.uint64)
    return np.where(lane == 64, _ALL, (np.uint64(1) << (lane & np.uint64(63))) - np.uint64(1))


def forest(prints: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the close pairs, none of them idle, that join what all of them join."""
    labels, out = np.arange(len(prints)), []
    for a, b in close_pairs(prints, ends):
        while True:
            low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
            open_ = low != high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            if not len(a):
                break
            # Each larger label hangs under one smaller one, so there is no circle among these.
            tops, at = np.unique(high, return_index=True)
            out.append((a[at], b[at]))
            up = np.arange(len(prints))
            up[tops] = low[at]
            while (up[up] != up).any():
                up = up[up]
            labels = up[labels]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def copy_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) between the ``vertex`` numbers of distinct ``print`` values that connect the close ones."""

    def compare(batches):
        """Rows come sorted by bucket; whole buckets gather until there are enough."""
        held, size, last = [], 0, None

        def flush():
            nonlocal held, size
            keys, vertices = (np.concatenate([h[n] for h in held]) for n in (0, 1))
            prints_ = [p for h in held for p in h[2]]
            held, size = [], 0
            edges = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
            ends = np.repeat(edges, np.diff(edges, prepend=0))
            a, b = forest(prints_, ends)
            return pa.RecordBatch.from_arrays([pa.array(vertices[a], pa.int64()), pa.array(vertices[b], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1)], axis=1)
            vertices, prints_ = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist()
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(keys) and last is not None and (keys[0] != last).any():
                edges = np.insert(edges, 0, 0)
            at = 0
            for edge in edges.tolist():
                if size + edge - at >= TOGETHER:
                    held.append((keys[at:edge], vertices[at:edge], prints_[at:edge]))
                    size += edge - at
                    at = edge
                    yield flush()
            if len(keys):
                held.append((keys[at:], vertices[at:], prints_[at:]))
                size += len(keys) - at
                last = keys[-1]
        if size:
            yield flush()

    together = _tasks(prints).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return together.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id) for every document; component_id is the smallest id that links reach.

    Links are those above: all but a few of the pairs of Jaccard similarity 0.8 or more (see the
    README for what was measured) and some of those of 0.6 to 0.8: the fingerprints decide, and no text is read again. Texts without words are copies of each
    other. Null ids count as no id: a component of null ids has a null component_id. Repeated rows stay
    repeated; an empty table gives an empty result. Other columns are left out.
    """
    if id_column in ("print", "component_id"):
        raise ValueError(f"the id column must not be named {id_column}")
    signed = stage(wide_fingerprints(docs, id_column, text), "wide_fingerprints")
    grouped = signed.groupBy("print").agg(F.min(id_column).alias("first"))
    prints = stage(grouped.withColumn("vertex", F.monotonically_increasing_id()), "wide_prints")
    roots = stage(stars(copy_links(prints.select("vertex", "print"))), "copy_roots")
    rooted = prints.join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # As a table of its own it meets the documents in a plain join, which can split a print many of them share.
    named = stage(rooted.join(firsts, "root").select("print", "component_id"), "copy_names")
    return signed.join(named, "print").select(id_column, "component_id")


def without_near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Rows are numbered first, so of repeated rows one stays; null ids come last.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"))
    numbered = stage(rows, "numbered")
    given = F.col("row").getField(id_column)
    key = F.struct(given.isNull().alias("missing"), given.alias("given"), F.col("number"))
    keyed = numbered.select(key.alias("key"), F.col("row").getField(text).alias("text"))
    first = near_copies(keyed, "key", "text").where("key = component_id").select("key.number")
    return numbered.join(first, "number", "left_semi").select("row.*")
