"""Benchmark passages in documents: shared q-grams in diagonal bands, then banded alignment.

Benchmark items are cut into overlapping segments. A text that holds a segment of m characters
with at most k edits shares at least m + 1 - q * (k + 1) of its q-grams, all on diagonals (text
position minus segment position) at most k away from where it begins. So the q-grams that a text
shares with a segment are counted in bands of diagonals that overlap by half; bands below the
bound hold no match within k edits, and the others are verified by an alignment confined to them.

Case and runs of white space are levelled in items and texts. An exact quotation of SURELY_FOUND
levelled characters is found wherever it begins; a shorter one (but a whole item) may be missed.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import edit_rows, map_rows

Q = 12
# A segment of m characters may have m // EDIT_SHARE edits; the bound of the lemma stays above 0.
EDIT_SHARE = 16
SEGMENT, STRIDE = 96, 16
# Any passage of so many characters of an item holds a whole segment, wherever it begins.
SURELY_FOUND = SEGMENT + STRIDE - 1
# Characters of items that one pass over the documents looks for (an index of about 140 bytes for each
# character, which every task holds); more items mean more passes.
PASS_CHARACTERS = 1 << 19
# Alignments verified, and common q-grams laid out, together; order work only.
ALIGNED_AT_ONCE, PAIRS_AT_ONCE = 256, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_FILTER_BITS = 22
_BETWEEN = "\n"  # between texts; levelled texts have none


def level(text: str) -> str:
    return " ".join(text.lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def qgram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each q-gram; those of 8 and 4 characters are put together from halves."""
    one = codes.astype(np.uint64) + np.uint64(1)
    two = one[:-1] * _power(1) + one[1:]
    four = two[:-2] * _power(2) + two[2:]
    eight = four[:-4] * _power(4) + four[4:]
    return eight[:-4] * _power(4) + four[8:]


@dataclass
class _Index:
    """Segments and their q-grams, sorted by hash."""

    items: np.ndarray  # item of each segment
    codes: list  # characters of each segment
    edits: np.ndarray
    bounds: np.ndarray
    steps: np.ndarray  # half the width of a segment's bands
    hashes: np.ndarray
    first: np.ndarray  # entries of hash n: first[n] to first[n + 1]
    segment: np.ndarray
    position: np.ndarray
    filter: np.ndarray


def segments(item: str) -> list[str]:
    """Overlapping pieces of a levelled item; any passage of ``SURELY_FOUND`` characters of it holds one."""
    starts = [*range(0, max(len(item) - SEGMENT, 0), STRIDE), max(len(item) - SEGMENT, 0)]
    return [item[a : a + SEGMENT] for a in starts]


def build_index(items: list[str | None]) -> _Index | None:
    """Index of item texts by their place in the list. Items shorter than a q-gram are not searched."""
    cut = [(n, s) for n, item in enumerate(items) for s in segments(level(item or "")) if len(s) >= Q]
    if not cut:
        return None
    codes = [_codes(s) for _, s in cut]
    sizes = np.array([len(c) for c in codes])
    edits = np.minimum(sizes // EDIT_SHARE, (sizes - Q) // Q)
    hashes = [qgram_hashes(c) for c in codes]
    flat, segment = np.concatenate(hashes), np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
    position = np.concatenate([np.arange(len(h)) for h in hashes])
    order = np.argsort(flat, kind="stable")
    different, first = np.unique(flat[order], return_index=True)
    marks = np.zeros(1 << _FILTER_BITS, bool)
    marks[different >> np.uint64(64 - _FILTER_BITS)] = True
    return _Index(
        np.array([n for n, _ in cut]), codes, edits, sizes + 1 - Q * (edits + 1), 2 * edits + 1, different,
        np.append(first, len(flat)), segment[order], position[order], marks,
    )


def _steps(done: np.ndarray):
    """Ranges of places whose pairs, counted up in ``done``, are laid out at a time; at least one place."""
    first = 0
    while first < len(done):
        held = done[first - 1] if first else 0
        last = max(int(np.searchsorted(done, held + PAIRS_AT_ONCE, "right")), first + 1)
        yield first, last
        first = last


def _candidates(index: _Index, joined: np.ndarray, starts: np.ndarray):
    """(text, segment, band) triples that share enough q-grams."""
    hashes = qgram_hashes(joined)
    at = np.flatnonzero(index.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
    place = np.searchsorted(index.hashes, hashes[at])
    known = index.hashes[np.minimum(place, len(index.hashes) - 1)] == hashes[at]
    at, place = at[known], place[known]
    counts = index.first[place + 1] - index.first[place]
    n_segments, n_bands = len(index.codes), (len(joined) + 2 * SEGMENT) + 2
    # A q-gram that is common on both sides stands for very many pairs: they are laid out so many at a
    # time, and only what each adds up to is kept.
    done, keys, sums = np.cumsum(counts), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for first, last in _steps(done):
        some, now = counts[first:last], place[first:last]
        entry = np.repeat(index.first[now], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        where = np.repeat(at[first:last], some)
        text, segment = np.searchsorted(starts, where, "right") - 1, index.segment[entry]
        # Diagonals count from the text's start; a segment of q characters back keeps them above zero.
        diagonal = where - starts[text] - index.position[entry] + SEGMENT
        band = diagonal // index.steps[segment]
        key = (text * n_segments + segment) * n_bands + band + 1
        key, shared = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        if not len(keys):
            keys, sums = key, shared
            continue
        keys, place_of = np.unique(np.concatenate([keys, key]), return_inverse=True)
        sums = np.bincount(place_of, np.concatenate([sums, shared])).astype(np.int64)
    text, rest = np.divmod(keys, n_segments * n_bands)
    segment, band = np.divmod(rest, n_bands)
    enough = sums >= index.bounds[segment]
    return text[enough], segment[enough], band[enough] - 1


def _aligned(index: _Index, joined, starts, ends, text, segment, band) -> np.ndarray:
    """Smallest number of edits of each candidate's segment within its band, for candidates of one segment size.

    Cell j of row i is the distance of the first i characters to some text that ends on diagonal j.
    """
    k = int(index.edits[segment[0]])
    pattern = np.array([index.codes[s] for s in segment])
    low = band * index.steps[segment] - SEGMENT - k
    width = 2 * int(index.steps[segment[0]]) + 2 * k
    size = pattern.shape[1]
    where = low[:, None] + np.arange(width + size)[None]
    inside = (where >= 0) & (where < (ends - starts)[text][:, None])
    window = np.where(inside, joined[np.clip(where + starts[text][:, None], 0, len(joined) - 1)].astype(np.int64), -1)
    steps = np.arange(width)
    row = np.zeros((len(text), width), np.int64)
    for i in range(size):
        new = row + (window[:, i : i + width] != pattern[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(axis=1)


def search(index: _Index | None, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, segments) by place in the lists: fewest edits and number of the item's segments found."""
    if index is None or not texts:
        return []
    levelled = [level(t or "") for t in texts]
    joined = _codes(_BETWEEN.join([*levelled, " " * Q]))
    sizes = np.array([len(t) for t in levelled])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text, segment, band = _candidates(index, joined, starts)
    found: dict[tuple[int, int], dict[int, int]] = {}
    lengths = np.array([len(c) for c in index.codes])[segment]
    for length in np.unique(lengths):
        for part in np.array_split(chosen := np.flatnonzero(lengths == length), -(-len(chosen) // ALIGNED_AT_ONCE)):
            t, s = text[part], segment[part]
            far = _aligned(index, joined, starts[:-1], starts[:-1] + sizes, t, s, band[part])
            for a, b, edits in zip(t.tolist(), s.tolist(), far.tolist()):
                if edits <= index.edits[b]:
                    seen = found.setdefault((a, int(index.items[b])), {})
                    seen[b] = min(edits, seen.get(b, edits))
    return sorted((a, item, min(seen.values()), len(seen)) for (a, item), seen in found.items())


def _passes(benchmark: DataFrame, columns: list[str]):
    """The benchmark in parts that a task can hold, each collected behind the check of its size."""
    given = benchmark.select(*columns).where(F.col(columns[-1]).isNotNull())
    size = given.agg(F.sum(F.length(columns[-1]))).first()[0] or 0
    parts = -(-size // PASS_CHARACTERS) or 1
    for number in range(parts):
        part = given.where(F.pmod(F.xxhash64(*columns), F.lit(parts)) == number) if parts > 1 else given
        yield part.collect()


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_column="doc_id", text="text", item_id="item_id", item_text="text"
) -> DataFrame:
    """One row per document and benchmark item of which it holds a segment: the ids, edits and segments.

    ``edits`` is the fewest among the item's segments found, ``segments`` how many were found. Texts
    are searched whole. Null, empty and short texts hold nothing; null items, and items shorter
    than a q-gram, are found nowhere. Repeated documents or items are reported each. Each pass
    looks for a bounded part of the benchmark in all documents.
    """
    given = docs.select(F.col(id_column), F.col(text).alias("_text"))
    item_kind = dict(benchmark.dtypes)[item_id]
    schema = f"`{id_column}` {given.schema.fields[0].dataType.simpleString()}, `{item_id}` {item_kind}, edits bigint, segments bigint"
    if id_column == item_id:
        raise ValueError("documents and items need id columns of different names")
    out = None
    for part in _passes(benchmark, [item_id, item_text]):
        ids, index = [r[0] for r in part], build_index([r[1] for r in part])

        def each(lists, ids=ids, index=index):
            for rows in lists:
                hits = search(index, [r[1] for r in rows])
                yield {
                    id_column: [rows[a][0] for a, _, _, _ in hits],
                    item_id: [ids[item] for _, item, _, _ in hits],
                    "edits": [edits for _, _, edits, _ in hits],
                    "segments": [n for _, _, _, n in hits],
                }

        found = map_rows(given, each, schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_passages(docs: DataFrame, benchmark: DataFrame, text="text", item_text="text") -> DataFrame:
    """The documents that hold no segment of any benchmark item, with all their columns."""
    for part in _passes(benchmark, [item_text]):
        index = build_index([r[0] for r in part])

        def decide(rows, index=index):
            hit = {a for a, _, _, _ in search(index, [r[0] for r in rows])}
            return [n not in hit for n in range(len(rows))], {}

        docs = edit_rows(docs, [text], decide)
    return docs
