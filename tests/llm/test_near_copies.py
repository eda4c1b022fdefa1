import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash

from ehrseq.llm import near_copies as nc
from ehrseq.llm.near_copies import close_pairs, forest, near_copies, wide_fingerprint, without_near_copies

from ..conftest import SMALL
from .odd import TEXTS, odd_documents


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_wide(text):
    """Word by word, in Python's integers."""
    whole, mask = [], 2**64 - 1
    for shingle in plain_shingles(text):
        h, bits = xxhash.xxh64(shingle.encode(), seed=42).intdigest(), 0
        for n in range(4):
            x = (h + 0x9E3779B97F4A7C15 * n) & mask
            if n:
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
                x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
                x ^= x >> 31
            bits |= x << 64 * n
        whole.append(bits)
    return sum(1 << b for b in range(256) if 2 * sum(w >> b & 1 for w in whole) > len(whole))


def plain_groups(n, pairs):
    """The smallest place each place reaches."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return [find(i) for i in range(n)]


def similar_pairs(texts, least, shared=60):
    """Jaccard similarity of pairs of texts that share a shingle found in at most so many of them."""
    sets, held = [plain_shingles(t) for t in texts], defaultdict(list)
    for i, found in enumerate(sets):
        for shingle in found:
            held[shingle].append(i)
    pairs = Counter(p for places in held.values() if 1 < len(places) <= shared for p in combinations(places, 2))
    return {
        (a, b): j for a, b in pairs if (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= least
    }


def scattered(rng, n, flips=0.09):
    """Fingerprints around a few centres, buckets of several sizes, and all their distances."""
    bits = rng.integers(0, 2, (12, 256))[rng.integers(0, 12, n)] ^ (rng.random((n, 256)) < flips)
    prints = [r.tobytes() for r in np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")]
    edges = np.unique(np.append(rng.integers(1, n + 1, 9), n))
    return prints, np.repeat(edges, np.diff(edges, prepend=0)), (bits[:, None] != bits[None]).sum(axis=2)


@pytest.mark.parametrize("text", [t for _, t in TEXTS if t is None or len(t) < 10_000] + ["a b", "A B c D e f", "x y " * 300])
def test_fingerprint_against_the_definition(text):
    assert int.from_bytes(wide_fingerprint(text), "little") == plain_wide(text)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 500])
@pytest.mark.parametrize("cells", [3, 1 << 15])
def test_pairs_and_forest_against_all_distances(monkeypatch, n, cells):
    monkeypatch.setattr(nc, "CELLS", cells if n < 500 else max(cells, 100))
    prints, ends, far = scattered(np.random.default_rng(n), n)
    for radius in (0, 30, 46, 62):
        found = [p for a, b in close_pairs(prints, ends, radius, {}) for p in zip(a.tolist(), b.tolist())]
        want = {(i, j) for i in range(n) for j in range(i + 1, ends[i]) if far[i, j] <= radius}
        assert len(found) == len(set(found)) and set(found) == want
    want = {(i, j) for a, b in close_pairs(prints, ends) for i, j in zip(a.tolist(), b.tolist())}
    few = [list(map(int, p)) for p in zip(*forest(prints, ends))]
    groups = plain_groups(n, want)
    assert plain_groups(n, few) == groups and len(few) == n - len(set(groups))


def test_abandoning_loses_few_links():
    """By binomial chance less than one link in a thousand at similarity 0.8."""
    prints, ends, far = scattered(np.random.default_rng(5), 900, flips=0.082)
    found = sum(len(a) for a, _ in close_pairs(prints, ends))
    assert found >= 0.999 * sum((far[i, i + 1 : ends[i]] <= nc.RADIUS).sum() for i in range(900))


def edited(rng, text, edits):
    words = text.split()
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"w{rng.integers(1 << 30)}"
    return " ".join(words)


def test_buckets_cut_into_blocks_and_small_flushes(spark, monkeypatch):
    """One large group of near copies among others, with buckets of any size cut and gathered anew."""
    rng = np.random.default_rng(3)
    base = [" ".join(f"b{rng.integers(5000)}" for _ in range(300)) for _ in range(30)]
    texts = [edited(rng, base[0], 4) for _ in range(80)] + base + base[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: 0 if i < 81 or i == 110 else {111: 81, 112: 82}.get(i, i) for i in range(len(texts))}
    for bucket, together in ((2048, 8192), (6, 8192), (6, 5), (2048, 1)):
        monkeypatch.setattr(nc, "BUCKET", bucket)
        monkeypatch.setattr(nc, "TOGETHER", together)
        assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want
    assert {r.doc_id for r in without_near_copies(docs).collect()} == set(want.values())


def test_recall_and_precision_on_given_documents(spark):
    """Pairs of similarity 0.8 or more, of all different texts that share a five-word shingle of at most
    60 texts, found in one component; and components only of texts linked by 0.55 or more."""
    docs = spark.read.parquet(SMALL.replace("sf0.001", "sf0.1") + "/documents.parquet")
    texts, ids = [], []
    for r in docs.orderBy("doc_id").collect():
        texts.append(r.text), ids.append(r.doc_id)
    component = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    assert set(component) == set(ids)
    firsts = {}
    for i, t in enumerate(texts):
        assert component[ids[i]] == component[ids[firsts.setdefault(t, i)]]
    some = [i for i in firsts.values() if plain_shingles(texts[i])]
    pairs = similar_pairs([texts[i] for i in some], 0.55)
    high = [component[ids[some[a]]] == component[ids[some[b]]] for (a, b), j in pairs.items() if j >= 0.8]
    assert len(high) > 40 and np.mean(high) >= 0.95
    chained = plain_groups(len(some), pairs)
    group = {component[ids[i]]: chained[n] for n, i in reversed(list(enumerate(some)))}
    strange = sum(group[component[ids[i]]] != chained[n] for n, i in enumerate(some))
    assert strange <= 0.002 * len(some)


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    out = near_copies(odd).collect()
    assert len(out) == odd.count()
    blank = {r.component_id for r in near_copies(odd.where("text IS NULL OR trim(text) = ''")).collect()}
    assert len(blank) <= 1
    kept = without_near_copies(odd)
    assert kept.dtypes == odd.dtypes and 0 < kept.count() <= odd.count()
    assert near_copies(odd.limit(0)).collect() == [] and without_near_copies(odd.limit(0)).collect() == []
    for name in ("print", "component_id"):
        with pytest.raises(ValueError, match=name):
            near_copies(odd.select("text", odd.doc_id.alias(name)), name)
    other = odd.select("text", odd.doc_id.alias("vertex"))
    assert near_copies(other, "vertex").count() == odd.count()
