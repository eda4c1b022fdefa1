import re

import numpy as np
import pytest
import xxhash

from ehrseq.llm import simhash
from ehrseq.llm.components import stars
from ehrseq.llm.simhash import close_lanes, fingerprint, near_duplicates, spanning_links, without_near_duplicates

from ..conftest import SMALL
from .odd import TEXTS, odd_documents


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius=4):
    """Smallest id reachable, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(int(prints[i]) ^ int(prints[j])).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def clustered(rng, n, centres=6, flips=6):
    base = rng.integers(0, 2**63, centres, dtype=np.uint64)
    flip = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, flips), replace=False)) for _ in range(n)]
    return base[rng.integers(0, centres, n)] ^ np.array(flip, np.uint64)


@pytest.mark.parametrize("text", [t for _, t in TEXTS if t is None or len(t) < 10_000] + ["a b c", "A B C d E", "x " * 300])
def test_fingerprint_against_the_definition(text):
    assert fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text_comes_in_pieces(monkeypatch):
    text = " ".join(str(i * i % 7919) for i in range(500))
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
@pytest.mark.parametrize("radius", [0, 3, 4, 6])
def test_bit_sliced_distances(n, radius):
    prints = clustered(np.random.default_rng(n), n)
    found = {(i, int(j)) for i, near in close_lanes(prints, radius, 0xFF0) for j in near}
    assert found == {(i, j) for j in range(n) for i in range(j) if bin(int(prints[i] ^ prints[j])).count("1") <= radius}


def test_spanning_links_are_few_and_join_the_same():
    prints = np.unique(clustered(np.random.default_rng(3), 200))
    found = spanning_links(prints)
    assert len(found) < len(prints)
    place = {int(p): i for i, p in enumerate(prints)}
    root = list(range(len(prints)))
    for a, b in found:
        old, new = root[place[a & (2**64 - 1)]], root[place[b & (2**64 - 1)]]
        root = [new if r == old else r for r in root]
    plain = plain_components(prints, range(len(prints)))
    assert len(set(root)) == len(set(plain))


@pytest.mark.parametrize("bucket", [2048, 16, 4])
def test_links_lose_nothing_in_large_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    prints = np.unique(np.concatenate([clustered(np.random.default_rng(5), 150, 3), np.arange(20, dtype=np.uint64)]))
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint bigint")
    roots = {r.vertex: r.root for r in stars(simhash.links(table)).collect()}
    groups = {}
    for p, c in zip(prints.view(np.int64), plain_components(prints, range(len(prints)))):
        groups.setdefault(c, set()).add(roots.get(int(p), int(p)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_stars_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (None, 3), (100, 101)]
    roots = {r.vertex: r.root for r in stars(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert stars(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {r.doc_id: r for r in near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts.values()]
    assert [out[i].fingerprint for i in texts] == [f"{p:016x}" for p in prints]
    assert [out[i].component_id for i in texts] == plain_components(prints, texts)


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    out = near_duplicates(odd)
    prints, ids = [plain_fingerprint(t) for _, t in TEXTS], [i for i, _ in TEXTS]
    want = zip(ids, (f"{p:016x}" for p in prints), plain_components(prints, ids))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert near_duplicates(odd.limit(0)).collect() == []


def test_one_document_of_a_group_stays(spark):
    odd = odd_documents(spark)
    kept = without_near_duplicates(odd)
    assert kept.schema == odd.schema
    # Blank texts are one group, the repeated text another; of each the smallest id stays.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "1", "4", "5", "7", "8", "9"])
    assert without_near_duplicates(odd.limit(0)).collect() == []
