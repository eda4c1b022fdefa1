import math
import random
from collections import Counter

import numpy as np
import pytest

from ehrseq.llm import ranked_search as search
from ehrseq.llm.ranked_search import ranked_search, share, terms

from .odd import TEXTS, odd_documents


def plain(docs, queries, top=50):
    """Term by term; the integer arithmetic written out."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    documents, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in queries:
        found = []
        for i, c, n in counted:
            score = 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * n * documents // length)))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, f[-1], -f[0]) for n, f in enumerate(sorted(found, key=lambda f: f[:3])[:top])]
    return sorted(out, key=str)


def ours(spark, docs, queries, top=50, schema="doc_id bigint, text string"):
    docs = spark.createDataFrame(docs, schema).repartition(5) if isinstance(docs, list) else docs
    found = ranked_search(docs, spark.createDataFrame(queries, "item_id bigint, text string"), top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def drawn(seed, docs, queries):
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(40)] + ["Ünï", "é", "x1y"]
    weights = [1 / (n + 1) for n in range(len(words))]
    text = lambda most: " ".join(rng.choices(words, weights, k=rng.randint(0, most)))
    return [(n, text(30)) for n in range(docs)], [(n, text(12)) for n in range(queries)]


@pytest.mark.parametrize("top", [1, 3, 50])
def test_equals_plain(spark, top):
    docs, queries = drawn(1, 200, 25)
    # Ties beyond the last rank, and repeated rows.
    docs += [(1000 + n, "w30 w31") for n in range(60)] + [(7, "w30"), (7, "w30"), (None, "w30 w31")]
    queries += [(900, "w30, W31!"), (900, "w30, W31!"), (901, None), (902, " .. "), (None, "w30"), (903, "never seen")]
    assert ours(spark, docs, queries, top) == plain(docs, queries, top)


def test_blocks_and_batches_change_nothing(spark, monkeypatch):
    docs, queries = drawn(2, 150, 30)
    expected = ours(spark, docs, queries, 5)
    for name, value in {"TERMS_PER_BLOCK": 20, "CELLS": 1, "CANDIDATES": 10, "SPREAD": 2, "PAIRED": 3}.items():
        monkeypatch.setattr(search, name, value)
    assert ours(spark, docs, queries, 5) == expected == plain(docs, queries, 5)


def test_odd_documents(spark):
    queries = [(1, "the same text word999 Ünïcödé"), (2, None), (3, "host 10 0 255")]
    assert ours(spark, odd_documents(spark), queries) == plain(TEXTS, queries)


def test_empty(spark):
    assert ours(spark, [], [(1, "a")]) == ours(spark, [(1, "a")], []) == ours(spark, [(1, ".")], [(1, "a")]) == []


def test_other_names_and_string_ids(spark):
    docs = spark.createDataFrame([("b", "x y", 1), ("a", "x y", 2), ("c", "z", 3)], "score string, words string, rank int")
    queries = spark.createDataFrame([("q", "Y")], "query string, words string")
    with pytest.raises(ValueError):
        ranked_search(docs, queries, id_column="score", item_column="query", text="words")
    found = ranked_search(docs.withColumnRenamed("score", "id"), queries, id_column="id", item_column="query", text="words")
    assert [r[:3] for r in sorted(found.collect())] == [("q", 1, "a"), ("q", 2, "b")]


def test_terms():
    assert terms("Aİb-É1_2`z{|}~\x7f0") == ["aİb", "É1", "2", "z", "0"]


def test_graph_sums_what_the_queries_hold():
    rng = random.Random(4)
    queries = [rng.sample(range(50), rng.randint(1, 20)) for _ in range(80)]
    queries += [queries[0], [0], list(range(30)), list(range(30))]
    graph = share(queries, 50)
    values = np.zeros((graph.nodes, 4), np.int64)
    values[:50] = np.random.default_rng(1).integers(0, 1000, (50, 4))
    graph.evaluate(values)
    assert (values[graph.roots] == np.array([values[q].sum(axis=0) for q in queries])).all()
    # Fewer sums than without sharing; equal queries are one node.
    assert graph.parts < 0.8 * sum(map(len, queries))
    assert graph.roots[0] == graph.roots[80] and graph.roots[-1] == graph.roots[-2]


def test_terms_that_go_together_are_added_once():
    graph = share([[0, 1, 2, 3, 4], [0, 1, 2, 3, 5], [0, 1, 2, 3, 6]], 7)
    assert any(sorted(parts[a:b]) == [0, 1, 2, 3] for _, parts, starts in graph.levels for a, b in zip(starts, [*starts[1:], len(parts)]))
    assert graph.parts == 4 + 3 * 2
