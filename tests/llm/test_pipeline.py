"""The corpus pipeline against a plain version of every stage's decision."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from ehrseq.llm.common import stage
from ehrseq.llm.quality import quality_rules

from ..conftest import SMALL
from .odd import odd_documents
from .test_near_copies import plain_groups, plain_shingles, plain_wide


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage kept."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, SMALL), name)
        out.append(docs)
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_keep_what_the_plain_rules_keep(spark, kept):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert all(frame.dtypes == docs.dtypes for frame in kept[:-1])
    good = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    first = rows(kept[0])
    assert set(first) == good and all(first[i] == r for i, r in rows(docs).items() if i in good)

    ids = sorted(first)
    prints = [plain_wide(first[i].text) for i in ids]
    close = [(a, b) for b in range(len(ids)) for a in range(b) if bin(prints[a] ^ prints[b]).count("1") <= 46]
    least = {ids[n] for n in plain_groups(len(ids), close)}
    second = rows(kept[1])
    assert all(second[i] == first[i] for i in second)
    # Links that no table of the filing has may be missed, and only those.
    assert least <= set(second) and len(set(second) - least) <= 1
    sets = {i: plain_shingles(second[i].text) for i in second}
    assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)

    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    third = rows(kept[2])
    assert not any(item in r.text for item in items for r in third.values())
    gone = set(second) - set(third)
    assert sum(any(item in second[i].text for item in items) for i in gone) >= len(gone) - 1

    fourth = rows(kept[3])
    assert set(fourth) == set(third)
    for i, r in fourth.items():
        assert "@" not in re.sub(r"\[(email|ip|card|phone)\]", "", r.text) or "@" in third[i].text
        assert re.search(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", r.text) is None
        assert r.text == third[i].text or r.n_chars == len(r.text)


def test_packed_ids_are_those_of_the_kept_texts(kept):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    fourth, found = rows(kept[3]), {}
    for r in kept[4].collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(fourth)
    for i, pieces in found.items():
        ids = np.array([*tokenizer.encode(fourth[i].text, add_special_tokens=False).ids, 2], "<u4")
        assert sum(p.length for p in pieces) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)


def test_run_gives_what_the_stages_give(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_odd_and_empty_documents_pass_all_stages(spark):
    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        for name, function in corpus_pipeline.STAGES[:-1]:
            after = stage(function(spark, stage(docs, "given"), SMALL), name)
            assert after.dtypes == docs.dtypes
            docs = after
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()
