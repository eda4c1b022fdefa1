import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ehrseq.llm import packing
from ehrseq.llm.packing import SLACK, WordTokenizer, cut_lengths, pack_documents

from ..conftest import SMALL
from .odd import LONG, TEXTS, odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    plain, ordinary = Tokenizer.from_file(PATH), Tokenizer.from_file(PATH)
    ordinary.encode_special_tokens = True
    return lambda text, as_text=False: (ordinary if as_text else plain).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ours():
    return WordTokenizer(PATH)


@pytest.mark.parametrize("text", [t or "" for _, t in TEXTS if t != LONG] + ["<|endoftext|> a<|startoftext|>b", "İSTANBUL ΣΑΣ ﬃ é ́x", "can't we've 1234 ½ x²", "a\x1cb\x1d\x1e\x1f c　d​e", "日本語 テキスト ١٢٣ ẞß Ǆ", "a <|endoftext|> b", "x<|endoftext|>y's <|STARTOFTEXT|> <|endoftext|", "é<|endoftext|>É日<|startoftext|>", "İ i̇ İx"])
def test_ids_are_the_librarys(text, ours, library):
    assert np.frombuffer(ours.ids(text), "<u4").tolist() == library(text)
    as_text = WordTokenizer(PATH, ordinary=True)
    assert np.frombuffer(as_text.ids(text), "<u4").tolist() == library(text, True)


def test_random_ids_are_the_librarys(ours, library):
    rng = random.Random(5)
    pool = [*"abcABC 019'.,-\n\té ßÄİΣσ́ ‍\U0001f600日!'s'll", "<|endoftext|>", "<|startoftext|>", "<|", "|>"]
    for _ in range(500):
        text = "".join(rng.choices(pool, k=rng.randint(0, 30)))
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == library(text)


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces_fill_their_classes(capacity):
    for total in [*range(1, 2 * capacity, max(capacity // 400, 1)), capacity, 2 * capacity]:
        lengths = cut_lengths(total, capacity)
        assert sum(lengths) == total and min(lengths) > 0
        for length in lengths[:-1]:
            k = capacity // length
            assert capacity - k * length <= max(capacity / SLACK, k)
        assert len(lengths) <= total // capacity + 6


def check(rows, texts, capacity, library):
    """Every id once, sequences gapless and within capacity; returns the share of padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*library(text), 2], "<u4").tobytes()
        assert b"".join(p[3] for p in sorted(pieces[doc])) == ids
        assert {p[2] for p in pieces[doc]} == {len(ids) // 4}
        ends = [0, *np.cumsum([p[1] for p in sorted(pieces[doc])]).tolist()]
        assert [p[0] for p in sorted(pieces[doc])] == ends[:-1]
    padding = 0
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else capacity - ends[-1]
    return padding / sum(n for parts in sequences.values() for _, n in parts)


@pytest.mark.parametrize("pooled", [1 << 24, 2_000])
def test_documents_round_trip(spark, library, monkeypatch, pooled):
    monkeypatch.setattr(packing, "POOLED_TOKENS", pooled)
    capacity = 4096 if pooled > 4096 else 128
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack_documents(docs.repartition(5, "doc_id"), PATH, 2, capacity).collect()
    assert check(rows, texts, capacity, library) < 0.03


def test_odd_and_empty_tables(spark, library):
    odd = odd_documents(spark)
    rows = pack_documents(odd, PATH, 2).collect()
    # Repeated and null ids stand for several documents: every piece must be part of one of them.
    given = {}
    for i, t in TEXTS:
        given.setdefault(i, []).append(np.array([*library(t), 2], "<u4").tobytes())
    assert all(r.ids in [ids[4 * r.start : 4 * (r.start + r.length)] for ids in given[r.doc_id]] for r in rows)
    for i, ids in given.items():
        assert sum(r.length for r in rows if r.doc_id == i) == sum(map(len, ids)) // 4
    assert pack_documents(odd.limit(0), PATH, 2).collect() == []


def test_a_class_fills_without_a_shuffle(spark):
    docs = spark.range(40).select("id", F.lit("word " * 1000).alias("text"))
    rows = pack_documents(docs.coalesce(1), PATH, 2, id_column="id").collect()
    firsts = [r for r in rows if r.start == 0]
    assert {r.length for r in firsts} == {819}
    per_sequence = {}
    for r in firsts:
        per_sequence[r.sequence_id] = per_sequence.get(r.sequence_id, 0) + 1
    assert sorted(per_sequence.values()) == [5] * 8


def test_digests_stand_for_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame([(77_777, "a <|endoftext|> b")], "doc_id bigint, text string"), allowMissingColumns=True)
    given = docs.coalesce(2)
    whole, digests = (pack_documents(given, PATH, 2, digest=digest) for digest in (False, True))
    assert "ids" not in digests.columns and "ids_crc32" not in whole.columns
    key = lambda r: (r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset)
    assert sorted((*key(r), zlib.crc32(r.ids)) for r in whole.collect()) == sorted((*key(r), r.ids_crc32) for r in digests.collect())


@pytest.mark.parametrize("name", ["start", "length", "ids_crc32"])
def test_ids_named_like_results_are_refused(spark, name):
    with pytest.raises(ValueError):
        pack_documents(spark.createDataFrame([(1, "a")], f"{name} bigint, text string"), PATH, 2, id_column=name)
