import random

import numpy as np
import pytest

from ehrseq.llm import decontamination
from ehrseq.llm.decontamination import EDIT_SHARE, Q, build_index, find_passages, level, qgram_hashes, search, segments, without_passages

from ..conftest import SMALL
from .odd import LONG, odd_documents


def distance_within(pattern, text):
    """Fewest edits between the pattern and any part of the text: the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain(items, texts):
    out = []
    for a, text in enumerate(texts):
        for b, item in enumerate(items):
            edits = {}
            for n, s in enumerate(segments(level(item or ""))):
                if len(s) >= Q:
                    d = distance_within(s, level(text or ""))
                    if d <= min(len(s) // EDIT_SHARE, (len(s) - Q) // Q):
                        edits[n] = d
            if edits:
                out.append((a, b, min(edits.values()), len(edits)))
    return out


def edited(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        letters[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "a", "zb"])
    return "".join(letters)


@pytest.mark.parametrize("seed", range(25))
def test_search_against_the_whole_table(seed):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choices("abcd ", k=n))
    items = [draw(rng.randint(5, 160)) for _ in range(3)] + [None, ""]
    texts = [draw(rng.randint(0, 60)) + edited(rng, rng.choice(items[:3]), rng.randint(0, 9)) + draw(rng.randint(0, 40)) for _ in range(4)]
    assert search(build_index(items), texts) == plain(items, texts)


def test_hashes_are_those_of_the_qgrams():
    text = "abcabcabcabcabcabcXabcabcabcabc"
    hashes = qgram_hashes(decontamination._codes(text))
    grams = [text[i : i + Q] for i in range(len(text) - Q + 1)]
    assert len(hashes) == len(grams)
    assert len(set(hashes.tolist())) == len(set(grams))
    assert len(qgram_hashes(np.zeros(Q - 1, np.uint32))) == 0


def test_long_passages_hold_a_segment():
    item = level(" ".join(f"w{i}" for i in range(200)))
    for at in range(0, len(item) - 144, 7):
        assert any(s in item[at : at + 144] for s in segments(item))


def test_documents_that_quote_the_benchmark(spark):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in benchmark.collect()}
    quoting = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in r.text}
    found = {(r.doc_id, r.item_id): r.edits for r in find_passages(docs, benchmark).collect()}
    assert len(quoting) > 10 and quoting <= set(found)
    assert len(set(found) - quoting) <= 2
    left = {r.doc_id for r in without_passages(docs, benchmark).collect()}
    assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_more_items_than_a_pass_holds(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, find_passages(docs, benchmark).collect()))
    kept = sorted(r.doc_id for r in without_passages(docs, benchmark).collect())
    monkeypatch.setattr(decontamination, "PASS_CHARACTERS", 3_000)
    assert sorted(map(tuple, find_passages(docs, benchmark).collect())) == whole
    assert sorted(r.doc_id for r in without_passages(docs, benchmark).collect()) == kept


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    items = [(1, LONG[3000:3300].upper()), (2, None), (None, "The same   text twice,\nword for word"), (4, ""), (4, "short")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted((r.doc_id, str(r.item_id)) for r in find_passages(odd, benchmark).collect())
    assert found == [(4, "1"), (5, "None"), (5, "None"), (6, "None")]
    kept = without_passages(odd, benchmark)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 4
    assert find_passages(odd.limit(0), benchmark).collect() == []
    assert find_passages(odd, benchmark.limit(0)).collect() == []
    assert without_passages(odd, benchmark.limit(0)).count() == odd.count()


def test_runs_of_one_character_take_bounded_memory():
    """Every position of the text meets every position of the item."""
    import tracemalloc

    index = build_index(["-" * 200])
    tracemalloc.start()
    found = search(index, ["-" * 1_000_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0][:3] == (0, 0, 0) and peak < 500e6


def test_steps_change_nothing(monkeypatch):
    items, texts = ["-" * 200, "abc " * 40], ["-" * 500 + "x" + "-" * 90, "abc " * 60, "- " * 300, ""]
    whole = search(build_index(items), texts)
    monkeypatch.setattr(decontamination, "PAIRS_AT_ONCE", 50)
    assert search(build_index(items), texts) == whole != []


@pytest.mark.parametrize("offset", range(0, 100, 7))
def test_a_quotation_is_found_wherever_it_begins(offset):
    rng = random.Random(2)
    item = "".join(rng.choices("abcdefghijklmnop ", k=300)).strip()
    said = level(item)[offset : offset + decontamination.SURELY_FOUND]
    assert search(build_index([item]), ["so they say " + said + " and more"])
