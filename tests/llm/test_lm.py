import math
import random
from collections import Counter

import numpy as np

from ehrseq.llm import lm
from ehrseq.llm.lm import BACKOFF, backoff_scores, word_key

from .odd import TEXTS, odd_documents


def plain_scores(texts, vocabulary):
    docs = [(t or "").translate({i: i + 32 for i in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ") for t in texts]
    docs = [[w for w in d.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] for d in docs]
    counts = Counter(w for d in docs for w in d)
    known = set(sorted(counts, key=lambda w: (-counts[w], word_key(w)))[:vocabulary])
    docs = [[w if w in known else "?" for w in d] for d in docs]
    seen = Counter(w for d in docs for w in d)
    total, seen["<"] = sum(seen.values()), sum(map(bool, docs))
    pairs = [list(zip(["<", *d], d)) for d in docs]
    table = Counter(p for d in pairs for p in d)
    held = Counter(p for d in pairs for p in set(d))
    out = []
    for d in pairs:
        terms = [math.log(table[p] / seen[p[0]]) if held[p] > 1 else math.log(BACKOFF * seen[p[1]] / total) for p in d]
        out.append((len(d), sum(held[p] < 2 for p in d), sum(terms, 0.0)))
    return out


def test_scores_against_counting(spark):
    texts = ["the cat sat on the mat", "The cat ran", "a cat sat on a mat", "the the the", "", None, "rare words only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for vocabulary in (65_534, 3, 0):
        out = {r.doc_id: r for r in backoff_scores(docs, vocabulary=vocabulary).collect()}
        for i, (n, backed, score) in enumerate(plain_scores(texts, vocabulary)):
            assert (out[i].n_words, out[i].n_backed_off) == (n, backed)
            assert abs(out[i].log_score - score) < 1e-9
            assert (out[i].mean_log_score is None) == (n == 0)


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    out = backoff_scores(odd).collect()
    want = [(i, n, b, round(s, 4)) for (i, _), (n, b, s) in zip(TEXTS, plain_scores([t for _, t in TEXTS], 65_534))]
    assert sorted(map(str, ((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 4) + 0.0) for r in out))) == sorted(map(str, want))
    assert backoff_scores(odd.limit(0)).collect() == []


def test_every_word_keeps_its_count(spark):
    """More different words than have numbers: seen once, repeated in one text, shared by texts."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(66_000)]
    texts = [" ".join(common) + " " + " ".join(reversed(common)), " ".join(w for w in common for _ in "ab")]
    texts += [f"rare{i % 7} rare{i % 5} only{i} twice{i} twice{i} c1 c2 rare{i % 3}" for i in range(40)] + ["", None]
    texts += [" ".join(rng.choices(common, k=50)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in backoff_scores(docs).collect()}
    for i, (n, backed, score) in enumerate(plain_scores(texts, 1 << 40)):
        assert (out[i].n_words, out[i].n_backed_off) == (n, backed)
        assert abs(out[i].log_score - score) < 1e-9 * max(1, abs(score))


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 2)
    monkeypatch.setattr(lm, "_repeated", lambda words: np.full(1 << (lm.REPEATED_BITS - 3), 255, np.uint8))
    monkeypatch.setattr(lm, "_in_table", lambda table: np.full(1 << (lm.TABLE_BITS - 3), 255, np.uint8))
    texts = ["the cat sat on the mat", "the cat ran on", "a cat sat on a mat", "rare words only here", "rare words on a mat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r.doc_id: r for r in backoff_scores(docs).collect()}
    for i, (n, backed, score) in enumerate(plain_scores(texts, 1 << 40)):
        assert (out[i].n_words, out[i].n_backed_off) == (n, backed)
        assert abs(out[i].log_score - score) < 1e-9


def counted_scores(texts, order, shared):
    """Stupid backoff by plain counting of n-grams of any order."""
    docs = [["<", *t.lower().split()] if t.split() else [] for t in texts]
    grams = [[tuple(d[i + 1 - n : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(d))] for d in docs]
    seen = Counter(g for d in grams for g in d)
    held = Counter(g for d in grams for g in set(d))
    total = sum(len(d) - 1 for d in docs if d)

    def score(gram):
        if len(gram) == 1:
            return seen[gram] / total
        if held[gram] > shared:
            return seen[gram] / seen[gram[:-1]]
        return BACKOFF * score(gram[1:])

    def top(d, i):
        return tuple(d[max(i + 1 - order, 0) : i + 1])

    return [
        (max(len(d) - 1, 0), sum(held[top(d, i)] <= shared and order > 1 for i in range(1, len(d))), sum(math.log(score(top(d, i))) for i in range(1, len(d))))
        for d in docs
    ]


def test_backs_off_through_every_order(spark, monkeypatch):
    """From trigrams to bigrams to words, and n-grams of one document if they are asked for; in one chunk and
    part or in many."""
    rng = random.Random(7)
    texts = ["the cat sat on the mat", "on the mat the cat sat on the mat", "the cat sat still", "", "only", "the", " \n"]
    texts += [" ".join(rng.choices("abcde", k=rng.randrange(30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    for chunk, part in ((2_000_000, 4_000_000), (20, 50)):
        monkeypatch.setattr(lm, "CHUNK_WORDS", chunk)
        monkeypatch.setattr(lm, "PART_WORDS", part)
        for order, shared in ((1, True), (2, True), (3, True), (3, False), (4, True)):
            out = {r.doc_id: r for r in backoff_scores(docs, order=order, shared=shared).collect()}
            assert len(out) == len(texts)
            for i, (n, backed, score) in enumerate(counted_scores(texts, order, shared)):
                assert (out[i].n_words, out[i].n_backed_off) == (n, backed)
                assert abs(out[i].log_score - score) < 1e-9


def test_no_question_is_hot(spark, monkeypatch):
    """A bigram that every document has is asked for once by a chunk, however many documents that has."""
    texts = ["of the"] * 500 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    lines = lm.stage(lm.chunks(docs, "doc_id", "text"), "chunks")
    asked = lm.questions(lines, 2, 1).collect()
    # Twice the number, and one more for several documents.
    assert sorted((r.part, lm._unpacked(r.seen, np.int32).tolist()) for r in asked) == [(0, [1001] * 3), (1, [1001] * 2)]
