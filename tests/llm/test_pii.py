import hashlib
import random
import re

import numpy as np
import pytest

from ehrseq.llm import pii, tagger
from ehrseq.llm.pii import KINDS, all_spans, documents_redacted, find_personal_data, pattern_spans, reconcile, redact, sample_windows, spelt, window_starts

from ..conftest import SMALL
from .odd import TEXTS, odd_documents


def plain_spans(text):
    """The contract's patterns as they are written."""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    }
    found = [(m.start(), m.end(), k) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m.group())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@pytest.mark.parametrize("seed", range(20))
def test_patterns_against_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choices("ab@.-0123459+ ()%é", k=rng.randint(0, 40)))
        assert pattern_spans(text) == plain_spans(text)


def test_patterns_are_linear_in_long_runs():
    for run in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000):
        pattern_spans(run)


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(0)
    model = tagger.new_tagger(5, 3, 4)
    for name in model.__dataclass_fields__:
        setattr(model, name, getattr(model, name).astype(float))
    ids, labels = rng.integers(0, tagger.N_CHARACTERS, (3, 7)), rng.integers(0, 5, (3, 7))
    _, gradients = tagger.loss_and_gradients(model, ids, labels)
    for weights, gradient in zip(model.parameters(), gradients):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            kept, losses = weights[at], []
            for step in (1e-5, -1e-5):
                weights[at] = kept + step
                losses.append(tagger.loss_and_gradients(model, ids, labels)[0])
            weights[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-5 - gradient[at]) < 1e-5


def test_decoding_finds_the_likeliest_path():
    from itertools import product

    model = tagger.new_tagger(3, 3, 4, seed=4)
    model.transitions += np.random.default_rng(1).normal(0, 1, (3, 3)).astype(np.float32)
    ids = np.random.default_rng(2).integers(0, 99, (2, 5))
    scores, _ = tagger._forward(model, ids)
    for row, found in zip(scores, tagger.decode(model, ids)):
        value = lambda p: sum(row[t, k] for t, k in enumerate(p)) + sum(model.transitions[a, b] for a, b in zip(p, p[1:]))
        assert tuple(found) == max(product(range(3), repeat=5), key=value)


def test_windows_cover_every_trigger():
    text = "".join(random.Random(3).choices("a" * 60 + "1", k=3_000)) + "@"
    starts = window_starts(text)
    for at in (m.start() for m in re.finditer("[0-9@]", text)):
        assert any(s <= at < s + pii.WINDOW for s in starts)
    assert window_starts("no trigger") == [] and window_starts("1") == [0]


def test_reconciled_spans_are_disjoint_and_heaviest():
    assert reconcile([(0, 10, 1), (5, 20, 1), (30, 31, 0)]) == [(0, 20, 1), (30, 31, 0)]
    assert reconcile([(0, 10, 0), (0, 10, 0), (5, 18, 1)]) == [(0, 10, 0)]
    assert reconcile([]) == []


def test_added_spans_never_touch_base_spans():
    base = [(5, 10, "email"), (20, 30, "card")]
    assert all_spans(base, [(0, 5, "ip"), (9, 12, "ip"), (10, 20, "phone")]) == [(0, 5, "ip"), (5, 10, "email"), (10, 20, "phone"), (20, 30, "card")]


def test_redaction():
    assert redact("call me at x@y.z or +1", [(11, 16, "email")]) == "call me at [email] or +1"
    assert redact("abcdef", [(1, 4, "card"), (2, 5, "phone")]) == "a[card]f"


def test_held_out_windows(spark):
    """Trained on four fifths of the sampled windows, exact spans on the rest."""
    rows = sample_windows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), per_kind=150).collect()
    assert {r.kind for r in rows} == {*KINDS, "none"} and len(rows) <= 5 * 150
    rows = sorted(rows, key=lambda r: hashlib.md5(r.window.encode()).digest())
    ids = np.array([tagger.character_ids(r.window, pii.WINDOW) for r in rows])
    labels = np.array([r.labels for r in rows])
    cut = len(rows) * 4 // 5
    model = tagger.new_tagger(2 * len(KINDS) + 1)
    tagger.train(model, ids[:cut], labels[:cut], steps=200)
    right = found = given = 0
    for decoded, gold, r in zip(tagger.decode(model, ids[cut:]), labels[cut:], rows[cut:]):
        a, b = set(pii._runs(decoded, 0, len(r.window))), set(pii._runs(gold, 0, len(r.window)))
        right, found, given = right + len(a & b), found + len(a), given + len(b)
    assert right / found > 0.75 and right / given > 0.75


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in find_personal_data(docs).collect():
        base = plain_spans(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(spelt(base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in KINDS] == [sum(s[2] == k for s in base) for k in KINDS]
        assert set(spelt(base).split(",")) <= set(row.spans.split(","))


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    out = find_personal_data(odd, tagger=None).collect()
    assert len(out) == len(TEXTS)
    [row] = [r for r in out if r.doc_id == 9]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.redacted == "mail [email] call [phone] now, host [ip], card [card]."
    assert next(r for r in out if r.doc_id == 1).redacted is None
    changed = documents_redacted(odd, tagger=None)
    assert changed.schema == odd.schema and changed.count() == len(TEXTS)
    [row] = changed.where("doc_id = 9").collect()
    assert row.n_chars == len(row.text) and "[card]" in row.text
    assert find_personal_data(odd.limit(0)).collect() == [] == documents_redacted(odd.limit(0)).collect()
    # One span is enough to train on.
    assert find_personal_data(odd).count() == len(TEXTS)
