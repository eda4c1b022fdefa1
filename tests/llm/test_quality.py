import random

import numpy as np
from pyspark.sql import functions as F

from ehrseq.llm.quality import Rules, class_counts, divergence, documents_kept, duplicate_lines, each_text_once, judge, language_references, quality_rules, repeated_words

from ..conftest import SMALL
from .odd import TEXTS, odd_documents


def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})


def test_repeated_words_against_the_definition():
    rng = random.Random(2)
    for size in [*range(12), *[rng.randint(5, 60) for _ in range(200)]]:
        words = rng.choices("ab", k=size)
        assert repeated_words(words) == plain_repeats(words)


def test_duplicate_lines():
    assert duplicate_lines("a\na\n\n\n \n \nb\na") == 2
    assert duplicate_lines("") == 0


def test_class_counts_cover_every_character():
    text = "Hello, wörld 42!\n#\U0001f600\x00"
    assert class_counts(text).sum() == len(text)
    assert class_counts("").sum() == 0


def test_divergence_is_bounded_and_zero_for_equals():
    assert divergence([2, 2, 0], np.array([0.5, 0.5, 0])) == 0
    assert abs(divergence([1, 0], np.array([0.0, 1.0])) - 1) < 1e-12
    assert divergence([0, 0], np.array([0.5, 0.5])) == 0


def test_rules_tell_junk_from_prose():
    rng = random.Random(1)
    vocabulary = ["the", "of", "and", *[f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]]
    prose = lambda n: " ".join(rng.choices(vocabulary, [200, 120, 100] + [1] * 400, k=n))
    counts = np.array([10, 20, 0, 0, 10, 0, 0, 0]) / 40
    for_words = np.array([200, 120, 100, 400]) / 820
    reference = {"en": {"classes": class_counts(prose(5000)) / len(prose(5000)), "common": ["the", "of", "and"], "words": for_words}}
    reference["en"]["classes"] = reference["en"]["classes"] / reference["en"]["classes"].sum()
    assert counts.sum() == 1
    assert judge(prose(300), "en", reference, Rules())[-1]
    assert not judge(" ".join(f"#{i}%$" for i in range(300)), "en", reference, Rules())[-1]
    # Too short for either histogram: only the base rules count.
    assert judge(" ".join(f"#{i}%$" for i in range(15)), "en", reference, Rules())[-1]


def test_good_documents_are_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality_rules(docs).collect() if not r.base_failed]
    good, poor = ([r.kept for r in rows if labels.get(r.doc_id) == q] for q in (1, 0))
    assert all(good) and len(good) > 200
    assert sum(poor) < 0.5 * len(poor)


def test_references_cover_whole_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = language_references(docs)
    rows = [r for r in docs.collect() if r.lang == "de"]
    total = sum(class_counts(r.text) for r in rows)
    assert np.allclose(found["de"]["classes"], total / total.sum())
    assert len(found["de"]["common"]) == 40


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    out = quality_rules(odd)
    rows = {(r.doc_id, r.n_words): r for r in out.collect()}
    assert len(out.collect()) == len(TEXTS)
    assert rows[(1, 0)].base_failed and not rows[(1, 0)].kept
    assert rows[(7, 7)].n_dup_lines == 1
    assert rows[(4, 120_000)].n_repeat_words == 120_000
    kept = documents_kept(odd)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in out.collect() if r.kept)
    assert quality_rules(odd.limit(0)).collect() == [] == documents_kept(odd.limit(0)).collect()


def test_copies_of_a_junk_text_are_no_reference(spark):
    """A third of the rows is one text, of symbols or of words without the common ones: others stay as they were."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    before = {r.doc_id for r in documents_kept(docs).collect()}
    for junk in (" ".join(f"#{i}%$" for i in range(2_000)), " ".join(f"Wq{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(600))):
        copies = spark.range(500).select((-1 - F.col("id")).alias("doc_id"), F.lit(junk).alias("text"), F.lit("en").alias("lang"))
        after = {r.doc_id for r in documents_kept(docs.unionByName(copies)).collect() if r.doc_id >= 0}
        assert len(before - after) <= 1 and len(after - before) <= 1
    assert len(before) > 500


def test_distinct_references_bound_a_text(spark):
    long, other = " ".join(f"long{i}" for i in range(50_000)), " ".join(f"other{i}" for i in range(1_000))
    poor = "again and again " * 50
    docs = spark.createDataFrame([(t, "en") for t in (long, other, other, other, poor)], "text string, lang string")
    found = language_references(docs, distinct=True)["en"]
    assert found["common"][0].startswith("other") and "again" not in found["common"]
    assert abs(found["words"][0] - 1 / 2_000) < 1e-5


def test_only_texts_with_copies_are_moved(spark):
    texts = ["one text", "another", "one text", "a third", "one text", "another "]
    given = spark.createDataFrame([(lang, t) for lang in ("en", "fr") for t in texts] + [("en", "a third")], "lang string, text string")
    once = each_text_once(given)
    assert sorted(map(tuple, once.collect())) == sorted({(r.lang, r.text) for r in given.collect()})
    plan = once._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Union") == 1 and once.where("text = 'another'").count() == 2
    alone = plan.split("Union")[1].split("HashAggregate")[0]
    assert "isnull(_several" in alone and "BroadcastHashJoin" in alone
