from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from ehrseq.llm.common import stage
from ehrseq.llm.sharding import _hypergeometric, _uniform, communication_matrix, shuffle_into_shards

from .odd import odd_documents


@pytest.mark.parametrize("total, good, drawn", [(20, 7, 6), (9, 9, 4), (5, 0, 3), (12, 5, 12), (100, 50, 1)])
def test_draws_follow_the_hypergeometric_law(spark, total, good, drawn):
    n = 8_000
    value = _hypergeometric(*[F.lit(x).cast("bigint") for x in (total, good, drawn)], _uniform(F.col("id")))
    counts = Counter(r.x for r in spark.range(n).select(value.alias("x")).collect())
    for x in range(drawn + 1):
        p = comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn)
        assert abs(counts.pop(x, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-9
    assert not counts


def test_large_margins_draw_near_the_mean(spark):
    value = _hypergeometric(*[F.lit(x).cast("bigint") for x in (10**10, 10**9, 5 * 10**9)], _uniform(F.col("id")))
    drawn = [r.x for r in spark.range(20).select(value.alias("x")).collect()]
    assert len(set(drawn)) > 15
    assert all(abs(x - 5 * 10**8) < 6 * 15_000 for x in drawn)


def test_matrix_has_its_margins(spark):
    sizes = {0: 10, 1: 0, 2: 7, 5: 13, 6: 2}
    table = stage(spark.createDataFrame(list(sizes.items()), "block bigint, rows bigint"), "sizes")
    matrix = {r.block: r.seats for r in communication_matrix(table, 5, 3).collect() if sum(r.seats)}
    assert {b: sum(s) for b, s in matrix.items()} == {b: n for b, n in sizes.items() if n}
    assert [sum(s) for s in zip(*matrix.values())] == [7, 7, 6, 6, 6]
    assert all(x >= 0 for s in matrix.values() for x in s)


def places(frame, n_shards):
    rows = frame.collect()
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(n_shards)}
    assert sum(map(len, slots.values())) == len(rows)
    assert all(found == list(range(len(found))) for found in slots.values())
    sizes = [len(found) for found in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    return rows


@pytest.mark.parametrize("partitions, rows", [(1, 1), (1, 40), (7, 100), (13, 5)])
def test_every_row_gets_its_place(spark, partitions, rows):
    given = spark.range(0, rows, 1, partitions).withColumnRenamed("id", "doc_id")
    assert sorted(r.doc_id for r in places(shuffle_into_shards(given, 4), 4)) == list(range(rows))


def test_buckets_of_a_shard_join_without_gaps(spark, monkeypatch):
    monkeypatch.setattr("ehrseq.llm.sharding.ROWS_PER_BUCKET", 5)
    monkeypatch.setattr("ehrseq.llm.sharding.BLOCK_BITS", 1)
    places(shuffle_into_shards(spark.range(0, 500, 1, 9), 3), 3)


def test_places_are_uniform(spark):
    """Each row's shard over many seeds, and the order within shards."""
    firsts = Counter()
    for seed in range(12):
        rows = shuffle_into_shards(spark.range(0, 64, 1, 5), 4, seed).collect()
        firsts += Counter((r.shard, r.id < 32) for r in rows)
    assert all(60 < n < 132 for n in firsts.values())


def test_a_seed_draws_alike(spark):
    given = spark.range(0, 50, 1, 4)
    runs = [sorted(map(tuple, shuffle_into_shards(given, 4, s).collect())) for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]


def test_odd_and_empty_tables(spark):
    odd = odd_documents(spark)
    out = shuffle_into_shards(odd, 4)
    assert set(out.columns) == set(odd.columns) | {"slot"}
    places(out, 4)
    assert shuffle_into_shards(odd.limit(0), 4).collect() == []
