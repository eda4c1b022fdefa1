import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ehrseq.llm import prefix_trie
from ehrseq.llm.prefix_trie import Skeleton, conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows, group=5, most=9):
    """Node by node from dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        paths[c] = own.get(c - int(c - group * int(c / group)), [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = Counter(node[:-1] for node in members if node)
    saved, leaves = Counter(), Counter()
    for node, who in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1].encode()) if node else 0)
            leaves[node[:d]] += not children[node]
    ends = {node: ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(node)))) for node, who in members.items()}
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends[node].encode()).hexdigest())
        for node, who in members.items()
    )


def ours(spark, rows, group=5, most=9, schema=SCHEMA, **sizes):
    c = F.col("conv_id")
    count = F.crc32(F.encode(c.cast("string"), "UTF-8")) % most
    trie = conversation_trie(spark.createDataFrame(rows, schema), c - c % group, count, most - 1, **sizes)
    assert trie.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r[: len(COLUMNS)]) for r in trie.collect())


def drawn(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(words)) for c in range(convs) for t in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"paths_per_shard": 4}), (3, {"paths_per_shard": 3, "turns_per_row": 2}), (4, {"turns_per_row": 1, "paths_per_shard": 6})])
def test_equals_plain(spark, seed, sizes):
    rows = drawn(seed, 60, 7, ["a", "b", "ünï"])
    # Copies of one conversation, and a long one that another follows for a while.
    rows += [(100 + 5 * n, t, "user", "same") for n in range(25) for t in range(3)]
    rows += [(c, t, "user", f"long {t % 3}" if t < stop else f"{c}") for c, stop in ((400, 99), (405, 14), (410, 14)) for t in range(20)]
    assert ours(spark, rows, **sizes) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"),
        (1, None, None, None),
        (1, None, "user", ""),
        (1, 3, "b", "tie"),
        (1, 3, "a", "tie"),
        (1, 3, "a", "tie"),
        (7, 0, "user", "x" * 200_000),
        (5, 9, "user", "y"),
        (-3, 1, "user", "below zero"),
        (-5, 0, "user", "below zero"),
    ]
    extra = [(*r, "x", 1) for r in rows]
    wide = SCHEMA + ", depth string, leaf int"
    assert ours(spark, extra, schema=wide, turns_per_row=2) == plain(rows)
    assert ours(spark, rows, paths_per_shard=1) == plain(rows)


def test_a_conversation_may_lose_all_turns(spark):
    # 3 gets its first turns from 0, which is not there.
    assert zlib.crc32(b"3") % 9 > 1
    assert ours(spark, [(3, 0, "u", "t")]) == plain([(3, 0, "u", "t")]) == [(3, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


def test_empty(spark):
    assert ours(spark, []) == []


def test_lists_of_many_ends_are_cut(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 7)
    rows = [(5 * n, t, "user", "same") for n in range(300) for t in range(2)]
    assert ours(spark, rows, paths_per_shard=50) == plain(rows)


def test_nodes_of_two_shards_are_on_the_skeleton():
    rng = random.Random(3)
    digest = [hashlib.md5(str(n).encode()).digest() for n in range(3)]
    paths = sorted({b"".join(rng.choices(digest, k=rng.randint(1, 6))) for _ in range(200)})
    skeleton = Skeleton(sorted(rng.sample(paths, 9)))
    seen, on = {}, set()
    for path in paths:
        shard = skeleton.shard(path)
        length, splitter = skeleton.on(path, shard)
        for n in range(1, len(path) // 16 + 1):
            seen.setdefault(path[: 16 * n], set()).add(shard)
            if n <= length:
                on.add((skeleton.number(splitter, n), path[: 16 * n]))
    assert {p for p, shards in seen.items() if len(shards) > 1} <= {p for _, p in on}
    # A number names one prefix, and a prefix has one number.
    assert len(on) == len({n for n, _ in on}) == len({p for _, p in on})
