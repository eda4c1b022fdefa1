"""Ranked lexical search for many queries at once, sharing sums between them.

A query's score for a document is the sum of what each of its terms adds there, so a set of terms
that several queries hold adds the same to all of them. These sets are mined from the queries,
pair by pair, into a graph: leaves are terms, every other node is the sum of nodes below, and a
query is the sum of the few nodes that are left of it. For a batch of documents each node is
evaluated once, in the order of the graph, as a row of partial scores.

Queries are taken in blocks, so the graph, the terms and their document counts are bounded; all
documents pass for each block. A task keeps the best of each query; these meet in two steps.
"""

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ehrseq.llm.common import lowered, map_rows, stage

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Terms of queries in a block (at least one query); a block is what the driver and the tasks hold.
TERMS_PER_BLOCK = 1 << 17
# Rounds of mining, and nodes of a query that are paired at a time; order work only.
ROUNDS, PAIRED = 12, 256
# Partial scores held at a time, and candidates kept before the best are picked; bound memory only.
CELLS, CANDIDATES = 1 << 22, 200_000
# Groups of tasks whose best meet first.
SPREAD = 64


def terms(text: str | None) -> list[str]:
    """The terms of a whole text, repeats included; A-Z lower-cased and nothing else."""
    return TERM.findall(lowered(text or ""))


@dataclass
class Graph:
    """Sums of sums: ``levels`` of (nodes, their parts end to end, where each node's parts begin).

    Nodes below ``leaves`` are terms. ``roots`` has the node of each query.
    """

    leaves: int
    nodes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    roots: np.ndarray

    @property
    def parts(self) -> int:
        return sum(len(parts) for _, parts, _ in self.levels)

    def evaluate(self, values: np.ndarray) -> None:
        """Fill the rows of ``values`` (nodes by documents), whose leaves are given."""
        for nodes, parts, starts in self.levels:
            values[nodes] = np.add.reduceat(values[parts], starts, axis=0)


def _pairs(held: set[int], support: Counter):
    """Pairs of shared nodes of a query; of a query of very many, those close in number."""
    shared = sorted(n for n in held if support[n] > 1)
    for at in range(0, len(shared), PAIRED):
        yield from combinations(shared[at : at + PAIRED], 2)


def share(queries: list[list[int]], leaves: int, rounds: int = ROUNDS) -> Graph:
    """The graph of queries given as lists of different terms, none empty."""
    parts: dict[int, list[int]] = {}
    distinct = {frozenset(q): n for n, q in reversed(list(enumerate(queries)))}
    places = {q: n for n, q in enumerate(distinct)}
    sets = [set(q) for q in distinct]

    # Terms that the same queries hold are one node from the start.
    holders = defaultdict(list)
    for n, held in enumerate(sets):
        for term in held:
            holders[term].append(n)
    alike = defaultdict(list)
    for term, who in holders.items():
        if len(who) > 1:
            alike[tuple(who)].append(term)
    top = leaves
    for who, group in sorted(alike.items()):
        if len(group) > 1:
            parts[top] = sorted(group)
            for n in who:
                sets[n].difference_update(group)
                sets[n].add(top)
            top += 1

    for _ in range(rounds):
        support = Counter(n for held in sets for n in held)
        counts = Counter(pair for held in sets for pair in _pairs(held, support))
        partner, made = {}, {}
        for pair, often in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if often > 1 and not partner.keys() & pair:
                partner[pair[0]], partner[pair[1]] = pair[1], pair[0]
                made[pair] = top
                parts[top] = list(pair)
                top += 1
        if not made:
            break
        for held in sets:
            for one in sorted(held & partner.keys()):
                other = partner[one]
                if one < other and other in held:
                    held.difference_update((one, other))
                    held.add(made[one, other])

    first_query = top
    for held in sets:
        parts[top] = sorted(held)
        top += 1
    depth = dict.fromkeys(range(leaves), 0)
    for node in sorted(parts):
        depth[node] = 1 + max(depth[p] for p in parts[node])
    levels = []
    for level in range(1, max(depth.values(), default=0) + 1):
        nodes = [n for n in parts if depth[n] == level]
        sizes = [len(parts[n]) for n in nodes]
        levels.append((np.array(nodes), np.array([p for n in nodes for p in parts[n]]), np.cumsum([0, *sizes[:-1]])))
    return Graph(leaves, top, levels, np.array([first_query + places[frozenset(q)] for q in queries], np.int64))


def _blocks(queries: DataFrame, item: str, text: str):
    """Lists of (item, its different terms), as many as a block may hold."""

    def each(lists):
        for rows in lists:
            yield {"item": [r[0] for r in rows], "terms": [sorted(set(terms(r[1]))) for r in rows]}

    given = queries.select(F.col(item), F.col(text).alias("_text"))
    kind = given.schema.fields[0].dataType.simpleString()
    found = stage(map_rows(given, each, f"item {kind}, terms array<string>"), "queries")
    block, size = [], 0
    for row in found.where("size(terms) > 0").toLocalIterator():
        if block and size + len(row.terms) > TERMS_PER_BLOCK:
            yield block
            block, size = [], 0
        block.append((row["item"], row.terms))
        size += len(row.terms)
    if block:
        yield block


def _postings(docs: DataFrame, numbers: dict[str, int], id_column: str, text: str) -> DataFrame:
    """(id, n, terms, counts) of every document: its length, and which of the known terms it has how often."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def each(lists):
        of = known.value
        for rows in lists:
            ids, lengths, found, often = [], [], [], []
            for one, text in rows:
                words = terms(text)
                counts = Counter(words)
                held = counts.keys() & of.keys()
                ids.append(one)
                lengths.append(len(words))
                found.append([of[t] for t in held])
                often.append([counts[t] for t in held])
            yield {"id": ids, "n": lengths, "terms": found, "counts": often}

    given = docs.select(F.col(id_column), F.col(text).alias("_text"))
    kind = given.schema.fields[0].dataType.simpleString()
    return map_rows(given, each, f"id {kind}, n bigint, terms array<int>, counts array<int>")


class _Best:
    """The best documents of each query seen so far."""

    def __init__(self, queries: int, top: int):
        self._least, self._top = np.ones(queries, np.int64), top
        self._held, self._size = [], 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores`` of queries by documents."""
        query, doc = np.nonzero(scores >= self._least[:, None])
        if len(query):
            self._held.append((query, scores[query, doc], ids.take(pa.array(doc))))
            self._size += len(query)
            if self._size > CANDIDATES:
                self.pick()

    def pick(self):
        """(query, score, id) of the best; equal scores by id, null last."""
        if not self._held:
            return None
        query, score = (np.concatenate([h[n] for h in self._held]) for n in (0, 1))
        ids = pa.concat_arrays([h[2] for h in self._held])
        order = pc.sort_indices(
            pa.table({"query": query, "score": score, "id": ids}), [("query", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end"
        ).to_numpy()
        query, score = query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        stay = place < self._top
        full = place == self._top - 1
        self._least[query[full]] = score[full]
        query, score, ids = query[stay], score[stay], ids.take(pa.array(order[stay]))
        self._held, self._size = [(query, score, ids)], 0
        return query, score, ids


def _best(postings: DataFrame, graph: Graph, weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """(query, score, id) of the best documents of each task."""
    known = postings.sparkSession.sparkContext.broadcast((graph, weights))
    wide = max(1, CELLS // (graph.nodes + max(len(parts) for _, parts, _ in graph.levels)))
    kind = dict(postings.dtypes)["id"]
    out = postings.sparkSession.createDataFrame([], f"query int, score bigint, id {kind}").schema
    arrow = to_arrow_schema(out)

    def run(batches):
        graph, weights = known.value
        best, values = _Best(len(graph.roots), top), np.zeros((graph.nodes, wide), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, wide):
                part = batch.slice(at, wide)
                ids, n, held, often = part.columns
                sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False)
                term, tf = (c.flatten().to_numpy().astype(np.int64) for c in (held, often))
                doc = np.repeat(np.arange(part.num_rows), sizes)
                m = 50 + 50 * n.to_numpy() * documents // length
                values[: graph.leaves] = 0
                values[term, doc] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                graph.evaluate(values)
                best.add(values[graph.roots, : part.num_rows], ids)
        picked = best.pick()
        if picked:
            query, score, ids = picked
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(score, pa.int64()), ids.cast(arrow.field("id").type)], schema=arrow)

    return postings.mapInArrow(run, out)


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = 50, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, id, score) of the ``top`` documents of every query with a score above 0, all if fewer.

    A document without a term (null and empty texts) is not counted and not found, a query without
    one finds nothing. Each row is a document, and a query, of its own: repeated rows are ranked
    each. Equal scores go by id, null last. Empty tables give an empty result; other columns
    are left out; id columns named like the results are refused. A query's term weighs floor(1000 * ln((2 N + 2) / (2 df + 1))); all else is integer.
    """
    if len({id_column, item_column, "rank", "score"}) < 4:
        raise ValueError("id columns must differ and not be named like the results")
    spark = docs.sparkSession
    kinds = [dict(frame.dtypes)[c] for frame, c in ((queries, item_column), (docs, id_column))]
    result = spark.createDataFrame([], f"_item {kinds[0]}, rank int, _id {kinds[1]}, score bigint")
    for block in _blocks(queries, item_column, text):
        vocabulary = sorted({t for _, held in block for t in held})
        numbers = {t: n for n, t in enumerate(vocabulary)}
        postings = stage(_postings(docs, numbers, id_column, text), "postings")
        documents, length = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not length:
            break
        counts = np.zeros(len(vocabulary), np.int64)
        # A row per term of the block.
        for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            counts[row.term] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in counts], np.int64)
        graph = share([[numbers[t] for t in held] for _, held in block], len(vocabulary))
        found = _best(postings, graph, weights, documents, length, top).withColumn("spread", F.spark_partition_id() % SPREAD)
        order = [F.desc("score"), F.asc_nulls_last("id")]
        for keys in (["query", "spread"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        # A row per query of the block.
        items = F.broadcast(spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], f"query int, _item {kinds[0]}"))
        result = result.unionByName(stage(found.join(items, "query").select("_item", "rank", F.col("id").alias("_id"), "score"), "found"))
    return result.toDF(item_column, "rank", id_column, "score")
