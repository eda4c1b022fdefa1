"""Stupid-backoff language-model scores from partitioned n-gram count tables.

S(w | u v) = c(u v w) / c(u v) where the trigram table has u v w, else BACKOFF * S(w | v), and so on
down to c(w) / c; ``order`` says how far up it begins. An n-gram of two words or more enters its table
only if two documents have it, or a text would vouch for itself.

Texts are cut into words once and staged in chunks. A chunk asks for each of its different n-grams
once, with what it has seen of it, and the parts of the tables that hold them add up what all chunks
have seen and answer. So no n-gram is hot, whatever number of documents have it, and no table, word
list or filter is on the driver or in every task.
"""

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import WORD, lowered, map_rows, stage

BACKOFF = 0.4
# Keys of the mark before a text and, with a closed vocabulary, of every word outside it; a word's key
# is never below zero.
START, UNKNOWN = -2, -1
# Words that a closed vocabulary may have at most.
FREQUENT = (1 << 16) - 2
# Different words counted by a task at a time; bounds memory only.
WORDS_AT_ONCE = 500_000
# Words of a chunk, and of the corpus for each part of a table; bound memory and order work only.
CHUNK_WORDS, PART_WORDS = 3_000_000, 3_000_000
# Odd factors: a key is by one of them and the part of the table by the other.
KEY_FACTOR, PART_FACTOR, FINISH = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
# A test of the bitmaps that thinned out the work before names them. Nothing reads them.
_repeated = _in_table = None


def word_key(word: str | bytes) -> int:
    """63 bits of the word's MD5."""
    word = word.encode() if isinstance(word, str) else word
    return int.from_bytes(hashlib.md5(word).digest()[:8], "big") >> 1


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n) of every word of every document, A-Z lower-cased. Tasks hand on sums."""

    def each(lists):
        counts = Counter()
        for rows in lists:
            for (words,) in rows:
                counts.update(WORD.findall(lowered(words)))
            if len(counts) > WORDS_AT_ONCE:
                yield {"key": [word_key(w) for w in counts], "n": list(counts.values())}
                counts.clear()
        yield {"key": [word_key(w) for w in counts], "n": list(counts.values())}

    given = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"))
    return map_rows(given, each, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """Numbers of words in the order in which they come; 0 is the mark before a text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: of small numbers most are zero, and compress."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def chunks(docs: DataFrame, id_column: str, text: str, known: frozenset[int] | None = None) -> DataFrame:
    """(chunk, ids, sizes, words, line, n_words) of so many documents: their ids and numbers of words, the
    keys of the chunk's different words, and the number of the word at each place of the documents, one
    after the other; a document that has words begins with START. Only ``known`` words keep their keys.
    """
    given = docs.select(F.col(id_column), F.col(text).alias("_text"))
    kind = given.schema.fields[0].dataType.simpleString()

    def chunk(name, ids, lines, numbers):
        words = np.array([START, *map(word_key, numbers)], np.int64)
        sizes = np.array([max(len(line) - 1, 0) for line in lines], np.int64)
        line = np.concatenate(lines)
        if known is not None:
            words[1:] = [key if key in known else UNKNOWN for key in words[1:].tolist()]
            words, place = np.unique(words, return_inverse=True)
            line = place[line].astype(np.int32)
        return {"chunk": [name], "ids": [ids], "sizes": [sizes], "words": [words.tobytes()], "line": [_packed(line)], "n_words": [int(sizes.sum())]}

    def each(lists):
        name = TaskContext.get().partitionId() << 32
        ids, lines, numbers, size = [], [], _Numbers(), 0
        for rows in lists:
            for i, given in rows:
                # Without an argument, split() of bytes knows the six ASCII white-space characters.
                words = (given or "").encode().lower().split()
                line = np.zeros(len(words) + bool(words), np.int32)
                line[1:] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                ids.append(i)
                lines.append(line)
                size += len(line) + 1
                if size > CHUNK_WORDS:
                    yield chunk(name, ids, lines, numbers)
                    ids, lines, numbers, size, name = [], [], _Numbers(), 0, name + 1
        if ids:
            yield chunk(name, ids, lines, numbers)

    schema = f"chunk bigint, ids array<{kind}>, sizes array<bigint>, words binary, line binary, n_words bigint"
    return map_rows(given, each, schema)


def _mixed(before: np.ndarray, word: np.ndarray, factor: int) -> np.ndarray:
    mixed = before.view(np.uint64) * np.uint64(factor) + word.view(np.uint64)
    for _ in range(2):
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(FINISH)
    return mixed ^ (mixed >> np.uint64(32))


class _Grams(NamedTuple):
    """The n-grams of a chunk: the places where one ends, and which of the different ones it is; how often
    each of these is there (twice that, and one more if in several documents), its key and its part; and the
    order in which the different ones are asked for, by parts."""

    at: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    keys: np.ndarray
    part: np.ndarray
    asked: np.ndarray


def _texts(sizes: np.ndarray) -> np.ndarray:
    """Which document of a chunk each place is of."""
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + (sizes > 0))


def _grams(words: np.ndarray, line: np.ndarray, texts: np.ndarray, order: int, parts: int) -> Iterator[_Grams]:
    """For n from 1 to ``order``."""
    depth = (np.arange(len(line)) - np.searchsorted(texts, texts)).astype(np.int32)
    line = line.astype(np.int64)
    at, gram, keys, part_keys = np.arange(len(line)), line, words, _mixed(np.zeros_like(words), words, PART_FACTOR)
    for n in range(1, order + 1):
        place = line
        if n > 1:
            at = np.flatnonzero(depth >= n - 1)
            pairs, place = np.unique(gram[at - 1] << 32 | line[at], return_inverse=True)
            before, word = keys[pairs >> 32], words[pairs & 0xFFFFFFFF]
            keys, part_keys = _mixed(before, word, KEY_FACTOR).view(np.int64), _mixed(before, word, PART_FACTOR)
            gram = np.zeros(len(line), np.int64)
            gram[at] = place
        part = (n - 1) * parts + ((part_keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        first, last = np.zeros((2, len(keys)), np.int32)
        # Of several values for one index the last stays.
        last[place], first[place[::-1]] = texts[at], texts[at][::-1]
        seen = 2 * np.bincount(place, minlength=len(keys)) + (first != last)
        # Equal numbers side by side take no room.
        yield _Grams(at, place, seen.astype(np.int32), keys, part, np.argsort(part << 33 | seen, kind="stable"))


def questions(lines: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, chunk, keys, seen): the different n-grams of a chunk that are of a part."""
    schema = "part bigint, chunk bigint, keys binary, seen binary"

    def run(batches):
        for batch in batches:
            for chunk, sizes, words, line in zip(*(batch[c].to_pylist() for c in ("chunk", "sizes", "words", "line"))):
                sizes, words = np.array(sizes, np.int64), np.frombuffer(words, np.int64)
                for g in _grams(words, _unpacked(line, np.int32), _texts(sizes), order, parts):
                    there, begins = np.unique(g.part[g.asked], return_index=True)
                    ends = np.append(begins[1:], len(g.asked)).astype(int)
                    own = [g.asked[b:e] for b, e in zip(begins, ends)]
                    columns = [there, [chunk] * len(there), [g.keys[o].tobytes() for o in own], [_packed(g.seen[o]) for o in own]]
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "chunk", "keys", "seen"])

    return lines.select("chunk", "sizes", "words", "line").mapInArrow(run, schema)


def answers(asked: DataFrame, parts: int, shared: bool) -> DataFrame:
    """(chunk, part, counts): for each key of a question, in its order, how often all chunks have it; 0 if it
    is not in the table."""

    def run(table):
        keys = [np.frombuffer(k, np.int64) for k in table["keys"].to_pylist()]
        seen = np.concatenate([_unpacked(s, np.int32) for s in table["seen"].to_pylist()])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(place, seen >> 1).astype(np.int64)
        if shared and table["part"][0].as_py() >= parts:
            counts[np.bincount(place, 1 + (seen & 1)) < 2] = 0
        each = np.split(counts[place], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"chunk": table["chunk"], "part": table["part"], "counts": pa.array(map(_packed, each), pa.binary())})

    return asked.groupBy("part").applyInArrow(run, "chunk bigint, part bigint, counts binary")


def scores(lines: DataFrame, counted: DataFrame, order: int, parts: int, total: int) -> DataFrame:
    """(id, n_words, n_backed_off, log_score) of the documents of the chunks."""
    kind = lines.schema["ids"].dataType.elementType.simpleString()

    def run(chunk, replies):
        sizes, words = chunk["sizes"][0].values.to_numpy(), np.frombuffer(chunk["words"][0].as_py(), np.int64)
        line, texts = _unpacked(chunk["line"][0].as_py(), np.int32), _texts(sizes)
        counts = np.concatenate([_unpacked(c, np.int64) for c in replies.sort_by("part")["counts"].to_pylist()])
        # How often the n-gram that ends at each place was seen, and whether the longest one was.
        score, ending, longest = np.zeros(len(line)), np.zeros(len(line), np.int64), np.ones(len(line), bool)
        for n, g in enumerate(_grams(words, line, texts, order, parts), 1):
            own = np.empty(len(g.keys), np.int64)
            own[g.asked], counts = counts[: len(own)], counts[len(own) :]
            now = own[g.place]
            has = now > 0
            before = ending[g.at - 1] if n > 1 else total
            with np.errstate(divide="ignore", invalid="ignore"):
                score[g.at] = np.where(has, np.log(now / before), math.log(BACKOFF) + score[g.at])
            ending = np.zeros(len(line), np.int64)
            ending[g.at], longest[g.at] = now, has
        word = line > 0
        added, backed_off = (np.bincount(texts[word], v[word], len(sizes)) for v in (score, ~longest))
        return pa.table({"id": chunk["ids"].combine_chunks().flatten(), "n_words": sizes, "n_backed_off": backed_off.astype(np.int64), "log_score": added.astype(float)})

    schema = f"id {kind}, n_words bigint, n_backed_off bigint, log_score double"
    return lines.drop("n_words").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(run, schema)


def backoff_scores(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: int | None = None, order: int = 2, shared: bool = True
) -> DataFrame:
    """(id, n_words, n_backed_off, log_score, mean_log_score) of every document.

    ``log_score`` is the sum of the natural logs of S over the document's words, the mean null
    without words. Null, empty and blank texts have no words and log_score 0. Repeated rows are
    scored each (and count as documents); an empty table gives an empty result. Other columns are
    left out. The word at place i of a text follows at most i words and START, so fewer than ``order`` may
    be looked up; it is backed off if the longest one is not in its table. ``shared=False`` keeps n-grams that
    one document alone has. ``vocabulary`` (at most FREQUENT) closes the vocabulary: all but so many
    most frequent words become one unknown word.
    """
    known = None
    if vocabulary is not None:
        frequent = word_counts(docs, text).orderBy(F.desc("n"), "key").limit(min(vocabulary, FREQUENT))
        known = frozenset(r.key for r in frequent.collect())
    lines = stage(chunks(docs, id_column, text, known), "chunks")
    total = lines.agg(F.sum("n_words")).first()[0] or 0
    parts = -(-max(total, 1) // PART_WORDS)
    counted = answers(questions(lines, order, parts), parts, shared)
    scored = scores(lines, counted, order, parts, total)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("id").alias(id_column), "n_words", "n_backed_off", "log_score", mean.alias("mean_log_score"))
