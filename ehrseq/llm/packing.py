"""Harmonic packing of tokenized documents into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: class k has those above capacity / (k + 1) and up to
capacity / k, and a sequence of class k takes exactly k pieces. Filling needs no search: a worker
keeps one open sequence per class and fills them by itself. A piece that would leave more than
``SLACK`` of its class's sequences empty is cut first at the next class's size, so sequences come
out full but for that share. What stays open at the end of a worker's rows is pooled and filled
again by fewer workers, until one task holds the rest; that rest is cut at capacity and then at
powers of two, which need no padding.
"""

import os
import re
import sys
import types
import zlib
from array import array

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import map_rows, stage

CAPACITY = 4096
# Largest share of a sequence that pieces of its class may leave empty, as 1 / SLACK.
SLACK = 64
# Tokens of pooled pieces that one task fills.
POOLED_TOKENS = 1 << 24
# Words, and pieces of words, whose ids a worker remembers; orders work only.
REMEMBERED_WORDS, REMEMBERED_PIECES = 400_000, 100_000

# Sequences handed to Spark at a time; bounds memory only.
SEQUENCES_AT_ONCE = 64

_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r]+")
# Latin letters below this lower-case one by one and are not touched by normalization.
_PLAIN_LIMIT = chr(0x180)


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordTokenizer:
    """Ids of whole texts from a vocabulary whose tokens never span white space.

    Texts are cut at white space and each different word is tokenized once; ``word_ids`` maps words
    to little-endian 32-bit ids. A special token's string in a text is that token, as in a plain call
    of the library, unless ``ordinary`` makes it text like any other.
    """

    def __init__(self, path: str, ordinary: bool = False):
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = ordinary
        special = [] if ordinary else [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        # Fixed value: the vocabulary's own pattern of pieces of a word.
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.word_ids: dict[str, bytes] = {}
        self._piece_ids: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if (known := self._piece_ids.get(piece)) is None:
            spelt = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self._letters)
            known = _bytes([t.id for t in self._model.tokenize(spelt)])
            if len(self._piece_ids) >= REMEMBERED_PIECES:
                self._piece_ids.clear()
            self._piece_ids[piece] = known
        return known

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._piece(word.lower())
        if max(word, default="") < _PLAIN_LIMIT and "İ" not in word and not self._special.search(word):
            return b"".join(map(self._piece, self._pieces.findall(word.lower())))
        return _bytes(self._tokenizer.encode(word, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        # str.split() also cuts at four control characters, which are no white space to the vocabulary.
        words = _SPACE.split(text) if _CONTROL.search(text) else text.split()
        if len(self.word_ids) >= REMEMBERED_WORDS:
            self.word_ids.clear()
        for word in set(words).difference(self.word_ids):
            self.word_ids[word] = self._word(word)
        return b"".join(map(self.word_ids.__getitem__, words))


def _bytes(ids: list[int]) -> bytes:
    """Little-endian, 32 bits each."""
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


def _tokenizer(path: str, ordinary: bool) -> WordTokenizer:
    """One tokenizer for all tasks of a worker process, so that words are remembered between tasks."""
    kept = sys.modules.setdefault("_word_tokenizers", types.ModuleType("_word_tokenizers")).__dict__
    if (path, ordinary) not in kept:
        kept[path, ordinary] = WordTokenizer(path, ordinary)
    return kept[path, ordinary]


def cut_lengths(total: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order; they fill their classes but for 1 / SLACK."""
    out = [capacity] * (total // capacity)
    left = total % capacity
    while left:
        k = capacity // left
        piece = left if (capacity - k * left) * SLACK <= capacity else capacity // (k + 1)
        out.append(piece)
        left -= piece
    return out


class _Filler:
    """The open sequences of one task. Pieces are (doc_id, start, length, doc_tokens, ids)."""

    def __init__(self, capacity: int, first_sequence: int):
        self._capacity, self._next, self._open = capacity, first_sequence, {}

    def add(self, piece):
        """Rows of the sequence that the piece completes, if it does."""
        k = self._capacity // piece[2]
        waiting = self._open.setdefault(k, [])
        waiting.append(piece)
        return self._placed(self._open.pop(k)) if len(waiting) == k else []

    def _placed(self, pieces):
        rows, offset = [], 0
        for piece in pieces:
            rows.append((*piece, self._next, offset))
            offset += piece[2]
        self._next += 1
        return rows

    def waiting(self):
        return [(*piece, None, None) for k in sorted(self._open) for piece in self._open[k]]

    def close(self):
        """Place what waits: full sequences first, then powers of two."""
        pieces = [piece for k in sorted(self._open) for piece in self._open[k]]
        left = sum(piece[2] for piece in pieces)
        room, held = 0, []
        for doc_id, start, length, doc_tokens, ids in pieces:
            at = 0
            while at < length:
                if room == 0:
                    yield from self._placed(held)
                    held, room = [], self._capacity if left >= self._capacity else 1 << (left.bit_length() - 1)
                size = min(room, length - at)
                held.append((doc_id, start + at, size, doc_tokens, ids[4 * at : 4 * (at + size)]))
                at, room, left = at + size, room - size, left - size
        yield from self._placed(held)


RESULTS = ("start", "length", "doc_tokens", "ids", "sequence_id", "offset", "ids_crc32")


def _columns(rows, id_column, digest):
    """Columns of rows; with ``digest`` a placed piece has the CRC-32 of its ids in place of them."""
    rows = [(*r[:4], None, *r[5:], zlib.crc32(r[4])) if digest and r[5] is not None else (*r, None) for r in rows]
    names = (id_column, *RESULTS)
    return dict(zip(names, zip(*rows))) if rows else {name: [] for name in names}


def _first_sequence(turn: int) -> int:
    """Sequence numbers of different turns and tasks don't meet."""
    return (turn << 56) + (TaskContext.get().partitionId() << 32)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text: str = "text",
    ordinary: bool = False,
    digest: bool = False,
) -> DataFrame:
    """Pieces of tokenized documents and their places.

    Returns, per piece: the id, start (ids of the document before it), length, doc_tokens (of the
    document, with ``end_id``), ids (little-endian, 32 bits each), sequence_id and offset (in the
    sequence, gapless from 0). Each id of each document lies in one piece. Null and empty texts
    are documents of ``end_id`` alone. Repeated rows and null ids are documents of their own; an
    empty table gives an empty result. Other columns are left out; an id column named like a result
    is refused. ``ordinary`` reads special tokens' strings as text; ``digest`` returns the unsigned
    ``ids_crc32`` in place of the ids, which then are not written but for pieces that wait.
    """
    if id_column in RESULTS:
        raise ValueError(f"the id column must not be named {id_column}")

    end = end_id.to_bytes(4, "little")

    def pieces(lists):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _tokenizer(tokenizer_path, ordinary)
        for rows in lists:
            for doc_id, words in rows:
                ids = tokenizer.ids(words or "") + end
                start = 0
                for length in cut_lengths(len(ids) // 4, capacity):
                    yield doc_id, start, length, len(ids) // 4, ids[4 * start : 4 * (start + length)]
                    start += length

    def fill(given, turn, last):
        filler = _Filler(capacity, _first_sequence(turn))
        out, size = [], 0
        for piece in given:
            out += (placed := filler.add(piece))
            size += sum(row[2] for row in placed)
            if size >= capacity * SEQUENCES_AT_ONCE:
                yield _columns(out, id_column, digest)
                out, size = [], 0
        yield _columns(out, id_column, digest)
        rest = list(filler.close() if last else filler.waiting())
        for at in range(0, len(rest), 10_000):
            yield _columns(rest[at : at + 10_000], id_column, digest)

    given = docs.select(F.col(id_column), F.col(text).alias("_text"))
    schema = (
        f"`{id_column}` {given.schema.fields[0].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, "
        "ids binary, sequence_id bigint, offset bigint, ids_crc32 bigint"
    )
    done = stage(map_rows(given, lambda lists: fill(pieces(lists), 0, False), schema), "filled_0")
    parts, turn = [done.where("sequence_id is not null")], 0
    while True:
        turn += 1
        open_pieces = done.where("sequence_id is null").drop("sequence_id", "offset", "ids_crc32")
        tokens = open_pieces.agg(F.sum("length")).first()[0] or 0
        tasks = -(-tokens // POOLED_TOKENS)
        if tasks <= 1:
            break
        done = stage(_filled_again(open_pieces.repartition(tasks), fill, turn, False, schema), f"filled_{turn}")
        parts.append(done.where("sequence_id is not null"))
    parts.append(stage(_filled_again(open_pieces.repartition(1), fill, turn, True, schema), f"filled_{turn}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("ids" if digest else "ids_crc32")


def _filled_again(open_pieces, fill, turn, last, schema):
    return map_rows(open_pieces, lambda lists: fill((row for rows in lists for row in rows), turn, last), schema)
