"""Personal data: patterns, and a trained character tagger that adds to them.

The patterns find emails, IP addresses, card numbers and phone numbers. A bidirectional LSTM with
CRF transitions is trained on windows around what they found in a bounded sample, and then reads
windows of every text. Windows overlap by half, lie on a fixed grid and are decoded one by one;
their spans are reconciled over the whole text. A span the model adds must carry the digits of its
kind, and pattern spans stay whatever the model says.
"""

import hashlib
import heapq
import re
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import edit_rows, map_rows, stage
from ehrseq.llm.tagger import Tagger, character_ids, decode, new_tagger, train

# Kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]")
# Every kind holds a digit or an at sign; windows without one hold no span.
_TRIGGER = re.compile("[0-9@]")

WINDOW, STRIDE = 128, 64
# Windows decoded together; orders work only.
WINDOWS_AT_ONCE = 256
# Bound of the labelled sample: windows per kind, and as many without any.
SAMPLE_PER_KIND = 300
OUTSIDE = "none"


def _emails(text):
    """Each at sign with the run of local characters before it; the same as searching from the left, in linear time."""
    end = at = -1
    while (at := text.find("@", start := at + 1)) >= 0:
        head = text[max(start, end, 0) : at]
        size = len(head) - len(head.rstrip(_LOCAL))
        if size and (match := _DOMAIN.match(text, at)):
            end = match.end()
            yield at - size, end


def _ips(text):
    """Every four numbers of a dotted chain."""
    for chain in _DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for first in range(0, len(parts) - 3, 4):
            four = parts[first : first + 4]
            size = len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _valid(kind: str, text: str) -> bool:
    digits = _DIGITS.sub("", text)
    if kind == "email":
        return text.count("@") == 1 and "." in text.partition("@")[2]
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return 10 <= len(digits) <= 15


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' valid matches, by start and then kind."""
    if not _TRIGGER.search(text):
        return []
    found = [(a, b, "email") for a, b in _emails(text)] + [(a, b, "ip") for a, b in _ips(text)]
    for kind, pattern in (("card", _CARD), ("phone", _PHONE)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def window_starts(text: str) -> list[int]:
    """Starts of the grid's windows that hold a trigger."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    found: dict[int, None] = {}
    for match in _TRIGGER.finditer(text):
        step = match.start() // STRIDE
        for k in (step - 1, step):
            if 0 <= k <= last:
                found[k] = None
    return [k * STRIDE for k in sorted(found)]


def _labels(spans, start: int) -> np.ndarray:
    """0 outside, 2k + 1 where a span of kind k begins, 2k + 2 where it goes on."""
    labels = np.zeros(WINDOW, np.int64)
    for a, b, kind in spans:
        if a < start + WINDOW and b > start:
            k = 2 * KINDS.index(kind)
            labels[max(a - start, 0) : b - start] = k + 2
            if a >= start:
                labels[a - start] = k + 1
    return labels


def sample_windows(docs: DataFrame, text: str = "text", per_kind: int = SAMPLE_PER_KIND) -> DataFrame:
    """Labelled windows: of each kind, and of none, those with the ``per_kind`` smallest hashes.

    Every document takes part. A task hands on no more than the bound.
    """

    def each(lists):
        kept: dict[str, list] = {}
        seen = set()
        for rows in lists:
            for (words,) in rows:
                spans = pattern_spans(words)
                for start in window_starts(words):
                    window = words[start : start + WINDOW]
                    labels = _labels(spans, start)
                    marked = int(labels.max())
                    group = KINDS[(marked - 1) // 2] if marked else OUTSIDE
                    draw = xxhash.xxh64_intdigest(window.encode()) >> 1
                    heap = kept.setdefault(group, [])
                    if (group, draw) in seen:
                        continue
                    if len(heap) < per_kind:
                        heapq.heappush(heap, (-draw, window, labels.tolist()))
                    elif -draw > heap[0][0]:
                        seen.discard((group, -heap[0][0]))
                        heapq.heapreplace(heap, (-draw, window, labels.tolist()))
                    else:
                        continue
                    seen.add((group, draw))
        out = [(group, -minus, window, labels) for group, heap in sorted(kept.items()) for minus, window, labels in sorted(heap)]
        yield dict(zip(("kind", "draw", "window", "labels"), zip(*out))) if out else {c: [] for c in ("kind", "draw", "window", "labels")}

    given = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"))
    windows = stage(map_rows(given, each, "kind string, draw bigint, window string, labels array<bigint>").distinct(), "windows")
    picked = [windows.where(F.col("kind") == kind).orderBy("draw", "window").limit(per_kind) for kind in (*KINDS, OUTSIDE)]
    return reduce(DataFrame.unionByName, picked)


def train_tagger(docs: DataFrame, text: str = "text", per_kind: int = SAMPLE_PER_KIND, steps: int = 240) -> Tagger | None:
    """A tagger trained on the driver from at most five times ``per_kind`` windows; None if no span was found."""
    sample = sorted(sample_windows(docs, text, per_kind).collect(), key=lambda r: (r.draw, r.window))
    if all(r.kind == OUTSIDE for r in sample):
        return None
    tagger = new_tagger(2 * len(KINDS) + 1)
    train(tagger, np.array([character_ids(r.window, WINDOW) for r in sample]), np.array([r.labels for r in sample]), steps)
    return tagger


def _runs(labels: np.ndarray, start: int, size: int):
    """Spans of one window's labels."""
    at, labels = 0, labels[:size].tolist()
    while at < size:
        if not labels[at]:
            at += 1
            continue
        kind, end = (labels[at] - 1) // 2, at + 1
        while end < size and labels[end] == 2 * kind + 2:
            end += 1
        yield start + at, start + end, kind
        at = end


def reconcile(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One set of disjoint spans for a text from those of its windows.

    Overlapping spans of a kind are parts of one; between kinds, the set with the most support
    (characters times windows that saw them) is chosen over the whole text.
    """
    joined: list[list[int]] = []
    for kind in sorted({s[2] for s in spans}):
        for a, b, _ in sorted(s for s in spans if s[2] == kind):
            if joined and joined[-1][2] == kind and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
                joined[-1][3] += b - a
            else:
                joined.append([a, b, kind, b - a])
    joined.sort(key=lambda s: (s[1], s[0]))
    ends = [s[1] for s in joined]
    best: list[tuple[int, tuple | None]] = [(0, None)]
    for n, (a, b, kind, weight) in enumerate(joined):
        before = np.searchsorted(ends[:n], a, "right")
        taken = best[before][0] + weight
        best.append((taken, (int(before), (a, b, kind))) if taken > best[n][0] else (best[n][0], None))
    out, n = [], len(joined)
    while n:
        if best[n][1]:
            n, span = best[n][1][0], best[n][1][1]
            out.append(span)
        else:
            n -= 1
    return out[::-1]


def tagged_spans(tagger: Tagger | None, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The model's valid spans of each whole text."""
    found: list[list] = [[] for _ in texts]
    if tagger is None:
        return found
    todo = [(n, start) for n, text in enumerate(texts) for start in window_starts(text)]
    for at in range(0, len(todo), WINDOWS_AT_ONCE):
        some = todo[at : at + WINDOWS_AT_ONCE]
        windows = [texts[n][start : start + WINDOW] for n, start in some]
        labels = decode(tagger, np.array([character_ids(w, WINDOW) for w in windows]))
        for (n, start), window, row in zip(some, windows, labels):
            found[n] += _runs(row, start, len(window))
    return [[(a, b, KINDS[k]) for a, b, k in reconcile(s) if _valid(KINDS[k], t[a:b])] for s, t in zip(found, texts)]


def all_spans(base, added) -> list[tuple[int, int, str]]:
    """Pattern spans, and the model's that overlap none of them."""
    out, n = [], 0
    reach = sorted((a, b) for a, b, _ in base)
    for a, b, kind in sorted(added):
        while n < len(reach) and reach[n][1] <= a:
            n += 1
        if not any(x < b and y > a for x, y in reach[n : n + 4]):
            out.append((a, b, kind))
    return sorted([*base, *out], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spelt(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_personal_data(docs: DataFrame, columns=("doc_id",), text: str = "text", tagger: Tagger | None | str = "train") -> DataFrame:
    """Spans of every whole text, next to ``columns``: n_email, n_ip, n_card, n_phone and base_sha256
    of the patterns' spans, ``spans`` (all, ``kind:start:end``, code points, end exclusive), and
    ``redacted``, the text with each span replaced by its kind in brackets.

    Null texts count as empty (their ``redacted`` is null). Repeated rows are read each; an empty
    table trains nothing and gives an empty result. ``columns`` must not be named like the results.
    """
    if tagger == "train":
        tagger = train_tagger(docs, text)
    names = list(columns)

    def each(lists):
        for rows in lists:
            texts = [row[-1] or "" for row in rows]
            bases = [pattern_spans(t) for t in texts]
            spans = [all_spans(base, added) for base, added in zip(bases, tagged_spans(tagger, texts))]
            out = dict(zip(names, zip(*(row[:-1] for row in rows))))
            for kind in KINDS:
                out[f"n_{kind}"] = [sum(s[2] == kind for s in base) for base in bases]
            out["base_sha256"] = [hashlib.sha256(spelt(base).encode()).hexdigest() for base in bases]
            out["spans"] = [spelt(s) for s in spans]
            out["redacted"] = [None if row[-1] is None else redact(row[-1], s) for row, s in zip(rows, spans)]
            yield out

    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    return map_rows(given, each, f"{kinds}, {counts}, base_sha256 string, spans string, redacted string")


def redact(text: str, spans) -> str:
    """The text with each span replaced; a span that begins inside an earlier one only widens it."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, kind])
    for a, b, kind in merged:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def documents_redacted(docs: DataFrame, text: str = "text", size: str | None = "n_chars", tagger: Tagger | None | str = "train") -> DataFrame:
    """The documents with personal data replaced, with all their columns.

    ``size``, where it is a column, becomes the new length of the texts that changed.
    """
    if tagger == "train":
        tagger = train_tagger(docs, text)
    sized = [size] if size in docs.columns else []

    def decide(rows):
        texts = [row[0] or "" for row in rows]
        spans = [all_spans(pattern_spans(t), added) for t, added in zip(texts, tagged_spans(tagger, texts))]
        new = {text: [redact(row[0], s) if s else row[0] for row, s in zip(rows, spans)]}
        if sized:
            new[size] = [len(t) if s else row[1] for row, t, s in zip(rows, new[text], spans)]
        return [True] * len(rows), new

    return edit_rows(docs, [text, *sized], decide)
