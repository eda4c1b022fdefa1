"""Quality rules: repetition counts, and divergence from what documents of the language look like.

The references are counted over the whole corpus: for each language the shares of eight character
classes and of its most common words. Copies of a poor text would pull a reference to themselves, so
what filters a corpus counts each text once, and only if it passes the repetition counts. A document is compared with them by Jensen-Shannon
divergence (base 2, from 0 to 1). The bounds lie above what ordinary prose reaches, and documents
too short for a histogram are not judged by it.
"""

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ehrseq.llm.common import WORD, edit_rows, lowered, map_rows, stage
from ehrseq.operators.sizes import join_lookup
from ehrseq.staging import Staging, like_measured

SYMBOLS = "#*$%&|<>"
# Character classes, fixed values in order; what is in none of them is "other ASCII", and all else "non-ASCII".
CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\v\f\r", ".,;:!?'\"()-")
N_CLASSES = len(CLASSES) + 2
# Words counted before a task hands its counts on; bounds memory only.
WORDS_AT_ONCE = 200_000
# Bits after the point of a word's bounded count.
SHARE_BITS = 20


@dataclass(frozen=True)
class Rules:
    languages: tuple[str, ...] = ("en", "fr", "de", "es")
    common_words: int = 40
    min_words: int = 10
    max_repeat_percent: int = 20
    # Guards and bounds of the two histograms.
    class_min_characters: int = 400
    class_max_divergence: float = 0.1
    word_min_words: int = 100
    word_max_divergence: float = 0.15
    # In references of distinct texts a longer text counts as if it had so many words.
    text_share_words: int = 1_000


def _class_table():
    table = np.full(128, len(CLASSES), np.uint8)
    for number, members in enumerate(CLASSES):
        for c in members:
            table[ord(c)] = number
    return table


_TABLE = _class_table()


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ascii_codes = codes[codes < 128]
    counts = np.bincount(_TABLE[ascii_codes], minlength=N_CLASSES)
    counts[-1] = len(codes) - len(ascii_codes)
    return counts


def divergence(counts, shares) -> float:
    """Jensen-Shannon divergence of counts from shares; 0 when there is nothing to compare."""
    counts, q = np.asarray(counts, float), np.asarray(shares, float)
    if counts.sum() == 0 or q.sum() == 0:
        return 0.0
    p = counts / counts.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(terms.sum() / 2)


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of five words found twice or more, the first one included.

    Windows get numbers by pairing: two words, then two pairs, then the fifth word; equal numbers
    mean equal words.
    """
    if len(words) < 6:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0

    def pair(a, b):
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = pair(ids[:-1], ids[1:])
    four = pair(two[:-2], two[2:])
    five = pair(four[:-1], ids[4:])
    repeated = np.flatnonzero(np.bincount(five)[five] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, repeated, 1)
    np.add.at(covered, repeated + 5, -1)
    return int((np.cumsum(covered) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def word_counts(words: list[str], common: list[str]) -> list[int]:
    counts = Counter(words)
    found = [counts.get(w, 0) for w in common]
    return [*found, len(words) - sum(found)]


def base_failed(words: list[str], repeats: int, rules: Rules) -> bool:
    return len(words) < rules.min_words or 100 * repeats > rules.max_repeat_percent * len(words)


def each_text_once(given: DataFrame) -> DataFrame:
    """The distinct rows of ``given`` (no nulls), of which only those are moved that may have a copy.

    A row whose hash no other row has is distinct already. The hashes that several rows have are
    broadcast while they are few, like any lookup.
    """
    hashed = given.withColumn("_hash", F.xxhash64(*given.columns))
    several = hashed.groupBy("_hash").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_hash")
    several = Staging(given.sparkSession).measured(several, "several")
    marked = join_lookup(hashed, like_measured(several.withColumn("_several", F.lit(True)), several), "_hash", "left")
    alone, met = (marked.where(f"_several IS {what}").select(*given.columns) for what in ("NULL", "NOT NULL"))
    return alone.unionByName(met.distinct())


def language_references(docs: DataFrame, rules: Rules = Rules(), text="text", lang="lang", distinct=False) -> dict:
    """For each language with documents: its most common words and the shares of both histograms.

    Counts cover all documents of the languages, copies and poor ones too; with ``distinct`` each text
    of a language once, if the base rules pass it, its share bounded. Tasks hand on sums, not words, so a language
    with most of the rows is no hot key. What comes to the driver is bounded by the languages
    times the common words.
    """

    def count(lists):
        sums = defaultdict(Counter)

        def handed_on():
            out = [(language, word, n) for language, counts in sums.items() for word, n in counts.items()]
            sums.clear()
            return dict(zip(("lang", "word", "n"), zip(*out))) if out else {"lang": [], "word": [], "n": []}

        for rows in lists:
            for language, words in rows:
                counts, own = sums[language], Counter(WORD.findall(lowered(words)))
                if distinct and base_failed(split := WORD.findall(words), repeated_words(split), rules):
                    continue
                # A word has no white space, so these names are free.
                own.update({f" {number}": int(n) for number, n in enumerate(class_counts(words))})
                if distinct:
                    size = max(len(split), rules.text_share_words)
                    own = {word: (n * rules.text_share_words << SHARE_BITS) // size for word, n in own.items()}
                counts.update(own)
                if sum(map(len, sums.values())) > WORDS_AT_ONCE:
                    yield handed_on()
        yield handed_on()

    given = docs.where(F.col(lang).isin(*rules.languages) & F.col(text).isNotNull()).select(lang, text)
    if distinct:
        given = each_text_once(given)
    sums = map_rows(given, count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stage(sums, "word_counts")
    is_class = F.startswith("word", F.lit(" "))
    # Each task keeps its own most common words before they meet: the rank is bounded.
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = counts.where(~is_class).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.common_words)
    kept = common.unionByName(counts.where(is_class).withColumn("rank", F.lit(0)))
    totals = {r.lang: r.words for r in counts.where(~is_class).groupBy("lang").agg(F.sum("n").alias("words")).collect()}
    found: dict[str, dict] = {}
    for r in sorted(kept.collect(), key=lambda r: (r.lang, r["rank"])):
        reference = found.setdefault(r.lang, {"classes": np.zeros(N_CLASSES), "common": [], "words": []})
        if r.word.startswith(" "):
            reference["classes"][int(r.word)] = r.n
        else:
            reference["common"].append(r.word)
            reference["words"].append(r.n)
    for language, reference in found.items():
        reference["classes"] = reference["classes"] / max(reference["classes"].sum(), 1)
        rest = totals.get(language, 0) - sum(reference["words"])
        reference["words"] = np.array([*reference["words"], rest]) / max(totals.get(language, 0), 1)
    return found


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "class_divergence double, word_divergence double, kept boolean"
)


def judge(text: str | None, language: str | None, references: dict, rules: Rules) -> tuple:
    """The row of SCHEMA for one document."""
    text = text or ""
    words = WORD.findall(text)
    n, repeats = len(words), repeated_words(words)
    failed = base_failed(words, repeats, rules)
    against = [references[language]] if language in references else list(references.values())
    class_far = word_far = None
    if against and len(text) >= rules.class_min_characters:
        counts = class_counts(text)
        class_far = min(divergence(counts, r["classes"]) for r in against)
    if against and n >= rules.word_min_words:
        small = WORD.findall(lowered(text))
        word_far = min(divergence(word_counts(small, r["common"]), r["words"]) for r in against)
    far = (class_far or 0) > rules.class_max_divergence or (word_far or 0) > rules.word_max_divergence
    return (
        n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats,
        failed, class_far, word_far, not (failed or far),
    )


def quality_rules(docs: DataFrame, rules: Rules = Rules(), columns=("doc_id",), text="text", lang="lang", distinct=True) -> DataFrame:
    """Counts, divergences and verdict per document, next to the given ``columns`` of ``docs``.

    A document is compared with its own language's reference; where it names none of the rules'
    languages, with the closest. Divergences are null below the guards (characters for the
    classes, words for the words) and then don't count against it. Null texts count as empty:
    no words, so the base rules reject them. Repeated rows are judged each; an empty table gives
    no references and no rows. References are of distinct texts unless ``distinct`` is false.
    ``columns`` must not be named like the results.
    """
    references = language_references(docs, rules, text, lang, distinct)
    names = list(columns)
    results = [part.split()[0] for part in SCHEMA.split(", ")]

    def each(lists):
        for rows in lists:
            judged = [judge(row[-2], row[-1], references, rules) for row in rows]
            yield dict(zip(names, zip(*(row[:-2] for row in rows)))) | dict(zip(results, zip(*judged)))

    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-2])
    return map_rows(given, each, f"{kinds}, {SCHEMA}")


def documents_kept(docs: DataFrame, rules: Rules = Rules(), text="text", lang="lang") -> DataFrame:
    """The documents that the rules keep, with all their columns. References are of distinct texts."""
    references = language_references(docs, rules, text, lang, distinct=True)
    return edit_rows(docs, [text, lang], lambda rows: ([judge(*row, references, rules)[-1] for row in rows], {}))
