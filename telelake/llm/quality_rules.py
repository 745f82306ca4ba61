"""Quality rules: exact counts and distribution divergence from language references.

Method: the histogram of character classes and the histogram of common words of a document
are compared with references of its language by Jensen-Shannon distance (base 2, 0 to 1).
References are means over all documents of the language that are long enough, so every
document counts alike. Short documents are spared by a minimum-length guard, and the limits
widen with the sampling errors that a document's length and a reference's number of
documents imply, so a reference of one document hardly decides and one of thousands does.

A mixture of languages is near none of them, so there is no reference of all. A document
that names no language takes the nearest reference; one whose language has no reference
is spared by a guard.

The references have one row per listed language, whatever the input; only these few rows
reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from telelake.llm.rows import add_struct, arrow_step, groups, struct_array, texts_of

# Common words of each language, in natural order.
COMMON_WORDS = {
    "de": "als an auch auf aus bei das dem den der des die durch ein eine er es für hat im in ist mit nach nicht sich sie sind über und von war werden wird zu zum zur".split(),
    "en": "a all an and are as at be but by for from has have he his in is it not of on or that the their they this to was we were which with you".split(),
    "es": "a al como con de del el en es ha la las le lo los más mi no o para pero por que se si sin sobre son su sus un una y".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les leur mais ne nous on ou par pas plus pour qu que qui sa se son sur un une".split(),
}

# Character classes in the order of the histogram.
CLASSES = (
    "ascii lower", "ascii upper", "other lower", "other upper", "digit", "white space",
    "sentence punctuation", "symbol", "beyond Latin",
)
SENTENCE = ".,;:!?'\"()-"
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_LATIN_END = 0x250
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; distances are Jensen-Shannon distances."""

    min_words: int = 20
    max_repeat_percent: int = 30
    # Distances are taken from so many words on; below, the base rules alone decide.
    guard_words: int = 20
    # Character classes this far from the reference are no prose of the language.
    char_distance: float = 0.35
    # Otherwise word distance + char_weight * character distance must not exceed
    # divergence + slack / sqrt(words): short texts differ by chance.
    char_weight: float = 0.44
    divergence: float = 0.24
    slack: float = 1.45
    # Documents from which a reference is made: so many words, and symbols no more than
    # this share of the characters.
    reference_words: int = 50
    reference_symbols: float = 0.01
    # Limits widen by this much divided by the root of a reference's documents: what few
    # documents show of a language may differ from it by chance.
    reference_slack: float = 0.5


RESULT = StructType(
    [
        StructField("n_words", LongType(), False),
        StructField("word_chars", LongType(), False),
        StructField("n_symbols", LongType(), False),
        StructField("n_dup_lines", LongType(), False),
        StructField("n_repeat_words", LongType(), False),
        StructField("base_failed", BooleanType(), False),
        StructField("char_distance", DoubleType()),
        StructField("word_distance", DoubleType()),
        StructField("kept", BooleanType(), False),
    ]
)
_SUMS = StructType(
    [
        StructField("language", StringType(), False),
        StructField("docs", LongType(), False),
        StructField("chars", ArrayType(DoubleType(), False), False),
        StructField("words", ArrayType(DoubleType(), False), False),
    ]
)


def _class_table() -> np.ndarray:
    found = np.full(_LATIN_END + 1, len(CLASSES) - 1, np.uint8)
    for code in range(_LATIN_END):
        c = chr(code)
        if c in _SPACES or c.isspace():
            kind = 5
        elif c.isdigit():
            kind = 4
        elif c.isalpha():
            kind = (0 if code < 128 else 2) + c.isupper()
        else:
            kind = 6 if c in SENTENCE else 7
        found[code] = kind
    return found


def _common_index() -> tuple[dict[bytes, int], dict[str, np.ndarray], int]:
    """Slot of each spelling of a common word, and the slots of each language."""
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    slot = {w: i for i, w in enumerate(listed)}
    spellings = {}
    for word, i in slot.items():
        for form in {word, word.capitalize(), word.upper()}:
            for mark in ("", *".,;:!?"):
                spellings[(form + mark).encode()] = i
    slots = {lang: np.array([slot[w] for w in words]) for lang, words in COMMON_WORDS.items()}
    return spellings, slots, len(listed)


class Profile:
    """Histograms and counts of one text after another."""

    def __init__(self) -> None:
        self.classes = _class_table()
        self.spellings, self.slots, self.size = _common_index()
        mix = np.random.default_rng(8).integers(1, 2**63, 2, dtype=np.int64).astype(np.uint64)
        self.factor, self.scramble = mix[0] | np.uint64(1), mix[1] | np.uint64(1)

    def chars(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        return np.bincount(self.classes[np.minimum(codes, _LATIN_END)], minlength=len(CLASSES))

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Number of each word in order of the text, and the counts of common words."""
        seen: dict[bytes, int] = {}
        numbers = np.array(
            [seen.setdefault(w, len(seen)) for w in text.encode("utf-8", "replace").split()], np.int64
        )
        common = np.zeros(self.size, np.int64)
        if len(seen):
            find = self.spellings.get
            slots = np.array([find(w, -1) for w in seen], np.int64)
            counts = np.bincount(numbers, minlength=len(seen))
            np.add.at(common, slots[slots >= 0], counts[slots >= 0])
        return numbers, common

    def repeated(self, numbers: np.ndarray) -> int:
        """Words inside windows of eight words that the text has twice or more."""
        n = len(numbers) - WINDOW + 1
        if n < 2 or numbers.max() == len(numbers) - 1:
            return 0
        with np.errstate(over="ignore"):
            mixed = (numbers.astype(np.uint64) + np.uint64(1)) * self.scramble
            mixed ^= mixed >> np.uint64(29)
            sums = np.zeros(n, np.uint64)
            for k in range(WINDOW):
                sums = sums * self.factor + mixed[k : k + n]
        order = np.argsort(sums, kind="stable")
        same = sums[order][1:] == sums[order][:-1]
        if not same.any():
            return 0
        # Equal sums are only candidates; neighbours in a run are compared word by word.
        left, right = order[:-1][same], order[1:][same]
        step = np.arange(WINDOW)
        if (numbers[left[:, None] + step] != numbers[right[:, None] + step]).any():
            windows = np.unique(numbers[np.arange(n)[:, None] + step], axis=0, return_inverse=True)[1].ravel()
            starts = np.flatnonzero(np.bincount(windows)[windows] > 1)
        else:
            starts = np.unique(np.r_[left, right])
        edge = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int]:
    """Characters in words, symbols, and lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return (
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
    )


def references(docs: DataFrame, text: str, lang: str | None, limits: Limits) -> dict[str, tuple]:
    """Per listed language: mean class and common-word histograms, and of how many documents."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, found = Profile(), {}
        for batch in batches:
            for part in groups(batch, "text"):
                for t, name in zip(texts_of(part.column("text")), part.column("lang").to_pylist(), strict=True):
                    if name not in COMMON_WORDS:
                        continue
                    numbers, common = profile.words(t)
                    symbols = sum(map(t.count, SYMBOLS))
                    if len(numbers) < limits.reference_words or symbols > limits.reference_symbols * len(t):
                        continue
                    chars = profile.chars(t)
                    own = found.setdefault(name, [0, np.zeros(len(CLASSES)), np.zeros(profile.size + 1)])
                    own[0] += 1
                    own[1] += chars / chars.sum()
                    own[2] += np.append(common, len(numbers) - common.sum()) / len(numbers)
        if found:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(found)),
                    pa.array([v[0] for v in found.values()]),
                    pa.array([v[1].tolist() for v in found.values()]),
                    pa.array([v[2].tolist() for v in found.values()]),
                ],
                names=_SUMS.names,
            )

    chosen = docs.select(
        F.col(f"`{text}`").alias("text"),
        (F.col(f"`{lang}`").cast("string") if lang else F.lit(None).cast("string")).alias("lang"),
    )
    sizes = (len(CLASSES), _common_index()[2] + 1)
    # Sums of rounded values do not depend on the order of the tasks.
    added = [
        F.array(*[F.sum(F.round(F.col(c)[i] * 2.0**30).cast("decimal(30,0)")).cast("double") for i in range(n)]).alias(c)
        for c, n in zip(("chars", "words"), sizes, strict=True)
    ]
    rows = (
        arrow_step(chosen, sums, _SUMS).groupBy("language").agg(F.sum("docs").alias("docs"), *added).collect()
    )
    found = {r.language: (np.array(r.chars), np.array(r.words), r.docs) for r in rows}
    return {k: (c / c.sum(), w / w.sum(), n) for k, (c, w, n) in found.items()}


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    p, q = p / p.sum(), q / q.sum()
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / middle), 0) + np.where(q > 0, q * np.log2(q / middle), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


def _of_language(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    own = words[slots]
    return np.append(own, words.sum() - own.sum())


def judge(
    docs: DataFrame,
    text: str = "text",
    lang: str | None = "lang",
    out: str = "quality",
    limits: Limits = Limits(),
    known: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """Add ``out``: the counts, both distances and ``kept``.

    A null or empty text has no words and fails the base rules. Distances are null where a
    guard spares the document: it is short, or its language has no reference, being
    unlisted or without documents. Where the language is null or blank the nearest of
    the references counts; if there is none, the base rules alone decide. Repeated rows get
    equal verdicts. An empty table stays empty. ``known`` takes the place of references
    learned from ``docs``.
    """
    learned = references(docs, text, lang, limits) if known is None else dict(known)
    _, slots, _ = _common_index()
    ready = {
        name: (learned[name][0], _of_language(learned[name][1], own), own, limits.reference_slack / learned[name][2] ** 0.5)
        for name, own in slots.items()
        if name in learned
    }
    every = list(ready.values())

    def make():
        profile = Profile()

        def one(t: str, name: str | None) -> tuple:
            numbers, common = profile.words(t)
            n, repeated = len(numbers), profile.repeated(numbers)
            word_chars, symbols, dup_lines = base_counts(t)
            failed = n < limits.min_words or 100 * repeated > limits.max_repeat_percent * n
            by_chars = by_words = None
            far = False
            own = ready.get(name)
            chosen = [own] if own else [] if name and name.strip() else every
            if chosen and n >= max(1, limits.guard_words):
                chars, words = profile.chars(t), np.append(common, n - common.sum())
                pairs = [(js_distance(chars, c), js_distance(_of_language(words, at), w), more) for c, w, at, more in chosen]
                by_chars, by_words, more = min(pairs, key=lambda d: d[1] + limits.char_weight * d[0] - d[2])
                allowed = limits.divergence + limits.slack / n**0.5 + more
                far = by_chars > limits.char_distance + more or by_words + limits.char_weight * by_chars > allowed
            return n, word_chars, symbols, dup_lines, repeated, failed, by_chars, by_words, not (failed or far)

        def work(texts: pa.Array, langs: pa.Array) -> pa.StructArray:
            rows = [one(t, x) for t, x in zip(texts_of(texts), langs.to_pylist(), strict=True)]
            return struct_array(RESULT, *[list(c) for c in zip(*rows, strict=True)])

        return work

    named = lang or "_lang"
    source = docs if lang else docs.withColumn(named, F.lit(None).cast("string"))
    judged = add_struct(source, out, RESULT, [text, named], make)
    return judged if lang else judged.drop(named)
