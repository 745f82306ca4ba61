"""Byte-pair encoding with word ends, and its decoding.

Method: contiguous rank array. A short word is held as an array of parts beside an array
with the rank of every adjacent pair. The smallest rank is looked for, the boundary
between its two parts is deleted, and the ranks of the neighbouring pairs are refreshed,
until no pair has a rank. Words of one length form one matrix, so a step handles all of
them at once. Long words keep a heap instead of scanning.

Every task reads the vocabulary file once. Encoded words are kept in a cache of bounded
size: it only saves work and never changes a result.
"""

from __future__ import annotations

import functools
import gc
import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from telelake.llm.rows import add_struct, struct_array, texts_of

# Words up to so many bytes are merged in matrices.
SHORT_WORD = 40
# Entries kept before a cache starts anew.
CACHE_WORDS = 500_000
_NO_RANK = np.iinfo(np.int32).max
_ID_BITS = 20
# Text of characters below U+0250 holds no combining marks and only simple case rules.
_BEYOND_PLAIN = re.compile("[\u0250-\U0010ffff]")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

ENCODED = StructType(
    [
        StructField("ids", ArrayType(IntegerType(), False), False),
        StructField("decoded", StringType(), False),
    ]
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """One vocabulary file of the ``tokenizers`` library with lower-casing and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or not suffix or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path} is not a word-end vocabulary")
        vocab = model["vocab"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.plain_pattern = regex.compile(split["pattern"]["Regex"] + "|\n")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] << _ID_BITS | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        # For repeated pairs the last rank counts, as in the library's map.
        last = np.r_[keys[order][1:] != keys[order][:-1], True]
        self.keys, self.ranks = keys[order][last], order[last].astype(np.int32)
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in (*vocab.items(), *self.special.items()):
            self.tokens[number] = token
        with open(path, encoding="utf-8") as file:
            self._source = file.read()

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self._source)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or ``_NO_RANK``."""
        wanted = left.astype(np.int64) << _ID_BITS | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], _NO_RANK)

    def pieces(self, word: str) -> list[str]:
        """Parts of a word between which nothing merges, by the library's own tables."""
        return self.pattern.findall(self._library.normalizer.normalize_str(word))

    def plain_pieces(self, words: list[bytes]) -> list[str]:
        """The same for words of characters below U+0250, with a line end after each word.

        Such text is in composed form already and has no case rules beyond one character.
        """
        return self.plain_pattern.findall((b"\n".join(words) + b"\n").decode().lower())

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit numbers, of words of one and the same length."""
        size = len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, size)
        parts = self.inner[raw]
        parts[:, -1] = self.final[raw[:, -1]]
        found: list[bytes] = [b""] * len(words)
        rows = np.arange(len(words))

        def fill(rows: np.ndarray, parts: np.ndarray) -> None:
            raw, step = parts.astype("<u4").tobytes(), 4 * parts.shape[1]
            for at, row in enumerate(rows.tolist()):
                found[row] = raw[at * step : (at + 1) * step]

        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while True:
            width = parts.shape[1]
            if width == 1:
                fill(rows, parts)
                return found
            column = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), column]
            over = least == _NO_RANK
            if over.any():
                fill(rows[over], parts[over])
                going = ~over
                rows, parts, ranks = rows[going], parts[going], ranks[going]
                column, least = column[going], least[going]
                if not len(rows):
                    return found
            each = np.arange(len(rows))
            parts[each, column] = self.merged[least]
            place = np.arange(width - 1)[None, :]
            parts = np.take_along_axis(parts, place + (place > column[:, None]), 1)
            place = place[:, :-1]
            ranks = np.take_along_axis(ranks, place + (place >= column[:, None]), 1)
            left = column > 0
            ranks[each[left], column[left] - 1] = self.rank(
                parts[each[left], column[left] - 1], parts[each[left], column[left]]
            )
            right = column < width - 2
            ranks[each[right], column[right]] = self.rank(
                parts[each[right], column[right]], parts[each[right], column[right] + 1]
            )

    @functools.cached_property
    def _pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def merge_long(self, word: bytes) -> bytes:
        """The same for one word of any length, in time n log n."""
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.final[raw[-1]])
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self._pairs.get(ids[i] << _ID_BITS | ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece."""
        found: dict[str, bytes] = {}
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "replace")
            if len(raw) > SHORT_WORD:
                found[piece] = self.merge_long(raw)
            else:
                names, raws = by_size.setdefault(len(raw), ([], []))
                names.append(piece)
                raws.append(raw)
        for names, raws in by_size.values():
            found.update(zip(names, self.merge_short(raws), strict=True))
        return found


class Encoder:
    """Encodes texts as little-endian 32-bit ids, with caches over words and their pieces."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.bpe = _load(path)
        self.cache_words = cache_words
        self.words: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        # White space ends a word in every case, so a text can be cut at it beforehand.
        split, special = [], set()
        for text in texts:
            raw = text.encode("utf-8", "replace")
            if text.isascii() or not _BEYOND_PLAIN.search(text):
                if b"<|" not in raw:
                    split.append(raw.translate(_LOWER).split())
                    continue
            # Kept apart by a leading space, which no word has.
            split.append([b" " + w for w in raw.split()])
            special.update(split[-1])
        if len(self.words) > self.cache_words:
            self.words = {}
        if len(self.known) > self.cache_words:
            self.known = {}
        new = set().union(*split).difference(self.words)
        # The many small objects made here hold no cycles.
        collecting = gc.isenabled()
        gc.disable()
        try:
            self._learn(new.difference(special), new.intersection(special))
        finally:
            if collecting:
                gc.enable()
        words = self.words
        return [b"".join([words[w] for w in s]) for s in split]

    def _learn(self, plain: set[bytes], special: set[bytes]) -> None:
        names = list(plain)
        pieces = self.bpe.plain_pieces(names)
        cut = {raw: self._with_special(raw[1:].decode()) for raw in special}
        missing = set(pieces).union(*[[p for p in c if isinstance(p, str)] for c in cut.values()])
        missing.discard("\n")
        known = self.known
        known.update(self.bpe.merge(list(missing.difference(known))))
        # Ids have a zero byte each, so this mark of four bytes occurs nowhere else.
        known["\n"] = b"\xff\xff\xff\xff"
        ids = b"".join([known[p] for p in pieces]).split(known["\n"])
        self.words.update(zip(names, ids, strict=False))
        for raw, parts in cut.items():
            self.words[raw] = b"".join([known[p] if isinstance(p, str) else p for p in parts])

    def _with_special(self, word: str) -> list:
        """Pieces of a word that may hold special tokens; those as encoded ids."""
        bpe, parts, at = self.bpe, [], 0
        for found in bpe.special_pattern.finditer(word) if bpe.special_pattern else ():
            parts += bpe.pieces(word[at : found.start()])
            parts.append(np.array([bpe.special[found[0]]], "<u4").tobytes())
            at = found.end()
        return parts + bpe.pieces(word[at:])


@functools.lru_cache(maxsize=2)
def _load(path: str) -> WordBpe:
    return WordBpe(path)


def decoder(path: str) -> Callable[[np.ndarray], str]:
    """A function from ids to text; special tokens stay and tokens are joined by a space."""
    tokens = _load(path).tokens
    return lambda ids: " ".join([tokens[i] for i in ids.tolist()])


def encode_decode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """Add ``out``: struct of ``ids`` of the whole text and the text ``decoded`` from them.

    A null or empty text has no ids and decodes to an empty text. Texts of any length are
    encoded whole; repeated rows are encoded each for itself; an empty table stays empty.
    ``path`` must be readable on every executor, like the installed libraries.
    """

    def make():
        encoder, decode = Encoder(path), decoder(path)

        def work(column: pa.Array) -> pa.StructArray:
            ids = [np.frombuffer(b, "<u4") for b in encoder.encode(texts_of(column))]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            listed = listed.cast(pa.list_(pa.field("element", pa.int32(), False)))
            return struct_array(ENCODED, listed, [decode(i) for i in ids])

        return work

    return add_struct(docs, out, ENCODED, [text], make)
