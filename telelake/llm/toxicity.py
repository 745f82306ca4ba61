"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, each with a vector in a hashed
table, so a misspelling that was never seen shares vectors with the words it resembles.
The mean over the words of a passage goes through a linear softmax; vectors and softmax
are trained together in numpy by gradient descent.

A document is scored by its passages: overlapping runs of ``passage_words`` words, each
with the mean of its words, and the document has the score of its worst passage. Mild
words spread over a long text therefore do not add up, and one insult is not diluted.

Only labelled rows train, and of these a sample of bounded size (``Settings.sample``):
rows of smallest hash of doc_id, half of them of each label where there are enough.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from telelake.llm.rows import add_struct, struct_array, texts_of


@dataclass(frozen=True)
class Settings:
    """Bounds and training parameters."""

    # Labelled documents that the model is fitted on at most, and their longest text.
    sample: int = 6000
    sample_chars: int = 20_000
    buckets: int = 1 << 16
    dim: int = 8
    min_gram: int = 3
    max_gram: int = 5
    # A longer word is cut into pieces of so many characters; each counts as a word.
    word_chars: int = 80
    passage_words: int = 12
    # Passes over the documents: as many as so many steps take, within these bounds.
    steps: int = 1200
    epochs: tuple[int, int] = (12, 30)
    # N-grams of fewer documents stay at zero and are not learned by heart.
    min_docs: int = 8
    batch: int = 64
    rate: float = 500.0
    # The softmax moves by this part of the rate of the vectors.
    softmax_rate: float = 0.002
    seed: int = 7
    threshold: float = 0.7
    # Words whose contribution a task keeps; saves work only.
    cache_words: int = 400_000


RESULT = StructType([StructField("score", DoubleType(), False), StructField("predicted", IntegerType(), False)])

# Letters and digits with the marks that stand in for letters inside words.
WORD = re.compile(r"[^\W_](?:[\w@$!*'’-]*[^\W_])?", re.UNICODE)


def words_of(text: str, settings: Settings) -> list[str]:
    """Words in lower case; the same word again and again counts once.

    Text without spaces is read in pieces, which overlap so that every n-gram is in one.
    """
    found = WORD.findall(text.lower())
    kept = [w for w, last in zip(found, ["", *found], strict=False) if w != last]
    size, step = settings.word_chars, settings.word_chars - settings.max_gram + 1
    if all(len(w) <= size for w in kept):
        return kept
    return [w[i : i + size] for w in kept for i in range(0, max(1, len(w) - size + step), step)]


def grams(word: str, settings: Settings) -> np.ndarray:
    """Buckets of a word's n-grams and of the word itself."""
    held = f"<{word}>"
    parts = [held]
    for n in range(settings.min_gram, settings.max_gram + 1):
        parts += [held[i : i + n] for i in range(len(held) - n + 1)]
    return np.array([zlib.crc32(p.encode("utf-8", "replace")) % settings.buckets for p in parts], np.int64)


@dataclass
class Model:
    """Vectors of the buckets and the softmax, reduced to one logit for each bucket.

    The softmax is linear in the mean of the vectors, so the difference of its two logits
    is a mean of one number per word; ``bucket_logit`` holds these numbers.
    """

    settings: Settings
    bucket_logit: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.bucket_logit[grams(word, self.settings)].mean())


def _starts(n: int, width: int) -> np.ndarray:
    return np.unique(np.r_[np.arange(0, max(1, n - width), width // 2), max(0, n - width)])


def passages(values: np.ndarray, width: int) -> np.ndarray:
    """Means of overlapping runs of ``width`` values, half a width apart; the last is full too.

    A text of less than half a width counts as that long, so one word alone decides little.
    """
    if len(values) <= width:
        return np.array([values.sum() / max(len(values), width // 2)])
    starts = _starts(len(values), width)
    total = np.r_[0.0, np.cumsum(values)]
    return (total[starts + width] - total[starts]) / width


def train(texts: list[str], toxic: list[int], settings: Settings) -> Model:
    """Fit on whole texts. A document is a bag of passages of which the worst one counts."""
    labels = np.array(toxic, np.float64)
    rate_toxic = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(rate_toxic / (1 - rate_toxic)))
    if not len(labels) or labels.min() == labels.max():
        return Model(settings, np.zeros(settings.buckets), prior)
    # Words as numbers, with the n-gram buckets of each in one flat array.
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t, settings)], np.int64) for t in texts]
    bags = [grams(w, settings) for w in number]
    sizes = np.array([len(b) for b in bags], np.int64)
    flat = np.concatenate(bags) if bags else np.empty(0, np.int64)
    begins = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(settings.seed)
    vectors = rng.normal(0, 0.01, (settings.buckets, settings.dim))
    softmax = rng.normal(0, 1, (2, settings.dim))
    bias = np.zeros(2)
    usable = [i for i, d in enumerate(docs) if len(d)]
    width = settings.passage_words
    # Both labels weigh alike, whatever their numbers are.
    weight = len(labels) / (2 * np.array([(labels == 0).sum(), (labels == 1).sum()]))
    least, most = settings.epochs
    epochs = min(most, max(least, settings.steps * settings.batch // max(1, len(usable))))
    # Documents of each n-gram, counted by the words that hold it.
    spread = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=len(sizes))
    rare = np.bincount(flat, np.repeat(spread, sizes), minlength=settings.buckets) < settings.min_docs
    vectors[rare] = 0
    for epoch in range(epochs):
        rate = settings.rate * (1 - epoch / epochs)
        # The worst passage of each document by the model so far, and any one of a clean
        # document, make up the epoch.
        logits = np.add.reduceat((vectors @ (softmax[1] - softmax[0]))[flat], begins) / sizes
        bags_now, kinds = [], []
        for i in usable:
            words, room = docs[i], max(0, len(docs[i]) - width)
            starts = _starts(len(words), width)
            worst = int(starts[passages(logits[words], width).argmax()])
            for start in {worst} if labels[i] else {worst, int(rng.integers(0, room + 1))}:
                bags_now.append(words[start : start + width])
                kinds.append(int(labels[i]))
        order = rng.permutation(len(bags_now))
        for batch in np.array_split(order, -(-len(order) // settings.batch)):
            lengths = np.array([len(bags_now[i]) for i in batch], np.int64)
            slot = np.repeat(np.arange(len(batch)), lengths)
            words, place = np.unique(np.concatenate([bags_now[i] for i in batch]), return_inverse=True)
            own = sizes[words]
            row = np.repeat(np.arange(len(words)), own)
            first = np.cumsum(own) - own
            bucket = flat[np.arange(len(row)) - first[row] + begins[words][row]]
            means = np.add.reduceat(vectors[bucket], first) / own[:, None]
            hidden = np.zeros((len(batch), settings.dim))
            np.add.at(hidden, slot, means[place])
            lengths = np.maximum(lengths, width // 2)
            hidden /= lengths[:, None]
            raw = hidden @ softmax.T + bias
            odds = np.exp(raw - raw.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            kind = np.array([kinds[i] for i in batch])
            odds[np.arange(len(batch)), kind] -= 1
            odds *= weight[kind][:, None]
            to_means = np.zeros_like(means)
            np.add.at(to_means, place, ((odds @ softmax) / lengths[:, None])[slot])
            touched, at = np.unique(bucket, return_inverse=True)
            to_vectors = np.zeros((len(touched), settings.dim))
            np.add.at(to_vectors, at, (to_means / own[:, None])[row])
            to_vectors[rare[touched]] = 0
            # Plain steps: what is rare moves little, so single words are not learned by heart.
            vectors[touched] -= rate * to_vectors / len(batch)
            softmax -= settings.softmax_rate * rate * (odds.T @ hidden) / len(batch)
            bias -= settings.softmax_rate * rate * odds.sum(0) / len(batch)
    return Model(settings, vectors @ (softmax[1] - softmax[0]), float(bias[1] - bias[0]))


def training_rows(
    docs: DataFrame, labels: DataFrame, train_when, settings: Settings, text: str, doc_id: str, toxic: str
) -> list:
    """The bounded sample: at most ``settings.sample`` rows of (text, toxic)."""
    known = (
        labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & train_when(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.xxhash64(F.lit(settings.seed), "doc_id"), F.col("doc_id")]
    half = settings.sample // 2
    picked = [known.where(F.col("toxic") == t).orderBy(*order).limit(half) for t in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = own.where(F.length("text").between(1, settings.sample_chars))
    # At most settings.sample rows, by the two limits above.
    rows = own.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).collect()
    return sorted(rows, key=lambda r: r.doc_id)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_when=lambda doc_id: F.lit(True),
    settings: Settings = Settings(),
    text: str = "text",
    doc_id: str = "doc_id",
    toxic: str = "toxic",
) -> Model:
    """Model from the labelled rows for which ``train_when(doc_id)`` holds.

    Several labels of one document count as toxic if one does; labels other than 0 and 1,
    null ids and empty texts are passed over. Without labels of both kinds the model knows
    the base rate only.
    """
    rows = training_rows(docs, labels, train_when, settings, text, doc_id, toxic)
    return train([r.text for r in rows], [r.toxic for r in rows], settings)


class Scorer:
    """Scores of texts, with a bounded cache of what each word contributes."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, text: str) -> float:
        model, known = self.model, self.known
        words = words_of(text, model.settings)
        if not words:
            return 0.0
        if len(known) > model.settings.cache_words:
            known.clear()
        for word in set(words).difference(known):
            known[word] = model.word(word)
        values = np.array([known[w] for w in words])
        worst = passages(values, model.settings.passage_words).max() + model.bias
        return float(1 / (1 + np.exp(-np.clip(worst, -60, 60))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: ``score`` between 0 and 1 and ``predicted`` (1 from the threshold on).

    A null or empty text, or one without a word, scores 0. Repeated rows score equal. An
    empty table stays empty. The model has a fixed size and is sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    threshold = model.settings.threshold

    def make():
        scorer = Scorer(shared.value)

        def work(texts: pa.Array) -> pa.StructArray:
            scores = [scorer.score(t) for t in texts_of(texts)]
            return struct_array(RESULT, scores, [int(s >= threshold) for s in scores])

        return work

    return add_struct(docs, out, RESULT, [text], make)
