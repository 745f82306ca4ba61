"""Quality classifier with site evidence.

Method: hierarchical empirical Bayes. A logistic model gives each document its own
evidence. The evidence is summed by host and by path below the host. A host's rate of good
documents is drawn towards the rate of all documents, a path's rate towards its host's,
the more so the fewer documents there are; how strongly, is learned from the spread of
hosts, and of paths inside hosts, beyond what chance explains (method of moments). The
posterior odds of the path move the document's own odds. A document is left out of the
site sums that it is judged by.

Texts are read once. Sums are combined before the shuffle, and sites meet documents in a
narrow join that carries no texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from telelake.llm.quality_rules import Profile
from telelake.llm.rows import add_struct, store, struct_array, texts_of


@dataclass(frozen=True)
class Settings:
    # Labelled documents that the model is fitted on at most, and their longest text.
    sample: int = 6000
    sample_chars: int = 20_000
    steps: int = 400
    rate: float = 1.0
    ridge: float = 1e-3
    seed: int = 5
    # Weight of the site's odds beside the document's own.
    site_weight: float = 0.5
    # Documents below this score are not kept.
    threshold: float = 0.3


FEATURES = (
    "log words", "class shares (9)", "word length", "distinct words", "repeated words", "repeated neighbours",
    "common words", "upper words",
)
_VECTOR = StructType([StructField("logit", DoubleType(), False)])


class Evidence:
    """Features of a text; all are shares or logarithms, so length alone changes little."""

    def __init__(self) -> None:
        self.profile = Profile()

    def features(self, text: str) -> np.ndarray:
        numbers, common = self.profile.words(text)
        n = len(numbers)
        if not n:
            return np.zeros(16)
        chars = self.profile.chars(text)
        shares = chars / chars.sum()
        letters = max(1, chars[:4].sum())
        return np.concatenate(
            [
                [np.log(n)],
                np.sqrt(shares),
                [
                    (len(text) - n) / n / 10,
                    (numbers.max() + 1) / n,
                    self.profile.repeated(numbers) / n,
                    (numbers[1:] == numbers[:-1]).mean() if n > 1 else 0.0,
                    common.sum() / n,
                    (chars[1] + chars[3]) / letters,
                ],
            ]
        )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, features: np.ndarray) -> float:
        return float(np.clip((features - self.mean) / self.scale @ self.weights + self.bias, -12, 12))


def train(features: np.ndarray, good: np.ndarray, settings: Settings) -> Model:
    """Logistic regression; both kinds weigh alike. Without both kinds all logits are 0."""
    width = features.shape[1] if features.ndim == 2 and len(features) else 16
    if not len(good) or good.min() == good.max():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, scale = features.mean(0), features.std(0) + 1e-6
    x = (features - mean) / scale
    weight = np.where(good == 1, 0.5 / (good == 1).sum(), 0.5 / (good == 0).sum())
    w, b = np.zeros(width), 0.0
    for _ in range(settings.steps):
        wrong = (1 / (1 + np.exp(-(x @ w + b))) - good) * weight
        w -= settings.rate * (x.T @ wrong + settings.ridge * w)
        b -= settings.rate * wrong.sum()
    return Model(mean, scale, w, b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train_when=lambda doc_id: F.lit(True),
    settings: Settings = Settings(),
    text: str = "text",
    doc_id: str = "doc_id",
    quality: str = "quality",
) -> Model:
    """Model from a bounded sample of the labelled documents, half of each label if there are enough.

    Of several labels of a document the lowest counts. Null ids, labels other than 0 and 1,
    and empty texts are passed over.
    """
    known = (
        labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{quality}`").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & train_when(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    order = [F.xxhash64(F.lit(settings.seed), "doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("quality") == q).orderBy(*order).limit(settings.sample // 2) for q in (0, 1)]
    # At most settings.sample rows, by the two limits.
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    own = own.where(F.length("text").between(1, settings.sample_chars))
    rows = sorted(own.join(sample, "doc_id").dropDuplicates(["doc_id"]).collect(), key=lambda r: r.doc_id)
    evidence = Evidence()
    features = np.array([evidence.features(r.text) for r in rows])
    return train(features, np.array([r.quality for r in rows], np.float64), settings)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-documents of a Beta prior by moments; ``groups`` has n and total of each site."""
    # Variance of the rates beyond the sampling variance, weighted by documents.
    row = groups.agg(
        F.sum(F.col("n") * (F.col("total") / F.col("n") - mean) ** 2).alias("between"),
        F.sum(mean * (1 - mean)).alias("chance"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("own"),
    ).first()
    if not row.n or row.own is None or row.own <= 0:
        return 1.0
    beyond = max(row.between - row.chance, 0.0) / row.n
    spread = row.own / row.n
    return float(min(max(spread / beyond - 1, 1.0), 1e4)) if beyond > 0 else 1e4


def judge(
    docs: DataFrame,
    model: Model,
    host: Column,
    path: Column,
    text: str = "text",
    columns: list[str] | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """``columns`` of ``docs`` (all but the text by default) with evidence, host_rate, path_rate, score, kept.

    ``host`` and ``path`` are columns of ``docs``; a null is a host or path of its own. An
    empty or null text has evidence like a text without words. A document alone on its
    site is judged by its host, alone on its host by all. Repeated rows count each for
    itself; an empty table stays empty. Columns named like a result are replaced.
    """
    results = {"evidence", "host_rate", "path_rate", "score", "kept"}
    wanted = [c for c in docs.columns if c != text] if columns is None else columns
    names = [c for c in wanted if c.lower() not in results]
    base = docs.select(
        *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(names)],
        F.col(f"`{text}`").alias("_text"), host.alias("_host"), path.alias("_path"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        evidence = Evidence()

        def work(texts: pa.Array) -> pa.StructArray:
            return struct_array(_VECTOR, [shared.value.logit(evidence.features(t)) for t in texts_of(texts)])

        return work

    scored = add_struct(base, "_own", _VECTOR, ["_text"], make).drop("_text")
    scored = scored.withColumn("_own", F.col("_own.logit")).withColumn("_p", 1 / (1 + F.exp(-F.col("_own"))))
    scored = store(scored, "quality-evidence")

    # Rounded to fixed places, so that sums do not depend on the order of tasks.
    place = F.sum(F.col("_p").cast("decimal(18,12)")).cast("double")
    paths = store(scored.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), place.alias("total")), "quality-paths")
    hosts = paths.groupBy("_host").agg(
        F.sum("n").alias("host_n"), F.sum(F.col("total").cast("decimal(30,12)")).cast("double").alias("host_total")
    )
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum(F.col("host_total").cast("decimal(30,9)")).cast("double").alias("total")).first()
    rate = min(max(whole.total / whole.n, 1e-6), 1 - 1e-6) if whole.n else 0.5
    by_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_total").alias("total")), F.lit(rate))
    drawn = (F.col("host_total") + by_host * rate) / (F.col("host_n") + by_host)
    sites = store(
        paths.join(hosts.withColumn("host_drawn", drawn), paths["_host"].eqNullSafe(hosts["_host"])).drop(hosts["_host"]),
        "quality-sites",
    )
    by_path = _strength(sites, F.col("host_drawn"))

    own = F.col("_p")
    host_rate = (F.greatest(F.col("host_total") - own, F.lit(0.0)) + by_host * rate) / (F.col("host_n") - 1 + by_host)
    path_rate = (F.greatest(F.col("total") - own, F.lit(0.0)) + by_path * F.col("host_rate")) / (F.col("n") - 1 + by_path)
    match = scored["_host"].eqNullSafe(sites["_host"]) & scored["_path"].eqNullSafe(sites["_path"])
    joined = scored.join(sites, match).withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    safe = F.least(F.greatest(F.col("path_rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    total = F.col("_own") + settings.site_weight * (_logit(safe) - float(np.log(rate / (1 - rate))))
    score = 1 / (1 + F.exp(-total))
    return joined.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)],
        F.col("_own").alias("evidence"), "host_rate", "path_rate",
        score.alias("score"), (score >= settings.threshold).alias("kept"),
    )
