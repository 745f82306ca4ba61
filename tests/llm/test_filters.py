"""Quality rules, quality classifier and toxicity."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from telelake.llm import quality_classifier, quality_rules, registry, toxicity
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def plain_counts(text: str) -> tuple:
    words, word = [], ""
    for c in text:
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def plain_distance(p: dict, q: dict) -> float:
    total = 0.0
    for a, b in ((p, q), (q, p)):
        for key, value in a.items():
            if value:
                total += value * np.log2(value / ((value + b.get(key, 0)) / 2)) / 2
    return max(total, 0.0) ** 0.5


def test_base_counts(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = registry.op10_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        wanted = plain_counts(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == wanted
        assert row.base_failed == (wanted[0] < 20 or 100 * wanted[4] > 30 * wanted[0])
        assert not (row.base_failed and row.kept)


def test_verdicts_follow_quality_labels(spark):
    rows = registry.op10_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.n_words >= 20]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_distances_by_hand(spark):
    rows = [(i, ("the cat and the dog of a town in the north, " * 3 + f"word{i} ") * 2, "en") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality_rules.judge(docs).select("text", "quality.*").collect()
    common = set(quality_rules.COMMON_WORDS["en"])

    def histograms(text):
        kinds = Counter()
        for c in text:
            kinds["lower" if "a" <= c <= "z" else "digit" if c.isdigit() else "space" if c == " " else "mark"] += 1
        words = [w.rstrip(",") for w in text.split()]
        own = Counter(w if w in common else "" for w in words)
        scale = lambda h: {k: v / sum(h.values()) for k, v in h.items()}
        return scale(kinds), scale(own)

    each = [histograms(t) for _, t, _ in rows]
    mean = [{k: sum(h[i].get(k, 0) for h in each) / len(each) for k in set().union(*[h[i] for h in each])} for i in (0, 1)]
    for row in found:
        chars, words = histograms(row.text)
        assert row.char_distance == pytest.approx(plain_distance(chars, mean[0]), abs=1e-6)
        assert row.word_distance == pytest.approx(plain_distance(words, mean[1]), abs=1e-6)


def test_texts_without_a_reference_of_their_own(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 0")
    known = quality_rules.references(docs, "text", "lang", quality_rules.Limits())
    assert set(known) == set(quality_rules.COMMON_WORDS)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "lang", "quality")
    # No language: the nearest reference, so clean text stays and junk goes.
    for none in (F.lit(None).cast("string"), F.lit(" ")):
        found = quality_rules.judge(rows.withColumn("lang", none), out="found", known=known).collect()
        good = [r.found.kept for r in found if r.quality == 1 and r.found.n_words >= 20]
        bad = [r.found.kept for r in found if r.quality == 0]
        assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    # A language of few documents has a reference with wide limits, whatever their number; an unlisted one is spared.
    good = rows.where("lang = 'de' and quality = 1")
    for count in (1, 5, 19, 20, 21):
        few = good.orderBy("doc_id").limit(count)
        mixed = rows.where("lang = 'en'").unionByName(few).unionByName(few.withColumn("lang", F.lit("nl")))
        for row in quality_rules.judge(mixed, out="found").where("lang <> 'en'").collect():
            assert row.found.kept == (not row.found.base_failed)
            assert row.lang != "nl" or row.found.char_distance is None


def test_limits_narrow_steadily_with_the_documents_of_a_reference(spark):
    chars, words = np.ones(len(quality_rules.CLASSES)), np.ones(quality_rules._common_index()[2] + 1)
    # Between the limit of a good reference and that of one document.
    docs = spark.createDataFrame([("word " * 7 + "Other, words in the text of 12 it. " * 3,)], "text string")
    kept = [
        quality_rules.judge(docs.withColumn("lang", F.lit("en")), known={"en": (chars / chars.sum(), words / words.sum(), n)}).first().quality.kept
        for n in (1, 2, 10, 10**6)
    ]
    assert kept == sorted(kept, reverse=True) and kept[-1] is False


def test_repeats_with_equal_sums():
    profile = quality_rules.Profile()
    profile.factor = np.uint64(1)  # sums of a window no longer depend on its order
    numbers = np.array([0, 1, 2, 3, 4, 5, 6, 7, 7, 6, 5, 4, 3, 2, 1, 0, 9, 9, 8])
    assert profile.repeated(numbers) == 0


def test_rules_edge_cases(spark):
    docs = cases.documents(spark)
    rows = quality_rules.judge(docs, out="_in0").collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert tuple(row["_in0"])[:5] == plain_counts(row.text or "")
    assert quality_rules.judge(cases.empty(spark)).count() == 0
    assert quality_rules.judge(docs, lang=None).columns == [*docs.columns, "quality"]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
    held = [r for r in rows if r.held_out]
    toxic = [r.predicted for r in held if r.toxic == 1]
    clean = [r.predicted for r in held if r.toxic == 0]
    assert np.mean(toxic) > 0.5 and np.mean(clean) < 0.02


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    plain = [" ".join(rng.choice(["one", "two", "tree", "house", "river", "stone"], 30)) for _ in range(200)]
    nasty = [p.replace("river", "horrible", 1) if "river" in p else p + " horrible" for p in plain]
    model = toxicity.train(plain + nasty, [0] * 200 + [1] * 200, toxicity.Settings())
    scorer = toxicity.Scorer(model)
    assert scorer.score("one two horrible tree") > 0.9 > 0.1 > scorer.score("one two stone tree")
    assert model.word("horribble") > model.word("stone") + 1 and model.word("horrib1e") > model.word("house") + 1
    assert scorer.score("") == 0.0


def test_score_by_hand(spark):
    """Scores from the logits of buckets and passages alone, over whole texts."""
    sf = "/root/testdata/sf0.001"
    docs, settings = spark.read.parquet(f"{sf}/documents.parquet"), toxicity.Settings()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    middle = "x" * 300 + "idiotmoronscum" + "y" * 300
    extra = spark.createDataFrame([(-1, middle), (-2, "a" * 5000), (-3, "漢字" * 700), (-4, "one-" * 200)], "doc_id long, text string")
    for row in toxicity.score(docs.select("doc_id", "text").unionByName(extra), model).collect():
        words = []
        for word in toxicity.WORD.findall((row.text or "").lower()):
            if not words or words[-1][0] != word:
                words.append((word, [word[i : i + 80] for i in range(0, max(1, len(word) - 4), 76)]))
        values = []
        for piece in [p for _, pieces in words for p in pieces]:
            held = f"<{piece}>"
            grams = [held] + [held[i : i + n] for n in (3, 4, 5) for i in range(len(held) - n + 1)]
            values.append(sum(model.bucket_logit[zlib.crc32(g.encode("utf-8", "replace")) % settings.buckets] for g in grams) / len(grams))
        if not values:
            assert row.toxicity.score == 0
            continue
        ends = [*range(0, max(1, len(values) - 12), 6), max(0, len(values) - 12)]
        worst = max(sum(values[i : i + 12]) / (12 if len(values) > 12 else max(len(values), 6)) for i in ends)
        assert abs(row.toxicity.score - 1 / (1 + math.exp(-worst - model.bias))) < 1e-9


def test_no_part_of_a_long_word_is_left_out():
    settings = toxicity.Settings()
    for size in (79, 80, 81, 156, 157, 400):
        word = "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(size))
        pieces = toxicity.words_of(word, settings)
        grams = {p[i : i + 5] for p in pieces for i in range(len(p) - 4)}
        assert {word[i : i + 5] for i in range(size - 4)} == grams and max(map(len, pieces)) <= 80


def test_passages_cover_every_word():
    for n in range(1, 60):
        starts = toxicity._starts(n, 12)
        assert {i for s in starts for i in range(s, min(n, s + 12))} == set(range(n))
        assert all(s + 12 <= n for s in starts) or n < 12


def test_toxicity_edge_cases(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model, out="_OUT").collect()
    assert len(rows) == docs.count() and all(0 <= r["_OUT"].score <= 1 for r in rows)
    assert all(r["_OUT"].score == 0 for r in rows if not (r.text or "").strip())
    nothing = toxicity.fit(cases.empty(spark), labels.limit(0))
    assert toxicity.score(cases.empty(spark), nothing).count() == 0
    assert len({r["toxicity"].score for r in toxicity.score(docs, nothing).where("doc_id < 3").collect()}) == 1


def test_sample_is_bounded(spark):
    docs = spark.range(200).selectExpr("id doc_id", "concat('text ', id) text")
    labels = spark.range(200).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    few = toxicity.Settings(sample=20)
    keep = lambda i: F.lit(True)
    assert len(toxicity.training_rows(docs, labels, keep, few, "text", "doc_id", "toxic")) == 20


def test_classifier_held_out(spark):
    rows = registry.op2_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.kept for r in held if r.quality == 1]) > 0.97
    assert np.mean([r.kept for r in held if r.quality == 0]) < 0.1


def test_site_rates_shrink(spark):
    """Brute force over the same evidence."""
    rows = [(i, "h1" if i < 40 else "h2" if i < 44 else f"h{i}", f"p{i % 3}", "good words " * (3 + i % 7)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, host string, path string, text string")
    model = quality_classifier.Model(np.zeros(16), np.ones(16), np.linspace(-1, 1, 16), 0.3)
    found = quality_classifier.judge(docs, model, F.col("host"), F.col("path")).collect()
    p = {r.doc_id: 1 / (1 + np.exp(-r.evidence)) for r in found}
    n, rate = len(found), sum(p.values()) / len(found)

    def strength(groups, means):
        between = sum(len(g) * (np.mean(g) - m) ** 2 for g, m in zip(groups, means, strict=True))
        chance = sum(m * (1 - m) for m in means)
        own = sum(len(g) * m * (1 - m) for g, m in zip(groups, means, strict=True))
        beyond = max(between - chance, 0) / n
        return min(max(own / n / beyond - 1, 1), 1e4) if beyond > 0 else 1e4

    hosts: dict = {}
    paths: dict = {}
    for r in found:
        hosts.setdefault(r.host, []).append(p[r.doc_id])
        paths.setdefault((r.host, r.path), []).append(p[r.doc_id])
    a = strength(hosts.values(), [rate] * len(hosts))
    drawn = {h: (sum(g) + a * rate) / (len(g) + a) for h, g in hosts.items()}
    b = strength(paths.values(), [drawn[h] for h, _ in paths])
    for r in found:
        h, g = hosts[r.host], paths[r.host, r.path]
        host_rate = (sum(h) - p[r.doc_id] + a * rate) / (len(h) - 1 + a)
        path_rate = (sum(g) - p[r.doc_id] + b * host_rate) / (len(g) - 1 + b)
        assert (r.host_rate, r.path_rate) == (pytest.approx(host_rate, abs=1e-6), pytest.approx(path_rate, abs=1e-6))


def test_classifier_edge_cases(spark):
    docs = cases.documents(spark).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.judge(docs, model, F.col("source"), F.col("lang")).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = quality_classifier.fit(cases.empty(spark), labels.limit(0))
    assert quality_classifier.judge(cases.empty(spark), none, F.col("source"), F.col("lang")).count() == 0
