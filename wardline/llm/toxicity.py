"""Counterfactual-regularised toxicity classifier.

A logistic score over words and word beginnings. For labelled sentences that name a group, the name is swapped for names of other
groups, and the squared change of the score is part of the loss, so a mention of a group by itself carries no weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bound_batches, stored, texts

#: From this score on a text is toxic.
THRESHOLD = 0.3
#: Names of groups, by kind; within a kind they are swapped for each other. A parameter of `learn`.
GROUPS = (
    ("women", "men", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous", "african", "european", "arab", "american"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals", "natives"),
    ("disabled", "blind", "deaf", "autistic", "old", "young", "elderly"),
    ("mexicans", "chinese", "indians", "russians", "germans", "french", "spaniards", "americans"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def word_features(word: str) -> list[int]:
    """64-bit names of a lower-case word and of its beginnings of 4, 5 and 6 letters."""
    f = [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]
    return [xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x in f]


def distinct_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Toxicity:
    """bias and the weight of each kept feature. A text's score is sigmoid(bias + sum over its distinct words of their weights)."""

    bias: float
    weights: dict[int, float]
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "known": {}}

    def word(self, w: str) -> float:
        got = self.known[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
        return got

    def score(self, text: str | None) -> float:
        if len(self.known) > 500_000:
            self.known.clear()
        known, z = self.known, self.bias
        for w in distinct_words(text or ""):
            v = known.get(w)
            z += self.word(w) if v is None else v
        return float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))

    def column(self, text: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series([model.score(t) for t in s], dtype="float64")

        return score(text)


def swaps(sentence: str, groups) -> list[tuple[set[str], set[str]]]:
    """For each group name in a sentence, the words that go and the words that come when it is swapped for every other of its kind."""
    words, out = distinct_words(sentence), []
    for kind in groups:
        for name in words & set(kind):
            at = kind.index(name)
            others = [kind[(at + i) % len(kind)] for i in range(1, len(kind))]
            out += [({name}, {o}) for o in others if o not in words]
    return out


def fit(x: np.ndarray, y: np.ndarray, delta: np.ndarray, l2: float = 2e-4, swap: float = 5.0, steps: int = 25) -> np.ndarray:
    """Newton steps on mean logistic loss + l2/2 |w|^2 + swap/2 mean (w.delta)^2; the last weight is the bias (not shrunk).

    x: rows of features; delta: changes of the features by counterfactual swaps. Words of the same copied passage share weight."""
    n, k = x.shape
    a = np.column_stack([x, np.ones(n)]).astype(np.float64)
    ridge = np.append(np.full(k, l2), 1e-6)
    quad = np.zeros((k + 1, k + 1))
    if len(delta):
        d = np.column_stack([delta, np.zeros(len(delta))]).astype(np.float64)
        quad = swap * d.T @ d / len(d)
    w = np.zeros(k + 1)

    def loss(w):
        z = a @ w
        return np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (ridge * w) @ w + 0.5 * w @ quad @ w

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (p - y) / n + ridge * w + quad @ w
        h = (a * (p * (1 - p))[:, None]).T @ a / n + np.diag(ridge + 1e-9) + quad
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        last, now = now, loss(w)
        if last - now < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, groups=GROUPS, max_rows: int = 8_000, max_features: int = 600, z: float = 4.0, seed: int = 9) -> Toxicity:
    """Fit on documents labelled in `labels` (doc_id, toxic 0/1). About `max_rows` of them, drawn by a hash of the id, are used: the bound of
    what is broadcast and sent to the driver. Equal texts count once. Features whose share differs between the classes by `z` standard errors
    are kept, the `max_features` strongest. Null labels and ids are left out; of several labels of one document the highest counts.
    Without both labels the score is the share of the one label, smoothed: 0.5 when there is none."""
    bound_batches(docs.sparkSession)
    rated = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = rated.count()
    part = min(1.0, max_rows / max(n, 1))
    picked = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(part * 1_000_000))
    sample = texts(docs).join(F.broadcast(picked), "doc_id").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    names = {n for kind in groups for n in kind}

    def describe(batches):
        for pdf in (b.iloc[lo:lo + 100] for b in batches for lo in range(0, len(b), 100)):
            feats, gone, come = [], [], []
            for t in pdf["text"]:
                feats.append(np.array([f for w in distinct_words(t) for f in word_features(w)], np.int64))
                pairs = [p for s in _SENTENCE.findall(t) for p in swaps(s, groups)] if names & distinct_words(t) else []
                gone.append([sorted({f for w in a for f in word_features(w)}) for a, _ in pairs])
                come.append([sorted({f for w in b for f in word_features(w)}) for _, b in pairs])
            yield pd.DataFrame({"h": pdf["h"].to_numpy(), "toxic": pdf["toxic"].to_numpy(), "feats": feats, "gone": gone, "come": come})

    rows = stored(sample.mapInPandas(describe, "h long, toxic int, feats array<long>, gone array<array<long>>, come array<array<long>>"), "toxicity-sample")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    base = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not (n0 and n1):
        return Toxicity(base, {})
    seen = rows.select("h", "toxic", F.explode(F.array_distinct("feats")).alias("f")).groupBy("f").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a + b >= 3")
    p1, p0 = F.col("a") / n1, F.col("b") / n0
    spread = (F.col("a") + F.col("b") + 1) / (n0 + n1)
    strength = (p1 - p0) / F.sqrt(spread * (1 - spread + 1e-9) * (1 / n0 + 1 / n1))
    kept = sorted(r["f"] for r in seen.select("f", strength.alias("s")).where(F.abs("s") >= z).orderBy(F.desc(F.abs("s")), "f").limit(max_features).collect())
    if not kept:
        return Toxicity(base, {})
    place = {f: i for i, f in enumerate(kept)}

    def known(batches):
        for pdf in batches:
            yield pdf.assign(feats=[[place[f] for f in x.tolist() if f in place] for x in pdf["feats"]])

    flat = rows.mapInPandas(known, rows.schema).select("toxic", "feats", "gone", "come").orderBy("h").collect()
    x, delta = np.zeros((len(flat), len(kept)), np.float32), []
    for i, r in enumerate(flat):
        np.add.at(x[i], r["feats"], 1)
        for a, b in zip(r["gone"], r["come"]):
            d = np.zeros(len(kept), np.float32)
            np.add.at(d, [place[f] for f in b if f in place], 1)
            np.add.at(d, [place[f] for f in a if f in place], -1)
            delta.append(d)
    w = fit(x, np.array([r["toxic"] for r in flat], np.float64), np.array(delta, np.float32).reshape(-1, len(kept)))
    return Toxicity(float(w[-1]), {f: float(v) for f, v in zip(kept, w[:-1]) if abs(v) > 1e-6})


def civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores under the threshold.

    Null and empty texts score like a text without known words; repeated rows stay repeated. Where the labels tell nothing (none at all, or of
    one kind only, or no word that differs) no document can be called toxic, and all stay.
    """
    model = learn(docs, labels.select("doc_id", "toxic"))
    if not model.weights:
        return docs
    return docs.where(model.column(docs["text"]) < threshold)
