"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all grades and ordered thresholds t_0 < t_1 < ... A text's features are
hashed: each word, the shape of each word, the shapes of neighbouring words, and whether a word repeats the one before; a
feature's value is the square root of its share of the words, so length does not matter and a small share still shows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bound_batches

#: A text is kept where P(grade > lowest) reaches this.
KEEP = 0.4
_RUN = re.compile(r"(.)\1+")
_KINDS = re.compile(r"[A-ZÀ-ÖØ-Þ]|[^\W\d_]|\d")


def _shape(word: str) -> str:
    """Upper-case letters as A, others as a, digits as 0, the rest as it is; runs count once, but two capitals show as AA."""
    s = _KINDS.sub(lambda m: "A" if m[0].isupper() else "0" if m[0].isdigit() else "a", word[:64])
    return ("U" if s[:2] == "AA" else "") + _RUN.sub(r"\1", s)


@dataclass
class Features:
    """Texts to rows of hashed features. `dims` buckets: a quarter for shapes, a quarter for pairs of shapes, the rest for words."""

    dims: int = 2048
    seen: dict[str, tuple[int, int]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"dims": self.dims, "seen": {}}

    def _word(self, w: str) -> tuple[int, int]:
        q = self.dims // 4
        got = self.seen[w] = (zlib.crc32(_shape(w).encode()), 2 * q + zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % (2 * q))
        return got

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        q = self.dims // 4
        if len(self.seen) > 500_000:
            self.seen.clear()
        for i, t in enumerate(texts):
            words = t.split()
            if not words:
                continue
            get = self.seen.get
            code = np.array([get(w) or self._word(w) for w in words], np.int64)
            shape = code[:, 0]
            pair = (shape[:-1] * 31 + shape[1:]) % (q - 1) + 1
            same = sum(map(str.__eq__, words[1:], words[:-1]))
            counts = np.bincount(np.concatenate([shape % q, q + pair, code[:, 1]]), minlength=self.dims)
            counts[q] = same  # the first bucket of the pairs is kept for repeats
            out[i] = np.sqrt(counts / len(words))
        return out


@dataclass
class Ordinal:
    """grades (ascending), weights, thresholds (one fewer than grades)."""

    features: Features
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) per row and threshold."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -40, 40)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        g = np.array(self.grades, np.float64)
        return g[0] + tails @ np.diff(g) if len(g) else np.zeros(len(tails))

    def column(self, text: Column) -> Column:
        """struct(expected, tail): the expected grade, and P(grade > lowest grade). Null and empty texts have no features: their
        tail follows from the thresholds alone. Without any rated rows: expected null and tail 1, so nothing is rejected."""
        model = self

        @F.pandas_udf("expected double, tail double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in batches:
                parts = []
                for lo in range(0, len(s), 500):
                    t = model.tails(model.features.rows([x or "" for x in s.iloc[lo:lo + 500]]).astype(np.float64))
                    parts.append(np.column_stack([model.expected(t), t[:, 0] if t.shape[1] else np.ones(len(t))]))
                both = np.concatenate(parts) if parts else np.zeros((0, 2))
                yield pd.DataFrame({"expected": both[:, 0] if model.grades else np.full(len(both), np.nan), "tail": both[:, 1]})

        return score(text)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-5, steps: int = 300, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Nesterov steps on the mean likelihood of y (0 .. K-1). Thresholds are a first value and increments
    exp(d), so they stay ordered. Deterministic: starts at zero weights and the thresholds of the grades' shares."""
    k = int(y.max()) + 1
    share = np.array([(y > j).mean() for j in range(k - 1)])
    start = -np.log(share / (1 - share))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    w = np.zeros(x.shape[1])
    x = x.astype(np.float32)
    scale = 4.0 / max(float((x * x).sum(1).mean()), 1e-9)  # step by the curvature of the likelihood
    vw, vt = np.zeros_like(w), np.zeros_like(theta)

    def cuts(th):
        return np.cumsum(np.concatenate([th[:1], np.exp(th[1:])]))

    for i in range(steps):
        m = min(0.95, i / (i + 3.0))
        aw, at = w + m * vw, theta + m * vt
        t = cuts(at)
        z = (x @ aw.astype(np.float32)).astype(np.float64)
        tail = np.column_stack([np.ones(len(y)), 1 / (1 + np.exp(-np.clip(z[:, None] - t, -40, 40))), np.zeros(len(y))])
        rows = np.arange(len(y))
        hi, lo = tail[rows, y], tail[rows, y + 1]
        p = np.maximum(hi - lo, 1e-12)
        gh, gl = hi * (1 - hi) / p, lo * (1 - lo) / p  # d log p / d z = gh - gl
        gz = -(gh - gl) / len(y)
        gt = np.zeros(k - 1)
        np.add.at(gt, np.clip(y - 1, 0, k - 2), np.where(y > 0, gh, 0) / len(y))
        np.add.at(gt, np.clip(y, 0, k - 2), np.where(y < k - 1, -gl, 0) / len(y))
        back = np.cumsum(gt[::-1])[::-1]
        gth = np.concatenate([back[:1], back[1:] * np.exp(at[1:])])
        gw = (x.T @ gz.astype(np.float32)).astype(np.float64) + l2 * aw
        vw, vt = m * vw - rate * scale * gw, m * vt - rate * gth
        w, theta = w + vw, theta + vt
    return w, cuts(theta)


def learn(docs: DataFrame, ratings: DataFrame, max_rows: int = 4000, dims: int = 2048, seed: int = 5) -> Ordinal:
    """Fit on documents rated in `ratings` (doc_id, grade). At most about `max_rows` of them, drawn by a hash of the id, are used: the bound of
    what is broadcast and of what reaches the driver. Null grades and null ids are left out; of several ratings of one document
    the lowest counts. One grade or none: no weights, everything is expected to have that grade."""
    bound_batches(docs.sparkSession)
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = rated.count()
    part = min(1.0, max_rows / max(n, 1))
    picked = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(part * 1_000_000))
    feats = Features(dims)

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo:lo + 500]
                rows = feats.rows([t or "" for t in part["text"]])
                yield pd.DataFrame({"grade": part["grade"].to_numpy(), "x": [r.astype(np.float16).tobytes() for r in rows], "doc_id": part["doc_id"].to_numpy()})

    got = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInPandas(run, "grade int, x binary, doc_id long").toPandas()
           .sort_values(["doc_id", "grade"], kind="stable"))
    grades = sorted(set(got["grade"].tolist()))
    if len(grades) < 2:
        return Ordinal(feats, grades, np.zeros(dims), np.zeros(0))
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
    w, t = fit(x, np.searchsorted(grades, got["grade"].to_numpy()))
    return Ordinal(feats, grades, w, t)


def good(docs: DataFrame, ratings: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of `docs`, with all their columns, for which P(grade > lowest grade) reaches `keep`.

    Null and empty texts are judged like a text without words; repeated rows go or stay together. Without ratings all rows stay."""
    model = learn(docs, ratings)
    return docs.where(model.column(docs["text"])["tail"] >= keep)
